import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def files(spark):
    """Makes a files table of one repository from (path, content[, size])."""

    def make(*rows, repo="r"):
        data = [(repo, i, r[0], r[2] if len(r) > 2 else len(r[1] or ""), r[1], False, False) for i, r in enumerate(rows)]
        return spark.createDataFrame(data, "repo_id string, file_pos long, path string, size long, content string, is_binary boolean, truncated boolean")

    return make
