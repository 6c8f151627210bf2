"""Results that several later steps read, written once to a folder that the whole cluster shares."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, ``spark.checkpoint.dir``.

    Where the session names none, a local folder is set if Spark runs in this one process (tests); on a cluster that is an error, as executors
    would write where neither the driver nor other executors can read.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or os.path.join(tempfile.gettempdir(), "checkpoints"))
    return context.getCheckpointDir()


#: with this set, the shuffle files of a query that is made meanwhile go as soon as it has ended
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries made and run in here leave no shuffle files. A DataFrame made before keeps what held then, so it has to be selected from anew."""
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN, before)


def saved(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder, so a lost executor costs no recomputation.

    The shuffle files behind it are not needed any more and go at once, rather than when the driver happens to collect its garbage.
    """
    shared_folder(df.sparkSession)
    with _dropping_shuffles(df.sparkSession):
        return df.select("*").checkpoint()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A function that writes a DataFrame as Parquet to the shared folder and reads it again. What it wrote is deleted at the end, so save before then what is made of it.

    Such a copy takes half the disk of a checkpoint, which also stays until the driver happens to collect its garbage.
    """
    folder = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"

    def write(df: DataFrame) -> DataFrame:
        path = f"{folder}/{uuid.uuid4().hex}"
        with _dropping_shuffles(spark):
            df.select("*").write.option("compression", "zstd").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield write
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def first_row(df: DataFrame) -> Row | None:
    """The first row of ``df``, whose shuffle files go at once."""
    with _dropping_shuffles(df.sparkSession):
        return df.first()


def counted(df: DataFrame) -> int:
    """The count of ``df``, whose shuffle files go at once."""
    with _dropping_shuffles(df.sparkSession):
        return df.count()


def broadcast_if(df: DataFrame, rows: int, most: int) -> DataFrame:
    """``df`` marked for broadcast if its counted ``rows`` are at most ``most``, else as it is, for a shuffled join."""
    return F.broadcast(df) if rows <= most else df


def ranked(df: DataFrame, group: str, order: list[Column | str], name: str = "place") -> DataFrame:
    """``df`` with ``name``, the place from 1 of each row in its ``group`` by ``order``, in which no two rows are alike.

    A window would take each group in one task. Here the rows are dealt out in ranges of (group, order), as even for one large group as for many small ones. A row's place is its
    place in its range's share of the group and the number of the group's rows in earlier ranges; these numbers are one row a group and range.
    """
    dealt = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    dealt = saved(dealt.withColumn("of_range", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
    shares = dealt.groupBy(group, "of_range").agg(F.min("at").alias("first_at"), F.count("*").alias("n"))
    earlier = Window.partitionBy(group).orderBy("of_range").rowsBetween(Window.unboundedPreceding, -1)
    shares = shares.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    return dealt.join(shares, [group, "of_range"]).withColumn(name, F.col("at") - F.col("first_at") + F.col("before") + 1).drop("of_range", "at", "first_at", "before")
