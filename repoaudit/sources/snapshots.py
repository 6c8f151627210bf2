"""Readers: checked-out snapshots, repository metadata, trees and advisory documents."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..catalogs import SKIP_DIRECTORIES
from ..operators import paths
from ..operators.advisories import EVENT
from ..plans.saved import saved
from .archives import glob_pattern, load_archives, opened, read_archives  # noqa: F401  archives are read from here too

FILE = "repo_id string, file_pos long, path string, size long, content string, is_binary boolean, truncated boolean"
#: bytes of files that one task reads, about
TASK_BYTES = 64 << 20


@dataclass
class Checkouts(InputPartition):
    """Folders of repositories that one task lists."""

    folders: list[str]


class CheckoutReader(DataSourceReader):
    """Lists the files of checked-out repositories in the order of a walk: a folder's files by name, then its folders by name."""

    def __init__(self, root: str, repos: str):
        self.root, self.repos = root, repos

    def partitions(self) -> list[Checkouts]:
        store, base = opened(self.root)
        wanted = glob_pattern(self.repos)
        names = sorted(f.base_name for f in store.get_file_info(fs.FileSelector(base or "/")) if f.type == fs.FileType.Directory and wanted.fullmatch(f.base_name) and not self.is_link(store, f.path))
        step = max(1, len(names) // 4096)
        return [Checkouts(names[at : at + step]) for at in range(0, len(names), step)] or [Checkouts([])]

    @staticmethod
    def is_link(store: fs.FileSystem, path: str) -> bool:
        """Links could lead out of a checkout, so they are not followed; only local file systems have them."""
        return isinstance(store, fs.LocalFileSystem) and os.path.islink(path)

    def read(self, partition: Checkouts) -> Iterator[pa.RecordBatch]:
        store, base = opened(self.root)
        skip, names = set(SKIP_DIRECTORIES), ["repo_id", "file_pos", "path", "size"]
        for repo in partition.folders:
            rows, place, left = [], 0, [f"{base}/{repo}"]
            while left:
                folder = left.pop()
                found = sorted((f for f in store.get_file_info(fs.FileSelector(folder)) if not self.is_link(store, f.path)), key=lambda f: f.base_name)
                for f in found:
                    if f.type == fs.FileType.File:
                        rows.append((repo, place, f.path[len(base) + len(repo) + 2 :], f.size))
                        place += 1
                left += [f.path for f in reversed(found) if f.type == fs.FileType.Directory and f.base_name not in skip]
                if len(rows) > 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)


class CheckoutSource(DataSource):
    """``spark.read.format("checkouts").load(root)``, with a pattern for the folders' names in option ``repos``."""

    @classmethod
    def name(cls) -> str:
        return "checkouts"

    def schema(self) -> str:
        return "repo_id string, file_pos long, path string, size long"

    def reader(self, schema) -> CheckoutReader:
        return CheckoutReader(self.options["path"], self.options.get("repos", "*"))


def read_snapshots(spark: SparkSession, root: str, repos: str = "*", max_file_size: int = 200_000) -> DataFrame:
    """``files`` of the folders under ``root`` whose names match ``repos``, one repository each. Files over the size are listed and never opened.

    Spark's own file sources leave out names that begin with a dot or an underscore, which for repositories are ``.env``, ``.github`` and ``__init__.py``. So a data source lists
    the folders, a task each, without entering vendored ones or following links, and the listing is dealt out evenly to tasks that read: a large repository is
    listed in one task and read in many.
    """
    spark.dataSource.register(CheckoutSource)
    listed = saved(spark.read.format("checkouts").option("repos", repos).load(root))
    total = listed.where(F.col("size") <= max_file_size).agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    tasks = max(spark.sparkContext.defaultParallelism, total // TASK_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened(root)
        for batch in batches:
            for at in range(0, len(batch), 32):
                part = batch.slice(at, 32)
                data = []
                for repo, path, size in zip(*(part.column(c).to_pylist() for c in ("repo_id", "path", "size"))):
                    if size > max_file_size:
                        data.append(None)
                        continue
                    try:
                        with store.open_input_stream(f"{base}/{repo}/{path}", compression=None) as stream:
                            data.append(stream.read())
                    except OSError:  # gone since it was listed, or not to be read: listed without content
                        data.append(None)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(data, pa.binary())], names=[*part.schema.names, "bytes"])

    rows = listed.repartition(tasks, "repo_id", "path").mapInArrow(run, "repo_id string, file_pos long, path string, size long, bytes binary")
    rows = paths.decode_text(paths.flag_binary(rows)).withColumn("truncated", F.col("size") > max_file_size)
    rows = rows.withColumn("is_binary", F.col("is_binary") & ~F.col("truncated")).withColumn("content", F.when(~F.col("is_binary"), F.col("content")))
    return rows.select("repo_id", "file_pos", "path", "size", "content", "is_binary", "truncated")


RAW = (
    "name string, owner struct<login:string>, html_url string, description string, default_branch string, stargazers_count bigint, forks_count bigint, "
    "subscribers_count bigint, watchers_count bigint, open_issues_count bigint, license struct<spdx_id:string>, archived boolean, pushed_at string"
)


def normalize_metadata(raw: DataFrame, column: str = "json") -> DataFrame:
    """``repos`` rows from raw repository JSON (repo_id, json)."""
    j = raw.select("repo_id", F.from_json(column, RAW).alias("j"))
    return j.select(
        "repo_id", F.coalesce(F.nullif(F.col("j.name"), F.lit("")), F.lit("unknown")).alias("name"), F.col("j.owner.login").alias("owner"), F.col("j.html_url").alias("url"), "j.description", "j.default_branch",
        F.col("j.stargazers_count").alias("stars"), F.col("j.forks_count").alias("forks"), F.coalesce(F.nullif(F.col("j.subscribers_count"), F.lit(0)), F.col("j.watchers_count")).alias("watchers"),
        F.col("j.open_issues_count").alias("open_issues"), F.col("j.license.spdx_id").alias("license"), "j.archived", "j.pushed_at", F.lit("github").alias("kind"),
    )


def tree_paths(trees: DataFrame, column: str = "json") -> DataFrame:
    """(repo_id, path, size) of the blobs of recursive tree listings (repo_id, json)."""
    entry = F.from_json(column, "struct<tree:array<struct<path:string,type:string,size:bigint>>>")
    rows = trees.select("repo_id", F.explode(entry["tree"]).alias("e"))
    return rows.where("e.type = 'blob'").select("repo_id", "e.path", "e.size")


ADVISORY = (
    "id string, summary string, details string, database_specific struct<severity:string>, affected array<struct<package:struct<ecosystem:string,name:string>,versions:array<string>,"
    f"ranges:array<struct<type:string,events:array<{EVENT}>>>>>"
)


def _affected(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(ADVISORY).json(path).select("id", "summary", "details", F.col("database_specific.severity").alias("severity_label"), F.posexplode("affected").alias("vuln_pos", "a"))
    return rows.select(F.col("id").alias("vuln_id"), "summary", "details", "severity_label", F.col("a.package.ecosystem").alias("ecosystem"), F.col("a.package.name").alias("name"), "vuln_pos", "a")


def read_advisories(spark: SparkSession, path: str) -> DataFrame:
    """(vuln_id, summary, details, severity_label, ecosystem, name, version, vuln_pos) from advisory JSON documents, a row for each version that they list.

    Documents that give ranges have their rows in ``read_advisory_ranges``; the two together are what ``match_advisories`` takes.
    """
    return _affected(spark, path).select("vuln_id", "summary", "details", "severity_label", "ecosystem", "name", F.explode("a.versions").alias("version"), "vuln_pos")


def read_advisory_ranges(spark: SparkSession, path: str) -> DataFrame:
    """(vuln_id, vuln_pos, ecosystem, name, range_type, events): a row for each range of advisory JSON documents."""
    rows = _affected(spark, path).select("vuln_id", "vuln_pos", "ecosystem", "name", F.explode("a.ranges").alias("r"))
    return rows.select("vuln_id", "vuln_pos", "ecosystem", "name", F.col("r.type").alias("range_type"), F.col("r.events").alias("events"))


def read_advisory_details(spark: SparkSession, path: str) -> DataFrame:
    """(vuln_id, summary, details, severity_label): one row a document, whether it lists versions or ranges."""
    return spark.read.schema(ADVISORY).json(path).select(F.col("id").alias("vuln_id"), "summary", "details", F.col("database_specific.severity").alias("severity_label")).dropDuplicates(["vuln_id"])
