"""Projections, filters and predicates over repository files (repo_id, file_pos, path, size, content, is_binary, truncated)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalogs import ACTIONS_PREFIX, BINARY_EXTENSIONS, CURATED_FILES, DEEP_SUFFIXES, SKIP_DIRECTORIES
from ..functions import text as X

MARKER = "audit"


def with_path_parts(files: DataFrame) -> DataFrame:
    """Adds ``name`` and ``suffix``."""
    return files.withColumn("name", X.basename()).withColumn("suffix", X.suffix())


def prune_skip_dirs(files: DataFrame) -> DataFrame:
    """Drops files below a vendored or build directory."""
    parents = F.expr("slice(split(path, '/'), 1, size(split(path, '/')) - 1)")
    return files.where(~F.arrays_overlap(parents, F.array(*map(F.lit, SKIP_DIRECTORIES))))


def flag_binary(files: DataFrame) -> DataFrame:
    """Sets ``is_binary`` by suffix or a NUL among the first 1024 of ``bytes``."""
    head = F.decode(F.substring("bytes", 1, 1024), "ISO-8859-1")
    return files.withColumn("is_binary", X.suffix().isin(*BINARY_EXTENSIONS) | F.coalesce(F.instr(head, "\x00") > 0, F.lit(False)))


def flag_truncated(files: DataFrame, max_file_size: int = 200_000) -> DataFrame:
    """Files over the size keep their row and lose their content."""
    big = F.coalesce(F.col("size") > max_file_size, F.lit(False))
    return files.withColumn("truncated", big).withColumn("content", F.when(~big, F.col("content")))


def decode_text(files: DataFrame) -> DataFrame:
    """``content`` from ``bytes``, with U+FFFD for invalid UTF-8."""
    return files.withColumn("content", F.expr("make_valid_utf8(cast(bytes AS string))"))


def cap_files(files: DataFrame, max_files: int | None = 500) -> DataFrame:
    """The first ``max_files`` files of each repository, with ``total_seen`` and ``cap_reached``.

    Ranks and counts run over ids only; contents are joined back by (repo_id, file_pos) and never sorted.
    """
    totals = files.groupBy("repo_id").agg(F.count("*").alias("total_seen"))
    if max_files is None:
        return files.join(totals, "repo_id").withColumn("cap_reached", F.lit(False))
    place = F.row_number().over(Window.partitionBy("repo_id").orderBy("file_pos"))
    first = files.select("repo_id", "file_pos").withColumn("place", place).where(F.col("place") <= max_files)
    kept = first.drop("place").join(totals, "repo_id").withColumn("cap_reached", F.col("total_seen") > max_files)
    return files.join(kept, ["repo_id", "file_pos"])


def select_curated(tree: DataFrame, deep: bool = False) -> DataFrame:
    """Paths of a tree (repo_id, path) worth fetching, with ``intended``, their number in the repository."""
    want = F.col("path").isin(*CURATED_FILES) | F.col("path").startswith(ACTIONS_PREFIX)
    if deep:
        want = want | F.col("path").rlike("(?:" + "|".join("\\" + s for s in DEEP_SUFFIXES) + r")\z")
    chosen = tree.where(want).select("repo_id", "path").distinct()
    return chosen.join(chosen.groupBy("repo_id").agg(F.count("*").alias("intended")), "repo_id")


def scannable(files: DataFrame) -> DataFrame:
    return files.where("content IS NOT NULL AND content <> '' AND NOT is_binary AND NOT truncated")


def drop_ignored_files(files: DataFrame, marker: str = MARKER) -> DataFrame:
    """Drops files with an ``ignore-file`` marker in the first 20 lines."""
    head = F.array_join(F.slice(F.split("content", X.BREAK, -1), 1, 20), "\n")
    return files.where(~head.rlike(rf"(?dU){marker}:\s*ignore-file"))


def parse_targets(df: DataFrame, column: str = "target") -> DataFrame:
    """Adds owner, repo and error for URLs, ``git@host:owner/repo`` and ``owner/repo`` slugs."""
    value = F.trim(F.col(column))
    is_url, is_git = value.rlike("^https?://"), value.startswith("git@")
    host = F.regexp_extract(value, r"^https?://([^/?#]*)", 1)
    slug = F.when(is_git, F.substring_index(F.regexp_replace(value, "^[^:]*:", ""), "\x00", 1)).when(is_url, F.regexp_extract(value, r"^https?://[^/?#]*/*([^?#]*)", 1)).otherwise(value)
    pattern = r"^([A-Za-z0-9_.\-]+)/([A-Za-z0-9_.\-]+?)(?:\.git)?$"
    owner, repo = F.regexp_extract(slug, pattern, 1), F.regexp_extract(slug, pattern, 2)
    error = (
        F.when(is_url & ~F.contains(host, F.lit("github.com")), F.concat(F.lit("unsupported host: "), host))
        .when(owner == "", F.lit("not a repository reference"))
    )
    return df.withColumn("error", error).withColumn("owner", F.when(error.isNull(), owner)).withColumn("repo", F.when(error.isNull(), repo))
