"""Gzipped tar archives as ``files`` rows, streamed member by member.

``archives`` is a Spark data source: the driver lists the archives, each task opens its own as a stream from their storage and sends members on in bounded
Arrow batches. So an archive of any size takes the memory of its largest inspected member, and none stands in a row. ``read_archives`` does the same for archives that
are landed in a table.

The archive's root folder is stripped, vendored folders are dropped, members over ``max_file_size`` are listed and never read, and those beyond ``max_files`` are only counted
(``beyond_cap``). An archive that breaks gives the members before the break and one row with ``error``.
"""

from __future__ import annotations

import gzip
import re
import tarfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..catalogs import BINARY_EXTENSIONS, SKIP_DIRECTORIES

MEMBER = "repo_id string, file_pos long, path string, size long, content string, is_binary boolean, truncated boolean, beyond_cap boolean, error string"
_KINDS = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
_ARROW = pa.schema([(name, _KINDS[kind]) for name, kind in (f.split() for f in MEMBER.split(", "))])
#: rows and characters of a batch, and bytes of archives that one task reads (one archive at least)
BATCH_ROWS, BATCH_CHARS, TASK_BYTES = 256, 4 << 20, 128 << 20


@dataclass(frozen=True)
class Limits:
    max_files: int | None = 500
    max_file_size: int = 200_000
    #: of the compressed archive; None takes any
    max_bytes: int | None = None


def members(repo_id: str, stream: BinaryIO, limits: Limits) -> Iterator[tuple]:
    """The rows of one archive, read once from front to end."""
    skip, seen = set(SKIP_DIRECTORIES), 0
    try:
        # tarfile's own gzip stream takes one that is cut within a member's header for the archive's end
        with gzip.GzipFile(fileobj=stream) as unpacked, tarfile.open(fileobj=unpacked, mode="r|") as tar:
            for member in tar:
                # what a stream has passed is of no use, and the list of it would grow with the archive
                tar.members.clear()
                path = member.name.partition("/")[2]
                if not member.isfile() or not path or skip & set(path.split("/")[:-1]):
                    continue
                place, seen = seen, seen + 1
                beyond, large = limits.max_files is not None and place >= limits.max_files, member.size > limits.max_file_size
                data = None if beyond or large else tar.extractfile(member).read()
                binary = data is not None and (path.lower().endswith(BINARY_EXTENSIONS) or b"\x00" in data[:1024])
                yield repo_id, place, path, member.size, None if data is None or binary else data.decode("utf-8", "replace"), binary, large and not beyond, beyond, None
    except (tarfile.TarError, OSError, EOFError, zlib.error) as error:
        yield repo_id, -1, None, None, None, None, None, None, str(error)


def batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows in Arrow batches of bounded size."""

    def made(part: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), _ARROW)], schema=_ARROW)

    part, chars = [], 0
    for row in rows:
        part.append(row)
        chars += len(row[4] or "")
        if len(part) >= BATCH_ROWS or chars >= BATCH_CHARS:
            yield made(part)
            part, chars = [], 0
    if part:
        yield made(part)


def opened(url: str) -> tuple[fs.FileSystem, str]:
    """The file system that a folder's URL or path names, and the folder within it."""
    if "://" in url or url.startswith("file:"):
        store, base = fs.FileSystem.from_uri(url)
        return store, base.rstrip("/")
    return fs.LocalFileSystem(), url.rstrip("/")


def glob_pattern(glob: str) -> re.Pattern:
    """A shell glob whose stars stay within a name."""
    return re.compile("".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in glob))


def repo_name(path: str) -> str:
    """An archive's repository: the file's name without its endings."""
    return re.sub(r"(?:\.tar\.gz|\.tgz)$", "", path.rsplit("/", 1)[-1])


def _too_large(name: str, size: int, limits: Limits) -> tuple | None:
    if limits.max_bytes is not None and size > limits.max_bytes:
        return name, -1, None, None, None, None, None, None, f"the archive has {size} bytes, more than {limits.max_bytes}"
    return None


@dataclass
class Archives(InputPartition):
    """Archives of one task: their paths within the file system of the source, and their sizes."""

    paths: list[tuple[str, int]]


class ArchiveReader(DataSourceReader):
    def __init__(self, url: str, limits: Limits):
        self.url, self.limits = url, limits

    def storage(self) -> tuple[fs.FileSystem, str, str]:
        """The file system, the folder in it that is listed, and the pattern of paths under that."""
        folder = re.split(r"[*?]", self.url)[0].rpartition("/")[0] or "/"
        store, base = opened(folder)
        return store, base or "/", self.url[len(folder.rstrip("/")) :].lstrip("/")

    def partitions(self) -> list[Archives]:
        store, base, glob = self.storage()
        wanted = glob_pattern(f"{base.rstrip('/')}/{glob}")
        found = store.get_file_info(fs.FileSelector(base, recursive="/" in glob, allow_not_found=True))
        sizes = sorted(((f.path, f.size) for f in found if f.is_file and wanted.fullmatch(f.path)), key=lambda f: (-f[1], f[0]))
        tasks: list[list[tuple[str, int]]] = []
        room = 0
        for path, size in sizes:
            if not tasks or size > room:
                tasks.append([])
                room = TASK_BYTES
            tasks[-1].append((path, size))
            room -= size
        return [Archives(t) for t in tasks] or [Archives([])]

    def read(self, partition: Archives) -> Iterator[pa.RecordBatch]:
        store, _, _ = self.storage()
        for path, size in partition.paths:
            name = repo_name(path)
            refused = _too_large(name, size, self.limits)
            if refused:
                yield from batches(iter([refused]))
                continue
            with store.open_input_stream(path, compression=None, buffer_size=1 << 20) as stream:
                yield from batches(members(name, stream, self.limits))


class ArchiveSource(DataSource):
    """``spark.read.format("archives").load("s3://bucket/*.tar.gz")``; options ``max_files``, ``max_file_size`` and ``max_bytes``, each a number or ``none``."""

    @classmethod
    def name(cls) -> str:
        return "archives"

    def schema(self) -> str:
        return MEMBER

    def reader(self, schema) -> ArchiveReader:
        given = {k.lower(): v for k, v in self.options.items()}
        chosen = {k: None if given[k].lower() == "none" else int(given[k]) for k in ("max_files", "max_file_size", "max_bytes") if k in given}
        return ArchiveReader(given["path"], Limits(**chosen))


def load_archives(spark: SparkSession, glob: str, max_files: int | None = 500, max_file_size: int = 200_000, max_bytes: int | None = None) -> DataFrame:
    """``files`` rows (with ``beyond_cap`` and ``error``) of the archives that ``glob`` matches, streamed from their storage; the repository is named by the file."""
    spark.dataSource.register(ArchiveSource)
    options = {"max_files": max_files, "max_file_size": max_file_size, "max_bytes": max_bytes}
    return spark.read.format("archives").options(**{k: "none" if v is None else v for k, v in options.items()}).load(glob)


def read_archives(archives: DataFrame, max_files: int | None = 500, max_file_size: int = 200_000, max_bytes: int | None = 80 << 20) -> DataFrame:
    """The same rows for archives that a table holds as bytes (repo_id, content)."""
    limits = Limits(max_files, max_file_size, max_bytes)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(len(part)):
                name, data = (part.column(c)[at] for c in ("repo_id", "content"))
                refused = _too_large(name.as_py(), data.as_buffer().size if data.is_valid else 0, limits)
                yield from batches(iter([refused]) if refused else members(name.as_py(), pa.BufferReader(data.as_buffer() if data.is_valid else b""), limits))

    return archives.select("repo_id", F.col("content").cast("binary").alias("content")).mapInArrow(run, MEMBER)
