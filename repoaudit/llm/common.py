"""Helpers shared by the training-data operators: tables, lineage cuts, Arrow mapping, labelled samples."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import TypeVar

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.saved import broadcast_if, counted, first_row, saved, shared_folder  # noqa: F401  for the other modules

T = TypeVar("T")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc32(doc_id: Column) -> Column:
    """crc32 of the id written as decimal text."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def slices(batch: pa.RecordBatch, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of an Arrow batch of about ``most_bytes`` each, as Python objects take many times a column's bytes."""
    step = max(1, len(batch) * most_bytes // max(1, batch.nbytes))
    for at in range(0, len(batch), step):
        yield batch.slice(at, step)


def map_rows(df: DataFrame, columns: list[str], make: Callable[[], Callable[..., tuple]], schema: str, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``df`` plus what ``make()(*values of columns)`` returns per row.

    ``make`` runs once per task and returns the row function, so models and tokenizers load once. Rows stream in
    Arrow batches, whose size Spark bounds by bytes, so memory follows the batch and not the partition.
    """
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    new = StructType.fromDDL(schema)
    out = StructType([df.schema[c] for c in keep] + new.fields)
    arrow = to_arrow_schema(out)
    n_keep = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = None
        for batch in (part for whole in batches for part in slices(whole)):
            f = f or make()
            rows = [f(*v) for v in zip(*(batch.column(c).to_pylist() for c in columns))]
            made = list(zip(*rows)) if rows else [[] for _ in new.fields]
            arrays = [batch.column(c).cast(arrow.field(i).type) for i, c in enumerate(keep)]
            arrays += [pa.array(list(v), type=arrow.field(n_keep + i).type) for i, v in enumerate(made)]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    used = list(dict.fromkeys([*keep, *columns]))
    return df.select(*used).mapInArrow(run, out)


def labelled_sample(examples: DataFrame, label: str, max_rows: int, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """About ``max_rows`` rows of ``examples``, as evenly over the values of ``label`` as they allow, with the ``weight`` (rows of its
    label that each stands for).

    Every label gives up to a level L of rows, the greatest with sum(min(rows of label, L)) <= ``max_rows``. L is found from sums over the table
    of counts, and the shares are joined to the rows, so any number of labels will do; labels beyond ``max_rows`` share it by chance.
    A row is taken if the hash of its ``by`` columns lies under its label's share: no sort, no window, the same rows at every partitioning.
    """
    counts = saved(examples.groupBy(label).agg(F.count("*").alias("n")))
    n_labels = counts.count()
    level = max_rows / max(1, n_labels) if n_labels >= max_rows else _level(counts, max_rows)
    shares = counts.select(F.col(label).alias("of_label"), F.least(F.lit(1.0), F.lit(float(level)) / F.col("n")).alias("share"))
    hashed = F.pmod(F.xxhash64(F.lit("train"), *by), F.lit(1 << 30))
    taken = examples.join(broadcast_if(shares, n_labels, 100_000), examples[label] == F.col("of_label")).where(hashed < F.col("share") * (1 << 30))
    return taken.withColumn("weight", 1 / F.col("share")).drop("of_label", "share")


def _level(counts: DataFrame, max_rows: int) -> int:
    """The greatest whole L with sum(min(n, L)) <= ``max_rows``: 64 candidates at a time, each a sum over the counts."""
    low, high = 0, max_rows
    while low < high:
        step = -(-(high - low) // 64)
        tried = list(range(low + step, high + step, step))
        sums = counts.agg(*(F.sum(F.least("n", F.lit(x))) for x in tried)).first()
        fit = [x for x, s in zip(tried, sums) if (s or 0) <= max_rows]
        low, high = max([low, *fit]), min([high, *(x - 1 for x in tried if x not in fit)])
    return low


def lookup(rows: DataFrame, values: DataFrame, key: str, total: int, share: int = 1000) -> DataFrame:
    """``rows`` left-joined to ``values``, which has one row a ``key`` with the number ``n`` of rows that hold it; ``total`` is the count of ``rows``.

    Fewer than ``share`` keys can be held by more than one ``share``-th of all rows each. These, whatever they are, are broadcast to their rows; all other keys
    are joined by a shuffle in which none is hot. Both sides should be saved, as both are read twice.
    """
    hot = values.where(F.col("n") * share > total).drop("n")
    rest = values.where(F.col("n") * share <= total).drop("n")
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key, "left")
    return rows.join(F.broadcast(hot), key).unionByName(cold)


def bounded(rows: DataFrame, n: str, most: int) -> DataFrame:
    """``rows`` (with ``weight``) whose numbers ``n`` add up to about ``most`` at most: all, or those under a hash bound that thins them evenly."""
    rows = saved(rows)
    total = rows.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    if total <= most:
        return rows
    share = most / total
    hashed = F.pmod(F.xxhash64(F.lit("thin"), "doc_id"), F.lit(1 << 30))
    return rows.where(hashed < share * (1 << 30)).withColumn("weight", F.col("weight") / share)


def fitted(rows: DataFrame, keys: list[str], fit: Callable[[pa.Table, list[int]], T]) -> T:
    """What ``fit`` makes of all ``rows``, which must be a bounded and saved sample, in one task of an executor.

    ``fit`` gets the rows and their places in the order of ``keys``, and returns plain values and arrays. Only what it returns comes to the driver, whose memory so stays free of the sample.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(rows.schema)

    def made(batches: list[pa.RecordBatch]) -> T:
        table = pa.Table.from_batches(batches, schema)
        return fit(table, pc.sort_indices(table, [(k, "ascending") for k in keys]).to_pylist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(b.columns, schema)], schema=schema) for b in batches]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(made(got))], pa.binary())], names=["made"])

    one = rows.coalesce(1).mapInArrow(run, "made binary").first()
    return pickle.loads(one["made"]) if one else made([])


def keep_rows(docs: DataFrame, judge: Callable[[DataFrame, list[str]], DataFrame], condition: str) -> DataFrame:
    """The rows of ``docs`` for which ``condition`` holds on the columns that ``judge(docs, columns to carry)`` adds.

    All columns go along in one struct, so none can clash with what the judge adds.
    """
    kept = judge(docs.select(F.col("text"), packed(docs)), ["own_row"]).where(condition)
    return unpacked(kept, docs.columns)


def packed(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one struct ``own_row``, whose fields can't clash with other columns."""
    return F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns))).alias("own_row")


def unpacked(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*(F.col(f"own_row.c{i}").alias(c) for i, c in enumerate(names)))
