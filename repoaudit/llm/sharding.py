"""Sharding by proportional stratified interleaving.

Rows are shuffled within their source by a seeded hash and ranked; row k of a source with n rows gets the fraction
(k - u) / n, where u is the source's own seeded phase between 0 and 1. Sorted by that fraction the sources interleave in proportion, so every equal cut
holds the mixture of the whole; the phases spread sources of few rows over all cuts.

No source and no cut meets in one task: ranks come from a count per (source, hash range), whose running sum is each
range's offset, and a row number inside the range. Ranges are sized from exact counts to about ``ROWS`` rows, and the order of all rows is
found the same way from ranges of the fraction. More than ``ROWS`` / 4 rows alike in source, id and text, which no hash of these can part, are told apart by a
running number. Only ids, sizes and checksums move, never texts.

Defined cases: a null text has size 16 and the checksum of no bytes; null sources are one source of their own; rows with null ids are dealt
like others; repeated rows each get a place (which of them is which is open, as they are alike); an empty table gives no
row; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_if, saved, table

SHARDS = 40
SEED = 20240917
ROWS = 4096
SPANS = 4096
FEW_SOURCES = 100_000


def _offsets(df: DataFrame, group: list[str], span: str) -> DataFrame:
    """(group, span, before): rows in earlier spans of the group, summed in two levels so that no window is long."""
    counts = df.groupBy(*group, span).agg(F.count("*").alias("n_span")).withColumn("block", F.expr(f"{span} div {SPANS}"))
    earlier = lambda keys, order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.groupBy(*group, "block").agg(F.sum("n_span").alias("n_block"))
    blocks = blocks.select(*group, "block", F.coalesce(F.sum("n_block").over(earlier(group, "block")), F.lit(0)).alias("before_block"))
    inside = counts.withColumn("before_span", F.coalesce(F.sum("n_span").over(earlier([*group, "block"], span)), F.lit(0)))
    return inside.join(blocks, [*group, "block"]).select(*group, span, (F.col("before_block") + F.col("before_span")).alias("before"))


def _numbered(df: DataFrame, group: list[str], span: str, order: list) -> DataFrame:
    """``df`` with ``place`` (from 1) within ``group`` in the order of (span, order); spans hold a bounded number of rows.

    Rows are dealt out by group and span, so that a hot group is many tasks.
    """
    dealt = df.repartition(*group, span)
    ranked = dealt.withColumn("in_span", F.row_number().over(Window.partitionBy(*group, span).orderBy(*order)))
    return ranked.join(_offsets(df, group, span), [*group, span]).withColumn("place", F.col("before") + F.col("in_span")).drop("before", "in_span")


def interleave(documents: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, text_crc32, place, shard, slot) of every row; counts of shards differ by one at most."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = saved(documents.select(
        "doc_id", "source", F.coalesce("source", F.lit("")).alias("stratum"), F.col("source").isNull().alias("no_source"),
        (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.monotonically_increasing_id().alias("row"),
    ).withColumn("h", F.pmod(F.xxhash64(F.lit(seed), "stratum", "doc_id", "text_crc32", "size"), F.lit(1 << 40))))
    alike = saved(rows.groupBy("h").count().where(F.col("count") > ROWS // 4).select("h"))
    n_alike = alike.count()
    if n_alike:
        apart = F.when(F.col("crowded"), F.pmod(F.xxhash64("h", "row"), F.lit(1 << 40))).otherwise(F.col("h"))
        rows = rows.join(broadcast_if(alike.withColumn("crowded", F.lit(True)), n_alike, FEW_SOURCES), "h", "left").withColumn("h", apart).drop("crowded")
    rows = rows.drop("row")
    per_source = saved(rows.groupBy("stratum", "no_source").agg(F.count("*").alias("n")))
    n_sources, total = per_source.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    sized = broadcast_if(per_source, n_sources, FEW_SOURCES)
    # the hash cut into equal ranges, so many that each holds about ROWS rows of its source
    ranked = rows.join(sized, ["stratum", "no_source"]).withColumn("span", F.floor(F.col("h") / F.lit(float(1 << 40)) * F.ceil(F.col("n") / ROWS)).cast("long"))
    ranked = _numbered(ranked, ["stratum", "no_source"], "span", ["h", "doc_id", "text_crc32", "size"])
    phase = (F.pmod(F.xxhash64(F.lit(seed), F.lit("phase"), "stratum", "no_source"), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    fraction = ranked.select("doc_id", "source", "size", "text_crc32", "h", ((F.col("place") - phase) / F.col("n")).alias("fraction"))
    fraction = saved(fraction.withColumn("cut", F.floor(F.col("fraction") * max(1, -(-total // ROWS))).cast("long")))
    placed = _numbered(fraction, [], "cut", ["fraction", F.xxhash64(F.lit(seed), "source"), "source", "h", "doc_id", "text_crc32", "size"]).withColumn("place", F.col("place") - 1)
    placed = placed.withColumn("shard", F.expr(f"cast((place * {shards}) div {max(1, total)} as int)"))
    first = F.expr(f"(shard * cast({total} as bigint) + {shards - 1}) div {shards}")
    return placed.withColumn("slot", (F.col("place") - first).cast("long")).select("doc_id", "source", "size", "text_crc32", "place", "shard", "slot")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = interleave(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")
