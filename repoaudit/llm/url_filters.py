"""URL filters: a blocked Bloom filter of listed canonical URLs before an exact hash join.

A listed entry is a host and a path prefix; it fits its host and all subdomains of it, for URLs whose path starts with its
path. So a URL hits an entry exactly if one of its probes, a suffix of its host at a label border joined with a
prefix of its path, is listed. Probes are made only for pairs of host and path lengths that the list has, so the work for a URL is linear in its
length for each such host length, whatever its number of labels. The filter is a table of
blocks: an entry's hash names one block and sets ``BITS_PER_KEY`` of its 256 bits, held as four longs. Probes whose bits are
not all set in their block are dropped; the rest meet the list in an exact equality join, which removes the false positives.

The filter is broadcast where its exact number of blocks is within ``MAX_BROADCAST_BLOCKS`` and joined by shuffle otherwise; likewise the list, and the
table of lengths, whose shuffled join is salted. In shuffled joins adaptive execution splits the probes of a hot block or entry. All of it is DataFrame expressions.

Defined cases: a null URL or one without ``://`` has empty host and path and gets the default verdict; entries with a null part are
ignored; an entry listed twice counts once, and as ``block`` if the verdicts differ; of entries that fit, the longest host
and path together wins, then the longer host; repeated rows are judged each; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if, saved, table

BITS_PER_KEY = 6
KEYS_PER_BLOCK = 16
MAX_BROADCAST_BLOCKS = 1 << 18  # 10 MB of blocks
MAX_BROADCAST_KEYS = 100_000
MAX_BROADCAST_LENGTHS = 1 << 20  # pairs of two numbers
SALTS = 64
DEFAULT = "allow"

#: Verdict, host, path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def url_parts(url: str) -> tuple:
    """Expressions for the host and path of column ``url``."""
    rest = f"substring({url}, locate('://', {url}) + 3)"
    there = f"locate('://', coalesce({url}, '')) > 0"
    host = f"translate(regexp_extract({rest}, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    path = f"regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1)"
    return F.expr(f"CASE WHEN {there} THEN {host} ELSE '' END"), F.expr(f"CASE WHEN {there} THEN {path} ELSE '' END")


def _hashed(df: DataFrame, blocks: int) -> DataFrame:
    """``df`` with the block of its ``key`` and four longs with the bits that the key sets there."""
    bits = [f"(pmod(shiftrightunsigned(h2, {8 * i}), 256))" for i in range(BITS_PER_KEY)]
    words = [" | ".join(f"CASE WHEN {b} div 64 = {w} THEN shiftleft(1L, cast({b} % 64 AS INT)) ELSE 0L END" for b in bits) for w in range(4)]
    df = df.withColumn("h1", F.xxhash64("key")).withColumn("h2", F.xxhash64(F.lit("bits"), "key"))
    own = [c for c in df.columns if c not in ("h1", "h2")]
    return df.select(*own, F.pmod("h1", F.lit(blocks)).alias("bloom_block"), *(F.expr(x).alias(f"b{w}") for w, x in enumerate(words)))


def bloom_filter(listed: DataFrame, blocks: int) -> DataFrame:
    """One row (bloom_block, w0..w3) for each block of the filter over the ``key`` column of ``listed`` that has a bit set."""
    return _hashed(listed.select("key"), blocks).groupBy("bloom_block").agg(*(F.expr(f"bit_or(b{w})").alias(f"w{w}") for w in range(4)))


def might_be_listed(probes: DataFrame, bloom: DataFrame, blocks: int, n_keys: int) -> DataFrame:
    """The rows of ``probes`` whose ``key`` has all its bits set in the filter."""
    hint = broadcast_if(bloom, min(blocks, n_keys), MAX_BROADCAST_BLOCKS)
    hit = _hashed(probes, blocks).join(hint, "bloom_block").where(" AND ".join(f"(b{w} & w{w}) = b{w}" for w in range(4)))
    return hit.select(*probes.columns)


def _probes(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """(row, host_len, path_len, key): each row's host suffixes and path prefixes of lengths that stand together in the list.

    The distinct host lengths of the list are numbers up to its longest host, so an array of them fits in a row; the path lengths that go with each
    are joined.
    """
    pairs = saved(listed.select("host_len", "path_len").distinct())
    hosts = pairs.agg(F.sort_array(F.collect_set("host_len"))).first()[0]
    lengths = F.array(*(F.lit(n) for n in hosts)).cast("array<int>")
    # a suffix counts if it is the whole host or stands behind a dot
    border = lambda n: (F.length("host") == n) | ((F.length("host") > n) & (F.col("host").substr(-n - 1, F.lit(1)) == "."))
    probed = rows.where("host <> ''").select("row", "host", "path", F.explode(F.filter(lengths, border)).alias("host_len"))
    by_host = pairs.groupBy("host_len").agg(F.collect_set("path_len").alias("path_lens"))
    if pairs.count() <= MAX_BROADCAST_LENGTHS:
        probed = probed.join(F.broadcast(by_host), "host_len")
    else:
        salted = by_host.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        probed = probed.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(salted, ["host_len", "salt"])
    probed = probed.select("row", "host", "path", "host_len", F.explode(F.filter("path_lens", lambda n: n <= F.length("path"))).alias("path_len"))
    return probed.select("row", "host_len", "path_len", F.expr("concat(substring(host, -host_len, host_len), substring(path, 1, path_len))").alias("key"))


def filter_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, host, path, rule, verdict) of every row of ``pages`` under ``rules`` (verdict, host, path)."""
    listed = rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL")
    listed = saved(listed.select(F.concat("host", "path").alias("key"), F.length("host").alias("host_len"), F.length("path").alias("path_len"), "verdict").groupBy("key", "host_len", "path_len").agg(F.max("verdict").alias("verdict")))
    n_keys = listed.count()
    blocks = max(1, -(-n_keys // KEYS_PER_BLOCK))
    host, path = url_parts(url)
    # a running number tells repeated rows apart; it is written before it is used, so it stays the same
    rows = saved(pages.select(F.monotonically_increasing_id().alias("row"), F.col(key), host.alias("host"), path.alias("path")))
    probes = _probes(rows, listed)
    hits = might_be_listed(probes, bloom_filter(listed, blocks), blocks, n_keys)
    exact = broadcast_if(listed, n_keys, MAX_BROADCAST_KEYS)
    found = hits.join(exact, ["key", "host_len", "path_len"]).groupBy("row").agg(
        F.max(F.struct((F.col("host_len") + F.col("path_len")).alias("len"), "host_len", F.col("key").alias("rule"), F.col("verdict"))).alias("best"))
    out = rows.join(found, "row", "left")
    return out.select(key, "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), F.lit(DEFAULT)).alias("verdict"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(RULES), "verdict string, host string, path string")
    return filter_urls(table(spark, sf_dir, "pages"), rules)


ORACLE_SQL = """
WITH parts AS (
  SELECT page_id,
    CASE WHEN contains(coalesce(url, ''), '://') THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN contains(coalesce(url, ''), '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
rules(verdict, host, path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
  ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fits AS (
  SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict,
    row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC NULLS LAST) AS k
  FROM parts p LEFT JOIN rules r ON (p.host = r.host OR p.host LIKE '%.' || r.host) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE k = 1
"""
