"""Hard negatives of anchors by exact integer scores, with angular triangle filtering.

Every row is stored once as integers with its norm and its angles to a few reference directions. For an anchor at angles a_j and a row at angles t_j, the angle
between the two lies between the largest |a_j - t_j| and the smallest of a_j + t_j and 2 pi - a_j - t_j. That bounds their cosine and, with the norms and a margin for rounding, their score.
Only rows whose bounds overlap a window are scored: those that may still reach the anchor's best positives so far, then those that may fall into the
window of one of its positives and still reach the best negatives so far. Scores are exact, so the filter changes no result, only the work.

Rows lie in blocks, a matrix each, made where the rows are read. Anchors lie in blocks too and meet all row blocks by an equi-join on the anchors' block number: broadcast while
their counted size is bounded, else salted and shuffled. A task keeps the best few per anchor over all its blocks, so what it sends on follows the anchors.

Defined cases: rows with a null id, label or vector, or a null or non-finite component, take no part; a shorter vector counts as padded with zeros, a zero vector
has the score zero with all; rows alike in id and score count once; "other" rows have another id; several anchors of one id are anchors each; an empty table gives no rows;
other columns are not read. A score that no long holds is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table

#: reference directions (rows with the smallest hashes), bytes of a block's matrix, rows of an anchor block
REFERENCES, BLOCK_BYTES, ANCHORS = 16, 1 << 20, 256
#: anchors are broadcast up to so many bytes; beyond, row blocks are dealt into so many salts
MAX_BROADCAST, SALTS = 32 << 20, 16
#: angles are stored in single precision and may be off by some 1e-7
SLACK = 4e-6
BLOCK = "ids binary, labels binary, dim int, vectors binary, norms binary, angles binary"


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, vector) of the rows that take part, labels as mining uses them."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & whole)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))


def whole_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two matrices of whole numbers, as int64."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    scores = whole(a) @ whole(b).T
    if np.abs(scores).max() >= 2**63:
        raise OverflowError("a score does not fit into a long")
    return scores.astype(np.int64)


def angles_to(vectors: np.ndarray, norms: np.ndarray, directions: np.ndarray) -> np.ndarray:
    unit = vectors / np.where(norms > 0, norms, 1)[:, None]
    return np.arccos(np.clip(unit @ directions.T, -1, 1)).astype(np.float32)


def score_bounds(a_angles: np.ndarray, a_norms: np.ndarray, b_angles: np.ndarray, b_norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of all pairs, wide enough for all rounding."""
    low = np.zeros((len(a_norms), len(b_norms)), np.float32)
    high = np.full_like(low, np.pi)
    for a, b in zip(a_angles.T, b_angles.T):
        total = a[:, None] + b
        np.minimum(high, total, out=high)
        np.minimum(high, np.float32(2 * np.pi) - total, out=high)
        np.maximum(low, np.abs(a[:, None] - b), out=low)
    norm = a_norms[:, None] * b_norms
    margin = norm * 1e-6 + 1
    return norm * np.cos(np.minimum(high + SLACK, np.pi)) - margin, norm * np.cos(np.maximum(low - SLACK, 0)) + margin


class Block:
    """Rows unpacked from one record."""

    def __init__(self, row: dict, prefix: str = ""):
        get = lambda name, kind: np.frombuffer(row[prefix + name], kind)
        self.ids, self.labels, self.norms = get("ids", "<i8"), get("labels", "<i8"), get("norms", "<f8")
        n = len(self.ids)
        # whole numbers below 2^24 are stored in single precision
        kind = "<f4" if len(row[prefix + "vectors"]) == 4 * n * row[prefix + "dim"] else "<f8"
        self.vectors = get("vectors", kind).reshape(n, -1).astype(np.float64)
        self.angles = get("angles", "<f4").reshape(n, -1)

    @staticmethod
    def packed(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, directions: np.ndarray) -> tuple:
        norms = np.sqrt((vectors * vectors).sum(axis=1))
        small = vectors.astype(np.float32) if np.abs(vectors).max(initial=0) < 2**24 else vectors
        return ids.tobytes(), labels.tobytes(), vectors.shape[1], small.tobytes(), norms.tobytes(), angles_to(vectors, norms, directions).tobytes()

    def scores(self, anchor: int, anchors: Block, wanted: np.ndarray) -> np.ndarray:
        return whole_scores(self.vectors[wanted], anchors.vectors[anchor : anchor + 1])[:, 0]


def pack(rows: DataFrame, directions: np.ndarray, block_rows: int) -> DataFrame:
    """``rows`` (vec_id, label, vector) as blocks, without a shuffle."""
    dim = directions.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in BLOCK.split(", ")]
        for batch in batches:
            for at in range(0, len(batch), block_rows):
                part = batch.slice(at, block_rows)
                listed = part.column("vector")
                vectors = np.zeros((len(part), dim))
                sizes = np.diff(np.asarray(listed.offsets))
                vectors[np.arange(dim) < sizes[:, None]] = np.floor(256 * listed.flatten().to_numpy())
                made = Block.packed(*(part.column(c).to_numpy() for c in ("vec_id", "label")), vectors, directions)
                yield pa.RecordBatch.from_pylist([dict(zip(names, made))], schema=pa.schema([(n, pa.int32() if n == "dim" else pa.binary()) for n in names]))

    return rows.select("vec_id", "label", "vector").mapInArrow(run, BLOCK)


def best_few(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``k`` different (score, id), higher scores first, then smaller ids."""
    if len(scores) > 4 * k:
        near = scores >= np.partition(scores, len(scores) - 4 * k)[len(scores) - 4 * k]
        if len(np.unique(ids[near])) >= k:
            scores, ids = scores[near], ids[near]
    order = np.lexsort((ids, -scores))
    scores, ids = scores[order], ids[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (scores[1:] != scores[:-1])
    return scores[new][:k], ids[new][:k]


def first_in_window(scores: np.ndarray, ids: np.ndarray, positive: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of rows in their order, the first ``k`` that count as hard for a positive score."""
    at = int(np.searchsorted(-scores, -positive))
    s, i = scores[at : at + k], ids[at : at + k]
    inside = 100 * s >= 80 * positive
    return s[inside], i[inside]


def meet(blocks: DataFrame, anchors: DataFrame, count: int, size: int) -> DataFrame:
    """Every row block beside every one of ``count`` anchor blocks (columns ``a_*``, of ``size`` bytes in all), by an equi-join on the anchor block's number."""
    keyed = blocks.withColumn("a_block", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    if size <= MAX_BROADCAST:
        return keyed.join(F.broadcast(anchors), "a_block")
    salted = anchors.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return keyed.withColumn("salt", F.pmod(F.crc32("ids"), F.lit(SALTS)).cast("int")).join(salted, ["a_block", "salt"]).drop("salt")


def nearest(pairs: DataFrame, k: int) -> DataFrame:
    """(a_key, id, score) of the best ``k`` rows with the label of an anchor; a task's best each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        none = np.empty(0, np.int64), np.empty(0, np.int64)
        for row in (r for batch in batches for part in range(len(batch)) for r in batch.slice(part, 1).to_pylist()):
            rows, anchors, keys = Block(row), Block(row, "a_"), np.frombuffer(row["a_keys"], "<i8")
            _, upper = score_bounds(anchors.angles, anchors.norms, rows.angles, rows.norms)
            other = (rows.labels == anchors.labels[:, None]) & (rows.ids != anchors.ids[:, None])
            for a, key in enumerate(keys.tolist()):
                scores, ids = best.get(key, none)
                least = scores[-1] if len(scores) == k else -np.inf
                wanted = np.flatnonzero(other[a] & (upper[a] >= least))
                if len(wanted):
                    best[key] = best_few(np.concatenate([scores, rows.scores(a, anchors, wanted)]), np.concatenate([ids, rows.ids[wanted]]), k)
        keys = np.repeat(np.array(list(best), np.int64), [len(s) for s, _ in best.values()])
        scores, ids = (np.concatenate([none[0], *(v[i] for v in best.values())]) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ids), pa.array(scores)], names=["a_key", "id", "score"])

    return pairs.mapInArrow(run, "a_key long, id long, score long")


def hardest(pairs: DataFrame, k: int) -> DataFrame:
    """(a_key, positive_id, positive_score, id, score) of the best ``k`` rows in the windows of each positive; a task's best each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {}
        none = np.empty(0, np.int64), np.empty(0, np.int64)
        for row in (r for batch in batches for part in range(len(batch)) for r in batch.slice(part, 1).to_pylist()):
            rows, anchors, keys = Block(row), Block(row, "a_"), np.frombuffer(row["a_keys"], "<i8")
            lower, upper = score_bounds(anchors.angles, anchors.norms, rows.angles, rows.norms)
            other = rows.labels != anchors.labels[:, None]
            for a, (key, windows) in enumerate(zip(keys.tolist(), row["a_windows"])):
                found = best.setdefault(key, [(w["positive_id"], w["positive_score"], *none) for w in windows])
                wanted = np.zeros(len(rows.ids), bool)
                for _, positive, scores, _ in found:
                    # floor of 0.8 of a positive, or what the k-th row so far has
                    least = max(4 * positive // 5, scores[-1]) if len(scores) == k else 4 * positive // 5
                    wanted |= (upper[a] >= least) & (lower[a] <= positive)
                wanted = np.flatnonzero(wanted & other[a])
                if len(wanted):
                    scores = rows.scores(a, anchors, wanted)
                    order = np.lexsort((rows.ids[wanted], -scores))
                    scores, ids = scores[order], rows.ids[wanted][order]
                    new = np.ones(len(ids), bool)
                    new[1:] = (ids[1:] != ids[:-1]) | (scores[1:] != scores[:-1])
                    scores, ids = scores[new], ids[new]
                    for i, (p, positive, had, had_ids) in enumerate(found):
                        more, more_ids = first_in_window(scores, ids, positive, k)
                        if len(more):
                            found[i] = (p, positive, *best_few(np.concatenate([had, more]), np.concatenate([had_ids, more_ids]), k))
        flat = [(key, p, s) for key, found in best.items() for p, s, had, _ in found for _ in range(len(had))]
        columns = list(zip(*flat)) or [[], [], []]
        scores, ids = (np.concatenate([none[0], *(f[i] for found in best.values() for f in found)]) for i in (2, 3))
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(ids), pa.array(scores)], names=["a_key", "positive_id", "positive_score", "id", "score"])

    return pairs.mapInArrow(run, "a_key long, positive_id long, positive_score long, id long, score long")


def first_few(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The best ``k`` over all tasks, with ``rank``; a partial limit stands before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))
    return found.distinct().withColumn("rank", place).where(F.col("rank") <= k)


def anchor_blocks(anchors: DataFrame, directions: np.ndarray, windows: DataFrame | None = None) -> DataFrame:
    """Anchors (a_key, a_block, vec_id, label, vector) as one row a block, with the windows of each where given."""
    dim = directions.shape[1]
    fields = [f"a_{c}" for c in BLOCK.split(", ")]
    window = "array<array<struct<positive_id:bigint,positive_score:bigint>>>"
    if windows is not None:
        # anchors without a positive have no windows
        listed = windows.groupBy("a_key").agg(F.sort_array(F.collect_list(F.struct("rank", "positive_id", "positive_score"))).alias("w"))
        listed = listed.select("a_key", F.transform("w", lambda x: F.struct(x["positive_id"], x["positive_score"])).alias("windows"))
        anchors = anchors.join(listed, "a_key")
    else:
        anchors = anchors.withColumn("windows", F.expr("cast(null AS array<struct<positive_id:bigint,positive_score:bigint>>)"))
    grouped = anchors.groupBy("a_block").agg(F.collect_list(F.struct("a_key", "vec_id", "label", "vector", "windows")).alias("rows"))
    grouped = grouped.select("a_block", *(F.col(f"rows.{c}").alias(c) for c in ("a_key", "vec_id", "label", "vector")), F.col("rows.windows").alias("a_windows"))
    names = [c.split()[0] for c in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                row = batch.slice(at, 1).to_pylist()[0]
                vectors = np.zeros((len(row["vector"]), dim))
                for i, v in enumerate(row["vector"]):
                    vectors[i, : len(v)] = np.floor(256 * np.array(v, np.float64))
                made = Block.packed(*(np.array(row[c], "<i8") for c in ("vec_id", "label")), vectors, directions)
                columns = [pa.array([row["a_block"]], pa.int32()), pa.array([np.array(row["a_key"], "<i8").tobytes()], pa.binary()), *(pa.array([m], pa.int32() if n == "a_dim" else pa.binary()) for n, m in zip(names, made)), batch.column("a_windows").slice(at, 1)]
                yield pa.RecordBatch.from_arrays(columns, names=["a_block", "a_keys", *names, "a_windows"])

    return grouped.mapInArrow(run, f"a_block int, a_keys binary, {', '.join(fields)}, a_windows {window}")


def mine(embeddings: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows whose id is divisible by ``every``."""
    rows = usable(embeddings)
    anchors = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "label", "vector"])
    anchors = saved(anchors.select(F.xxhash64("vec_id", "label", "vector").alias("a_key"), "*"))
    n_anchors = anchors.count()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n_anchors:
        return embeddings.sparkSession.createDataFrame([], schema)
    dim = max(1, rows.agg(F.max(F.size("vector"))).first()[0])
    sampled = rows.select("vec_id", "vector", F.xxhash64("vec_id").alias("h")).orderBy("h", "vec_id").limit(REFERENCES).collect()
    directions = np.zeros((len(sampled), dim))
    for i, r in enumerate(sampled):
        directions[i, : len(r["vector"])] = r["vector"]
    sizes = np.sqrt((directions * directions).sum(axis=1))
    directions = directions[sizes > 0] / sizes[sizes > 0, None] if (sizes > 0).any() else np.eye(1, dim)

    count, size = -(-n_anchors // ANCHORS), n_anchors * dim * 8
    placed = anchors.withColumn("a_block", F.pmod(F.xxhash64(F.lit("block"), "a_key"), F.lit(count)).cast("int"))
    blocks = saved(pack(rows, directions, max(64, BLOCK_BYTES // (8 * dim))))
    near = first_few(nearest(meet(blocks, anchor_blocks(placed, directions), count, size), positives), ["a_key"], positives)
    windows = saved(near.select("a_key", "rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    hard = hardest(meet(blocks, anchor_blocks(placed, directions, windows), count, size), negatives)
    best = first_few(hard, ["a_key", "positive_id", "positive_score"], negatives)
    named = best.join(placed.select("a_key", F.col("vec_id").alias("anchor_id")), "a_key")
    return named.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "embeddings"))


#: The same rows by comparing every anchor with every row.
ORACLE_SQL = """
WITH usable AS (
    SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)
), scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::BIGINT AS score
    FROM usable a, usable b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, n.vec_id AS negative_id, positive_score, n.score AS negative_score
FROM positives p JOIN scored n USING (anchor_id)
WHERE NOT n.same AND 80 * positive_score <= 100 * n.score AND n.score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.vec_id)
QUALIFY row_number() OVER w <= 5
"""
