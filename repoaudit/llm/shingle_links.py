"""Links of texts whose sets of shingles have a Jaccard similarity of ``least`` or more.

Candidates come from MinHash bands: ``ROWS`` minima of a set make one band's key, and there are so many bands that two sets at ``least`` share no key with
a probability of ``MISSED`` only (less for sets that are more alike). Sets of one key are a group, whose links ``graph.group_links`` finds without
comparing each with each. A pair is a link only if its whole sets, not their sketches, are at ``least`` or more.

Texts that share boilerplate crowd into band keys without being links. Groups that stay large are dealt anew by the shingles of their sets' prefixes, rarest first,
which is exact and leaves out what most of them share (``regrouped``).

Where rows of a group must be compared each with each, a parity bitmap of each set rules out pairs first: two bitmaps differ in at most as many bits as
the sets differ in shingles, so no link is lost there.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if, counted, map_rows, saved
from .features import mix
from .graph import group_links, groups_of

ROWS, MISSED = 5, 1e-5
#: sets that the order of shingles is learnt from, and shingles it learns
ORDER_SETS, ORDER_SHINGLES = 2000, 1 << 16


def n_bands(least: float) -> int:
    return math.ceil(math.log(MISSED) / math.log(1 - least**ROWS)) if least < 1 else 1


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(23)
    draw = lambda: rng.integers(0, 1 << 63, (n, 1), dtype=np.uint64) * np.uint64(2)
    return draw(), draw() + np.uint64(1)


def bands(shingles: np.ndarray, least: float) -> np.ndarray:
    """The band keys (signed) of a set of shingle hashes; none for an empty set."""
    if not len(shingles):
        return np.empty(0, np.int64)
    n = n_bands(least)
    turn, odd = _permutations(n * ROWS)
    low = np.full(n * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), 256):
        np.minimum(low, ((shingles[None, at : at + 256] ^ turn) * odd).min(axis=1), out=low)
    low, key = mix(low).reshape(n, ROWS), np.arange(1, n + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = mix(key * np.uint64(3) + low[:, k])
    return key.view(np.int64)


def signature(shingles: np.ndarray) -> int:
    """One signed long for a sorted set of shingles."""
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), 7)).view(np.int64))


def parity(shingles: np.ndarray) -> np.ndarray:
    """For each of a power of two of bits, as many as shingles at least and 256, whether an odd number of shingles falls on it."""
    width = max(256, 1 << (len(shingles) - 1).bit_length()) if len(shingles) else 256
    odd = np.bincount((mix(shingles) & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Parity bitmaps (rows) at a smaller width."""
    return np.bitwise_xor.reduce(bits.reshape(len(bits), -1, words), axis=1)


def may_link(sizes: np.ndarray, bits: list[np.ndarray], group: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of all pairs of different groups that size and parity don't rule out, in batches."""
    words = np.array([len(b) for b in bits])
    most = (1 - least) / (1 + least)  # of both sizes, that the sets may differ in
    for w in np.unique(words):
        own, wider = np.flatnonzero(words == w), np.flatnonzero(words == 2 * w)
        all_ = np.concatenate([own, wider])
        flat = np.stack([bits[i] for i in own])
        if len(wider):
            flat = np.concatenate([flat, folded(np.stack([bits[i] for i in wider]), int(w))])
        step = max(1, (1 << 21) // (len(all_) * int(w)))
        for at in range(0, len(own), step):
            q = own[at : at + step]
            ok = (group[q][:, None] != group[all_][None]) & (np.arange(len(all_))[None] > np.arange(at, at + len(q))[:, None])
            a, b = sizes[q][:, None], sizes[all_][None]
            ok &= np.minimum(a, b) >= least * np.maximum(a, b) - 1e-9
            differ = np.bitwise_count(flat[at : at + len(q), None, :] ^ flat[None]).sum(axis=2, dtype=np.int64)
            i, j = np.nonzero(ok & (differ <= most * (a + b) + 1e-9))
            if len(i):
                yield q[i], all_[j]


def prefix(shingles: np.ndarray, least: float, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the order of ``counts`` (of the ``common`` ones, sorted; others first) and of their hashes: so many that two sets at ``least`` share one.

    That holds for any order; one that puts common shingles last keeps sets apart that have only these in common.
    """
    n = len(shingles) - math.ceil(least * len(shingles) - 1e-9) + 1
    at = np.minimum(np.searchsorted(common, shingles), max(0, len(common) - 1))
    count = np.where(common[at] == shingles, counts[at], 0) if len(common) else np.zeros(len(shingles), np.int64)
    return shingles[np.lexsort((mix(shingles), count))[: min(n, len(shingles))]]


def regrouped(sets: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """(key, node): the nodes by the shingles of their prefixes, for nodes whose band keys are crowded; exact at ``least`` or more.

    Shingles that hold for one set in fifty and more of a bounded hash sample come last, commonest at the very end.
    """
    chosen = saved(sets.join(nodes.select(F.col("node").alias("sig")), "sig", "left_semi").select("sig", "s"))
    share = max(1, counted(chosen)) / ORDER_SETS
    split = F.transform(F.sequence(F.lit(0), (F.length("s") / 8).cast("int") - 1), lambda i: F.substring(F.col("s"), i * 8 + 1, F.lit(8)))
    sample = chosen.where(F.pmod(F.xxhash64(F.lit("order"), "sig"), F.lit(1 << 30)) < int((1 << 30) / max(1.0, share)))
    held = sample.where(F.length("s") > 0).select(F.explode(split).alias("x")).groupBy("x").count().where(F.col("count") > ORDER_SETS // 50)
    top = held.orderBy(F.desc("count"), "x").limit(ORDER_SHINGLES).collect()
    common, counts = np.array([int.from_bytes(r["x"], "little") for r in top], np.uint64), np.array([r["count"] for r in top], np.int64)
    order = np.argsort(common)
    common, counts = common[order], counts[order]

    def keys(s: bytes) -> tuple:
        return (prefix(np.frombuffer(s, np.uint64), least, common, counts).view(np.int64).tolist(),)

    keyed = saved(map_rows(chosen, ["s"], lambda: keys, "keys array<long>", ["sig"]).select(F.explode("keys").alias("key"), F.col("sig").alias("node")))
    several = keyed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("key")
    return saved(keyed.join(several, "key"))


def links(documents: DataFrame, prints: DataFrame, shingled: Callable[[str | None], np.ndarray], least: float, candidates: DataFrame | None = None) -> DataFrame:
    """(a, b) by signature: links that join all sets at ``least`` or more.

    ``documents`` has doc_id, th and text of each row, ``prints`` doc_id, th, sig, size and bands. ``candidates`` are pairs (a, b) from elsewhere, of which those
    at ``least`` or more become links too.
    """
    keyed = prints.select(F.explode("bands").alias("key"), "sig", "size")
    groups = saved(keyed.groupBy("key").agg(F.min("sig").alias("low"), F.max("sig").alias("high")).where("low <> high").select("key"))
    members = saved(keyed.join(broadcast_if(groups, counted(groups), 1 << 18), "key").select("key", F.col("sig").alias("node"), "size").distinct())
    nodes = members.select(F.col("node").alias("sig"))
    if candidates is not None:
        candidates = saved(candidates.distinct())
        nodes = nodes.union(candidates.select("a")).union(candidates.select("b"))
    nodes = nodes.distinct()
    # one row for each set: its texts are alike, so any of them will do; taken before the join, so copies meet in their map tasks and none is a hot key
    one = prints.groupBy("sig").agg(F.min(F.struct("doc_id", "th")).alias("at"))
    wanted = saved(one.join(nodes, "sig", "left_semi").select("at.doc_id", "at.th").distinct())

    def whole(text: str | None) -> tuple:
        s = np.unique(shingled(text))
        return signature(s), len(s), s.tobytes(), parity(s).tobytes()

    hint = broadcast_if(wanted.select(F.col("doc_id").alias("w_id"), F.col("th").alias("w_th")), counted(wanted), 1 << 18)
    texts = documents.join(hint, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("th") == F.col("w_th")), "left_semi")
    sets = saved(map_rows(texts, ["text"], lambda: whole, "sig long, size int, s binary, parity binary", []).dropDuplicates(["sig"]))

    def verify(pairs: DataFrame) -> DataFrame:
        side = lambda c: sets.select(F.col("sig").alias(c), F.col("size").alias(f"{c}_size"), F.col("s").alias(f"{c}_set"))
        both = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("a_size", "b_size") >= least * F.greatest("a_size", "b_size") - 1e-9)

        def alike(a: bytes, b: bytes) -> tuple[bool]:
            x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            shared = len(np.intersect1d(x, y, assume_unique=True))
            return (shared >= least * (len(x) + len(y) - shared) - 1e-9,)

        return map_rows(both, ["a_set", "b_set"], lambda: alike, "alike boolean", ["a", "b"]).where("alike").select("a", "b")

    def compare(rows: DataFrame) -> DataFrame:
        rows = rows.join(sets.select(F.col("sig").alias("node"), "size", "parity"), "node").repartition("key", "tile").sortWithinPartitions("key", "tile")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in groups_of(batches, ("key", "tile")):
                node, group, size = (t.column(c).to_numpy() for c in ("node", "component", "size"))
                bits = [np.frombuffer(x, np.uint64) for x in t.column("parity").to_pylist()]
                for i, j in may_link(size.astype(np.int64), bits, group, least):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j]))], names=["a", "b"])

        return verify(saved(rows.mapInArrow(run, "a long, b long").distinct()))

    known = () if candidates is None else (saved(verify(candidates)),)
    return group_links(members.select("key", "node"), verify, compare, lambda crowded: regrouped(sets, crowded, least), known)
