"""SimHash near-duplicates by a Gray-order hierarchical index.

Equal fingerprints are one class. Cut into ``limit + m`` bit blocks, two 64-bit fingerprints that differ in at most ``limit``
bits agree on at least m blocks, so every class is dealt out once for each choice of m blocks (3 times for two bits, 84 times for six),
with these blocks moved to the leading bits. Within a task the rows are sorted by Gray rank, which keeps rows of equal leading
blocks together and neighbours alike; leaves of a few rows and the nodes above them hold the bit pattern that all their
rows share (a mask and its values). A search goes down this tree with the differences counted so far, adds only
those on the bits that a node newly shares, and drops the whole group once they exceed the limit or the leading blocks differ.

Leading blocks shared by more than ``MAX_GROUP`` classes never meet in one task. For two bits their classes are linked through
the 65 fingerprints within one bit of each instead: two fingerprints at most two bits apart share such a neighbour, and no neighbour has more
than 65 classes, so this way is exact and linear for any skew. For more bits ``graph.group_links`` compares such groups. Tasks send a spanning set of
their links, not all pairs; components come from alternating large-star and small-star steps on tables, each written to the checkpoint folder.

Fingerprints see only very near copies: texts at a Jaccard similarity of 0.8 differ in some ten of 64 bits. ``deduplicate`` therefore links, beside texts within
``limit`` bits, all texts whose sets of shingles are at ``least`` or more (``shingle_links``).

Defined cases: a null or blank text has fingerprint zero and links like any other; repeated rows and texts share a class;
for ``near_duplicates`` rows with a null id get a fingerprint and a null component and link nothing; with shingles of ``n`` words, texts of fewer words
count as one shingle; other columns of the input are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shingle_links
from .common import broadcast_if, counted, map_rows, packed, saved, table, unpacked
from .graph import components, group_links, groups_of, local_components

MAX_GROUP = 8192
FANOUT, LEAF = 8, 16


def shingles(text: str | None, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` words of one text, repeats included; none for a blank text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= n:
        runs = [b" ".join(words)]
    else:
        runs = map(b" ".join, zip(*(words[k:] for k in range(n))))
    return np.array([xxhash.xxh64_intdigest(s, 42) for s in runs], np.uint64)


def majority(h: np.ndarray) -> int:
    """The signed 64-bit SimHash of shingle hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 14):
        part = np.unpackbits(h[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += part.sum(axis=0, dtype=np.int32)
    bits = np.packbits(2 * ones > len(h), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprint(text: str | None, n: int = 3) -> int:
    """The signed 64-bit SimHash of one text."""
    return majority(shingles(text, n))


def fingerprints(documents: DataFrame, n: int = 3, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (doc_id if not given) with ``fp``, the SimHash as a signed long."""
    return map_rows(documents, ["text"], lambda: lambda text: (fingerprint(text, n),), "fp long", keep or ["doc_id"])


def choices(limit: int) -> list[tuple[list[tuple[int, int]], int]]:
    """For each choice of agreeing blocks: all blocks as (lowest bit, width) with the chosen ones first, and the mask of the chosen bits."""
    m = max(1, limit // 2)
    n = limit + m
    edges = [round(64 * i / n) for i in range(n + 1)]
    blocks = [(64 - b, b - a) for a, b in zip(edges, edges[1:])]
    out = []
    for chosen in itertools.combinations(range(n), m):
        order = [blocks[i] for i in chosen] + [blocks[i] for i in range(n) if i not in chosen]
        out.append((order, sum(((1 << w) - 1) << low for low, w in order[:m])))
    return out


def moved(fp: np.ndarray, order: list[tuple[int, int]]) -> np.ndarray:
    """``fp`` with its blocks put in the given order, first block leading."""
    out = np.zeros_like(fp)
    for low, width in order:
        out = (out << np.uint64(width)) | ((fp >> np.uint64(low)) & np.uint64((1 << width) - 1))
    return out


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of a bit pattern in the reflected Gray sequence."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


class GrayIndex:
    """The tree over fingerprints sorted by Gray rank."""

    def __init__(self, values: np.ndarray):
        """``values``: uint64, already in Gray order."""
        self.values, self.levels = values, []
        ones, some = values, values
        step = LEAF
        while True:
            starts = np.arange(0, len(ones), step)
            ones, some = np.bitwise_and.reduceat(ones, starts), np.bitwise_or.reduceat(some, starts)
            mask = ~(ones ^ some)
            self.levels.append([mask, ones & mask, mask])
            if len(starts) == 1:
                break
            step = FANOUT
        for below, above in zip(self.levels, self.levels[1:]):
            below[2] = below[0] & ~np.repeat(above[0], FANOUT)[: len(below[0])]  # bits that the node above doesn't share

    def links(self, limit: int, must: np.uint64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of places (i < j) whose values differ in at most ``limit`` bits and agree on ``must``, in batches."""
        n = len(self.values)
        for at in range(0, n, 1024):
            q = np.arange(at, min(n, at + 1024))
            node, far = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
            for depth, (_, pattern, residual) in enumerate(reversed(self.levels)):
                differ = (self.values[q] ^ pattern[node]) & residual[node]
                far = far + np.bitwise_count(differ)
                alive = (far <= limit) & ((differ & must) == 0)
                q, node, far = q[alive], node[alive], far[alive]
                last = depth == len(self.levels) - 1
                width, size = (LEAF, n) if last else (FANOUT, len(self.levels[len(self.levels) - 2 - depth][0]))
                if last:
                    break
                q, far = np.repeat(q, width), np.repeat(far, width)
                node = (node[:, None] * width + np.arange(width)).ravel()
                inside = node < size
                q, node, far = q[inside], node[inside], far[inside]
            for part in range(0, len(q), 1 << 16):
                a = np.repeat(q[part : part + (1 << 16)], LEAF)
                b = (node[part : part + (1 << 16), None] * LEAF + np.arange(LEAF)).ravel()
                ok = (b > a) & (b < n)
                a, b = a[ok], b[ok]
                differ = self.values[a] ^ self.values[b]
                ok = (np.bitwise_count(differ) <= limit) & ((differ & must) == 0)
                if ok.any():
                    yield a[ok], b[ok]


def _task_links(limit: int):
    """Links of the rows of one task, which come sorted by choice of blocks and the blocks' value."""
    plan = choices(limit)
    m = max(1, limit // 2)

    def pack(choice: int, fp: np.ndarray, rep: np.ndarray) -> pa.RecordBatch:
        order, _ = plan[choice]
        values = moved(fp, order)
        by_rank = np.argsort(gray_rank(values), kind="stable")
        rep = rep[by_rank]
        width = sum(w for _, w in order[:m])
        must = ((np.uint64(1) << np.uint64(width)) - np.uint64(1)) << np.uint64(64 - width)
        label = local_components(len(rep), GrayIndex(values[by_rank]).links(limit, must))
        own = label != np.arange(len(rep))
        return pa.RecordBatch.from_arrays([pa.array(rep[own]), pa.array(rep[label[own]])], names=["a", "b"])

    def packs(rows: dict[str, np.ndarray], start: int, end: int) -> Iterator[pa.RecordBatch]:
        part = {c: v[start:end] for c, v in rows.items()}
        same = (part["key"][1:] == part["key"][:-1]) & (part["choice"][1:] == part["choice"][:-1])
        paired = np.zeros(end - start, np.bool_)  # a row alone with its blocks has no link here
        paired[1:] |= same
        paired[:-1] |= same
        for choice in np.unique(part["choice"][paired]):
            at = np.flatnonzero(paired & (part["choice"] == choice))
            yield pack(int(choice), part["fp"][at].view(np.uint64), part["rep"][at])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: dict[str, np.ndarray] | None = None
        for batch in batches:
            new = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("choice", "key", "fp", "rep")}
            rest = new if rest is None else {c: np.concatenate([rest[c], new[c]]) for c in new}
            changes = (rest["key"][1:] != rest["key"][:-1]) | (rest["choice"][1:] != rest["choice"][:-1])
            edge, done = np.flatnonzero(changes) + 1, 0
            while len(rest["key"]) - done > 2 * MAX_GROUP:  # cut behind the last whole group that fits
                last = np.searchsorted(edge, done + MAX_GROUP, "right") - 1
                if last < 0 or edge[last] <= done:
                    last += 1
                    if last >= len(edge):
                        break
                yield from packs(rest, done, int(edge[last]))
                done = int(edge[last])
            rest = {c: v[done:] for c, v in rest.items()}
        if rest is not None and len(rest["key"]):
            yield from packs(rest, 0, len(rest["key"]))

    return run


def links(classes: DataFrame, limit: int = 2) -> DataFrame:
    """(a, b): a spanning set of the links between the classes (fp, rep) at ``limit`` or fewer differing bits, by rep."""
    signed = lambda mask: mask - (1 << 64) if mask >> 63 else mask
    structs = (F.struct(F.lit(i).cast("tinyint").alias("choice"), F.col("fp").bitwiseAND(F.lit(signed(mask)).cast("long")).alias("key")) for i, (_, mask) in enumerate(choices(limit)))
    keyed = classes.select("fp", "rep", F.explode(F.array(*structs)).alias("k")).select("k.choice", "k.key", "fp", "rep")
    large = saved(keyed.groupBy("choice", "key").count().where(F.col("count") > MAX_GROUP).select("choice", "key"))
    n_large = counted(large)
    if n_large:
        hint = broadcast_if(large, n_large, 100_000)
        hot = keyed.join(hint, ["choice", "key"])
        keyed = keyed.join(hint, ["choice", "key"], "left_anti")
    by_tree = keyed.repartition("choice", "key").sortWithinPartitions("choice", "key").mapInArrow(_task_links(limit), "a long, b long")
    if not n_large:
        return by_tree
    return by_tree.unionByName(_near(hot) if limit == 2 else _crowded(hot, limit))


def _near(hot: DataFrame) -> DataFrame:
    """Links at two or fewer bits, through the fingerprints within one bit of each."""
    flips = F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")
    near = hot.select("fp", "rep").distinct().select("rep", F.explode(flips).alias("near")).groupBy("near").agg(F.collect_set("rep").alias("reps"))
    return near.where(F.size("reps") > 1).select(F.explode("reps").alias("a"), F.array_min("reps").alias("b")).where("a <> b")


def _crowded(hot: DataFrame, limit: int) -> DataFrame:
    """Links at ``limit`` or fewer bits within large groups of equal blocks."""
    prints = saved(hot.select("rep", "fp").distinct())

    def verify(pairs: DataFrame) -> DataFrame:
        side = lambda c: prints.select(F.col("rep").alias(c), F.col("fp").alias(f"{c}_fp"))
        return pairs.join(side("a"), "a").join(side("b"), "b").where(F.bit_count(F.col("a_fp").bitwiseXOR(F.col("b_fp"))) <= limit).select("a", "b")

    def compare(rows: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in groups_of(batches, ("key", "tile")):
                node, group, fp = (t.column(c).to_numpy() for c in ("node", "component", "fp"))
                fp = fp.view(np.uint64)
                for at in range(0, len(fp), 256):
                    near = (np.bitwise_count(fp[at : at + 256, None] ^ fp[None]) <= limit) & (group[at : at + 256, None] != group[None])
                    i, j = np.nonzero(near)
                    if len(i):
                        yield pa.RecordBatch.from_arrays([pa.array(node[at + i]), pa.array(node[j])], names=["a", "b"])

        rows = rows.join(prints.withColumnRenamed("rep", "node"), "node").repartition("key", "tile").sortWithinPartitions("key", "tile")
        return rows.mapInArrow(run, "a long, b long").distinct()

    return group_links(saved(hot.select(F.xxhash64("choice", "key").alias("key"), F.col("rep").alias("node")).distinct()), verify, compare)


def near_duplicates(documents: DataFrame, n: int = 3, limit: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) of every row: shingles of ``n`` words, links at ``limit`` or fewer differing bits."""
    prints = saved(fingerprints(documents, n))
    classes = saved(prints.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    linked = components(links(classes, limit))
    label = classes.join(linked.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    out = prints.select("doc_id", "fp").join(label, "fp", "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def deduplicate(documents: DataFrame, n: int = 5, limit: int = 2, least: float = 0.8) -> DataFrame:
    """``documents`` with one row of each group of near-duplicates, all columns kept.

    Texts are linked whose whole sets of ``n``-word shingles have a Jaccard similarity of ``least`` or more; candidates are those whose fingerprints lie within ``limit``
    bits, by the Gray index, and those that share a MinHash band. Groups are whatever such links join. The row with the smallest id stays, of several the one whose text has the least hash; a null id
    comes after all others. Rows are told apart by id and text, so no text is lost by an id that repeats; of rows equal in both one stays.
    """
    texts = documents.select("doc_id", F.xxhash64("text").alias("th"), "text")

    def row(text: str | None) -> tuple:
        h = shingles(text, n)
        s = np.unique(h)
        return majority(h), shingle_links.signature(s), len(s), shingle_links.bands(s, least).tolist()

    prints = saved(map_rows(texts, ["text"], lambda: row, "fp long, sig long, size int, bands array<long>", ["doc_id", "th"]))
    # a class of equal fingerprints goes by the smallest signature in it
    classes = saved(prints.groupBy("fp").agg(F.min("sig").alias("rep"), F.max("sig").alias("high")))
    equal = prints.select("fp", F.col("sig").alias("a")).join(classes.where("rep <> high").select("fp", F.col("rep").alias("b")), "fp").select("a", "b").where("a <> b")
    near = links(classes.select("fp", "rep"), limit).unionByName(equal)
    label = saved(components(shingle_links.links(texts, prints, lambda text: shingles(text, n), least, near))).select(F.col("node").alias("sig"), "component")
    row_key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th").alias("row_key")
    named = saved(prints.select("sig", row_key).join(broadcast_if(label, counted(label), 1 << 18), "sig", "left").select(F.coalesce("component", "sig").alias("group"), "row_key"))
    groups = named.groupBy("group").agg(F.min("row_key").alias("first"), F.count("*").alias("n")).where("n > 1").select("group", "first")
    marked = saved(named.join(groups, "group").select("row_key", F.col("row_key").eqNullSafe(F.col("first")).alias("stays")))
    gone = saved(marked.where("NOT stays").select("row_key.doc_id", "row_key.th").distinct())
    again = saved(marked.where("stays").groupBy("row_key").count().where("count > 1").select("row_key.doc_id", "row_key.th"))
    rows = documents.select(packed(documents), "doc_id", F.xxhash64("text").alias("th"))

    def matched(df: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        keys = broadcast_if(keys.select(F.col("doc_id").alias("k_id"), F.col("th").alias("k_th")), counted(keys), 1 << 18)
        return df.join(keys, F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("th") == F.col("k_th")), how)

    kept = matched(rows, gone, "left_anti")
    if not again.isEmpty():
        repeated = matched(rows, again, "left_semi").groupBy("doc_id", "th").agg(F.first("own_row").alias("own_row"))
        kept = matched(kept, again, "left_anti").unionByName(repeated.select("own_row", "doc_id", "th"))
    return unpacked(kept, documents.columns)


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
