"""Components of graphs whose edges are table rows, and links within groups of any size.

A group of G nodes is not compared each with each. Its nodes are first compared with one centre of the group, and nodes that prove linked
are one from then on; after a few such rounds with other centres only nodes of different components still have to be compared. These
remaining rows are compared within tasks, a large group cut into tiles of which each pair is a task, and only links leave a task. Where the caller
has a sharper grouping, large groups are dealt into that first, so what is common to many nodes that are not linked costs no comparison of all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import first_row, saved

#: Rows of one tile, and rounds of comparing with centres.
TILE, ROUNDS = 2048, 3


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of the edges (a, b) reaches, itself included.

    Each round's large-star step ties larger neighbours of a node to its smallest one, the small-star step the
    smaller ones; both keep connections and end at stars.
    """
    now = saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = _told(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        star = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = star.groupBy("u").agg(F.min("v").alias("m"))
        new = star.join(down, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = saved(new.select("e.u", "e.v").where("u <> v").distinct())
        told = _told(now)
        if told == state:
            return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
        state = told


def _told(edges: DataFrame) -> tuple:
    """Count and checksum of edges, which tell whether a step changed any."""
    return tuple(first_row(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))))


def _stars(label: DataFrame) -> DataFrame:
    """(a, b): the edges of components (node, component), which join what the edges behind them join."""
    return label.select(F.col("node").alias("a"), F.col("component").alias("b")).where("a <> b")


def local_components(n: int, batches: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest place that each of ``n`` places reaches."""
    label = np.arange(n)
    for a, b in batches:
        while True:
            la, lb = label[a], label[b]
            open_ = la != lb
            if not open_.any():
                break
            a, b = a[open_], b[open_]
            low, high = np.minimum(la, lb)[open_], np.maximum(la, lb)[open_]
            np.minimum.at(label, high, low)
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up
    return label


def groups_of(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """The rows of each value of ``keys``, which come sorted by them."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        values = [batch.column(k).to_numpy() for k in keys]
        edges = np.flatnonzero(reduce(np.logical_or, (v[1:] != v[:-1] for v in values))) + 1
        cuts = [0, *edges.tolist(), len(batch)]
        for k, (start, end) in enumerate(zip(cuts, cuts[1:])):
            if k == 0 and rest and any(rest[-1].column(c)[-1] != batch.column(c)[0] for c in keys) or k and rest:
                yield pa.Table.from_batches(rest)
                rest = []
            rest.append(batch.slice(start, end - start))
    if rest:
        yield pa.Table.from_batches(rest)


def _joined(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _tiled(sizes: DataFrame) -> DataFrame:
    """(key, tile, node, component) of groups (with their size ``n``): each pair of tiles of a group is a tile here."""
    tiles = sizes.withColumn("tiles", F.ceil(F.col("n") / TILE)).withColumn("mine", F.pmod(F.xxhash64(F.lit("tile"), "node"), "tiles"))
    tiles = tiles.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    return tiles.select("key", (F.least("mine", "other") * F.col("tiles") + F.greatest("mine", "other")).alias("tile"), "node", "component")


def group_links(
    members: DataFrame, verify: Callable[[DataFrame], DataFrame], compare: Callable[[DataFrame], DataFrame], regroup: Callable[[DataFrame], DataFrame] | None = None,
    known: tuple[DataFrame, ...] = (), labels: DataFrame | None = None,
) -> DataFrame:
    """(a, b): links that join whatever the links between two nodes of one group join; ``members`` has distinct (key, node).

    ``verify`` returns those rows of pairs (a, b) that are links. ``compare`` gets rows (key, tile, node, component) dealt out and sorted by key and tile, and returns
    the links (a, b) between rows of one key and tile that lie in different components. ``regroup`` gets the nodes of groups that are still large and not joined, and deals
    them into other groups (key, node), of which every link between two of them has one in common; without it such groups are compared tile by tile.
    ``known`` are links found before, ``labels`` components (node, component) that some of them make.
    """
    found, now = list(known), members.withColumn("component", F.col("node")) if labels is None else members.join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    for r in range(ROUNDS):
        if r:
            label = components(_joined(found))
            found, label = [_stars(label)], label.withColumnRenamed("component", "reached")  # the next round starts from what is joined already
            now = saved(now.drop("component").join(label, "node", "left").select("key", "node", F.coalesce("reached", "node").alias("component")))
            several = now.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
            now = saved(now.join(several, "key"))
            if now.isEmpty():
                return _joined(found)
        centre = F.min(F.struct(F.xxhash64(F.lit(r), "node").alias("order"), "node", "component"))
        stars = now.groupBy("key").agg(centre.alias("c")).select("key", F.col("c.node").alias("centre"), F.col("c.component").alias("own"))
        pairs = now.join(stars, "key").where("component <> own").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
        found.append(saved(verify(pairs)))
    reached = components(_joined(found))
    found = [_stars(reached)]
    label = reached.withColumnRenamed("component", "reached")
    now = saved(now.drop("component").join(label, "node", "left").select("key", "node", F.coalesce("reached", "node").alias("component")))
    several = now.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).where("low <> high").select("key", "n")
    sizes = saved(now.join(several, "key"))
    if sizes.isEmpty():
        return _joined(found)
    if regroup is not None:
        crowded = saved(sizes.where(F.col("n") > TILE).select("node").distinct())
        if not crowded.isEmpty():
            found.append(saved(compare(_tiled(sizes.where(F.col("n") <= TILE)))))
            return group_links(regroup(crowded), verify, compare, None, tuple(found), reached)
    return _joined([*found, compare(_tiled(sizes))])
