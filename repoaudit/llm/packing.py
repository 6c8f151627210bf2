"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become token ids and one end id; only longer ones than a sequence are cut, into whole sequences with a shorter first piece.
Whole pieces are sequences of their own. The rest is dealt by hash into blocks of about ``BLOCK`` pieces. Each block evolves on
several islands: an individual is a grouping of the block's pieces into bins; crossover injects whole bins of the better filled half of one
parent into the other, removes the bins that held any of their pieces, and best-fits the displaced pieces, longest first; mutation empties some bins more,
emptier ones rather. An epoch ends at ``CHILDREN`` births, at ``PATIENCE`` births without a better best, or when the bound by tokens is met. After each
epoch every island's best individual, its elite, migrates to the next island of the ring. From a block's best individual the
well-filled bins stay; pieces of the others are dealt anew in the next round, until one block is left or the rounds end.

Blocks are bounded whatever the input, so no task and no driver holds a table; epochs and rounds are shuffles of narrow
rows, and texts never move. Pieces and rounds are written to the checkpoint folder.

Defined cases: a null or empty text is the end id alone; repeated rows and null ids are packed each, told apart by a running number of the
row; an empty table gives no row; other columns of the input are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, saved, table
from .tokens import ByteBpe

CAPACITY = 2048
END = 0
BLOCK = 2000
ISLANDS = 2
EPOCHS = 2
POPULATION = 6
CHILDREN = 64
PATIENCE = 16
MUTATED = 24
ROUNDS = 4
WELL_FILLED = 0.999


def pieces(documents: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's pieces."""

    def make():
        bpe = ByteBpe.public()

        def row(text):
            ids = np.append(bpe.ids(text), END).astype("<u4")
            n = len(ids)
            cuts = [0, *range(n % capacity or capacity, n, capacity), n]
            return ([{"piece": k, "start": a, "length": b - a, "ids_crc32": zlib.crc32(ids[a:b].tobytes())} for k, (a, b) in enumerate(zip(cuts, cuts[1:]))],)

        return row

    schema = "p array<struct<piece:int,start:long,length:long,ids_crc32:long>>"
    return map_rows(documents, ["text"], make, schema, ["doc_id"]).select("doc_id", F.inline("p"))


# --- one block -----------------------------------------------------------------------------------------------------


def best_fit(lengths: np.ndarray, items: np.ndarray, bins: np.ndarray, room: dict[int, int], capacity: int) -> None:
    """Puts ``items`` in their order each into the bin with the least room that takes it, or into a new one."""
    open_ = sorted((r, b) for b, r in room.items() if r > 0)
    new = max(room, default=-1) + 1
    for i in items.tolist():
        n = int(lengths[i])
        at = bisect_left(open_, (n, -1))
        if at < len(open_):
            r, b = open_.pop(at)
        else:
            r, b, new = capacity, new, new + 1
        bins[i] = b
        room[b] = r - n
        if r > n:
            insort(open_, (r - n, b))


def fitness(lengths: np.ndarray, bins: np.ndarray) -> tuple[int, float]:
    """Fewer bins first, then the squares of their fill: greater is better."""
    fill = np.bincount(bins, weights=lengths)
    return -int(np.count_nonzero(fill)), float((fill * fill).sum())


def crossover(lengths: np.ndarray, mother: np.ndarray, father: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    fill = np.bincount(father, weights=lengths)
    used = np.flatnonzero(fill)
    good = used[fill[used] >= np.median(fill[used])]
    injected = np.isin(father, good[rng.random(len(good)) < rng.uniform(0.05, 0.5)])
    own = np.bincount(mother, weights=lengths)
    emptied = np.zeros(len(own), np.bool_)
    emptied[mother[injected]] = True
    used = np.flatnonzero(own)
    spare = capacity - own[used] + 1
    emptied[rng.choice(used, size=min(len(used), int(rng.integers(1, MUTATED + 1))), replace=False, p=spare / spare.sum())] = True
    child = mother.copy()
    displaced = emptied[mother] & ~injected
    child[injected] = len(own) + father[injected]
    child[displaced] = -1
    labels, dense = np.unique(child[~displaced], return_inverse=True)
    child[~displaced] = dense
    room = dict(enumerate((capacity - np.bincount(dense, weights=lengths[~displaced], minlength=len(labels))).astype(np.int64).tolist()))
    best_fit(lengths, np.flatnonzero(displaced), child, room, capacity)
    return child


def evolve(lengths: np.ndarray, seeds: list[np.ndarray], capacity: int, seed: int, population: int = POPULATION, children: int = CHILDREN, patience: int = PATIENCE) -> np.ndarray:
    """The best grouping found; ``lengths`` stand in descending order, ``seeds`` are groupings to start from."""
    rng = np.random.default_rng(seed)
    people = list(seeds)
    while len(people) < population:
        order = np.argsort(-lengths * (1 + 0.05 * len(people) * rng.random(len(lengths))), kind="stable") if people else np.arange(len(lengths))
        bins = np.full(len(lengths), -1, np.int64)
        best_fit(lengths, order, bins, {}, capacity)
        people.append(bins)
    rated = sorted(((fitness(lengths, p), k, p) for k, p in enumerate(people)), key=lambda x: x[:2], reverse=True)
    least = -(-int(lengths.sum()) // capacity)
    born, since = len(rated), 0
    for _ in range(children):
        if -rated[0][0][0] <= least or since >= patience:
            break
        best = rated[0][0]
        a, b = rng.choice(len(rated), 2, replace=False)
        child = crossover(lengths, rated[min(a, b)][2], rated[max(a, b)][2], capacity, rng)
        rated.append((fitness(lengths, child), born, child))
        born += 1
        rated = sorted(rated, key=lambda x: x[:2], reverse=True)[:population]
        since = 0 if rated[0][0] > best else since + 1
    return rated[0][2]


# --- all blocks ----------------------------------------------------------------------------------------------------

_STATE = "block long, island int, row_id long, length long, bin long"


def _epoch(capacity: int, salt: int):
    """Evolves one (block, island) from the individuals that its rows name in ``origin``."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["origin", "length", "row_id"], ascending=[True, False, True], kind="stable")
        groups = [g for _, g in rows.groupby("origin", sort=True)]
        seeds = [g["bin"].to_numpy(np.int64) for g in groups if g["bin"].iloc[0] >= 0]
        first = groups[0]
        seed = (int(key[0]) * 1009 + int(key[1]) * 31 + salt) & 0x7FFFFFFF
        bins = evolve(first["length"].to_numpy(np.int64), seeds, capacity, seed)
        return pd.DataFrame({"block": key[0], "island": key[1], "row_id": first["row_id"].to_numpy(), "length": first["length"].to_numpy(), "bin": bins})

    return run


def _elite(capacity: int):
    """The best individual of one block's islands, as places in sequences."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        best = max((g for _, g in rows.groupby("island", sort=True)), key=lambda g: fitness(g["length"].to_numpy(), g["bin"].to_numpy(np.int64)))
        best = best.sort_values(["bin", "row_id"])
        by = best.groupby("bin")
        return pd.DataFrame({
            "row_id": best["row_id"], "length": best["length"], "sequence_id": by["row_id"].transform("min"),
            "offset": by["length"].cumsum() - best["length"], "fill": by["length"].transform("sum"),
        })

    return run


def pack(items: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, rounds: int = ROUNDS) -> DataFrame:
    """(row_id, sequence_id, offset) for items (row_id, length): every item once, no sequence over ``capacity``, offsets gapless."""
    whole = items.where(F.col("length") >= capacity).select("row_id", F.col("row_id").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest, placed = items.where(F.col("length") < capacity), [whole]
    for r in range(rounds):
        blocks = max(1, round(rest.count() / block))
        last = blocks == 1 or r == rounds - 1
        dealt = rest.select(F.pmod(F.xxhash64(F.lit(r), "row_id"), F.lit(blocks)).alias("block"), F.explode(F.array(*map(F.lit, range(ISLANDS)))).alias("island"), "row_id", "length")
        state = dealt.withColumn("bin", F.lit(-1).cast("long")).withColumn("origin", F.lit(0))
        for epoch in range(EPOCHS):
            elite = state.groupBy("block", "island").applyInPandas(_epoch(capacity, 7919 * r + 101 * epoch), _STATE)
            # each island's best stays and goes to the next island of the ring
            there = F.array(F.struct(F.col("island").alias("island"), F.lit(0).alias("origin")), F.struct(((F.col("island") + 1) % ISLANDS).alias("island"), F.lit(1).alias("origin")))
            state = elite.select("block", "row_id", "length", "bin", F.explode(there).alias("t")).select("block", "t.island", "row_id", "length", "bin", "t.origin")
        done = saved(elite.groupBy("block").applyInPandas(_elite(capacity), "row_id long, length long, sequence_id long, offset long, fill long"))
        keep = F.lit(True) if last else F.col("fill") >= WELL_FILLED * capacity
        placed.append(done.where(keep).select("row_id", "sequence_id", "offset"))
        if last:
            break
        rest = done.where(~keep).select("row_id", "length")
    out = placed[0]
    for p in placed[1:]:
        out = out.unionByName(p)
    return out


def pack_documents(documents: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document."""
    rows = saved(pieces(documents, capacity).withColumn("row_id", F.monotonically_increasing_id()))
    return rows.join(pack(rows.select("row_id", "length"), capacity), "row_id").drop("row_id")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
