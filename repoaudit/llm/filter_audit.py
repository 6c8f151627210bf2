"""How filters interact: what each removes, repeats and alone catches in every order of applying them, per part of a corpus.

A part's documents are counted by the outcomes of all its filters, a tensor of two cells (pass, fail) along one axis a filter. One einsum contracts every axis
with the three selections pass, fail and all; each number of each step of each order is then one cell of the contracted tensor. So documents are read
once, and everything behind that works on at most 2^filters counts a part.

Defined cases: a null text counts as empty, a null source is the part ``''``; a null id is no smaller id and has none, and has no label; repeated rows are
documents each, and rows of one id and text are not identical to a *smaller* id; of several label rows of a document, 1 wins over other values; an
empty table has no parts and so no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lookup, saved, table

PASS, FAIL, ALL = 0, 1, 2
#: what is counted for each part and outcome
COUNTED = ("n", "n_good", "n_toxic")
SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def text_conditions(text: Column) -> dict[str, Column]:
    """The failure conditions A to D, which depend on the text alone."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), "")
    n_words = F.size(words)
    return {
        "A": n_words < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * n_words,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.char_length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def outcomes(documents: DataFrame, source: str = "source") -> DataFrame:
    """(doc_id, part, mask) of every document: bit k of ``mask`` is set if it fails the k-th of the filters A to E.

    Only E needs other documents: digests of texts that repeat meet their documents with hot ones broadcast apart (``lookup``), texts stay where they are read.
    """
    text = F.coalesce("text", F.lit(""))
    bits = [F.when(fails, 1 << k).otherwise(0) for k, fails in enumerate(text_conditions(text).values())]
    rows = documents.select("doc_id", F.coalesce(source, F.lit("")).alias("part"), sum(bits[1:], bits[0]).alias("mask"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    rows = saved(rows)
    groups = saved(rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1"))
    found = lookup(rows, groups, "digest", rows.count())
    repeats = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))
    return found.select("doc_id", "part", (F.col("mask") + F.when(repeats, 1 << len(bits)).otherwise(0)).alias("mask"))


def contingency(judged: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts per (part, mask), of all documents and of those labelled good and toxic. Labels meet only documents that have them."""
    marks = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("bad"))
    zero = F.lit(0).cast("long")
    everything = judged.groupBy("part", "mask").agg(F.count("*").alias("n")).select("part", "mask", "n", zero.alias("n_good"), zero.alias("n_toxic"))
    labelled = judged.join(marks, "doc_id").groupBy("part", "mask").agg(F.coalesce(F.sum("good"), zero).alias("n_good"), F.coalesce(F.sum("bad"), zero).alias("n_toxic"))
    both = everything.unionByName(labelled.select("part", "mask", zero.alias("n"), "n_good", "n_toxic"))
    return both.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in COUNTED))


def contracted(tensor: np.ndarray) -> np.ndarray:
    """``tensor`` (parts, counts, 2, ..., 2) with each outcome axis contracted to pass, fail and all: (parts, counts, 3, ..., 3)."""
    k = tensor.ndim - 2
    inner, outer = ascii_lowercase[:k], ascii_uppercase[:k]
    select = np.array([[1, 0], [0, 1], [1, 1]], np.int64)
    spec = f"yz{inner}," + ",".join(o + i for i, o in zip(inner, outer)) + f"->yz{outer}"
    return np.einsum(spec, tensor, *[select] * k, optimize="greedy")


def step_cells(filters: int) -> tuple[list[tuple[int, ...]], dict[str, np.ndarray]]:
    """All orders of so many filters, and for each (order, step) the cell (a selection for each axis) of every number."""
    orders = list(permutations(range(filters)))
    cells = {name: np.full((len(orders), filters, filters), fill) for name, fill in (("kept", ALL), ("removed", ALL), ("fails", ALL), ("alone", PASS))}
    for o, order in enumerate(orders):
        for s, axis in enumerate(order):
            cells["kept"][o, s, list(order[: s + 1])] = PASS
            cells["removed"][o, s, list(order[:s])] = PASS
            for name in ("removed", "fails", "alone"):
                cells[name][o, s, axis] = FAIL
    return orders, cells


def steps(counts: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """A row for every part, order and step from ``counts`` (part, mask and COUNTED); a part is one row of at most 2^filters counts."""
    k = len(filters)
    packed = counts.groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTED)).alias("cells"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders, cells = step_cells(k)
        axis_of = np.array(orders)
        names = np.array(["".join(filters[i] for i in order) for order in orders]).repeat(k)
        step_no = np.tile(np.arange(1, k + 1, dtype=np.int32), len(orders))
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64).to_pydict()
                tensor = np.zeros((len(part["part"]), len(COUNTED), *[2] * k), np.int64)
                for p, found in enumerate(part["cells"]):
                    for cell in found:
                        tensor[(p, slice(None), *((cell["mask"] >> i) & 1 for i in range(k)))] = [cell[c] for c in COUNTED]
                cube = contracted(tensor)
                # cell numbers are (parts, counts, orders, steps)
                read = {name: cube[(slice(None), slice(None), *np.moveaxis(cell, -1, 0))] for name, cell in cells.items()}
                removed = read["removed"][:, 0]
                by_filter = np.stack([np.where(axis_of == f, removed, 0).sum(axis=(1, 2)) for f in range(k)], axis=1)
                values = [read["kept"][:, 0], removed, read["fails"][:, 0] - removed, read["alone"][:, 0], read["removed"][:, 1], read["removed"][:, 2], by_filter[:, axis_of]]
                n = len(part["part"])
                columns = [pa.array([p for p in part["part"] for _ in range(len(names))], pa.string()), pa.array(np.tile(names, n).tolist(), pa.string()), pa.array(np.tile(step_no, n))]
                columns += [pa.array(np.ascontiguousarray(v).reshape(-1)) for v in values]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCHEMA.split(", ")])

    return packed.mapInArrow(run, SCHEMA)


def audit_filters(documents: DataFrame, labels: DataFrame, source: str = "source") -> DataFrame:
    """Kept, removed, redundant and lost documents of the filters A to E per part (value of ``source``), order and step."""
    return steps(contingency(outcomes(documents, source), labels))


def op12_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_SPACE = r"[\x20\x09-\x0D]+"

ORACLE_SQL = rf"""
WITH texts AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body,
        list_filter(string_split_regex(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '') AS words
    FROM documents
), judged AS (
    SELECT doc_id, part,
        CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
        + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
        + CASE WHEN 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 2 * length(body) THEN 4 ELSE 0 END
        + CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 8 ELSE 0 END
        + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY body) THEN 16 ELSE 0 END AS mask
    FROM texts
), marks AS (
    SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id
), cells AS (
    SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS n_good, coalesce(sum(bad), 0) AS n_toxic
    FROM judged LEFT JOIN marks USING (doc_id) GROUP BY part, mask
), letters(l, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), orders AS (
    SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
    FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps AS (
    SELECT filter_order, s AS step, bits[s] AS bit, coalesce(list_sum(bits[1:s - 1]), 0)::BIGINT AS before
    FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS s)
), numbers AS (
    SELECT part, filter_order, step, bit,
        sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN mask & before > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n_good ELSE 0 END) AS good_lost,
        sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n_toxic ELSE 0 END) AS toxic_lost
    FROM cells, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
    good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM numbers
"""
