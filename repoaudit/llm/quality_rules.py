"""Quality rules: exact text statistics with fixed limits, and a hashed n-gram logistic regression beside them.

The regression reads indicators of character 2- to 4-grams, words and pairs of words (held, and held several times), hashed to a fixed number of buckets. It is
fitted by adaptive stochastic gradient steps to a bounded sample of labelled rows (``max_rows``, evenly by class), calibrated by a
logistic curve on out-of-fold margins, and scored in Arrow batches against the fixed ``KEEP_AT``. The sample's bounds are those of the quality classifier.

Defined cases: a null text has no words, like an empty one, and so fails the word minimum; repeated rows are judged each;
rows with null ids are judged and never learnt from; without labels of both classes the regression keeps every document;
other columns of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import features as X
from .common import map_rows, table
from .quality_classifier import fit_rows, labelled, sparse_rows

BITS = 18
SIZES = (2, 3, 4)
MAX_ROWS = 3000
KEEP_AT = 0.3
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
DAMPING = 60.0

_IS_SYMBOL = np.isin(np.arange(128), np.frombuffer(SYMBOLS, np.uint8))


def statistics(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    c = X.points(text)
    start, end = X.word_spans(c)
    n = len(start)
    chars = int((end - start).sum())
    symbols = int(np.count_nonzero(_IS_SYMBOL[c[c < 128]]))
    seen: set[str] = set()
    dup = 0
    for line in (text or "").split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            dup += line in seen
            seen.add(line)
    return n, chars, symbols, dup, _repeated(X.span_hashes(c, start, end))


def _repeated(words: np.ndarray) -> int:
    """Words inside windows of ``WINDOW`` words that the text holds twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        h = X.mix(h * np.uint64(3) + words[k : k + n])
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    twice = np.zeros(n, np.bool_)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(edge)))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float
    fitted: bool


def _size(n: int) -> float:
    return 8 / float(np.sqrt(n + DAMPING))


def _steps(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, epochs: int = 6, rate: float = 0.15, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    w, g2, bias, b2 = np.zeros(1 << BITS), np.full(1 << BITS, 1e-2), 0.0, 1e-2
    order, rng = np.arange(len(rows)), np.random.default_rng(11)
    for _ in range(epochs):
        rng.shuffle(order)
        for i in order:
            idx, size = rows[i], _size(len(rows[i]))
            g = (X.sigmoid(float(w[idx].sum()) * size + bias) - y[i]) * weight[i]
            step = g * size + decay * w[idx]
            g2[idx] += step * step
            w[idx] -= rate * step / np.sqrt(g2[idx])
            b2 += g * g
            bias -= rate * g / float(np.sqrt(b2))
    return w, bias


def fit(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, folds: int = 3) -> Model:
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(1 << BITS, np.float32), 0.0, 0.0, 0.0, False)
    part, out = np.arange(len(rows)) % folds, np.zeros(len(rows))
    # in the steps, both classes weigh the same
    even = np.where(y > 0, len(y) / (2 * max(1, int(y.sum()))), len(y) / (2 * max(1, int((1 - y).sum()))))
    for k in [*range(folds), -1]:
        own = np.flatnonzero(part != k)
        if len(set(y[own].tolist())) < 2:
            continue
        w, bias = _steps([rows[i] for i in own], y[own], even[own])
        if k >= 0:
            for i in np.flatnonzero(part == k):
                out[i] = w[rows[i]].sum() * _size(len(rows[i])) + bias
    return Model(w.astype(np.float32), bias, *X.platt(out, y, weight), True)


def train(documents: DataFrame, examples: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """The model, fitted in a task of an executor."""
    return Model(**fit_rows(sparse_rows(documents, examples, max_rows, BITS, SIZES), lambda *rows: vars(fit(*rows))))


def judge(documents: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (doc_id if not given) with the statistics, base_failed, kept and probability."""

    def make():
        weights = model.weights.astype(np.float64)

        def row(text):
            s = statistics(text)
            failed = s[0] < MIN_WORDS or 100 * s[4] > MAX_REPEATED_PERCENT * s[0]
            idx = X.indicators(text, BITS, SIZES)
            p = X.sigmoid(model.slope * (float(weights[idx].sum()) * _size(len(idx)) + model.bias) + model.offset) if model.fitted else 1.0
            return *s, failed, not failed and p >= KEEP_AT, p

        return row

    schema = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double"
    return map_rows(documents, ["text"], make, schema, keep or ["doc_id"])


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    examples = labelled(table(spark, sf_dir, "labels"), "quality")
    return judge(docs, train(docs, examples))
