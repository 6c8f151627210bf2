"""Quality classifier: Naive Bayes support vectors.

Character n-gram and word n-gram indicators (that a text holds an n-gram, and that it does so several times), hashed to a fixed number of buckets, are scaled by class log-count ratios; a
linear hinge-loss model is then fitted to the scaled, length-normalised indicators by dual coordinate descent, and
its margins are turned into probabilities by a logistic curve fitted on out-of-fold margins.

Fitting uses at most about ``max_rows`` labelled rows (a documented bound, chosen by id hash, evenly by class) of at most about ``MAX_FEATURES``
indicators together (a second bound, which thins the rows where texts are long); the log-count ratios are those of that sample. Scoring
streams every whole text once, without a shuffle.

Defined cases: a null or empty text has no indicator and scores by the offset alone; rows with a null id are scored and
never learnt from; repeated rows are scored each; if several labels name one id, the greatest counts, and if several texts have one id, the one of
least hash is learnt from; without labels of both classes the score is 0.5 for every row; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import features as X
from .common import T, bounded, broadcast_if, fitted, id_crc32, labelled_sample, map_rows, saved, table

BITS = 18
SIZES = (2, 3, 4)
MAX_ROWS = 3000
#: Four bytes each go to the task that fits.
MAX_FEATURES = 16_000_000
THRESHOLD = 0.3
DAMPING = 25.0


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # ratio times weight, for each bucket
    ratios: np.ndarray
    bias: float
    slope: float
    offset: float


def labelled(labels: DataFrame, label: str, drop_mod: int | None = 5) -> DataFrame:
    """(doc_id, y) to learn from: rows whose crc32(doc_id as text) mod ``drop_mod`` is not 0."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    if drop_mod:
        rows = rows.where(id_crc32(F.col("doc_id")) % drop_mod != 0)
    return rows.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))


def sparse_rows(
    documents: DataFrame, examples: DataFrame, max_rows: int, bits: int = BITS, sizes: tuple[int, ...] = SIZES, max_features: int = MAX_FEATURES
) -> DataFrame:
    """(doc_id, y, weight, n, idx): the distinct buckets of a bounded sample of labelled documents."""
    sample = saved(labelled_sample(examples, "y", max_rows))
    docs = documents.select("doc_id", "text").join(broadcast_if(sample, sample.count(), 100_000), "doc_id")
    docs = docs.groupBy("doc_id", "y", "weight").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def make():
        def row(text):
            idx = X.indicators(text, bits, sizes).astype("<i4")
            return len(idx), idx.tobytes()

        return row

    return bounded(map_rows(docs, ["text"], make, "n long, idx binary", ["doc_id", "y", "weight"]), "n", max_features)


def fit_rows(rows: DataFrame, fit: Callable[[list[np.ndarray], np.ndarray, np.ndarray], T]) -> T:
    """What ``fit`` makes of the buckets, labels and weights of ``sparse_rows``, in a task of an executor."""

    def of(got: pa.Table, order: list[int]) -> T:
        column = lambda name: got[name].to_numpy()[order]
        return fit([np.frombuffer(got["idx"][i].as_buffer(), "<i4") for i in order], column("y").astype(np.int32), column("weight").astype(float))

    return fitted(rows, ["doc_id"], of)


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, bits: int) -> np.ndarray:
    """log((1 + docs of class 1 with the bucket) / their sum) less the same for class 0."""
    counts = np.ones((2, 1 << bits))
    for idx, label in zip(rows, y):
        counts[int(label > 0), idx] += 1
    share = counts / counts.sum(axis=1, keepdims=True)
    return np.log(share[1] / share[0])


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, bits: int, cost: float = 1.0, epochs: int = 15, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of the L2-regularised hinge-loss model: one dual variable per row, each step solved exactly."""
    w, bias = np.zeros(1 << bits), 0.0
    alpha, sign = np.zeros(len(rows)), np.where(y > 0, 1.0, -1.0)
    # the rarer class costs more, so that both classes weigh the same
    n_pos = max(1, int((y > 0).sum()))
    top = np.where(y > 0, cost * len(y) / (2 * n_pos), cost * len(y) / (2 * max(1, len(y) - n_pos)))
    norm = np.array([v @ v for v in values]) + 1.0
    order, rng = np.arange(len(rows)), np.random.default_rng(seed)
    for _ in range(epochs):
        rng.shuffle(order)
        moved = 0.0
        for i in order:
            gradient = sign[i] * (w[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), top[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                w[rows[i]] += step * values[i]
                bias += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-4:
            break
    return w, bias


def _unit(rows: list[np.ndarray], ratios: np.ndarray) -> list[np.ndarray]:
    return [ratios[i] * _scale(float(ratios[i] @ ratios[i])) for i in rows]


def _scale(squares: float) -> float:
    """Brings a row to one length; short texts, which show little, stay shorter."""
    return 8 / float(np.sqrt(squares + DAMPING))


def fit(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, bits: int = BITS, folds: int = 3) -> Model:
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(1 << bits, np.float32), np.zeros(1 << bits, np.float32), 0.0, 0.0, 0.0)
    part, out = np.arange(len(rows)) % folds, np.zeros(len(rows))
    for k in [*range(folds), -1]:
        own = [i for i in range(len(rows)) if part[i] != k]
        if len(set(y[own].tolist())) < 2:
            continue
        ratios = log_count_ratios([rows[i] for i in own], y[own], bits)
        w, bias = dual_coordinate_descent([rows[i] for i in own], _unit([rows[i] for i in own], ratios), y[own], bits)
        if k >= 0:
            for i in np.flatnonzero(part == k):
                out[i] = w[rows[i]] @ _unit([rows[i]], ratios)[0] + bias
    slope, offset = X.platt(out, y, weight)
    return Model(w.astype(np.float32), ratios.astype(np.float32), bias, slope, offset)


def scorer(model: Model, bits: int = BITS, sizes: tuple[int, ...] = SIZES):
    """The function that scores one text."""
    scaled, squares = (model.weights * model.ratios).astype(np.float64), (model.ratios * model.ratios).astype(np.float64)

    def score(text: str | None) -> float:
        idx = X.indicators(text, bits, sizes)
        margin = float(scaled[idx].sum()) * _scale(float(squares[idx].sum())) + model.bias
        return X.sigmoid(model.slope * margin + model.offset)

    return score


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS) -> Model:
    return Model(**fit_rows(sparse_rows(documents, labelled(labels, label), max_rows), lambda *rows: vars(fit(*rows))))


def classify(documents: DataFrame, model: Model, threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (doc_id if not given) with score and predicted (1 from ``threshold`` on)."""

    def make():
        f = scorer(model)

        def row(text):
            s = f(text)
            return s, int(s >= threshold)

        return row

    return map_rows(documents, ["text"], make, "score double, predicted int", keep or ["doc_id"])


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = classify(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(id_crc32(F.col("doc_id")) % 5 == 0, F.lit(False)).alias("held_out"), "score", "predicted")
