"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by stochastic gradient descent.

A text is the mean of the embeddings of its character 2- to 4-grams, each hashed to one of 2**BITS rows; a linear layer and a
softmax follow. Embeddings and layer are trained in numpy on a bounded sample of rows with a known language (about ``max_rows``, chosen by id
hash, evenly by language, of at most about ``MAX_FEATURES`` n-grams together). A third of that sample is held back: it sets the softmax temperature and the least
probability that is accepted, below which a share of ``LOST`` of its rightly predicted rows lies. For scoring, embeddings and layer are multiplied
once, so a text costs one table look-up per n-gram. There may be any number of languages; those with few rows give all of them.

Defined cases: a null text or one without a letter is ``und`` with score 0 and not accepted; rows with a null id or language are
predicted and never learnt from; repeated rows are predicted each and learnt from once; with no row to learn from every text is ``und``; other
columns of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import features as X
from .common import bounded, fitted, id_crc32, labelled_sample, map_rows, table

BITS = 15
SIZES = (2, 3, 4)
DIM = 16
MAX_ROWS = 3000
#: Eight bytes each go to the task that fits.
MAX_FEATURES = 8_000_000
UNKNOWN = "und"
#: Share of rightly predicted held-back rows that the rejection may lose, and the highest bound it may set.
LOST, MOST = 0.002, 0.9
HELD = 3
#: Least passes over the sample, and least gradient steps, for small samples of many languages.
EPOCHS, STEPS = 6, 12_000


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    table: np.ndarray  # embeddings times layer
    bias: np.ndarray
    temperature: float
    accept_at: float


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def _rows(documents: DataFrame, max_rows: int) -> DataFrame:
    """A bounded sample (doc_id, th, lang, idx, n) of the rows to learn from, as n-grams and their numbers."""
    known = documents.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (id_crc32(F.col("doc_id")) % 4 != 2))
    sample = labelled_sample(known.select("doc_id", "lang", F.xxhash64("text").alias("th"), "text"), "lang", max_rows, ("doc_id", "th"))
    docs = sample.groupBy("doc_id", "lang", "th", "weight").agg(F.first("text").alias("text"))

    def make():
        def row(text):
            idx, n = np.unique(X.grams(text, BITS, SIZES, False), return_counts=True)
            return len(idx), idx.astype("<i4").tobytes(), n.astype("<f4").tobytes(), has_letter(text)

        return row

    rows = map_rows(docs, ["text"], make, "size long, idx binary, n binary, letters boolean", ["doc_id", "lang", "th", "weight"]).where("letters AND size > 0")
    return bounded(rows, "size", MAX_FEATURES).select("doc_id", "th", "lang", "idx", "n")


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], epochs: int = EPOCHS, rate: float = 0.5, seed: int = 5) -> Model:
    languages = tuple(sorted({r[0] for r in rows}))
    if not languages:
        return Model((), np.zeros((1 << BITS, 0)), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    E = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM))
    W, bias = np.zeros((DIM, len(languages))), np.zeros(len(languages))
    y = np.array([languages.index(r[0]) for r in rows])
    train = [i for i in range(len(rows)) if i % HELD] or list(range(len(rows)))
    epochs = max(epochs, -(-STEPS // len(train)))
    total = epochs * len(train)
    done = 0
    for _ in range(epochs):
        rng.shuffle(train)
        for i in train:
            _, idx, n = rows[i]
            share = n / n.sum()
            e = share @ E[idx]
            z = e @ W + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            step = rate * (1 - done / total)
            back = W @ p
            W -= step * np.outer(e, p)
            bias -= 0.1 * step * p
            # the mean spreads a step thinly over the n-grams, so each takes it times their number
            E[idx] -= step * np.outer(share * min(len(idx), 200), back)
            done += 1
    P = (E @ W).astype(np.float32)
    held = [i for i in range(len(rows)) if i % HELD == 0] or train
    z = np.array([(rows[i][2] / rows[i][2].sum()) @ P[rows[i][1]] + bias for i in held])
    best = min((float(_loss(z / t, y[held])), t) for t in (0.1, 0.15, 0.2, 0.3, 0.5, 0.7, 1.0, 1.5, 2.0))[1]
    top = _softmax(z / best)
    right = np.sort(top.max(1)[top.argmax(1) == y[held]])
    bound = float(right[int(LOST * len(right))]) if len(right) else 0.0
    return Model(languages, P, bias, best, max(0.0, min(MOST, bound)))


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(-1, keepdims=True))
    return p / p.sum(-1, keepdims=True)


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return -np.log(np.maximum(_softmax(z)[np.arange(len(y)), y], 1e-12)).mean()


def train(documents: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """The model, fitted in a task of an executor."""

    def of(rows: pa.Table, order: list[int]) -> dict:
        get = lambda name, kind, i: np.frombuffer(rows[name][i].as_buffer(), kind)
        return vars(fit([(rows["lang"][i].as_py(), get("idx", "<i4", i), get("n", "<f4", i)) for i in order]))

    return Model(**fitted(_rows(documents, max_rows), ["doc_id", "th", "lang"], of))


def identify(documents: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (doc_id if not given) with lang_pred, score and accepted."""

    def make():
        P = model.table.astype(np.float64)

        def row(text):
            if not model.languages or not has_letter(text):
                return UNKNOWN, 0.0, False
            idx = X.grams(text, BITS, SIZES, False)
            z = np.bincount(idx, minlength=1 << BITS) @ P / len(idx) if len(idx) > 1 << 13 else P[idx].sum(0) / max(1, len(idx))
            p = _softmax((z + model.bias) / model.temperature)
            return model.languages[int(p.argmax())], float(p.max()), bool(p.max() >= model.accept_at)

        return row

    return map_rows(documents, ["text"], make, "lang_pred string, score double, accepted boolean", keep or ["doc_id"])


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, train(docs))
    return out.select("doc_id", F.coalesce(id_crc32(F.col("doc_id")) % 4 == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")
