"""Trained operators: held-out accuracy, defined cases, and exact statistics against plain readings."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from repoaudit.llm import features, language_id, quality_classifier, quality_rules

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, own_row string"
ODD = [(1, None, None, None, None, "a", "b"), (1, "", "en", None, 0, "a", "b"), (None, "the and of", "en", "s", 9, "a", "b"), (3, "x" * 300_000, "en", "s", 9, "a", "b"), (4, "!!! 123", "en", "s", 9, "a", "b"), (4, "!!! 123", "en", "s", 9, "a", "b")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


def sampled(*args, **options):
    """Buckets, labels and weights of a sample."""
    return quality_classifier.fit_rows(quality_classifier.sparse_rows(*args, **options), lambda *rows: rows)


def test_quality_classifier_on_held_out_rows(spark):
    got = quality_classifier.op1_quality_classifier(spark, SF)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [r for r in got.collect()]
    assert len(rows) == 1000 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) > 0.9


def test_classifier_cases(spark, odd):
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 0), (4, 1, 0), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    model = quality_classifier.train(odd, labels)
    assert quality_classifier.classify(odd, model).count() == len(ODD)
    assert quality_classifier.classify(odd.limit(0), model).count() == 0
    empty = quality_classifier.train(odd, labels.limit(0))
    assert {r["score"] for r in quality_classifier.classify(odd, empty).collect()} == {0.5}


def test_dual_coordinate_descent_separates():
    rows = [np.array([0, 2], np.int32), np.array([1, 2], np.int32)] * 20
    y = np.array([1, 0] * 20)
    w, bias = quality_classifier.dual_coordinate_descent(rows, [np.ones(2)] * 40, y, 2)
    assert all((w[r].sum() + bias > 0) == (label > 0) for r, label in zip(rows, y))


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            hit |= set(range(i, i + 8))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


@pytest.mark.parametrize("text", ["", "a", "é # b\n\na\na\n a \nb", "a b c d e f g h " * 3 + "tail", "x\x0by\x0cz\r\nq\tw", "w " * 40, "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8", "a b c"])
def test_statistics(text):
    assert quality_rules.statistics(text) == plain(text)


def test_rules_keep_good_documents(spark, odd):
    got = {r["doc_id"]: r for r in quality_rules.op4_quality_rules(spark, SF).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for r in got.values():
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) and not (r["base_failed"] and r["kept"])
    good = [got[k] for k, v in labels.items() if v == 1 and not got[k]["base_failed"]]
    bad = [got[k] for k, v in labels.items() if v == 0]
    assert np.mean([r["kept"] for r in good]) > 0.97 and len(bad) > 20 and np.mean([r["kept"] for r in bad]) < 0.1
    model = quality_rules.fit([], np.array([]), np.array([]))
    rows = quality_rules.judge(odd, model).collect()
    assert len(rows) == len(ODD) and quality_rules.judge(odd.limit(0), model).count() == 0
    assert next(r for r in rows if r["doc_id"] is None)["n_words"] == 3


def test_language_on_held_out_rows(spark, odd):
    got = {r["doc_id"]: r for r in language_id.op8_language_id(spark, SF).collect()}
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    held = [k for k, r in got.items() if r["held_out"]]
    assert all(got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) for k in got)
    assert np.mean([got[k]["lang_pred"] == langs[k] for k in held]) > 0.95
    assert np.mean([r["accepted"] for r in got.values()]) > 0.98


def test_language_cases(spark, odd):
    model = language_id.train(odd)
    rows = language_id.identify(odd, model).collect()
    assert [r["lang_pred"] for r in rows if r["doc_id"] == 4] == ["und", "und"] and sum(r["lang_pred"] == "und" for r in rows) == 4
    none = language_id.train(odd.limit(0))
    assert {r["lang_pred"] for r in language_id.identify(odd, none).collect()} == {"und"} and language_id.identify(odd.limit(0), model).count() == 0


def test_features_are_positions_free():
    a, b = features.points("one two"), features.points("   zero one two")
    ha, hb = features.span_hashes(a, *features.word_spans(a)), features.span_hashes(b, *features.word_spans(b))
    assert (ha == hb[1:]).all() and len(set(hb.tolist())) == 3


# --- plain readings, one n-gram at a time ----------------------------------------------------------------------------

WHOLE = (1 << 64) - 1


def spread(h):
    h = ((h ^ (h >> 31)) * 0xBF58476D1CE4E5B9) & WHOLE
    return h ^ (h >> 29)


def plain_buckets(text, bits, sizes, words):
    c, out = [ord(x) for x in text], []
    golden = 0x9E3779B97F4A7C15
    for n in sizes:
        for i in range(len(c) - n + 1):
            h = n
            for x in c[i : i + n]:
                h = (h * 0x110003 + x) & WHOLE
            out.append(spread(h * golden & WHOLE))
    if words:
        hashed = [spread((sum((ord(x) + 1) * pow(golden, i, 1 << 64) for i, x in enumerate(w)) + len(w)) & WHOLE) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
        out += hashed + [spread((a * 3 + b) & WHOLE) for a, b in zip(hashed, hashed[1:])]
    return [h >> (64 - bits) for h in out]


def plain_indicators(text):
    found = Counter(plain_buckets(text, 18, (2, 3, 4), True))
    often = [spread((b * (2 * k + 1) + k) & WHOLE) >> 46 for k in (4, 16) for b, n in found.items() if n >= k]
    return {*found, *often}


@pytest.fixture(scope="module")
def some(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [r["text"] for r in docs.orderBy("n_chars").limit(25).collect()] + ["", "é", "a b a b", "\u4e2d\u6587 word \U0001f600"]
    return docs, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def logistic(x):
    return 1 / (1 + np.exp(-x))


def test_scores_against_plain_sums(spark, some):
    docs, few = some
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    m = quality_classifier.train(docs, labels)
    for r in quality_classifier.classify(few, m, keep=["text"]).collect():
        own = plain_indicators(r["text"])
        size = 8 / np.sqrt(sum(float(m.ratios[b]) ** 2 for b in own) + 25.0)
        margin = sum(float(m.weights[b]) * float(m.ratios[b]) * size for b in own) + m.bias
        assert abs(r["score"] - logistic(m.slope * margin + m.offset)) < 1e-5
    rules = quality_rules.train(docs, quality_rules.labelled(labels, "quality"))
    for r in quality_rules.judge(few, rules, ["text"]).collect():
        own = plain_indicators(r["text"])
        p = logistic(rules.slope * (sum(float(rules.weights[b]) for b in own) * 8 / np.sqrt(len(own) + 60.0) + rules.bias) + rules.offset)
        assert abs(r["probability"] - p) < 1e-5 and r["kept"] == (not r["base_failed"] and r["probability"] >= 0.3)


def test_languages_against_plain_means(some):
    docs, few = some
    m = language_id.train(docs)
    for r in language_id.identify(few, m, ["text"]).collect():
        own = plain_buckets(r["text"], 15, (2, 3, 4), False)
        if not any(x.isalpha() for x in r["text"]):
            assert (r["lang_pred"], r["score"], r["accepted"]) == ("und", 0.0, False)
            continue
        mean = np.sum([m.table[b].astype(float) for b in own], axis=0) / max(1, len(own)) + m.bias if own else m.bias
        p = np.exp(mean / m.temperature) / np.exp(mean / m.temperature).sum()
        assert r["lang_pred"] == m.languages[int(p.argmax())] and abs(r["score"] - p.max()) < 1e-5 and r["accepted"] == (r["score"] >= m.accept_at)


def test_fit_reaches_the_optimum():
    """The primal and the dual objective of the hinge-loss model meet."""
    rng = np.random.default_rng(3)
    rows = [np.sort(rng.choice(64, 12, replace=False)).astype(np.int32) for _ in range(120)]
    y = np.array([int(3 in r or (5 in r and 7 in r)) for r in rows])
    values = [np.ones(12)] * 120
    w, bias = quality_classifier.dual_coordinate_descent(rows, values, y, 6, epochs=2000)
    sign, cost = np.where(y > 0, 1.0, -1.0), np.where(y > 0, 120 / (2 * y.sum()), 120 / (2 * (1 - y).sum()))

    def primal(w, bias):
        return 0.5 * (w @ w + bias * bias) + (cost * np.maximum(0, 1 - sign * np.array([w[r].sum() + bias for r in rows]))).sum()

    best = primal(w, bias)
    assert all(primal(w + rng.normal(0, s, 64), bias + rng.normal(0, s)) >= best * 0.999 for s in (1e-3, 1e-2, 0.1) for _ in range(50))
    ratios = quality_classifier.log_count_ratios(rows, y, 6)
    count = [[1 + sum(b in r for r, own in zip(rows, y) if own == c) for b in range(64)] for c in (0, 1)]
    assert np.allclose(ratios, np.log((np.array(count[1]) / sum(count[1])) / (np.array(count[0]) / sum(count[0]))))


def test_a_hundred_languages(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(100):
        letters = [chr(0x3400 + 40 * k + i) for i in range(30)]
        rows += [(100 * i + k, " ".join("".join(rng.choice(letters, 5)) for _ in range(12)), f"l{k}") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs)
    assert len(model.languages) == 100
    got = language_id.identify(docs, model, ["doc_id"]).collect()
    assert np.mean([r["lang_pred"] == f"l{r['doc_id'] % 100}" for r in got]) > 0.7  # ten short texts of each


def test_unlearnt_and_mixed_texts_are_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.train(docs)
    by = {lang: [r["text"] for r in docs.where(f"lang = '{lang}' AND n_chars > 400").limit(20).collect()] for lang in model.languages}
    names = list(by)
    mixed = [by[names[i % 2]][i % 10][:200] + " " + by[names[2 + i % 2]][i % 7][:200] for i in range(20)]
    unlearnt = ["\u0442\u0435\u043a\u0441\u0442 \u043d\u0430 \u0434\u0440\u0443\u0433\u043e\u043c " * 5, "\u4e2d\u6587\u5b57" * 40, "zqx jjk vvw kxz " * 10]
    pure = [t for texts in by.values() for t in texts]
    kinds = [("mixed", t) for t in mixed] + [("unlearnt", t) for t in unlearnt] + [("pure", t) for t in pure]
    rows = language_id.identify(spark.createDataFrame(kinds, "kind string, text string"), model, ["kind"]).collect()
    share = {k: np.mean([r["accepted"] for r in rows if r["kind"] == k]) for k in ("mixed", "unlearnt", "pure")}
    assert share["unlearnt"] == 0 and share["mixed"] <= 0.8 and share["pure"] >= 0.97, share


def test_many_long_texts_stay_within_the_bound(spark):
    """The features that come to the driver are bounded whatever the texts' lengths."""
    docs = spark.range(60).selectExpr("id AS doc_id", "repeat(concat(sha2(cast(id AS string), 512), ' ', sha2(cast(id + 1 AS string), 256), ' '), 40) AS text")
    labels = spark.range(60).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS quality")
    rows, y, weight = sampled(docs, quality_classifier.labelled(labels, "quality"), 1000, max_features=8000)
    total = sum(map(len, rows))
    assert 2000 < total < 16_000 and abs(weight.sum() - 48) < 30 and set(y.tolist()) == {0, 1}


def test_samples_are_even_over_any_number_of_labels(spark):
    from pyspark.sql import functions as F

    from repoaudit.llm.common import labelled_sample

    rows = spark.range(20_000).select("id", F.col("id").alias("doc_id"), F.when(F.col("id") < 15_000, "hot").when(F.col("id") < 19_900, "warm").otherwise(F.concat(F.lit("l"), F.col("id") % 90)).alias("label"))
    got = labelled_sample(rows, "label", 1100).groupBy("label").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).collect()
    n = {r["label"]: r["n"] for r in got}
    assert len(n) == 92 and abs(n["hot"] - 500) < 100 and abs(n["warm"] - 500) < 100 and sum(v for k, v in n.items() if k[0] == "l") == 100
    assert abs(next(r["w"] for r in got if r["label"] == "hot") - 15_000) < 3000


def test_an_id_with_several_texts_is_learnt_from_once(spark):
    docs = spark.createDataFrame([(1, "one text"), (1, "another text"), (2, "word soup"), (None, "no id")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1)], "doc_id long, quality int")
    examples = quality_classifier.labelled(labels, "quality", None)
    first = sampled(docs, examples, 100)
    again = sampled(docs.repartition(3), examples, 100)
    assert len(first[0]) == 2 and all(np.array_equal(a, b) for a, b in zip(first[0], again[0]))
