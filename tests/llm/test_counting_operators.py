"""Token counts, filter interactions and hard negatives against plain readings."""

import hashlib
import math
import random
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from repoaudit.llm import common, filter_audit, hard_negatives, token_counts

P = pytest.importorskip("public_tokenizers")
FILE = P.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"
TEXTS = [
    "", " \n\t ", "Hello, World!", "hello,  world!", "HELLO,\nWORLD!\t", "it's we'll I'D don't '' 's", "<|endoftext|>", "a<|startoftext|>b", "<|ENDOFTEXT|> x", "x <| y A  B", "École été ½² ªº", "İstanbul ΣΑΣ Ζ",
    "прИВет 12,5 €", "é É     x", "日本語 text \U0001f600\U0001f600", "a\x1cb\x85c d", "1234567890" * 5, "x" * 3000, "ÿŸſK", "\x00\x7f﻿",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(FILE)


def plain(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


# --- token counts ----------------------------------------------------------------------------------------------------


def test_counts_of_the_query_equal_the_library(spark, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = token_counts.op11_token_counts(spark, SF).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows} == {i: (len((t or "").encode()), plain(library, t), plain(library, t) > 2048) for i, t in texts.items()}
    assert len(rows) == len(texts)


def test_counting_of_odd_texts(library, monkeypatch):
    counting = token_counts.Counting(FILE)
    rng = random.Random(3)
    letters = "aAbsStT'éÉ \n0½.,<|>пПİΣ́ "
    texts = TEXTS + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    assert [counting.count(t) for t in texts] == [plain(library, t) for t in texts]
    # a text is taken in pieces, and words are forgotten
    monkeypatch.setattr(token_counts, "PIECE", 50)
    monkeypatch.setattr(token_counts, "MAX_WORDS", 10)
    long = " ".join(t for t in texts[:400])
    for t in (long, long.encode("ascii", "ignore").decode().replace("<|", ""), "ab" * 5000):
        assert counting.count(t) == plain(library, t)


def test_every_alike_character(library):
    counting = token_counts.Counting(FILE)
    for low, high in token_counts._ALIKE:
        for c in map(chr, range(low, high + 1)):
            for t in (c, c + c, f"a{c}b {c}1"):
                assert counting.count(t) == plain(library, t), hex(ord(c))


def test_normalising_changes_no_count(spark, library):
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choice("aB \n\t <|Eé'É\x1c") for _ in range(12)) for _ in range(500)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", token_counts.normalised(F.col("t")).alias("n"), token_counts.text_digest(F.col("t")).alias("d")).collect()
    assert all(plain(library, r["t"]) == plain(library, r["n"]) and bytes(r["d"]) == hashlib.sha256(r["n"].encode()).digest() for r in rows)
    assert len({r["n"] for r in rows[2:5]}) == 2  # case and runs of blanks go, a blank at the end stays one blank


def test_cache_encodes_each_miss_once(spark, tmp_path, library, monkeypatch):
    cache, encoded = str(tmp_path / "cache"), []
    true = token_counts.encode
    monkeypatch.setattr(token_counts, "encode", lambda texts, file: (encoded.append(texts.count()), true(texts, file))[1])
    ask = lambda texts: {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), cache, FILE).collect()}
    first = ["One two", "one  two", "three", None, "", "three"]
    assert ask(first) == {i: plain(library, t) for i, t in enumerate(first)} and encoded == [3]
    assert ask(first) == {i: plain(library, t) for i, t in enumerate(first)} and encoded == [3]  # all known: nothing is encoded
    assert ask([*first, "four <|endoftext|>"])[6] == 2 and encoded == [3, 1]
    assert ask([]) == {} and encoded == [3, 1]
    # another version shares nothing, and a digest that was appended twice counts once
    monkeypatch.setattr(token_counts, "COUNTING", "other")
    assert ask(["One two"]) == {0: 2} and encoded == [3, 1, 1]
    spark.read.parquet(cache).coalesce(1).write.mode("append").parquet(str(tmp_path / "twice"))
    spark.read.parquet(cache).coalesce(1).write.mode("append").parquet(str(tmp_path / "twice"))
    assert token_counts.stored(spark, str(tmp_path / "twice"), token_counts.tokenizer_version(FILE)).count() == 1


def test_counts_with_nulls_repeats_and_clashing_columns(spark, tmp_path):
    rows = [(None, "a b", "x", 1, "v"), (7, "a b", "y", 2, "w"), (7, "a b", "y", 2, "w"), (7, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string, n_tokens int, version string")
    got = sorted(((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(docs, str(tmp_path / "c"), FILE).collect()))
    assert got == [(-1, 3, 2), (7, 0, 0), (7, 3, 2), (7, 3, 2)]


def test_lookup_gives_hot_and_other_keys(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i}") for i in range(1000)] + [(-1, "unknown")], "i long, k string")
    values = rows.where("k <> 'unknown'").groupBy("k").agg(F.count("*").alias("n"), F.min("i").alias("least"))
    got = {r["i"]: r["least"] for r in common.lookup(rows, values, "k", 1001, share=10).collect()}
    assert got == {i: 1 if i % 2 else i for i in range(1000)} | {-1: None}


# --- filter interactions ---------------------------------------------------------------------------------------------


def brute_audit(docs, labels):
    """Every order by walking through all documents."""
    words = lambda t: [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in t).split(" ") if w]
    first, fails, parts = {}, [], {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    for i, text, source in docs:
        t, w = text or "", words(text or "")
        upper = sum("A" <= c <= "Z" for c in t)
        fails.append({"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * upper > 2 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and first[t] < i})
        parts.setdefault(source or "", []).append(len(fails) - 1)
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, x in labels if x == 1} - {None}
    out = {}
    for part, members in parts.items():
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = set(members)
            for s, f in enumerate(order):
                removed = {m for m in left if fails[m][f]}
                redundant = {m for m in members if m not in left and fails[m][f]}
                alone = {m for m in members if fails[m][f] and sum(fails[m].values()) == 1}
                left -= removed
                shapley[f] += len(removed)
                out[part, order, s + 1] = [len(left), len(removed), len(redundant), len(alone), sum(docs[m][0] in good for m in removed), sum(docs[m][0] in toxic for m in removed)]
        for (p, order, s), row in out.items():
            if p == part:
                row.append(shapley[order[s - 1]])
    return out


def audited(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = filter_audit.audit_filters(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    found = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in rows}
    assert len(found) == len(rows)
    return found


def test_audit_equals_walking_through_all_orders(spark):
    rng = random.Random(2)
    texts = ["", " ", "A", "a " * 250, " ".join(f"w{i}" for i in range(200)), " ".join(f"w{i}" for i in range(199)), " ".join(f"W{i}" for i in range(300)), " ".join(f"w{i}" for i in range(260)) + " #", "x\x0by\x1cz " * 120, "É 中\U0001f600 $", None]
    docs = [(i if i % 17 else None, rng.choice(texts), rng.choice(["s", "t", "", None])) for i in range(160)] + [(5, "again", "s"), (5, "again", "s"), (6, "again", "t")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 160, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (999, 1, 1)]
    assert audited(spark, docs, labels) == brute_audit(docs, labels)
    assert audited(spark, docs[:3], []) == brute_audit(docs[:3], [])
    assert audited(spark, [], labels) == {}


def test_audit_of_one_hot_text_and_a_clashing_column(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.concat(F.lit("t"), "id")).alias("text"), F.lit("s").alias("source"), F.lit(1).alias("mask"), F.lit("x").alias("digest"), F.lit(2).alias("n"), F.lit("p").alias("part"))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = {(r["filter_order"], r["step"]): r for r in filter_audit.audit_filters(docs, labels).collect()}
    assert rows["EABCD", 1]["removed"] == 999 and rows["EABCD", 2]["removed"] == 2001 and rows["ABCDE", 5]["redundant"] == 999


def test_contraction_is_a_sum_of_cells():
    tensor = np.random.default_rng(0).integers(0, 9, (2, 3, 2, 2, 2))
    cube = filter_audit.contracted(tensor)
    assert cube.shape == (2, 3, 3, 3, 3)
    assert (cube[:, :, 2, 2, 2] == tensor.sum(axis=(2, 3, 4))).all() and (cube[:, :, 0, 1, 2] == tensor[:, :, 0, 1].sum(axis=-1)).all()


# --- hard negatives --------------------------------------------------------------------------------------------------


def brute_mine(rows, every=100, k=5):
    usable = {(i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * x) for x in v)) for i, label, v in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = set()
    for i, label, v in usable:
        if i % every:
            continue
        scored = [(score(v, w), j, m) for j, m, w in usable]
        positives = sorted({(-s, j) for s, j, m in scored if m == label and j != i})[:k]
        for p, j in positives:
            hard = sorted({(-s, n) for s, n, m in scored if m != label and 80 * -p <= 100 * s <= 100 * -p})[:k]
            out |= {(i, j, r + 1, n, -p, -s) for r, (s, n) in enumerate(hard)}
    return out


def mined(spark, rows, **options):
    found = hard_negatives.mine(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(5), **options).collect()
    got = {tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in found}
    assert len(got) == len(found)
    return got


def random_rows(n, dim, seed, spread=1.0, labels=10):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(labels, dim))
    return [(i, int(l), [float(np.float32(x)) for x in v]) for i, (l, v) in enumerate(zip(rng.integers(0, labels, n), centers[rng.integers(0, labels, n)] + spread * rng.normal(size=(n, dim))))]


def test_mining_equals_comparing_all(spark):
    rows = random_rows(600, 16, 1)
    assert mined(spark, rows, every=20) == brute_mine(rows, 20) and len(brute_mine(rows, 20)) > 300
    tight = random_rows(500, 8, 2, spread=0.1)
    assert mined(spark, tight, every=25) == brute_mine(tight, 25)


def test_mining_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = random_rows(150, 4, 3)
    rows += [(1000, 3, None), (1001, None, [1.0, 2.0, 3.0, 4.0]), (1002, 3, [1.0, None, 0.0, 0.0]), (1003, 3, [nan, 0.0, 0.0, 0.0]), (1004, 3, [inf, 0.0, 0.0, 0.0]), (None, 3, [1.0, 1.0, 1.0, 1.0])]
    rows += [(1010, 2, [0.5, 0.5]), (1011, 2, []), (1020, 2, [0.0] * 4), (1030, 4, [9.0, 9.0, 9.0, 9.0, 9.0]), rows[20], rows[20], rows[3], (40, 1, [2.0, 1.0, 0.0, 1.0])]
    rows += [(2000 + i, i % 2, [0.25, 0.5, 0.0, 0.0]) for i in range(60)]  # ties by id
    rows += [(3000 + i, 5, [100.0 * (i + 1), -3e4, 2.0, 1e5]) for i in range(20)] + [(3100 + i, 6, [100.0 * (i + 1), -3e4, 2.0, 1e5]) for i in range(20)]  # beyond 2^53
    assert mined(spark, rows, every=10) == brute_mine(rows, 10)
    assert mined(spark, [], every=10) == set() == mined(spark, rows[:1][1:] + [(1, 1, [1.0])], every=10)


def test_blocks_and_salts_change_nothing(spark, monkeypatch):
    rows = random_rows(400, 6, 4)
    want = brute_mine(rows, 10)
    for name, value in (("ANCHORS", 7), ("MAX_BROADCAST", -1), ("REFERENCES", 3), ("BLOCK_BYTES", 1)):
        monkeypatch.setattr(hard_negatives, name, value)
    assert mined(spark, rows, every=10) == want


def test_bounds_hold_and_shut_out_far_rows():
    rng = np.random.default_rng(5)
    refs = rng.normal(size=(6, 5))
    refs /= np.linalg.norm(refs, axis=1)[:, None]
    a, b = np.floor(256 * rng.normal(size=(40, 5))), np.floor(256 * np.vstack([rng.normal(size=(300, 5)), refs, -refs, np.zeros((1, 5))]))
    norms = [np.sqrt((x * x).sum(axis=1)) for x in (a, b)]
    low, high = hard_negatives.score_bounds(hard_negatives.angles_to(a, norms[0], refs), norms[0], hard_negatives.angles_to(b, norms[1], refs), norms[1])
    scores = a @ b.T
    assert (low <= scores).all() and (scores <= high).all()
    best = np.sort(scores, axis=1)[:, -5:-4]
    assert (high < best).mean() > 0.3  # in few dimensions the filter decides much


def test_query_equals_comparing_all(spark):
    data = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    found = hard_negatives.op13_hard_negatives(spark, SF).collect()
    got = {tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in found}
    assert got == brute_mine([(r["vec_id"], r["label"], r["embedding"]) for r in data])
