"""Near-duplicates, sharding and the pipeline against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from repoaudit.llm import graph, language_id, quality_classifier, secret_scans, sharding, shingle_links, simhash_dedup

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text, n=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, limit=2):
    """Smallest id reachable, for {id: fingerprint}."""
    ids = sorted(prints)
    label = {i: i for i in ids}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= limit:
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {i: root(i) for i in ids}


def test_query_equals_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = {r["doc_id"]: r for r in simhash_dedup.op6_simhash_dedup(spark, SF).collect()}
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    assert {i: r["fingerprint"] for i, r in rows.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r["component_id"] for i, r in rows.items()} == brute_components(prints)


@pytest.mark.parametrize("limit", [2, 4, 6])
@pytest.mark.parametrize("most", [3, 8192])
def test_links_of_crowded_fingerprints(spark, monkeypatch, most, limit):
    monkeypatch.setattr(simhash_dedup, "MAX_GROUP", most)
    monkeypatch.setattr(graph, "TILE", 5)
    monkeypatch.setattr(graph, "ROUNDS", 1)
    rng = random.Random(most)
    centers = [rng.getrandbits(64) for _ in range(4)]
    prints = {i: rng.choice(centers) ^ sum(1 << b for b in rng.sample(range(64), rng.choice([0, 1, 2, 3, 4, 6, 9, 13]))) for i in range(400)}
    classes = {}
    for i, p in prints.items():
        classes[p] = min(i, classes.get(p, i))
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    df = spark.createDataFrame([(signed(p), i) for p, i in classes.items()], "fp long, rep long")
    got = {r["node"]: r["component"] for r in graph.components(simhash_dedup.links(df, limit)).collect()}
    want = brute_components({i: p for p, i in classes.items()}, limit)
    assert {i: got.get(i, i) for i in want} == want


def test_gray_order_and_index():
    code = np.arange(16, dtype=np.uint64)
    code ^= code >> np.uint64(1)
    assert simhash_dedup.gray_rank(code).tolist() == list(range(16))
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 5, dtype=np.uint64)
    values = np.unique(base[rng.integers(0, 5, 300)] ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)))
    values = values[np.argsort(simhash_dedup.gray_rank(values))]
    got = {(int(a), int(b)) for x, y in simhash_dedup.GrayIndex(values).links(2, np.uint64(0)) for a, b in zip(x, y)}
    want = {(a, b) for a in range(len(values)) for b in range(a + 1, len(values)) if int(values[a] ^ values[b]).bit_count() <= 2}
    assert got == want


def test_near_duplicate_cases(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n", "x"), (4, "A b", "x"), (4, "A b", "x"), (5, "a B", "x"), (None, "a b", "x"), (6, "w " * 50_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((r["doc_id"] or 0, r["component_id"]) for r in simhash_dedup.near_duplicates(df).collect())
    assert [g for g in got if g[0] == 0] == [(0, None)] and [g[1] for g in got if g[0] in (1, 2, 3)] == [1, 1, 1] and [g[1] for g in got if g[0] in (4, 5)] == [4, 4, 4]
    assert simhash_dedup.near_duplicates(df.limit(0)).count() == 0


def test_sharding(spark):
    rows = [(i, None if i % 9 == 0 else "t" * i, None if i % 11 == 0 else f"s{i % 3}") for i in range(997)] + [(5, "same", "s1")] * 5 + [(None, "x", "s0")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumnRenamed("nothing", "n")
    got = sharding.interleave(df).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r)
    counts = [len(v) for v in by.values()]
    assert len(by) == 40 and max(counts) - min(counts) <= 1 and all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by.values())
    for s in (None, "s0", "s1", "s2"):
        n = [sum(r["source"] == s for r in v) for v in by.values()]
        assert max(n) - min(n) <= 2
    text = {r[0]: r[1] for r in rows if r[0] != 5}
    assert all((r["size"], r["text_crc32"]) == (len(text[r["doc_id"]] or "") + 16, zlib.crc32((text[r["doc_id"]] or "").encode())) for r in got if r["doc_id"] not in (5, None))
    again = {(r["doc_id"], r["text_crc32"]): r["shard"] for r in sharding.interleave(df.repartition(7)).collect()}
    assert sum(again[r["doc_id"], r["text_crc32"]] == r["shard"] for r in got if r["doc_id"] != 5) == len(got) - 6
    assert sharding.interleave(df.limit(0)).count() == 0 and sharding.interleave(df.limit(3)).count() == 3


def spark_hash(*values):
    """Spark's xxhash64 of strings, longs, and ints or booleans given as (value,)."""
    h = 42
    for v in values:
        if v is not None:
            raw = v.encode() if isinstance(v, str) else int(v[0]).to_bytes(4, "little") if isinstance(v, tuple) else (v & (1 << 64) - 1).to_bytes(8, "little")
            h = xxhash.xxh64_intdigest(raw, h)
    return h


def plain_places(rows, shards):
    """(doc_id, crc, shard, slot) of rows (doc_id, text, source), ranked and sorted in one list."""
    seed, by = sharding.SEED, {}
    for doc_id, text, source in rows:
        raw = (text or "").encode()
        crc, size = zlib.crc32(raw), len(raw) + 16
        by.setdefault(source, []).append((spark_hash((seed,), source or "", doc_id, crc, size) % (1 << 40), doc_id, crc, size))
    out = []
    for source, own in by.items():
        phase = (spark_hash((seed,), "phase", source or "", (source is None,)) % (1 << 30) + 0.5) / (1 << 30)
        tie = spark_hash((seed,), source)
        out += [((k - phase) / len(own), tie - (1 << 64) if tie >> 63 else tie, h, doc_id, crc) for k, (h, doc_id, crc, _) in enumerate(sorted(own), 1)]
    places = [(doc_id, crc, place * shards // len(out)) for place, (*_, doc_id, crc) in enumerate(sorted(out))]
    first = {}
    for place, (_, _, shard) in enumerate(places):
        first.setdefault(shard, place)
    return [(*p, place - first[p[2]]) for place, p in enumerate(places)]


@pytest.mark.parametrize("rows_of", [4096, 10])
def test_sharding_equals_a_plain_ranking(spark, monkeypatch, rows_of):
    monkeypatch.setattr(sharding, "ROWS", rows_of)
    monkeypatch.setattr(sharding, "SPANS", 4096 if rows_of > 10 else 3)
    rows = [(i, None if i % 9 == 0 else "t" * (i % 50), None if i % 11 == 0 else f"s{i % 3}" if i % 2 else f"own{i}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = [(r["doc_id"], r["text_crc32"], r["shard"], r["slot"]) for r in sharding.interleave(df).collect()]
    assert sorted(got) == sorted(plain_places(rows, 40))


@pytest.mark.parametrize("kind", ["sources", "rows", "both"])
def test_ties_do_not_meet_in_one_task(spark, monkeypatch, kind):
    """60 000 sources of one row each, or rows alike in everything, are dealt out like others: no group ranked in one task is large."""
    n, most = 60_000, []
    df = spark.range(n).selectExpr(*{
        "sources": ("id AS doc_id", "'x' AS text", "concat('s', id) AS source"),
        "rows": ("cast(NULL AS long) AS doc_id", "cast(NULL AS string) AS text", "'one' AS source"),
        "both": ("id % 3 AS doc_id", "'x' AS text", "CASE WHEN id % 2 = 0 THEN 'hot' ELSE concat('s', id) END AS source"),
    }[kind])
    plain = sharding._numbered

    def watched(rows, group, span, order):
        most.append(rows.groupBy(*group, span).count().agg({"count": "max"}).first()[0])
        return plain(rows, group, span, order)

    monkeypatch.setattr(sharding, "_numbered", watched)
    out = sharding.interleave(df).groupBy("shard").agg({"slot": "max", "*": "count"}).collect()
    assert len(most) == 2 and max(most) <= 2 * sharding.ROWS and len(out) == 40 and all(r["count(1)"] == n // 40 == r["max(slot)"] + 1 for r in out)


def test_sharding_in_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS", 10)
    monkeypatch.setattr(sharding, "SPANS", 3)
    df = spark.range(1000).selectExpr("id AS doc_id", "'x' AS text", "CASE WHEN id < 700 THEN 'hot' ELSE 'cold' END AS source")
    got = sharding.interleave(df, shards=7).collect()
    assert sorted(r["place"] for r in got) == list(range(1000))
    hot = [sum(r["source"] == "hot" for r in got if r["shard"] == k) for k in range(7)]
    assert max(hot) - min(hot) <= 2


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(10_001, None, None, None, None), (None, docs.first()["text"], "en", "src0", 5)], docs.schema)
    docs = docs.unionByName(extra).unionByName(docs.limit(3))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        kept = spark.read.parquet(str(tmp_path / str(k)))
        rows = kept.collect()
        if k < 4:
            assert kept.columns == docs.columns and kept.schema.simpleString() == docs.schema.simpleString(), name
        if k == 0:  # scored one by one in this process
            score = quality_classifier.scorer(quality_classifier.train(docs, spark.read.parquet(f"{SF}/labels.parquet")))
            assert Counter(rows) == Counter(r for r in before if score(r["text"]) >= 0.3)
        if k == 1:
            said = {(r["doc_id"], r["text"]): r["accepted"] for r in language_id.identify(docs, language_id.train(docs), ["doc_id", "text"]).collect()}
            assert Counter(rows) == Counter(r for r in before if said[r["doc_id"], r["text"]]) and not [r for r in rows if r["text"] is None]
        if k == 2:
            assert sorted((r["doc_id"] or 0, r["text"]) for r in rows) == brute_kept([(r["doc_id"], r["text"]) for r in before])
        if k == 3:
            assert sorted((r["doc_id"], masked(r["text"])) for r in before) == sorted((r["doc_id"], r["text"]) for r in rows)
        if k == 4:
            assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == Counter(r["doc_id"] for r in before)
        docs = kept


def masked(text):
    """The text with each run of overlapping secrets replaced."""
    spans = sorted(m.span() for r in secret_scans.RULES for m in re.finditer(r.pattern, text, (re.I | re.A) if r.ignore_case else re.A) if len(m.group(r.group)) >= r.least)
    out, at = "", 0
    for start, end in spans:
        if start >= at:
            out += text[at:start] + "[secret]"
        at = max(at, end)
    return out + text[at:]


def five_word_sets(texts):
    words = ["".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split() for t in texts]
    return [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]


def brute_kept(rows):
    """(id, text) of what stays of (id, text): the smallest row of each group, by a comparison of each with each."""
    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    sets = five_word_sets([t for _, t in rows])
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] | sets[j] == set() or sets[i] and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return sorted((rows[i][0] or 0, rows[i][1]) for i in range(len(rows)) if root(i) == i)


def test_pipeline_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
        docs = out if out.columns == docs.columns else docs


def planted(seed=5):
    """Texts in which words were changed in 1 to 5 steps, with one line in common, and a crowd of copies."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    line = [word() for _ in range(12)]
    texts = []
    for k in range(60):
        words = [word() for _ in range(200)] + line
        for edits in range(k % 5 + 1):
            copy = list(words)
            for i in rng.sample(range(200), edits * 2):
                copy[i] = word()
            texts.append(" ".join(copy))
    crowd = [word() for _ in range(150)]
    for _ in range(60):
        copy = list(crowd)
        for i in rng.sample(range(150), rng.randint(0, 5)):
            copy[i] = word()
        texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("rounds", [3, 1])
def test_every_near_copy_is_found(spark, monkeypatch, rounds):
    monkeypatch.setattr(graph, "ROUNDS", rounds)
    monkeypatch.setattr(graph, "TILE", 2048 if rounds > 1 else 7)
    texts = planted()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect())
    assert got == brute_kept(list(enumerate(texts)))
    sets, prints = five_word_sets(texts), [simhash_dedup.fingerprint(t, 5) & (1 << 64) - 1 for t in texts]
    alike = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(alike) > 300 and sum((prints[i] ^ prints[j]).bit_count() > 6 for i, j in alike) > 50  # far beyond fingerprints


def templated(n, seed, own=25):
    """Texts of one header of 80 words and some words of their own: alike by about 0.6, with fingerprints that are often within two bits."""
    rng = random.Random(seed)
    header = " ".join(f"h{i}" for i in range(80))
    return [header + " " + " ".join(f"w{rng.randrange(1 << 40)}" for _ in range(own)) for _ in range(n)]


def kept_ids(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    return sorted(r["doc_id"] for r in simhash_dedup.deduplicate(docs).select("doc_id").collect())


def test_shared_header_loses_no_text(spark, monkeypatch):
    monkeypatch.setattr(graph, "TILE", 64)
    texts = templated(400, 1, 14) + templated(60, 2)
    prints = [simhash_dedup.fingerprint(t, 5) & (1 << 64) - 1 for t in texts]
    assert sum((a ^ b).bit_count() <= 2 for i, a in enumerate(prints) for b in prints[:i]) >= 5  # near by fingerprint
    planted = [texts[i] + " tail" for i in range(0, 400, 10)] + texts[:5]  # copies within the crowd
    kept = kept_ids(spark, texts + planted)
    assert kept == [i for i, _ in brute_kept(list(enumerate(texts + planted)))]
    assert set(range(len(texts))) <= set(kept) | {0} and len(kept) == len(texts)


def test_crowded_keys_are_compared_in_proportion(spark, monkeypatch):
    """Rows into the comparison each with each, for templated corpora of growing size."""
    monkeypatch.setattr(graph, "TILE", 32)
    rows = []
    true = shingle_links.group_links

    def counted(members, verify, compare, *more):
        return true(members, verify, lambda tiles: (rows.append(tiles.count()), compare(tiles))[1], *more)

    monkeypatch.setattr(shingle_links, "group_links", counted)
    seen = []
    for n in (250, 1000):
        rows.clear()
        texts = templated(n, n)
        assert kept_ids(spark, texts + texts[:9]) == list(range(n))
        seen.append(sum(rows))
    assert seen[1] <= 5 * max(seen[0], 250)


@pytest.mark.parametrize("least", [0.5, 0.8, 0.95])
def test_prefixes_of_alike_sets_meet(least):
    rng = np.random.default_rng(3)
    common = np.sort(rng.integers(0, 1 << 63, 40, dtype=np.uint64))
    counts = rng.integers(1, 99, 40)
    for _ in range(400):
        own = rng.integers(0, 1 << 63, rng.integers(1, 60), dtype=np.uint64)
        shared = np.concatenate([own, rng.choice(common, rng.integers(0, 40), replace=False)])
        a, b = (np.unique(np.concatenate([shared[rng.random(len(shared)) < 0.97], rng.integers(0, 1 << 63, rng.integers(0, 6), dtype=np.uint64)])) for _ in range(2))
        if len(a) and len(b) and len(np.intersect1d(a, b)) >= least * len(np.union1d(a, b)):
            assert len(np.intersect1d(shingle_links.prefix(a, least, common, counts), shingle_links.prefix(b, least, common, counts)))


def test_bands_of_pairs_at_the_limit():
    rng = np.random.default_rng(1)
    missed = 0
    for _ in range(300):
        s = rng.integers(0, 1 << 63, 90, dtype=np.uint64)
        a, b = np.sort(s[:85]), np.sort(np.concatenate([s[:75], s[85:]]))  # 75 of 90: a similarity of 0.83
        missed += not (set(shingle_links.bands(a, 0.8).tolist()) & set(shingle_links.bands(b, 0.8).tolist()))
        differ = np.bitwise_count(shingle_links.parity(a) ^ shingle_links.parity(b)).sum()
        assert differ <= 15
    assert missed == 0 and shingle_links.n_bands(0.8) == 29


def test_groups_of_rows_in_many_batches():
    import pyarrow as pa

    rng = random.Random(3)
    keys = sorted((rng.randint(0, 9), rng.randint(0, 2)) for _ in range(100))
    table = pa.table({"k": [k for k, _ in keys], "t": [t for _, t in keys]})
    for size in (1, 3, 7, 100):
        got = [(g.column("k")[0].as_py(), g.column("t")[0].as_py(), len(g)) for g in graph.groups_of(iter(table.to_batches(size)), ("k", "t"))]
        assert got == [(*k, n) for k, n in sorted(Counter(keys).items())]


def test_rows_that_repeat_an_id(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, "one text of its own kind here", "a"), (1, "another text with the same id", "b"), (1, long, "c"), (2, long, "d"), (3, long + " tail", "e"), (3, "kept though its id repeats one that went", "f"), (None, long, "g"), (None, "no id but a text", "h"), (None, "no id but a text", "i"), (4, None, "j"), (5, "", "k"), (4, None, "l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, th string")
    out = simhash_dedup.deduplicate(docs)
    assert out.columns == docs.columns
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in out.collect())
    assert got == sorted([(1, rows[0][1]), (1, rows[1][1]), (1, long), (3, rows[5][1]), (0, "no id but a text"), (4, "")])
