"""Version keys and advisories that give ranges, against hand-made documents and plain comparisons."""

import glob
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from repoaudit.functions import versions
from repoaudit.operators import advisories
from repoaudit.plans.saved import scratch, shared_folder
from repoaudit.sources import snapshots

ORDERED = {
    "semver": "0.0.0-0 0.9 1.0.0-alpha 1.0.0-alpha.1 1.0.0-alpha.beta 1.0.0-beta 1.0.0-beta.2 1.0.0-beta.11 1.0.0-rc.1 v1.0.0 1.0.1-0.20200101-abc 1.0.1 1.2 1.2.0.1 1.10.0 2 10.0.0 99999999999999999999.0.0",
    "pep440": "1.dev0 1.0.dev456 1.0a1 1.0a2.dev456 1.0a12.dev456 1.0a12 1.0b1.dev456 1.0b2 1.0b2.post345.dev456 1.0b2.post345 1.0rc1.dev456 1.0rc1 1.0 1.0+abc.5 1.0+abc.7 1.0+5 1.0.post456.dev34 1.0.post456 1.0.15 1.1.dev1 1.1 1!0.1",
    "gem": "0.9 1.0.a 1.0.a.2 1.0.b1 1.0-x 1.0.pre 1.0 1.0.1 1.2.b1 1.2 1.10",
    "composer": "1.0.0-dev 1.0.0-alpha 1.0.0-alpha2 1.0.0-beta1 1.0.0-RC1 1.0.0-rc2 v1.0 1.0.0-p1 1.0.1 1.2 1.10",
}
PINS = "repo_id string, dep_pos long, ecosystem string, name string, version string, source string"


def keys(spark, order, texts):
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    return {r["v"]: r["k"] for r in df.select("v", versions.KEYS[order](F.col("v")).alias("k")).collect()}


@pytest.mark.parametrize("order", ORDERED)
def test_keys_sort_as_versions(spark, order):
    texts = ORDERED[order].split()
    found = keys(spark, order, texts)
    assert None not in found.values()
    assert sorted(texts, key=found.get) == texts and len(set(found.values())) == len(texts)


@pytest.mark.parametrize("order, same", [
    ("semver", ["v1.2", "1.2.0", "1.2.0+build.7"]), ("pep440", ["1.0", "1", "1.0.0", " v1.0 "]), ("pep440", ["1.0-1", "1.0.post1", "1.0.r1"]), ("pep440", ["1.0rc1", "1-c.1", "1.0-preview_1"]),
    ("gem", ["1", "1.0.0"]), ("gem", ["1.a", "1.0.a"]), ("composer", ["1.0", "v1.0.0.0"]),
])
def test_versions_that_are_one(spark, order, same):
    assert len(set(keys(spark, order, same).values())) == 1


@pytest.mark.parametrize("order", ORDERED)
def test_texts_that_are_no_version(spark, order):
    assert set(keys(spark, order, ["", "x", "latest", "1..0", "^1.0", ">=2", None]).values()) == {None}


def test_pep440_keys_equal_the_packaging_library(spark):
    packaging = pytest.importorskip("packaging.version")
    rng, texts = random.Random(1), set()
    while len(texts) < 1500:
        t = ("1!" if rng.random() < 0.1 else "") + ".".join(rng.choice(["0", "0", "1", "2", "10"]) for _ in range(rng.randint(1, 4)))
        t += rng.choice(["", "", "a1", ".b2", "-rc.3", "_alpha", "c11", "preview0"]) + rng.choice(["", "", ".post1", "-2", "r3", ".rev"]) + rng.choice(["", "", ".dev4", "dev", "-dev_5"]) + rng.choice(["", "", "", "+a", "+1.a", "+ab-2"])
        texts.add(t)
    found, texts = keys(spark, "pep440", texts), sorted(texts)
    assert None not in found.values()
    for _ in range(20_000):
        a, b = rng.choice(texts), rng.choice(texts)
        x, y = packaging.Version(a), packaging.Version(b)
        assert (found[a] < found[b], found[a] == found[b]) == (x < y, x == y), (a, b)


def document(i, ecosystem, name, *ranges, versions=None, **more):
    listed = [{"type": kind, "events": [{k: v} for k, v in events]} for kind, events in ranges]
    affected = {"package": {"ecosystem": ecosystem, "name": name}, "ranges": listed} | ({"versions": versions} if versions else {})
    return {"id": i, "affected": [affected]} | more


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    docs = [
        document("GO-1", "Go", "golang.org/x/net", ("SEMVER", [("introduced", "0"), ("fixed", "0.17.0")]), summary="s"),
        document("RS-1", "crates.io", "tokio", ("SEMVER", [("introduced", "1.7.0"), ("fixed", "1.18.4"), ("introduced", "1.19.0"), ("fixed", "1.20.3")]), database_specific={"severity": "HIGH"}),
        document("PY-1", "PyPI", "Zope.Interface", ("ECOSYSTEM", [("introduced", "1.0rc2"), ("last_affected", "2.0")]), versions=["1.5"]),
        document("PY-2", "PyPI", "django", ("GIT", [("introduced", "0"), ("fixed", "abcdef")]), versions=["4.2.0"]),
        document("RB-1", "RubyGems", "rails", ("ECOSYSTEM", [("introduced", "7.0.a"), ("limit", "7.1")])),
        document("PH-1", "Packagist", "a/b", ("ECOSYSTEM", [("fixed", "1.2.4"), ("introduced", "1.0")])),
        document("NP-1", "npm", "open", ("SEMVER", [("introduced", "2.0.0-rc.1")])),
        document("NP-2", "npm", "odd", ("SEMVER", [("introduced", "0"), ("fixed", "soon")])),
        document("OS-1", "Alpine:v3.18", "musl", ("ECOSYSTEM", [("introduced", "0")])),
        document("NP-3", "npm", "none", ("SEMVER", [("fixed", "1.0.0")])),
        {"id": "EMPTY"}, {"id": "NULLS", "affected": [{"package": {"ecosystem": "npm", "name": "open"}, "ranges": None}]},
    ]
    path = tmp_path_factory.mktemp("advisories") / "all.json"
    path.write_text("\n".join(map(json.dumps, docs)))
    return str(path)


HITS = [
    ("Go", "golang.org/x/net", "0.16.9", {"GO-1"}), ("Go", "golang.org/x/net", "0.17.0-rc.1", {"GO-1"}), ("Go", "golang.org/x/net", "0.17.0", set()), ("Go", "golang.org/x/net", "0.0.0-20200101000000-abcdefabcdef", {"GO-1"}), ("Go", "golang.org/x/text", "0.1.0", set()),
    ("crates.io", "tokio", "1.6.9", set()), ("crates.io", "tokio", "1.7.0", {"RS-1"}), ("crates.io", "tokio", "1.18.4", set()), ("crates.io", "tokio", "1.19.0", {"RS-1"}), ("crates.io", "tokio", "1.20.3", set()), ("crates.io", "Tokio", "1.19.0", set()),
    ("PyPI", "zope-interface", "1.0rc1", set()), ("PyPI", "zope-interface", "1.0rc2", {"PY-1"}), ("PyPI", "zope_interface", "2.0.0", {"PY-1"}), ("PyPI", "zope.interface", "2.0.post1", set()), ("PyPI", "Zope.Interface", "1.5", {"PY-1"}), ("PyPI", "django", "4.2.0", {"PY-2"}),
    ("RubyGems", "rails", "7.0.a", {"RB-1"}), ("RubyGems", "rails", "7.0", {"RB-1"}), ("RubyGems", "rails", "7.1.pre", {"RB-1"}), ("RubyGems", "rails", "7.1", set()), ("Packagist", "A/B", "v1.2.3", {"PH-1"}), ("Packagist", "a/b", "1.2.4.0", set()),
    ("npm", "open", "2.0.0-rc.0", set()), ("npm", "open", "2.0.0", {"NP-1"}), ("npm", "open", "latest", set()), ("npm", "odd", "0.1.0", set()), ("Alpine:v3.18", "musl", "1.0", set()),
]


def test_ranges_of_documents(spark, source):
    pins = spark.createDataFrame([("r", i, e, n, v, "lock") for i, (e, n, v, _) in enumerate(HITS)], PINS)
    listed, ranges = snapshots.read_advisories(spark, source), snapshots.read_advisory_ranges(spark, source)
    found = advisories.match_advisories(pins, listed, None, ranges).collect()
    assert {(r["dep_pos"], r["vuln_id"]) for r in found} == {(i, v) for i, (_, _, _, ids) in enumerate(HITS) for v in ids}
    # a version that is listed and lies in a range is one hit
    assert len(found) == len({(r["dep_pos"], r["vuln_id"]) for r in found})
    problems = {r["vuln_id"]: r["problem"] for r in advisories.unread_ranges(ranges).collect()}
    assert problems == {"PY-2": "range type", "NP-2": "version", "OS-1": "ecosystem", "NP-3": "no introduced event"}
    assert snapshots.read_advisory_details(spark, source).count() == 12


def test_salted_join_and_caps_change_nothing(spark, source, monkeypatch):
    rows = [(f"r{r}", i, e, n, v, "lock") for r in range(5) for i, (e, n, v, _) in enumerate(HITS)]
    pins = spark.createDataFrame(rows, PINS)
    listed, ranges = snapshots.read_advisories(spark, source), snapshots.read_advisory_ranges(spark, source)
    read = lambda most: sorted(map(tuple, advisories.match_advisories(pins, listed, most, ranges).collect()))
    everything = read(None)
    assert read(1000) == everything
    assert read(3) == [r for r in everything if r[1] < 3]
    monkeypatch.setattr(advisories, "MAX_BROADCAST", -1)
    assert read(None) == everything


def test_random_ranges_equal_a_plain_reading(spark):
    rng = random.Random(7)
    number = lambda: (rng.randint(0, 3), rng.choice([0, 2, 9, 10]))
    ranges, spans = [], []
    for i in range(60):
        marks = sorted({number() for _ in range(rng.randint(1, 5))})
        events, name = [], f"p{i % 4}"
        for k, m in enumerate(marks):
            kind = "introduced" if k % 2 == 0 else rng.choice(["fixed", "last_affected"])
            events.append((*(f"{m[0]}.{m[1]}.0" if f == kind else None for f in ("introduced", "fixed", "last_affected")), None))
            if kind == "introduced":
                spans.append([f"V{i}", name, m, None, False])
            else:
                spans[-1][3:] = [m, kind == "last_affected"]
        rng.shuffle(events)
        ranges.append((f"V{i}", 0, "npm", name, "SEMVER", events))
    pins = [("r", n, "npm", f"p{p}", f"{a}.{b}.0", "lock") for n, (p, a, b) in enumerate((p, a, b) for p in range(4) for a in range(4) for b in (0, 1, 2, 9, 10, 11))]
    want = set()
    for _, pos, _, name, version, _ in pins:
        v = tuple(map(int, version.split(".")[:2]))
        want |= {(pos, i) for i, n, low, high, closed in spans if n == name and low <= v and (high is None or v < high or closed and v == high)}
    frame = spark.createDataFrame(ranges, f"vuln_id string, vuln_pos int, ecosystem string, name string, range_type string, events array<{advisories.EVENT}>")
    none = spark.createDataFrame([], "ecosystem string, name string, version string, vuln_id string, vuln_pos int")
    found = advisories.match_advisories(spark.createDataFrame(pins, PINS), none, None, frame)
    assert {(r["dep_pos"], r["vuln_id"]) for r in found.collect()} == want and len(want) > 100


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tables_are_not_broadcast_on_a_guess(spark, monkeypatch):
    """Rows exploded from a small table: their guessed size stays under Spark's broadcast limit, whatever comes out (d12, d13, d16)."""
    monkeypatch.setattr(advisories, "MAX_BROADCAST", 0)
    pins = spark.createDataFrame([(f"r{i % 50}", i, "npm", f"p{i % 7}", "1", "lock") for i in range(300)], PINS)
    many = spark.range(7).select(F.lit("npm").alias("ecosystem"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("name"), F.lit("1").alias("version"), F.col("id").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("vuln_pos"))
    listed = many.withColumn("vuln_id", F.concat_ws("-", "name", F.col("vuln_pos").cast("string")))
    hits = advisories.match_advisories(pins, listed, None)
    assert "BroadcastHashJoin" not in _plan(hits)
    details = listed.select("vuln_id", F.lit("s").alias("summary"), F.lit("d").alias("details"), F.lit("low").alias("severity_label"))
    for most, told in ((None, 1200), (1000, 1200), (2, 600)):
        out = advisories.enrich(hits, details, most)
        assert "BroadcastHashJoin" not in _plan(out)
        rows = out.collect()
        assert len(rows) == 1200 and sum(r["summary"] is not None for r in rows) <= told


def test_only_heavy_pins_are_salted(spark, monkeypatch):
    monkeypatch.setattr(advisories, "MAX_BROADCAST", 0)
    monkeypatch.setattr(advisories, "HEAVY", 10)
    pins = spark.createDataFrame([(f"r{i}", i, "npm", "hot" if i % 2 else f"p{i}", "1", "lock") for i in range(60)], PINS)
    listed = spark.createDataFrame([("npm", n, "1", f"{n}-{k}", k) for n in ["hot", "p4", "gone"] for k in range(2)], "ecosystem string, name string, version string, vuln_id string, vuln_pos int")
    found = sorted((r["repo_id"], r["vuln_id"]) for r in advisories.match_advisories(pins, listed, None).collect())
    assert found == sorted([(f"r{i}", f"hot-{k}") for i in range(1, 60, 2) for k in range(2)] + [("r4", "p4-0"), ("r4", "p4-1")])


def test_intervals_are_not_broadcast_on_a_guess(spark):
    pins = spark.createDataFrame([(f"r{i}", i, "npm", f"p{i % 5}", f"{i % 4}.0", "lock") for i in range(40)] + [("x", 99, "npm", "p1", "latest", "lock")], PINS)
    ranges = spark.range(5).select(F.concat(F.lit("V"), F.col("id").cast("string")).alias("vuln_id"), F.lit(0).alias("vuln_pos"), F.lit("npm").alias("ecosystem"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("name"), F.lit("SEMVER").alias("range_type"),
        F.expr(f"array(cast(named_struct('introduced', '1.0', 'fixed', null, 'last_affected', null, 'limit', null) AS {advisories.EVENT}), cast(named_struct('introduced', null, 'fixed', '3.0', 'last_affected', null, 'limit', null) AS {advisories.EVENT}))").alias("events"))
    found = advisories.pins_in_ranges(pins, ranges)
    joins = [x for x in _plan(found).splitlines() if "BroadcastHashJoin" in x]
    assert len(joins) == 1 and "salt" not in joins[0]  # only that of the keys, which are counted
    assert {(r["name"], r["version"]) for r in found.collect()} == {(f"p{i % 5}", f"{i % 4}.0") for i in range(40) if i % 4 in (1, 2)}


@pytest.fixture(scope="module")
def odd(spark):
    """Pins, advisories and details with rows that come twice, nulls, an advisory of two pins, one without details and one at the place of another."""
    pins = [(f"r{r}", r * 100 + i, "npm", f"p{i % 5}", str(i % 3), "lock") for r in range(6) for i in range(r * 4)]
    pins += [pins[7], (None, 1, "npm", "p1", "1", "lock"), ("r2", 1, "npm", None, "1", "lock"), ("r3", 2, "npm", "p1", "1", None)]
    listed = [("npm", f"p{p}", str(v), f"V{(p * 3 + v + k) % 9}", k) for p in range(4) for v in range(2) for k in range(3)]
    listed += [listed[4], ("npm", "p1", "1", None, 7), ("npm", None, "1", "V1", 0), ("npm", "p1", "1", "V0", 0), ("npm", "gone", "1", "V2", 0)]
    details = [(f"V{i}", None if i % 3 else f"s{i}", f"first {i}\nsecond", "high" if i % 2 else None) for i in range(8)] + [("V3", "again", "", "LOW"), (None, "none", None, None), ("V4", "", "of empty\nsummary", "low")]
    return (
        spark.createDataFrame(pins, PINS), spark.createDataFrame(listed, "ecosystem string, name string, version string, vuln_id string, vuln_pos int"),
        spark.createDataFrame(details, "vuln_id string, summary string, details string, severity_label string"),
    )


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def _plain_rows(pins, listed, details, most):
    pins, listed, details = ([tuple(r) for r in df.collect()] for df in (pins, listed, details))
    hits = [(*p, v, k) for p in pins for *key, v, k in listed if None not in p[2:5] and list(p[2:5]) == key]
    first = {}
    for h in hits:
        first[h[0], h[6]] = min(first.get((h[0], h[6]), h[1::6]), h[1::6])
    place = {}
    for repo in {h[0] for h in hits}:
        for n, (_, _, v) in enumerate(sorted((at, v is not None, v) for (r, v), at in first.items() if r == repo)):
            place[repo, v] = n
    out = []
    for h in hits:
        told = [d[1:] for d in details if d[0] == h[6]] if h[0] is not None and h[6] is not None and place[h[0], h[6]] < most else []
        out += [(*h, *d) for d in told or [(None, None, None)]]
    return sorted(out, key=repr)


@pytest.mark.parametrize("few, heavy", [(200_000, 50_000), (0, 50_000), (0, 3)])
def test_details_of_pins_equal_details_of_hits(spark, odd, monkeypatch, few, heavy):
    monkeypatch.setattr(advisories, "MAX_BROADCAST", few)
    monkeypatch.setattr(advisories, "HEAVY", heavy)
    pins, listed, details = odd
    for most in (1, 3, 100):
        want = _plain_rows(pins, listed, details, most)
        assert _rows(advisories.match_and_enrich(pins, listed, details, None, most)) == want and len(want) > 100
        assert _rows(advisories.enrich(advisories.match_advisories(pins, listed, None), details, most)) == want
    known = pins.where("repo_id IS NOT NULL")
    assert _rows(advisories.match_and_enrich(known, listed, details, None, None)) == _plain_rows(known, listed, details, 100)


def test_all_dependencies_stay_on_disk_only_until_they_are_met(spark, odd, monkeypatch):
    """Copies of all dependencies are gone once those with advisories are saved, also where a step fails (F1, F2)."""
    folder, pins = shared_folder(spark), odd[0]
    left = lambda: glob.glob(f"{folder.removeprefix('file:')}/scratch-*")
    with scratch(spark) as write:
        copy = write(pins)
        assert _rows(copy) == _rows(pins) and copy.schema == pins.schema and len(left()) == 1
    assert not left()
    found = advisories.match_and_enrich(*odd)
    assert not left() and found.count() > 100
    monkeypatch.setattr(advisories, "_meet", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        advisories.match_and_enrich(*odd)
    assert not left()


def test_headlines_give_the_same_findings(odd):
    pins, listed, details = odd
    found = lambda told: _rows(advisories.dependency_findings(advisories.match_and_enrich(pins, listed, told, None, 3), None))
    assert found(advisories.headlines(details)) == found(details)
    assert not any("\n" in (r["details"] or "") for r in advisories.headlines(details).collect())


@pytest.mark.parametrize("name", ["d16_dependency_findings", "d13_enrich"])
def test_hits_are_shuffled_only_as_rows_of_dependencies(spark, monkeypatch, name):
    """The plan deals hits by no key of theirs: exchanges hold dependencies, pins or details (F1, F2)."""
    from repoaudit.plans import queries

    monkeypatch.setattr(advisories, "MAX_BROADCAST", 0)
    plan = _plan(queries.QUERIES[name](spark, "/root/testdata/sf0.001"))
    dealt = re.findall(r"Exchange hashpartitioning\(([^\n]*?), \d+\)", plan)
    dealt = [re.sub(r"#\d+L?", "", x) for x in dealt]
    assert sorted(dealt) == ["ecosystem, name, version"] * 2 + ["vuln_id"] * 2
