"""Dependencies, technologies, health, scores, reports and sources on small tables."""

import io
import json
import tarfile

import pytest

from pyspark.sql import functions as F

from repoaudit import catalogs as C
from repoaudit.operators import advisories, deps, health, paths, scoring, tech
from repoaudit.plans import audit, queries
from repoaudit.sources import reports, snapshots

FINDINGS = "repo_id string, finding_pos long, rule_id string, title string, severity string, file_path string, line_number int, description string, recommendation string, category string"
REPOS = "repo_id string, name string, owner string, url string, description string, default_branch string, stars long, forks long, watchers long, open_issues long, license string, archived boolean, pushed_at string, kind string"


def findings(spark, *rows):
    return spark.createDataFrame([("r", i, f"R{i}", "t", s, "a.py", 1, "d", "x", c) for i, (s, c) in enumerate(rows)], FINDINGS)


def score(spark, *rows):
    return scoring.security_score(findings(spark, *rows)).first()["security"]


def test_security_score(spark):
    assert score(spark, *[("critical", "secret")] * 10) == 0
    assert score(spark, ("high", "code_pattern")) >= 90
    assert score(spark, *[("medium", "code_pattern")] * 20) > 50
    assert score(spark, ("high", "maintenance")) == 100
    # two whole, three by half, one by a quarter
    assert score(spark, *[("low", "secret")] * 6) == round(100 - 5 * (2 + 1.5 + 0.25))


def test_risk_and_gate(spark):
    def risk(trust, *rows):
        t = spark.createDataFrame([("r", trust)], "repo_id string, trust int")
        return scoring.risk_level(t, findings(spark, *rows)).first()["risk"]

    assert risk(95, ("critical", "code_pattern")) == "Critical" and risk(85, ("high", "secret")) == "High" and risk(85, ("high", "code_pattern")) == "Low"
    assert [risk(t, ("info", "coverage")) for t in (80, 60, 40)] == ["Low", "Medium", "High"]
    assert scoring.gate(findings(spark, ("high", "code_pattern")), "high").first()["worst"] == "high"
    assert scoring.gate(findings(spark, ("high", "code_pattern")), "critical").first()["worst"] is None
    assert scoring.gate(findings(spark, ("high", "coverage")), "low").first()["worst"] is None


def test_trust_leaves_out_null_areas(spark):
    rows = [("a", 100, 50, 0, None, 40), ("b", 100, 100, 100, 100, 100)]
    out = {r["repo_id"]: r["trust"] for r in scoring.trust_score(spark.createDataFrame(rows, "repo_id string, security int, maintenance int, documentation int, popularity int, structure int")).collect()}
    assert out == {"a": round((3500 + 1250 + 400) / 90), "b": 100}


def test_lockfiles(files):
    df = files(
        ("requirements.txt", "Django==4.2 # x\n-r y\nflask[a] == 2.0\nz>=1\nw===1"), ("package-lock.json", '{"packages": {"": {}, "node_modules/a": {"version": "1"}}}'), ("old/package-lock.json", '{"dependencies": {"x": {"version": "1", "dependencies": {"y": {"version": "2"}}}}}'),
        ("composer.lock", '{"packages": [{"name": "a/b", "version": "v1.2"}, {"name": "c", "version": "dev-x"}]}'), ("Cargo.lock", '[[package]]\nname = "Serde"\nversion = "1.0"\n'), ("bad/Pipfile.lock", "{"), ("go.mod", "require a v1\nrequire (\n\tb v2 // c\n)\n"),
        ("Gemfile.lock", "    rails (7.0)\n      rack (1)\n"), ("again/requirements.txt", "django==4.2"),
    )
    got = {(r["ecosystem"], r["name"], r["version"], r["source"]) for r in deps.extract_versions(df).collect()}
    assert got == {
        ("PyPI", "django", "4.2", "requirements.txt"), ("PyPI", "flask", "2.0", "requirements.txt"), ("npm", "a", "1", "package-lock.json"), ("npm", "x", "1", "old/package-lock.json"), ("npm", "y", "2", "old/package-lock.json"),
        ("Packagist", "a/b", "1.2", "composer.lock"), ("crates.io", "Serde", "1.0", "Cargo.lock"), ("Go", "a", "1", "go.mod"), ("Go", "b", "2", "go.mod"), ("RubyGems", "rails", "7.0", "Gemfile.lock"),
    }


def test_deep_npm_trees(files):
    """Pins at any depth that the JSON parser takes, in the order of the tree; texts beyond that are named, not dropped."""
    level = lambda n, inner: '{"p%d": {"version": "%d", "dependencies": %s}, "q%d": {"version": 1}}' % (n, n, inner, n)

    def tree(depth):
        return '{"dependencies": ' + "".join('{"p%d": {"version": "%d", "dependencies": ' % (n, n) for n in range(depth)) + "{}" + "}}" * depth + "}"

    small = '{"dependencies": ' + level(0, level(1, level(2, "null"))) + "}"
    df = files(("package-lock.json", small), ("a/package-lock.json", tree(900)), ("b/package-lock.json", tree(50_000)), ("c/package-lock.json", "{"), ("Pipfile.lock", "{"), ("d/Pipfile.lock", "{}"), ("composer.lock", "[]"), ("e/composer.lock", "x"), ("f/package-lock.json", '{"packages": {}}'), ("g/package-lock.json", '{"dependencies": [1, {"a": 2}]}'), ("h/package-lock.json", '{"dependencies": {"a": null, "b": "1", "c": {"version": ""}}}'))
    pins = deps.parse_package_lock_v1(df).collect()
    assert [(r["name"], r["version"]) for r in sorted((r for r in pins if r["file_pos"] == 0), key=lambda r: r["item"])] == [("p0", "0"), ("q0", "1"), ("p1", "1"), ("q1", "1"), ("p2", "2"), ("q2", "1")]
    assert {r["name"] for r in pins if r["file_pos"] == 1} == {f"p{n}" for n in range(900)} and {r["file_pos"] for r in pins} == {0, 1}
    assert {r["path"] for r in deps.unread_lockfiles(df).collect()} == {"b/package-lock.json", "c/package-lock.json", "Pipfile.lock", "e/composer.lock"}
    assert deps.extract_versions(df).where("name LIKE 'p%'").count() == 900  # p0 to p2 stand in both


def test_advisories(spark):
    d = spark.createDataFrame([("r", 1, "npm", "a", "1", "lock"), ("r", 2, "npm", "b", "1", "lock")], "repo_id string, dep_pos long, ecosystem string, name string, version string, source string")
    adv = spark.createDataFrame([("npm", "a", "1", f"V{i}", i) for i in range(12)], "ecosystem string, name string, version string, vuln_id string, vuln_pos int")
    details = spark.createDataFrame([("V0", None, "first\nmore", "CRITICAL"), ("V1", "sum", None, None)], "vuln_id string, summary string, details string, severity_label string")
    got = {r["rule_id"]: r for r in advisories.dependency_findings(advisories.enrich(advisories.match_advisories(d, adv), details)).collect()}
    assert len(got) == 10 and got["V0"]["severity"] == "high" and got["V1"]["severity"] == "medium" and got["V0"]["description"].endswith("V0: first") and got["V5"]["description"].endswith("V5: V5")


def test_languages_and_types(spark, files):
    counts = tech.language_counts(files(("a.ts", ""), ("b.ts", ""), ("c.js", ""), ("tsconfig.json", "")))
    assert [r["lang"] for r in tech.detect_languages(counts).orderBy("place").collect()] == ["TypeScript", "JavaScript"]

    def kind(*rows):
        return audit.technologies(files(*rows))[2].first()["project_type"]

    assert kind(("package.json", '{"dependencies": {"react": "1"}}'), ("vite.config.ts", "x")) == "Frontend app"
    assert kind(("pyproject.toml", 'dependencies = ["typer>=1"]')) == "CLI tool"
    assert kind(("requirements.txt", "fastapi")) == "Backend API"
    assert kind(("main.tf", "x")) == "Infrastructure/devops repo" and kind(("x.txt", "y")) == "Unknown"


def test_license_and_coverage(spark, files):
    lic = lambda *rows: [r["license"] for r in health.detect_license(files(*rows)).collect()]
    assert lic(("LICENSE", "MIT License\n")) == ["MIT"] and lic(("LICENSE", "Apache License\nVersion 2.0")) == ["Apache-2.0"] and lic(("COPYING", "mine")) == ["Detected"] and lic(("sub/LICENSE", "MIT License")) == []
    rows = [("r", 0, "a.py", 1, "x", False, False), ("r", 1, "b.md", 1, "y", False, False), ("r", 2, "c", 1, None, False, True), ("r", 3, "d", 1, None, True, False)]
    df = spark.createDataFrame(rows, snapshots.FILE)
    inputs = spark.createDataFrame([("r", 10, True, False, None)], "repo_id string, intended long, cap_reached boolean, deep boolean, source_files_in_repo long")
    cov = health.coverage(df, inputs)
    c = cov.first()
    assert (c["analyzed"], c["skipped_large"], c["skipped_binary"], c["not_inspected"]) == (2, 1, 1, 6)
    assert {r["rule_id"] for r in health.coverage_findings(cov).collect()} == {"COV001", "COV002"}


def test_maintenance(spark):
    rows = [("a", "n", None, None, None, None, 9, 0, None, 900, None, True, "2000-01-01 00:00:00", "github"), ("b", "n", None, None, None, None, 0, 0, None, 0, "MIT", False, "2001-07-30 00:00:00", "local"), ("c", "n", None, None, None, None, 0, 0, None, 0, "MIT", None, "junk", "github")]
    repos, now = spark.createDataFrame(rows, REPOS), F.lit("2001-08-01 00:00:00").cast("timestamp")
    found = health.maintenance_findings(repos, now)
    ids = lambda k: {r["rule_id"] for r in found.collect() if r["repo_id"] == k}
    assert ids("a") == {"MN001", "MN002", "MN003", "MN005"} and ids("b") == set() and ids("c") == set()
    assert {r["repo_id"]: r["maintenance"] for r in health.maintenance_score(repos, found, now).collect()} == {"a": 50, "b": 100, "c": 95}
    assert {r["repo_id"]: r["popularity"] for r in health.popularity_score(repos).collect()} == {"a": 45, "b": None, "c": 25}


def test_archives(spark):
    def archive(*rows):
        buffer = io.BytesIO()
        with tarfile.open(fileobj=buffer, mode="w:gz") as tar:
            for path, data in rows:
                info = tarfile.TarInfo("root/" + path)
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
        return buffer.getvalue()

    df = spark.createDataFrame([("a", archive(("x.py", b"hi\xff"), ("b.bin", b"1"), ("node_modules/z.js", b"1"), ("big.txt", b"1" * 50))), ("b", b"no archive")], "repo_id string, content binary")
    got = {(r["repo_id"], r["path"]): r for r in snapshots.read_archives(df, max_file_size=40).collect()}
    assert set(got) == {("a", "x.py"), ("a", "b.bin"), ("a", "big.txt"), ("b", None)}
    assert got["a", "x.py"]["content"] == "hi�" and got["a", "b.bin"]["is_binary"] and got["a", "big.txt"]["truncated"] and got["b", None]["error"]


def test_snapshots_from_folders(spark, tmp_path):
    for path, data in (("r1/a.txt", b"hi"), ("r1/z/b.py", b"x = 1"), ("r1/c.png", b"1"), ("r2/node_modules/q.js", b"1"), ("r2/nul.txt", b"a\x00b"), ("r2/big.txt", b"1" * 300)):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(data)
    got = {(r["repo_id"], r["path"]): (r["file_pos"], r["content"], r["is_binary"]) for r in snapshots.read_snapshots(spark, str(tmp_path), max_file_size=200).collect()}
    assert got == {("r1", "a.txt"): (0, "hi", False), ("r1", "c.png"): (1, None, True), ("r1", "z/b.py"): (2, "x = 1", False), ("r2", "big.txt"): (0, None, False), ("r2", "nul.txt"): (1, None, True)}


def test_advisory_documents(spark, tmp_path):
    doc = {"id": "V1", "summary": "s", "database_specific": {"severity": "LOW"}, "affected": [{"package": {"ecosystem": "npm", "name": "a"}, "versions": ["1", "2"]}]}
    (tmp_path / "a.json").write_text(json.dumps(doc) + "\n")
    got = [(r["vuln_id"], r["ecosystem"], r["name"], r["version"], r["severity_label"]) for r in snapshots.read_advisories(spark, str(tmp_path)).collect()]
    assert sorted(got) == [("V1", "npm", "a", "1", "LOW"), ("V1", "npm", "a", "2", "LOW")]


def test_paths(spark, files):
    got = {r["path"]: (r["name"], r["suffix"]) for r in paths.with_path_parts(files(("a/.env", ""), ("b.", ""), ("x.tar.GZ", ""))).collect()}
    assert got == {"a/.env": (".env", ""), "b.": ("b.", ""), "x.tar.GZ": ("x.tar.GZ", ".gz")}
    capped = paths.cap_files(files(*((f"f{i}", "x") for i in range(10))), 3).collect()
    assert sorted(r["path"] for r in capped) == ["f0", "f1", "f2"] and {(r["total_seen"], r["cap_reached"]) for r in capped} == {(10, True)}


def test_whole_audit_and_reports(spark, files):
    df = files(("README.md", "# x"), ("app.py", "eval(x)\n"), ("requirements.txt", "django==4.2"), ("LICENSE", "MIT License"))
    repos = spark.createDataFrame([("r", "n", None, None, None, None, None, None, None, None, None, None, None, "local"), ("empty", "m", None, None, None, None, None, None, None, None, None, None, None, "local")], REPOS)
    inputs = spark.createDataFrame([("r", 4, False, False, None)], "repo_id string, intended long, cap_reached boolean, deep boolean, source_files_in_repo long")
    result = audit.audit(df, repos, inputs, F.lit("2001-08-01 00:00:00").cast("timestamp")).cache()
    row = {r["repo_id"]: r for r in result.collect()}
    assert set(row) == {"r", "empty"} and row["r"]["repository"]["license"] == "MIT" and row["r"]["score_breakdown"]["popularity"] is None
    assert {"PY001", "DOC002"} <= {f["rule_id"] for f in row["r"]["findings"]} and "Django" in row["r"]["verdict"]
    report = json.loads(reports.to_json_report(result).where("repo_id = 'r'").first()["report"])
    assert report["trust_score"] == row["r"]["trust_score"]
    text = reports.to_markdown(result).where("repo_id = 'r'").first()["report"]
    assert "| Popularity | — | n/a |" in text and "PY001" in text and "39%" in text


def test_sarif(spark):
    df = spark.createDataFrame([("r", 0, "A", "t", "high", "a.py", None, "one\ntwo", "x", "secret"), ("r", 1, "A", "t", "low", None, None, "d", "x", "secret")], FINDINGS)
    doc = json.loads(reports.to_sarif(df).first()["report"])
    run = doc["runs"][0]
    assert doc["version"] == "2.1.0" and len(run["tool"]["driver"]["rules"]) == 1 and len(run["results"]) == 2
    assert run["results"][0]["message"]["text"] == "one" and run["results"][0]["locations"][0]["physicalLocation"]["region"]["startLine"] == 1 and "locations" not in run["results"][1]


def test_registry():
    assert len(C.RULES) == 61 and set(queries.SQL) <= set(queries.QUERIES)


def test_redact_whole_texts(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: r["redacted"] for r in queries.QUERIES["m18_redact_whole"](spark, sf).collect()}
    assert got == {k: None if t is None else "*" * len(t) if len(t) <= 4 else t[:4] + "*" * max(8, len(t) - 4) for k, t in texts.items()}
    assert max(len(t or "") for t in got.values()) > 1000


def test_decode_text_reads_whole_files(spark):
    sf = "/root/testdata/sf0.001"
    files = {(r["repo_id"], r["file_pos"]): r["content"] for r in queries.T.files(spark, sf).collect()}
    got = {(r["repo_id"], r["file_pos"]): r["content"] for r in queries.QUERIES["f5_decode_text"](spark, sf).collect()}
    broken = lambda pos, text: b"\xff" + text.encode() if pos % 3 == 0 else text.encode() + b"\xe2\x82"
    assert got == {k: None if t is None else broken(k[1], t).decode("utf-8", "replace") for k, t in files.items()}
    assert any(len(t or "") > 1000 for t in got.values())


def test_risk_over_all_findings(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["repo_id"]: r["risk"] for r in queries.QUERIES["g3_risk_level_all"](spark, sf).collect()}
    trust = {r["repo_id"]: r["trust"] for r in queries.QUERIES["g2_trust_score"](spark, sf).collect()}
    critical, grave = set(), set()
    for r in spark.read.parquet(f"{sf}/events.parquet").collect():
        critical |= {str(r["user_id"])} if r["event_type"] == "purchase" else set()
        grave |= {str(r["user_id"])} if r["event_type"] in ("error", "purchase") and r["event_id"] % 6 < 2 else set()
    want = {k: "Critical" if k in critical else "High" if k in grave or t < 45 else "Medium" if t < 65 else "Low" for k, t in trust.items()}
    assert got == want and "Critical" in want.values()
    days = {r["repo_id"]: r["risk"] for r in queries.QUERIES["g3_risk_level"](spark, sf).collect()}
    events = {(f"{r['user_id']}@{r['ts']:%Y-%m-%d}", r["event_type"] == "purchase") for r in spark.read.parquet(f"{sf}/events.parquet").collect()}
    assert {k for k, v in days.items() if v == "Critical"} == {k for k, bought in events if bought and k.split("@")[0] in trust} and len(set(days.values())) == 4


def test_extract_versions_of_all_lockfiles(spark):
    sf = "/root/testdata/sf0.001"
    run = lambda q: {tuple(r) for r in queries.QUERIES[q](spark, sf).collect()}
    trees = {r["repo_id"] for r in queries.T.files(spark, sf).where("path = 'legacy/package-lock.json' AND content <> ''").collect()}
    want = {(repo, "npm", name, version, "legacy/package-lock.json") for repo in trees for name, version in (("x", "1.1.0"), ("y", "2.2.0"))}
    got = run("d11_extract_versions_all")
    assert trees and got == run("d11_extract_versions") and want < got


def test_limits_of_the_audit_are_the_callers(spark, files):
    """A large lockfile keeps all its advisories, unless the caller sets limits; an unreadable source gives a note."""
    pins = "\n".join(f"p{i}==1.0" for i in range(1200))
    df = files(("requirements.txt", pins))
    adv = spark.createDataFrame([("PyPI", f"p{i}", "1.0", f"V{i}-{j}", j) for i in (0, 1100, 1199) for j in range(12)], "ecosystem string, name string, version string, vuln_id string, vuln_pos int")
    details = spark.createDataFrame([("V1199-11", "s", "d", "CRITICAL")], "vuln_id string, summary string, details string, severity_label string")
    repos = spark.createDataFrame([("r", "n", "github", False, "MIT", "2001-07-01 00:00:00", 0)], "repo_id string, name string, kind string, archived boolean, license string, pushed_at string, open_issues long")
    docs, cov = health.documentation_score(df), health.coverage(df, spark.createDataFrame([("r", 1, False, False, None)], "repo_id string, intended long, cap_reached boolean, deep boolean, source_files_in_repo long"))
    as_of = F.lit("2001-08-01 00:00:00").cast("timestamp")

    def found(**limits):
        rows = audit.findings_of(df, repos, docs, cov, as_of, adv, details, **limits).where("category = 'dependency' OR rule_id = 'DEP000'").collect()
        return {r["rule_id"]: r["severity"] for r in rows}

    everything = found()
    assert len(everything) == 36 and everything["V1199-11"] == "high"
    assert set(found(max_queries=1000)) == {f"V0-{j}" for j in range(12)} and len(found(max_per_dep=10)) == 30
    assert found(max_details=5)["V1199-11"] == "medium"
    status = spark.createDataFrame([("r", False)], "repo_id string, available boolean")
    assert found(advisory_status=status) == {"DEP000": "info"} and len(found(advisory_status=status.withColumn("available", F.lit(True)))) == 36


def test_hot_pins_are_salted(spark, monkeypatch):
    d = spark.createDataFrame([(f"r{i}", 1, "npm", "a", "1", "lock") for i in range(200)], "repo_id string, dep_pos long, ecosystem string, name string, version string, source string")
    adv = spark.createDataFrame([("npm", "a", "1", "V", 0), ("npm", "b", "1", "W", 0)], "ecosystem string, name string, version string, vuln_id string, vuln_pos int")
    plain = sorted(map(tuple, advisories.match_advisories(d, adv).collect()))
    monkeypatch.setattr(advisories, "MAX_BROADCAST", 0)
    assert sorted(map(tuple, advisories.match_advisories(d, adv).collect())) == plain and len(plain) == 200


def test_own_catalogues(spark, files):
    df = files(("build.zig", "x"), ("a.zig", ""), ("package.json", '{"dependencies": {"left": "1"}}'))
    assert [tuple(r) for r in deps.detect_manifests(df, (("build.zig", "zig", "Zig"),)).collect()] == [("r", "build.zig", "zig", "Zig")]
    assert {r["lang"]: r["n"] for r in tech.language_counts(df, (("build.zig", "Zig"),), ((".zig", "Zig"),)).collect()} == {"Zig": 7}
    kind = tech.all_deps(df).first()["kind"]
    assert [r["name"] for r in tech.match_frameworks(tech.all_deps(df), ((kind, "Left", "Framework", ("left",)),)).collect()] == ["Left"]


def test_checkpoint_folder_is_never_guessed_on_a_cluster(spark):
    from types import SimpleNamespace

    from repoaudit.plans import saved

    context = lambda master: SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda folder: None)
    session = lambda master, folder=None: SimpleNamespace(sparkContext=context(master), conf=SimpleNamespace(get=lambda key, default: folder))
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]", "k8s://x"):
        with pytest.raises(ValueError):
            saved.shared_folder(session(master))
        saved.shared_folder(session(master, "hdfs://x/y"))
    for master in ("local", "local[4]", "local[*]"):
        saved.shared_folder(session(master))


def test_a_report_holds_no_plan_of_the_files(spark):
    """Rows of one repository each are written once; before, the plan behind every report read the files again in many copies (g12, s5, s7)."""
    from repoaudit.plans import queries

    out = queries._audit(spark, "/root/testdata/sf0.001")
    assert "FileScan parquet" not in out._jdf.queryExecution().executedPlan().toString() and out.count() > 0
