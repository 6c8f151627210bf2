"""Rules, masking, suppression and path context on small files."""

import random

import pytest
from pyspark.sql import functions as F

from repoaudit.operators import masking, scan

KEY = "AK" + "IA" + "Q7" * 8

CASES = [
    ("a.py", "eval(s)", {"PY001"}), ("b.py", "df.eval('a')", set()), ("c.py", "yaml.load(raw)", {"PY008"}), ("d.py", "yaml.load(\n  raw,\n  Loader=yaml.SafeLoader)", set()), ("e.py", "get(u, verify=False)", {"PY009"}),
    ("f.py", "# eval(x)\ns = 'exec(y)'\n", set()), ("g.py", 'x = f"{eval(z)}"\n', {"PY001"}), ("h.py", "subprocess.run(a,\n shell=True)", {"PY004"}), ("i.py", "it's eval(x)", {"PY001"}),
    ("a.js", "$scope.$eval(x)", set()), ("b.js", "el.innerHTML = x", {"JS006"}), ("c.js", "el.innerHTML === x", set()), ("d.js", "setTimeout('x')", {"JS007"}), ("e.js", "this.setTimeout('x')", set()), ("f.js", "/* eval(x) */ const t = `eval(y)`;", set()), ("g.js", "/it's/; eval(x)", {"JS001"}),
    ("a.rb", "Marshal.load(x)", {"RB006"}), ("b.rb", "YAML.load(x) # eval(y)", {"RB007"}), ("c.rb", "`ls`", {"RB002"}),
    ("a.php", "<?php eval($x);", {"PHP001"}), ("b.php", "system('ls');", {"PHP002"}), ("c.php", "include $_GET['p'];", {"PHP006"}), ("d.php", "$o->eval(1); // eval(2)", set()), ("e.php", "assert('x');", {"PHP009"}),
    ("run.sh", "curl x | bash", {"SH001"}), ("x/run.sh", "curl -k y", {"SH008"}), ("y.sh", "# curl x | sh\nsudo ls", {"SH003"}), ("sub/Makefile", "\tsudo x", set()),
    ("Dockerfile", "FROM a:latest\nUSER root", {"DK001", "DK005"}), ("sub/Dockerfile", "USER root", set()), (".github/workflows/c.yml", "on:\n  pull_request_target:\n", {"GH001"}), (".github/workflows/d.yml", "x: ${{ github.event.issue.title }}", {"GH006"}),
    ("config.py", f"k = '{KEY}'", {"SEC003"}), ("ok.py", "eval(x)  # audit: ignore PY001", set()), ("ok2.py", "eval(x)  # audit: ignore", set()), ("no.py", "eval(x)  # audit: ignore PY002", {"PY001"}), ("all.py", "# audit: ignore-file\neval(x)", set()),
    ("m.py", "exec(a)\n\n\nexec(b)\n", {"PY002"}), (".env", "A=1", {"SEC011"}), ("package.json", '{"scripts": {"postinstall": "x", "test": "y"}}', {"JS100"}), ("bad/package.json", "{", set()), ("empty.py", "", set()), ("null.py", None, set()),
    ("n1.py", "model.eval()", set()), ("n2.py", "y = eval(x)", {"PY001"}), ("n3.py", "yaml.safe_load(x)", set()), ("n4.py", "yaml.load(raw, Loader=yaml.CSafeLoader)", set()), ("n5.py", "eval(eval(x))", {"PY001"}), ("n6.py", "async_exec(x); my.exec(y)", set()),
    ("n1.js", "vm.eval(x)", set()), ("n2.js", "eval(x)", {"JS001"}), ("n3.js", "a.outerHTML += b", {"JS006"}), ("n4.js", "setTimeout(() => f(), 5)", set()), ("n5.js", "setInterval(`f()`, 5)", {"JS007"}), ("n6.js", "document.write(x)", {"JS006"}), ("n7.js", "// eval(x)\n'eval(y)'", set()),
    ("n1.rb", "obj.eval(x)", set()), ("n2.rb", "# Marshal.load(x)", set()), ("n3.rb", "eval(x)", {"RB001"}), ("n4.rb", "YAML.safe_load(x)", set()),
    ("n1.php", "<?php unserialize($x);", {"PHP003"}), ("n2.php", "include $file;", {"PHP005"}), ("n3.php", "require_once($_POST['p']);", {"PHP006"}), ("n4.php", "// eval($x)", set()), ("n5.php", "$s = 'eval(1)';", set()), ("n6.php", "extract($_GET);", {"PHP007"}),
    ("n7.php", "create_function('a', 'b');", {"PHP008"}), ("n8.php", "# system('ls')", set()), ("n9.php", "base64_decode($x);", {"PHP004"}), ("n10.php", "$this->system('x');", set()),
    ("n1.sh", "wget --no-check-certificate u", {"SH008"}), ("n2.sh", "  # sudo ls", set()), ("n3.sh", "echo 'curl x | sh'", {"SH001"}),
    (".github/workflows/e.yml", "x: ${{ github.event.repository.name }}", set()), (".github/workflows/f.yml", "x: ${{ github.event.sender.login }}", set()), (".github/workflows/g.yml", "x: ${{ github.event.comment.body }}", {"GH006"}),
    (".github/workflows/h.yml", "x: ${{ github.event.pull_request.title }}", {"GH006"}), (".github/workflows/i.yml", "x: ${{ github.event.review_comment.body }}", {"GH006"}),
]


@pytest.fixture(scope="module")
def found(spark, files):
    return scan.scan_files(files(*((p, c) for p, c, _ in CASES))).collect()


@pytest.mark.parametrize("path,expected", [(p, e) for p, _, e in CASES])
def test_rules(found, path, expected):
    assert {r["rule_id"] for r in found if r["file_path"] == path} == expected


def test_lines_and_redaction(found):
    assert sorted(r["line_number"] for r in found if r["file_path"] == "m.py") == [1, 4]
    secret = next(r for r in found if r["rule_id"] == "SEC003")
    assert KEY not in secret["description"] and KEY[:4] + "*" * 16 in secret["description"]


def test_low_trust_paths_drop_one_tier(files):
    rows = scan.scan_files(files(("app.py", "eval(x)"), ("tests/a.py", "eval(x)"), ("examples/b.py", "eval(x)"))).collect()
    assert {r["file_path"]: r["severity"] for r in rows} == {"app.py": "high", "tests/a.py": "medium", "examples/b.py": "medium"}


def test_dedupe_is_idempotent_and_null_safe(spark):
    rows = [("r", i, "A", "t", "high", None, None, "d", "x", "secret") for i in range(3)]
    df = spark.createDataFrame(rows, "repo_id string, finding_pos long, rule_id string, title string, severity string, file_path string, line_number int, description string, recommendation string, category string")
    once = scan.dedupe_findings(df)
    assert [r["finding_pos"] for r in once.collect()] == [0] and scan.dedupe_findings(once).count() == 1


def hidden(text, starts, quotes):
    """Places inside comments and strings: a machine whose state is the closing mark it waits for."""
    places, waits, begun, k = set(), None, 0, 0
    while k < len(text) or waits:
        here = text[k : k + 1]
        match waits:
            case None:
                opening = next((t for t in (*starts, *quotes) if text.startswith(t, k)), "")
                waits, begun = {"//": "\n", "#": "\n", "/*": "*/"}.get(opening, opening) or None, k
                k += max(1, len(opening))
            case "\n":
                if here in ("", "\n"):
                    places.update(range(begun, k))
                    waits = None
                else:
                    k += 1
            case "*/":
                if here == "" or text.startswith("*/", k):
                    k = min(len(text), k + 2)
                    places.update(range(begun, k))
                    waits = None
                else:
                    k += 1
            case quote:
                if here == quote:
                    places.update(range(begun + 1, k))
                    waits, k = None, k + 1
                elif here == "\\":
                    k += 2
                elif here == "" and quote == "`":  # open to the end: the last character shows, unless a backslash stands alone there
                    places.update(range(begun + 1, min(k, len(text)) if k > len(text) else k - 1))
                    waits = None
                elif here == "" or here == "\n" and quote != "`":  # never closed: an ordinary character
                    waits, k = None, begun + 1
                else:
                    k += 1
    return places


def plain_mask(text, starts, quotes):
    inside = hidden(text, starts, quotes)
    return "".join(" " if k in inside and c not in "\r\n" else c for k, c in enumerate(text))


@pytest.mark.parametrize("mask,starts,quotes", [(masking.mask_c_family, ("//", "/*"), "\"'`"), (masking.mask_php, ("//", "#", "/*"), "\"'"), (masking.mask_ruby, ("#",), "\"'")])
def test_masks_agree_with_a_state_machine(spark, mask, starts, quotes):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab/*#\"'`\\\n\r ") for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    got = spark.createDataFrame([(t,) for t in texts], "content string").select("content", mask(F.col("content")).alias("m")).collect()
    wrong = [(r["content"], r["m"]) for r in got if r["m"] != plain_mask(r["content"], starts, quotes)]
    assert not wrong, wrong[:3]


def test_equal_texts_are_scanned_once_with_equal_findings(spark, monkeypatch):
    """Forks of one repository: the same findings as file by file, from as many scanned texts as there are distinct ones a profile."""
    texts = [c for _, c, _ in CASES if c] + ["eval(x)\nexec(y)\n", f"k = '{KEY}'", "a\x01b eval(z)\x02", "# audit: ignore-file\neval(x)"]
    names = ["a.py", "b.js", "c.rb", "Rakefile", "d.php", "e.sh", "Makefile", "Dockerfile", ".github/workflows/x.yml", "docker-compose.yml", "n.txt", "tests/a.py", "lib/other.py"]
    rows = [(f"r{r}", i, f"f{i // len(names)}/{names[i % len(names)]}" if names[i % len(names)][0] not in ".D" else names[i % len(names)], len(t), t, False, False) for r in range(3) for i, t in enumerate(t for t in texts for _ in names)]
    files = spark.createDataFrame(rows, "repo_id string, file_pos long, path string, size long, content string, is_binary boolean, truncated boolean").repartition(4)
    scanned = []
    true = scan.scan_matches
    monkeypatch.setattr(scan, "scan_matches", lambda f, *a, **k: (scanned.append(f.count()), true(f, *a, **k))[1])
    read = lambda distinct: sorted(map(repr, scan.scan_files(files, distinct=distinct).collect()))
    once, each = read(True), read(False)
    assert once == each and len(once) > 300
    profiles = 8  # Python, JavaScript, Ruby, PHP, shell, Dockerfile, workflow, compose; plain files share one with none
    assert scanned[0] <= len(set(texts)) * (profiles + 1) < scanned[1] / 3


def test_profiles_of_rules_without_globs(spark, files):
    """Rules of one's own that look at masked or raw text everywhere."""
    base = {"title": "t", "severity": "low", "globs": (), "literals": (), "redact": False, "description": "d", "recommendation": "r", "pack": "X"}
    rules = ({**base, "rule_id": "X1", "pattern": "foo", "category": "code_pattern"}, {**base, "rule_id": "X2", "pattern": "foo", "category": "secret"})
    table = files(("a.py", "x = 'foo'  # foo\nfoo()"), ("b.txt", "foo\n# foo"), ("c.md", "foo\n# foo"))
    for distinct in (True, False):
        found = sorted((r["rule_id"], r["file_path"], r["line_number"]) for r in scan.scan_files(table, rules, distinct=distinct).collect())
        assert found == [("X1", "a.py", 2), ("X1", "b.txt", 1), ("X1", "c.md", 1), ("X2", "a.py", 1), ("X2", "a.py", 2), ("X2", "b.txt", 1), ("X2", "b.txt", 2), ("X2", "c.md", 1), ("X2", "c.md", 2)]
