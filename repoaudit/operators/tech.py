"""Technology profile: languages, dependencies, frameworks and project type of each repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import catalogs as C
from ..functions import text as X


def language_counts(files: DataFrame, by_names: tuple[tuple[str, str], ...] = C.LANGUAGE_BY_NAME, by_suffixes: tuple[tuple[str, str], ...] = C.LANGUAGE_BY_SUFFIX) -> DataFrame:
    """(repo_id, lang, n, evidence, first_seen): five for each manifest that hints at a language, one for each file suffix.

    The two catalogues, (name or suffix, language), may be the caller's own.
    """
    spark = files.sparkSession
    names = F.broadcast(spark.createDataFrame(list(by_names), "name string, lang string"))
    suffixes = F.broadcast(spark.createDataFrame(list(by_suffixes), "suffix string, lang string"))
    parts = files.select("repo_id", "file_pos", X.basename().alias("name"), X.suffix().alias("suffix"))
    by_name = parts.join(names, "name").select("repo_id", "lang", F.lit(5).alias("n"), F.col("name").alias("evidence"), (F.col("file_pos") * 2).alias("at"))
    by_suffix = parts.join(suffixes, "suffix").select("repo_id", "lang", F.lit(1).alias("n"), F.concat(F.lit("`"), "suffix", F.lit("` files")).alias("evidence"), (F.col("file_pos") * 2 + 1).alias("at"))
    found = by_name.unionByName(by_suffix).groupBy("repo_id", "lang")
    return found.agg(F.sum("n").alias("n"), F.array_sort(F.collect_set("evidence")).alias("evidence"), F.min("at").alias("first_seen"))


def merge_language_bytes(counts: DataFrame, language_bytes: DataFrame) -> DataFrame:
    """The greater of each count and the language's bytes on a scale of 20; ``language_bytes``: repo_id, lang, bytes, lang_pos."""
    top = F.greatest(F.max("bytes").over(Window.partitionBy("repo_id")), F.lit(1))
    scaled = language_bytes.select("repo_id", "lang", F.floor(20 * F.col("bytes") / top).cast("long").alias("scaled"), "lang_pos")
    both = counts.join(scaled, ["repo_id", "lang"], "full_outer")
    said = F.when(F.col("scaled").isNotNull(), F.array(F.lit("GitHub language stats"))).otherwise(F.expr("cast(array() AS array<string>)"))
    evidence = F.array_sort(F.concat(F.coalesce("evidence", F.expr("cast(array() AS array<string>)")), said))
    return both.select("repo_id", "lang", F.greatest(F.coalesce("n", F.lit(0)), F.coalesce("scaled", F.lit(0))).alias("n"), evidence.alias("evidence"), F.coalesce("first_seen", F.lit(1 << 40) + F.col("lang_pos")).alias("first_seen"))


def detect_languages(counts: DataFrame) -> DataFrame:
    """(repo_id, lang, confidence, evidence, place): share of the top count, at most 0.99, from 0.05 on; by count, then first seen."""
    top = F.greatest(F.max("n").over(Window.partitionBy("repo_id")), F.lit(1))
    confidence = F.least(F.lit(0.99), F.bround(F.col("n") / top, 2))
    place = F.row_number().over(Window.partitionBy("repo_id").orderBy(F.col("n").desc(), "first_seen", "lang"))
    kept = counts.withColumn("confidence", confidence).where("confidence >= 0.05")
    return kept.withColumn("place", place).select("repo_id", "lang", "confidence", "evidence", "place")


def primary_language(languages: DataFrame) -> DataFrame:
    return languages.where("place = 1").select("repo_id", F.col("lang").alias("primary_language"))


def first_content(files: DataFrame, *names: str) -> DataFrame:
    """(repo_id, name, content) of the first non-empty file of each of the base names."""
    own = files.where(X.basename().isin(*names) & (F.col("content") != "")).select("repo_id", X.basename().alias("name"), "file_pos", "content")
    return own.groupBy("repo_id", "name").agg(F.min_by("content", "file_pos").alias("content"))


def _keys(content: str, *sections: str) -> Column:
    keys = [F.coalesce(F.map_keys(F.from_json(F.get_json_object(content, f"$.{s}"), "map<string,string>")), F.expr("cast(array() AS array<string>)")) for s in sections]
    return F.array_distinct(F.concat(*keys))


def _found(content: str | Column, pattern: str) -> Column:
    return F.regexp_extract_all(content, F.lit(pattern), F.lit(1))


def requirements_names(content: str = "content") -> Column:
    lines = F.transform(X.lines(content), lambda x: X.strip(F.split(x, "#", 2)[0]))
    return F.transform(F.filter(lines, lambda x: (x != "") & ~x.startswith("-")), lambda x: F.lower(F.split(x, r"[<>=!~\[\s]", 2)[0]))


def pyproject_names(content: str = "content") -> Column:
    """Every quoted string that may be a requirement."""
    return F.transform(_found(content, r'(?d)"([A-Za-z0-9_.\-]+)\s*(?:[<>=!~\[].*)?"'), F.lower)


def pipfile_names(content: str = "content") -> Column:
    names = F.transform(_found(content, r"(?dm)^([A-Za-z0-9_.\-]+)\s*="), F.lower)
    return F.filter(names, lambda x: ~x.isin("name", "url", "verify_ssl", "python_version"))


def setup_names(content: str = "content") -> Column:
    block = F.regexp_extract(content, r"(?s)install_requires\s*=\s*\[(.*?)\]", 1)
    return F.transform(_found(block, r"""['"]([A-Za-z0-9_.\-]+)"""), F.lower)


def gemfile_names(content: str = "content") -> Column:
    return _found(content, r"""(?dm)^\s*gem\s+['"]([^'"]+)['"]""")


def gemfile_lock_names(content: str = "content") -> Column:
    return _found(content, r"(?dm)^\s{4}([A-Za-z0-9_\-]+)\s*\(")


def go_names(content: str = "content") -> Column:
    """The first word of each line that is no module, go or comment line."""
    lines = F.filter(F.transform(X.lines(content), X.strip), lambda x: (x != "") & ~x.rlike(r"^(?:module |go |//)"))
    return F.transform(lines, lambda x: F.split(x, r"\s+", 2)[0])


def cargo_names(content: str = "content") -> Column:
    """Keys in sections whose header names dependencies; the section is carried along the lines of the row."""

    def step(a: Column, line: Column) -> Column:
        state = lambda on, out: F.struct(on.alias("on"), out.alias("out"))
        key = F.regexp_replace(X.strip(F.split(line, "=", 2)[0]), '^"+|"+$', "")
        header = line.startswith("[") & line.endswith("]")
        taken = a["on"] & F.contains(line, F.lit("=")) & ~line.startswith("#")
        return F.when(header, state(F.contains(line, F.lit("dependencies")), a["out"])).when(taken, state(a["on"], F.concat(a["out"], F.array(key)))).otherwise(a)

    start = F.struct(F.lit(False).alias("on"), F.expr("cast(array() AS array<string>)").alias("out"))
    return F.aggregate(F.transform(X.lines(content), X.strip), start, step, lambda a: a["out"])


def java_names(content: str = "content") -> Column:
    """The catalogue's keys that the text holds."""
    keys = [k for kind, _, _, names in C.FRAMEWORKS if kind == "java" for k in names]
    return F.filter(F.array(*map(F.lit, keys)), lambda k: F.contains(F.col(content), k))


#: manifest, ecosystem, rank among its ecosystem's manifests, source that evidence names, names
MANIFEST_DEPS = (
    ("requirements.txt", "python", 0, "requirements.txt", requirements_names), ("pyproject.toml", "python", 1, "pyproject.toml", pyproject_names), ("Pipfile", "python", 2, "Pipfile", pipfile_names), ("setup.py", "python", 3, "setup.py", setup_names),
    ("package.json", "javascript", 0, "package.json", lambda: _keys("content", "dependencies", "devDependencies", "peerDependencies", "optionalDependencies")), ("Gemfile", "ruby", 0, "Gemfile", gemfile_names), ("Gemfile.lock", "ruby", 1, "Gemfile.lock", gemfile_lock_names),
    ("go.mod", "go", 0, "go.mod", go_names), ("Cargo.toml", "rust", 0, "Cargo.toml", cargo_names), ("composer.json", "php", 0, "composer.json", lambda: _keys("content", "require", "require-dev")),
    *((name, "java", rank, "pom.xml/build.gradle", java_names) for rank, name in enumerate(("pom.xml", "build.gradle", "build.gradle.kts", "settings.gradle"))),
)


def all_deps(files: DataFrame, *kinds: str) -> DataFrame:
    """(repo_id, kind, dep, source) of all ecosystems, or of ``kinds``; of a name in several manifests the first counts.

    One scan: the first manifest of each name is parsed in its row by the expression for that name.
    """
    chosen = [m for m in MANIFEST_DEPS if not kinds or m[1] in kinds]
    found = F.expr("cast(array() AS array<struct<kind:string,dep:string,rank:int,source:string>>)")
    for name, kind, rank, source, names in chosen:
        own = _described(names(), kind, rank, source)
        found = F.when(F.col("name") == name, own).otherwise(found)
    rows = first_content(files, *(m[0] for m in chosen)).select("repo_id", F.inline(found)).where("dep <> ''")
    best = rows.groupBy("repo_id", "kind", "dep").agg(F.min(F.struct("rank", "source")).alias("m"))
    return best.select("repo_id", "kind", "dep", F.col("m.source").alias("source"))


def _described(names: Column, kind: str, rank: int, source: str) -> Column:
    return F.transform(names, lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("dep"), F.lit(rank).alias("rank"), F.lit(source).alias("source")))


def python_deps(files: DataFrame) -> DataFrame:
    """(repo_id, dep, source): requirements.txt before pyproject.toml, Pipfile and setup.py."""
    return all_deps(files, "python").select("repo_id", "dep", "source")


def javascript_deps(files: DataFrame) -> DataFrame:
    """(repo_id, dep) of the four dependency sections of the first package.json."""
    return all_deps(files, "javascript").select("repo_id", "dep")


def javascript_scripts(files: DataFrame) -> DataFrame:
    """(repo_id, script, command) of the first package.json's non-empty scripts."""
    scripts = F.from_json(F.get_json_object("content", "$.scripts"), "map<string,string>")
    return first_content(files, "package.json").select("repo_id", F.explode(scripts).alias("script", "command")).where("command <> ''")


def ruby_deps(files: DataFrame) -> DataFrame:
    """(repo_id, dep, source): Gemfile before Gemfile.lock."""
    return all_deps(files, "ruby").select("repo_id", "dep", "source")


def go_deps(files: DataFrame) -> DataFrame:
    return all_deps(files, "go").select("repo_id", "dep")


def rust_deps(files: DataFrame) -> DataFrame:
    return all_deps(files, "rust").select("repo_id", "dep")


def php_deps(files: DataFrame) -> DataFrame:
    return all_deps(files, "php").select("repo_id", "dep")


def java_blob(files: DataFrame) -> DataFrame:
    """(repo_id, blob): the first pom.xml and gradle files, in a fixed order."""
    names = ("pom.xml", "build.gradle", "build.gradle.kts", "settings.gradle")
    first = first_content(files, *names).withColumn("k", F.array_position(F.array(*map(F.lit, names)), F.col("name")))
    ordered = F.array_sort(F.collect_list(F.struct("k", "content")))
    return first.groupBy("repo_id").agg(F.array_join(F.transform(ordered, lambda s: s["content"]), "\n").alias("blob"))


def match_frameworks(deps: DataFrame, frameworks: tuple[tuple[str, str, str, tuple[str, ...]], ...] = C.FRAMEWORKS) -> DataFrame:
    """(repo_id, name, category, confidence, evidence, place): the first key of each entry that a repository's dependencies have.

    ``frameworks``: (kind of dependency, name, category, keys), the caller's own if given.
    """
    rows = [(kind, name, category, key, rank, i) for i, (kind, name, category, keys) in enumerate(frameworks) for rank, key in enumerate(keys)]
    entries = F.broadcast(deps.sparkSession.createDataFrame(rows, "kind string, name string, category string, key string, rank int, place int"))
    # go names match by prefix, all others as a whole; either way the catalogue is the broadcast side
    exact = deps.where("kind <> 'go'").join(entries.withColumn("dep", F.col("key")), ["kind", "dep"])
    loose = deps.where("kind = 'go'").join(entries, "kind").where(F.col("dep").startswith(F.col("key")))
    fields = ("repo_id", "kind", "name", "category", "key", "rank", "place", "source")
    both = exact.select(*fields).unionByName(loose.select(*fields))
    best = both.groupBy("repo_id", "kind", "name", "category", "place").agg(F.min(F.struct("rank", "key", "source")).alias("m"))
    confidence = F.when(F.col("kind") == "java", 0.85).otherwise(0.9)
    return best.select("repo_id", "name", "category", confidence.alias("confidence"), F.concat(F.lit("`"), "m.key", F.lit("` in "), "m.source").alias("evidence"), "place")


def marker_frameworks(files: DataFrame) -> DataFrame:
    """Technologies that the presence of a file shows, in one aggregation."""
    ends = lambda *names: F.max(F.col("path").rlike("(?:" + "|".join(n.replace(".", r"\.") for n in names) + r")\z"))
    marks = (
        ("Vite", "Tooling", 0.85, "vite.config.* present", ends("vite.config.ts", "vite.config.js"), 100),
        ("Next.js", "Framework", 0.9, "next.config.* present", ends("next.config.js", "next.config.mjs"), 101),
        ("Nuxt", "Framework", 0.9, "nuxt.config.* present", ends("nuxt.config.ts", "nuxt.config.js"), 102),
        ("Angular", "Framework", 0.9, "angular.json present", F.max(F.col("path") == "angular.json"), 103),
        ("Docker", "Runtime", 0.8, "Dockerfile present", F.max(X.basename() == "Dockerfile"), 900),
        ("Docker Compose", "Runtime", 0.7, "compose file present", F.max(X.basename().isin("docker-compose.yml", "compose.yml")), 901),
    )
    flags = files.groupBy("repo_id").agg(*(m[4].alias(f"m{i}") for i, m in enumerate(marks)))
    found = F.filter(F.array(*(F.when(F.col(f"m{i}"), F.struct(F.lit(m[0]).alias("name"), F.lit(m[1]).alias("category"), F.lit(m[2]).alias("confidence"), F.lit(m[3]).alias("evidence"), F.lit(m[5]).alias("place"))) for i, m in enumerate(marks))), lambda s: s.isNotNull())
    return flags.select("repo_id", F.inline(found))


def hook_signal(scripts: DataFrame) -> DataFrame:
    """One "npm install hook" row for each hook among a repository's scripts."""
    hooks = ("preinstall", "install", "postinstall", "prepare")
    place = F.array_position(F.array(*map(F.lit, hooks)), F.col("script")).cast("int") + 103
    return scripts.where(F.col("script").isin(*hooks)).select("repo_id", F.lit("npm install hook").alias("name"), F.lit("Tooling").alias("category"), F.lit(0.6).alias("confidence"), F.concat(F.lit("package.json scripts."), "script").alias("evidence"), place.alias("place"))


def detect_frameworks(*signals: DataFrame) -> DataFrame:
    """(repo_id, name, category, confidence, evidence, place): signals merged by name, most certain first.

    Python and JavaScript entries stand before marker files, and all others behind them, as in the catalogue's order.
    """
    union = signals[0]
    for s in signals[1:]:
        union = union.unionByName(s)
    n_early = sum(kind in ("python", "javascript") for kind, *_ in C.FRAMEWORKS)
    at = F.when((F.col("place") < 100) & (F.col("place") >= n_early), F.col("place") + 200).otherwise(F.col("place"))
    union = union.withColumn("at", at)
    ordered = F.transform(F.array_sort(F.collect_set(F.struct("at", "evidence"))), lambda s: s["evidence"])
    merged = union.groupBy("repo_id", "name").agg(F.min_by("category", "at").alias("category"), F.max("confidence").alias("confidence"), F.array_distinct(ordered).alias("evidence"))
    place = F.row_number().over(Window.partitionBy("repo_id").orderBy(F.col("confidence").desc(), "name"))
    return merged.withColumn("place", place)


def classify_project_type(files: DataFrame, frameworks: DataFrame, languages: DataFrame) -> DataFrame:
    """(repo_id, project_type) by an ordered list of tests over one row of flags per repository."""
    ends = lambda s: F.max(F.col("path").endswith(s))
    named = lambda *n: F.max(X.basename().isin(*n))
    flags = files.groupBy("repo_id").agg(
        ends(".tf").alias("tf"), named("Chart.yaml").alias("helm"), ends(".ipynb").alias("notebook"), named("pyproject.toml", "setup.py").alias("python_package"), named("package.json").alias("npm"),
        F.max(F.contains("path", F.lit("background.js")) | F.contains("path", F.lit("content_script"))).alias("extension"), named("manifest.json").alias("manifest"), F.max(F.contains("path", F.lit("popup"))).alias("popup"), named("Dockerfile").alias("docker"),
    )
    fw = frameworks.groupBy("repo_id").agg(F.collect_set("name").alias("fw"))
    lang = languages.groupBy("repo_id").agg(F.collect_set("lang").alias("lg"))
    none = F.expr("cast(array() AS array<string>)")
    row = flags.join(fw, "repo_id", "left").join(lang, "repo_id", "left").withColumn("fw", F.coalesce("fw", none)).withColumn("lg", F.coalesce("lg", none))
    has = lambda column, *names: F.arrays_overlap(column, F.array(*map(F.lit, names)))
    front, back = has("fw", *C.FRONTEND), has("fw", *C.BACKEND)
    kind = (
        F.when(F.col("tf") | F.col("helm"), "Infrastructure/devops repo")
        .when(F.col("notebook") & has("lg", "Python"), "Data science notebook repo")
        .when(front & back, "Fullstack app").when(front, "Frontend app").when(back, "Backend API")
        .when(has("fw", "Typer", "Click"), "CLI tool").when(has("fw", "Clap") & has("lg", "Rust"), "CLI tool").when(has("fw", "Cobra") & has("lg", "Go"), "CLI tool")
        .when(F.col("python_package"), "Library/package").when(F.col("npm") & has("fw", "Electron"), "Desktop app")
        .when(F.col("extension") | (F.col("manifest") & F.col("popup")), "Browser extension").when(F.col("docker"), "Dockerized service")
        .when(F.arrays_overlap(F.transform("fw", lambda f: F.lower(f)), F.array(*map(F.lit, C.GAMES))), "Game project").when(has("lg", "Swift", "Kotlin", "Dart"), "Mobile app").otherwise("Unknown")
    )
    return row.select("repo_id", kind.alias("project_type"))
