"""Rule matching: findings with line numbers, suppression, redaction, down-ranking and de-duplication.

Matches of all rules come from one projection per file: each rule is gated by its globs and by literals that a match must
hold, and only then marks its matches in the text, which is cut at the marks. Files are never multiplied by rules, and a text that stands in
many files is scanned once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import catalogs as C
from ..functions import text as X
from . import masking, paths

FINDING = ("repo_id", "finding_pos", "rule_id", "title", "severity", "file_path", "line_number", "description", "recommendation", "category")
#: parts that the places of a text are dealt into
SALTS = 16
DOWNRANKED = "\n\n_Down-ranked: the match lies in a test, example or fixture path._"


def rules_frame(spark, rules: tuple[dict, ...] = C.RULES) -> DataFrame:
    rows = [(i, r["rule_id"], r["title"], r["severity"], r["pattern"], list(r["globs"]), r["redact"], r["category"], r["description"], r["recommendation"]) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "pos int, rule_id string, title string, severity string, pattern string, globs array<string>, redact boolean, category string, description string, recommendation string")


def match_rules_to_files(files: DataFrame, rules: DataFrame) -> DataFrame:
    """(repo_id, path, rule_id) for every rule that applies to a file. ``rules`` is a small dimension (its size is that of the rule set)."""
    patterns = rules.select("rule_id", F.explode_outer("globs").alias("glob"))
    escaped = F.regexp_replace(F.regexp_replace("glob", r"([^A-Za-z0-9_/*?-])", r"\\$1"), r"\?", "(?s:.)")
    star = F.coalesce(F.regexp_replace(escaped, r"\*", "(?s:.*)"), F.lit("(?s:.*)"))
    patterns = patterns.select("rule_id", F.concat(F.lit(r"\A"), star, F.lit(r"\z")).alias("glob_pattern"))
    return files.select("repo_id", "path").join(F.broadcast(patterns), F.expr("path rlike glob_pattern")).select("repo_id", "path", "rule_id").distinct()


def _matches(text: str, rule: dict, pos: int) -> Column:
    """array<struct<rule,line,hit>> of one rule in column ``text``."""
    pattern = X.quoted("(?dU)" + rule["pattern"])
    pieces = f"split(regexp_replace({text}, {pattern}, '\\u0001$0\\u0002'), '\\u0001', -1)"
    breaks = f"size(split(p, {X.quoted(X.BREAK)}, -1)) - 1"
    kind = "array<struct<rule:int,line:int,hit:string>>"
    step = (
        f"aggregate({pieces}, named_struct('line', 1, 'out', cast(array() AS {kind})), (a, p) -> named_struct('line', a.line + {breaks}, 'out', "
        f"CASE WHEN instr(p, '\\u0002') > 0 THEN concat(a.out, array(named_struct('rule', {pos}, 'line', a.line, 'hit', substring_index(p, '\\u0002', 1)))) ELSE a.out END), a -> a.out)"
    )
    gate = [f"contains({text}, {X.quoted(x)})" for x in rule["literals"]]
    gates = ([f"({' OR '.join(gate)})"] if gate else []) + [f"regexp_like({text}, {pattern})"]
    return F.expr(f"CASE WHEN {' AND '.join(gates)} THEN {step} ELSE cast(array() AS {kind}) END")


def _unmarked(text: str) -> Column:
    """The text with blanks for the two characters that mark matches. Hardly any text holds them, and looking for them takes a tenth of the time that replacing does."""
    marked = F.contains(text, F.lit("\x01")) | F.contains(text, F.lit("\x02"))
    return F.when(marked, F.translate(text, "\x01\x02", "  ")).otherwise(F.col(text))


def scan_matches(
    files: DataFrame, rules: tuple[dict, ...], raw: str = "content", masked: str = "masked", keys: tuple[str, ...] = ("repo_id", "file_pos", "path"),
    applies: Callable[[tuple[str, ...]], Column] | None = None,
) -> DataFrame:
    """One row per match: ``keys``, match_pos, rule (place in ``rules``), line_number, hit, line_text. ``applies`` says whether a set of globs fits a row, by its path if not given."""
    applies = applies or (lambda globs: X.matches_globs("path", globs))
    files = files.withColumn("scan_raw", _unmarked(raw))
    if any(r["category"] != "secret" for r in rules):
        files = files.withColumn("scan_masked", _unmarked(masked))
    by_globs: dict[tuple, list[Column]] = {}
    for pos, r in enumerate(rules):
        text = "scan_raw" if r["category"] == "secret" else "scan_masked"
        by_globs.setdefault(r["globs"], []).append(_matches(text, r, pos))
    none = F.expr("cast(array() AS array<struct<rule:int,line:int,hit:string>>)")
    parts = [F.concat(*cols) if not globs else F.when(applies(globs), F.concat(*cols)).otherwise(none) for globs, cols in by_globs.items()]
    # sorted by rule; matches of one rule come in the order of the text
    found = F.expr("array_sort(all_found, (a, b) -> CASE WHEN a.rule < b.rule THEN -1 WHEN a.rule > b.rule THEN 1 ELSE 0 END)")
    # no filter on all_found: it would be pushed down and the rules would run twice
    hits = files.withColumn("all_found", F.concat(*parts)).withColumn("raw_lines", F.when(F.size("all_found") > 0, F.split(raw, X.BREAK, -1)))
    hits = hits.select(*keys, "raw_lines", F.posexplode(found).alias("match_pos", "m"))
    return hits.select(*keys, "match_pos", F.col("m.rule").alias("rule"), F.col("m.line").alias("line_number"), F.col("m.hit").alias("hit"), F.get("raw_lines", F.col("m.line") - 1).alias("line_text"))


def with_rules(matches: DataFrame, rules: tuple[dict, ...]) -> DataFrame:
    """Joins the rule attributes, a dimension of one row per rule."""
    dim = rules_frame(matches.sparkSession, rules).withColumnRenamed("pos", "rule").drop("pattern", "globs")
    return matches.join(F.broadcast(dim), "rule")


def drop_suppressed(matches: DataFrame, marker: str = paths.MARKER) -> DataFrame:
    """Drops matches whose line has the marker, for all rules or naming this one."""
    pattern = rf"(?dU){marker}:\s*ignore(?:\s+([A-Z0-9,\s]+))?"
    named = F.regexp_extract("line_text", pattern, 1)
    ids = F.filter(F.transform(F.split(named, ","), X.strip), lambda t: t != "")
    ignored = F.col("line_text").rlike(pattern) & ((named == "") | F.array_contains(ids, F.col("rule_id")))
    return matches.where(~F.coalesce(ignored, F.lit(False)))


def describe(matches: DataFrame) -> DataFrame:
    """Appends the matched value, redacted if the rule says so, to the description of grave or redacting rules."""
    shown = F.when(F.col("redact"), X.redact("hit")).otherwise(F.col("hit"))
    grave = F.col("severity").isin("high", "critical") | F.col("redact")
    return matches.withColumn("description", F.when(grave, F.concat("description", F.lit("\n\nMatched value: `"), shown, F.lit("`"))).otherwise(F.col("description")))


def apply_path_context(findings: DataFrame, path: str = "file_path") -> DataFrame:
    """Secret and code findings in low-trust paths drop one severity; ``info`` stays."""
    rank = X.severity_rank()
    lower = X.is_low_trust(path) & F.col("category").isin("secret", "code_pattern") & (rank > 0)
    down = F.element_at(F.array(*map(F.lit, C.SEVERITIES)), F.greatest(rank, F.lit(1)))
    return findings.withColumn("description", F.when(lower, F.concat("description", F.lit(DOWNRANKED))).otherwise(F.col("description"))).withColumn("severity", F.when(lower, down).otherwise(F.col("severity")))


def install_hooks(files: DataFrame) -> DataFrame:
    """Findings for npm scripts that run on install."""
    scripts = F.from_json(F.get_json_object("content", "$.scripts"), "map<string,string>")
    hooks = files.where((X.basename() == "package.json") & (F.col("content") != "")).select("repo_id", "file_pos", "path", F.posexplode(scripts).alias("k", "hook", "command"))
    hooks = hooks.where(F.col("hook").isin("preinstall", "install", "postinstall", "prepare"))
    return hooks.select(
        "repo_id", "file_pos", F.col("k").alias("match_pos"), F.lit("JS100").alias("rule_id"), F.concat(F.lit("npm `"), "hook", F.lit("` script declared")).alias("title"),
        F.when(F.col("hook") == "prepare", "medium").otherwise("high").alias("severity"), F.col("path").alias("file_path"), F.lit(None).cast("int").alias("line_number"),
        F.concat(F.lit("The script `"), "hook", F.lit("` runs on install: `"), F.substring("command", 1, 200), F.lit("`")).alias("description"),
        F.lit("Read the script before installing.").alias("recommendation"), F.lit("install_hook").alias("category"),
    )


def env_files(files: DataFrame) -> DataFrame:
    """Findings for committed environment files."""
    found = files.where(X.basename().isin(".env", ".env.local", ".env.production") & (F.col("content") != ""))
    return found.select(
        "repo_id", "file_pos", F.lit(0).alias("match_pos"), F.lit("SEC011").alias("rule_id"), F.concat(F.lit("`"), X.basename(), F.lit("` committed to the repository")).alias("title"),
        F.lit("high").alias("severity"), F.col("path").alias("file_path"), F.lit(None).cast("int").alias("line_number"),
        F.lit("Environment files often hold credentials.").alias("description"), F.lit("Move the values to a secret store and ignore the file.").alias("recommendation"), F.lit("secret").alias("category"),
    )


def dedupe_findings(findings: DataFrame, order: tuple[str, ...] = ("finding_pos",)) -> DataFrame:
    """The first finding per rule, path, line and title of a repository; nulls are equal."""
    first = F.row_number().over(Window.partitionBy("repo_id", "file_path", "rule_id", "line_number", "title").orderBy(*order))
    return findings.withColumn("nth", first).where("nth = 1").drop("nth")


def scan_profile(rules: tuple[dict, ...]) -> tuple[Column, Callable[[tuple[str, ...]], Column]]:
    """What a scan has to know of a path, as one number: the kind of its mask (0 if no rule reads masked text) and which sets of globs fit. Second: the test of the
    number for a set of globs."""
    groups = list(dict.fromkeys(r["globs"] for r in rules if r["globs"]))
    fits = [F.when(X.matches_globs("path", g), F.lit(8 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, g in enumerate(groups)]
    bits = sum(fits, F.lit(0).cast("long"))
    code = [r["globs"] for r in rules if r["category"] != "secret"]
    masks = F.lit(() in code)
    if any(code):
        masks = masks | (bits.bitwiseAND(F.lit(sum(8 << i for i, g in enumerate(groups) if g in code)).cast("long")) != 0)
    profile = bits + F.when(masks, masking.mask_kind()).otherwise(0)
    return profile, lambda globs: F.col("profile").bitwiseAND(F.lit(8 << groups.index(globs)).cast("long")) != 0 if globs else F.lit(True)


def content_findings(files: DataFrame, rules: tuple[dict, ...], marker: str) -> DataFrame:
    """repo_id, file_pos, file_path and the findings' columns, by scanning every distinct text once.

    Forks and vendored files hold the same texts, so files meet as digests: one text of each (digest, profile of its path) is masked and scanned, lines suppressed
    and values shown there too, and only what was found is joined back to the places that hold it. Both sides are salted, as one text may stand in most repositories.
    """
    profile, applies = scan_profile(rules)
    kept = paths.scannable(files).select("repo_id", "file_pos", "path", "content", profile.alias("profile"), F.unhex(F.sha2(F.col("content").cast("binary"), 256)).alias("digest"))
    texts = kept.groupBy("digest", "profile").agg(F.max("content").alias("content"))
    texts = paths.drop_ignored_files(texts, marker)
    if any(r["category"] != "secret" for r in rules):
        texts = texts.withColumn("masked", masking.mask_by_kind(F.col("profile").bitwiseAND(F.lit(7).cast("long")), F.col("content")))
    found = scan_matches(texts, rules, keys=("digest", "profile"), applies=applies)
    found = describe(drop_suppressed(with_rules(found, rules), marker)).drop("line_text", "hit")
    found = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    places = kept.select("repo_id", "file_pos", F.col("path").alias("file_path"), "digest", "profile", F.pmod(F.xxhash64("repo_id", "file_pos"), F.lit(SALTS)).cast("int").alias("salt"))
    return places.join(found, ["digest", "profile", "salt"])


def file_findings(files: DataFrame, rules: tuple[dict, ...], marker: str) -> DataFrame:
    """The same rows by scanning every file, without a shuffle: of use where hardly any text comes twice."""
    kept = paths.drop_ignored_files(paths.scannable(files), marker)
    if any(r["category"] != "secret" for r in rules):
        kept = masking.mask_code(kept)
    return describe(drop_suppressed(with_rules(scan_matches(kept, rules), rules), marker)).withColumnRenamed("path", "file_path")


def rule_findings(files: DataFrame, rules: tuple[dict, ...] = C.RULES, marker: str = paths.MARKER, distinct: bool = True) -> DataFrame:
    """Findings of regex rules before de-duplication, with file_pos and match_pos as their order; ``distinct`` scans equal texts once."""
    found = (content_findings if distinct else file_findings)(files, rules, marker)
    return apply_path_context(found).select("repo_id", "file_pos", "match_pos", *FINDING[2:])


def scan_files(files: DataFrame, rules: tuple[dict, ...] = C.RULES, marker: str = paths.MARKER, distinct: bool = True) -> DataFrame:
    """All security findings of every repository, first occurrence of each, with ``finding_pos`` as their order.

    The order is stage (rules, hooks, environment files), file and match; it is one number, so no global sort is needed.
    """
    stages = [rule_findings(files, rules, marker, distinct), install_hooks(files), env_files(files)]
    staged = [s.withColumn("finding_pos", F.lit(i).cast("long") * F.lit(1 << 60) + F.col("file_pos") * F.lit(1 << 24) + F.col("match_pos")) for i, s in enumerate(stages)]
    out = staged[0]
    for s in staged[1:]:
        out = out.unionByName(s)
    return dedupe_findings(out.select(*FINDING))
