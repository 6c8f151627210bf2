"""Maintenance, documentation, structure and coverage of repositories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import catalogs as C
from ..functions import text as X


def detect_license(files: DataFrame) -> DataFrame:
    """(repo_id, license) from the first top-level licence file; repositories without one have no row."""
    own = files.where(~F.contains("path", F.lit("/")) & F.lower("path").isin(*C.LICENSE_NAMES))
    first = own.groupBy("repo_id").agg(F.min_by(F.struct("content"), "file_pos").alias("f")).select("repo_id", F.substring("f.content", 1, 4096).alias("head"))
    label = F.lit("Detected")
    for name, pattern in reversed(C.LICENSES):
        label = F.when(F.col("head").rlike("(?iu)" + pattern), name).otherwise(label)
    return first.select("repo_id", label.alias("license"))


def days_since(timestamp: Column, as_of: Column) -> Column:
    """Whole days passed, never below 0; null for what is no timestamp. Pass ``as_of``: results must not depend on the clock."""
    days = F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(F.try_to_timestamp(timestamp))) / 86400).cast("int")
    return F.when(days.isNotNull(), F.greatest(F.lit(0), days))


def _finding(condition: Column, rule_id: str, severity: str, description: Column, recommendation: str, category: str) -> Column:
    fields = F.struct(F.lit(rule_id).alias("rule_id"), F.lit(C.TITLES[rule_id]).alias("title"), F.lit(severity).alias("severity"), description.alias("description"), F.lit(recommendation).alias("recommendation"), F.lit(category).alias("category"))
    return F.when(condition, fields)


def _findings(df: DataFrame, found: list[Column]) -> DataFrame:
    rows = df.select("repo_id", F.posexplode(F.filter(F.array(*found), lambda f: f.isNotNull())).alias("k", "f"))
    return rows.select("repo_id", F.col("k").cast("long").alias("finding_pos"), F.col("f.rule_id"), F.col("f.title"), F.col("f.severity"), F.lit(None).cast("string").alias("file_path"), F.lit(None).cast("int").alias("line_number"), F.col("f.description"), F.col("f.recommendation"), F.col("f.category"))


def maintenance_findings(repos: DataFrame, as_of: Column) -> DataFrame:
    age = days_since(F.col("pushed_at"), as_of)
    aged = F.concat(F.lit("Last push was "), age.cast("string"), F.lit(" days ago."))
    return _findings(repos, [
        _finding(F.coalesce("archived", F.lit(False)), "MN001", "medium", F.lit("It gets no more updates."), "Prefer a maintained fork.", "maintenance"),
        _finding(F.col("license").isNull(), "MN002", "medium", F.lit("Without a licence nothing may be used."), "Ask for a licence.", "maintenance"),
        _finding(age > 365, "MN003", "medium", aged, "Confirm that the project is maintained.", "maintenance"),
        _finding((age > 180) & (age <= 365), "MN004", "low", aged, "Check whether maintainers respond.", "maintenance"),
        _finding(F.col("open_issues") > 500, "MN005", "low", F.concat(F.col("open_issues").cast("string"), F.lit(" open issues and pull requests.")), "Read the issues with most votes.", "maintenance"),
    ])


def maintenance_score(repos: DataFrame, findings: DataFrame, as_of: Column) -> DataFrame:
    """(repo_id, maintenance): 100 less 5, 15, 30 or 50 a finding, 5 less for an unknown age, 5 more below 30 days, within 0 to 100."""
    penalty = F.element_at(F.array(*map(F.lit, (0, 5, 15, 30, 50))), X.severity_rank() + 1)
    lost = findings.where(F.col("rule_id").startswith("MN")).groupBy("repo_id").agg(F.sum(penalty).alias("lost"))
    age = days_since(F.col("pushed_at"), as_of)
    bonus = F.when(age.isNull(), -5).when(age < 30, 5).otherwise(0)
    score = 100 - F.coalesce("lost", F.lit(0)) + bonus
    return repos.join(lost, "repo_id", "left").select("repo_id", F.least(F.lit(100), F.greatest(F.lit(0), score)).cast("int").alias("maintenance"))


def popularity_score(repos: DataFrame) -> DataFrame:
    """(repo_id, popularity); null for local repositories."""
    n = F.coalesce("stars", F.lit(0)) + F.coalesce("forks", F.lit(0))
    # the logarithm of an exact power of ten may come out just below its whole value
    score = F.when((F.coalesce("stars", F.lit(0)) == 0) & (F.coalesce("forks", F.lit(0)) == 0), 25).otherwise(F.least(F.lit(100), F.greatest(F.lit(0), (F.log10(n + 1) * 20).cast("int") + 25)))
    return repos.select("repo_id", F.when(F.col("kind") != "local", score).cast("int").alias("popularity"))


def documentation_score(files: DataFrame) -> DataFrame:
    """(repo_id, documentation, has_readme, has_security_policy) from top-level names and directories, in one aggregation."""
    low = F.lower("path")
    top, folder = ~F.contains("path", F.lit("/")), F.when(F.contains("path", F.lit("/")), F.split(low, "/")[0])
    flags = [(F.max(top & low.isin(*names)), points) for _, names, points in C.DOCUMENTS] + [(F.max(F.coalesce(folder.isin(*names), F.lit(False))), points) for names, points in C.DOCUMENT_DIRS]
    row = files.groupBy("repo_id").agg(*(f.alias(f"f{i}") for i, (f, _) in enumerate(flags)))
    score = sum((F.when(F.col(f"f{i}"), points).otherwise(0) for i, (_, points) in enumerate(flags)), F.lit(0))
    return row.select("repo_id", F.least(F.lit(100), score).cast("int").alias("documentation"), F.col("f0").alias("has_readme"), F.col("f3").alias("has_security_policy"))


def documentation_findings(scores: DataFrame) -> DataFrame:
    return _findings(scores, [
        _finding(~F.col("has_readme"), "DOC001", "medium", F.lit("Nothing says what the project is."), "Add a README.", "documentation"),
        _finding(~F.col("has_security_policy"), "DOC002", "low", F.lit("Nothing says how to report security issues."), "Add a SECURITY.md.", "documentation"),
    ])


def structure_signals(files: DataFrame) -> DataFrame:
    """(repo_id, file_count, has_tests, has_ci, has_manifest) in one aggregation."""
    tests = F.col("path").rlike(r"\A(?:tests|test|spec)/|/tests?/")
    return files.groupBy("repo_id").agg(
        F.count("*").alias("file_count"), F.max(tests).alias("has_tests"), F.max(F.col("path").startswith(C.ACTIONS_PREFIX)).alias("has_ci"),
        F.max(X.basename().isin(*(m[0] for m in C.MANIFESTS))).alias("has_manifest"),
    )


def structure_score(signals: DataFrame) -> DataFrame:
    add = lambda condition, points: F.when(condition, points).otherwise(0)
    score = 40 + add(F.col("file_count") >= 5, 15) + add(F.col("file_count") >= 20, 10) + add(F.col("has_manifest"), 15) + add(F.col("has_tests"), 10) + add(F.col("has_ci"), 10)
    return signals.select("repo_id", F.least(F.lit(100), score).cast("int").alias("structure"))


def coverage(files: DataFrame, inputs: DataFrame) -> DataFrame:
    """The coverage summary per repository; ``inputs``: repo_id, intended, cap_reached, deep, source_files_in_repo (null: unknown)."""
    text = F.col("content").isNotNull()
    counts = files.groupBy("repo_id").agg(
        F.count("*").alias("loaded"), F.count_if(text & ~F.col("is_binary") & ~F.col("truncated")).alias("analyzed"), F.count_if("is_binary").alias("skipped_binary"),
        F.count_if("truncated").alias("skipped_large"), F.count_if(text & X.is_source()).alias("source_files_inspected"),
    )
    zero = {c: 0 for c in ("loaded", "analyzed", "skipped_binary", "skipped_large", "source_files_inspected")}
    joined = inputs.join(counts, "repo_id", "left").fillna(zero)
    missing = F.greatest(F.lit(0), F.col("intended") - F.col("loaded"))
    source = F.greatest(F.coalesce("source_files_in_repo", "source_files_inspected"), F.col("source_files_inspected"))
    return joined.select(
        "repo_id", F.greatest("intended", "loaded").alias("intended"), "analyzed", "skipped_binary", "skipped_large", missing.alias("not_inspected"), "cap_reached", "deep",
        source.alias("source_files_in_repo"), "source_files_inspected", (F.col("cap_reached") | (missing > 0)).alias("is_partial"), ((source > 0) & (F.col("source_files_inspected") == 0)).alias("source_uncovered"),
    )


def coverage_findings(cov: DataFrame) -> DataFrame:
    said = lambda column, rest: F.concat(F.col(column).cast("string"), F.lit(rest))
    return _findings(cov, [
        _finding(F.col("is_partial"), "COV001", "low", said("not_inspected", " file(s) were not read."), "Raise the file cap.", "coverage"),
        _finding(F.col("skipped_large") > 0, "COV002", "low", said("skipped_large", " file(s) are over the size limit."), "Inspect them, or raise the limit.", "coverage"),
        _finding(F.col("source_uncovered"), "COV003", "medium", said("source_files_in_repo", " source file(s) were not read."), "Scan the source files too.", "coverage"),
    ])
