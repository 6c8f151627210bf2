"""Report sinks: one JSON, SARIF or Markdown document per repository.

``results`` are rows of ``plans.audit.audit``. ``max_findings`` bounds what one report row gathers, worst first (a code-scanning upload takes no more
than some thousands anyway); None takes all. The paged reports hold every finding in documents of bounded size, however many a repository has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import catalogs as C
from ..functions import text as X
from ..operators import scoring

SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"
TOOL = "repoaudit"


def to_json_report(results: DataFrame) -> DataFrame:
    """(repo_id, report): the nested row as a JSON document."""
    return results.select("repo_id", F.to_json(F.struct(*(c for c in results.columns if c != "repo_id")), {"ignoreNullFields": "false"}).alias("report"))


def to_sarif(findings: DataFrame, max_findings: int | None = 10_000) -> DataFrame:
    """(repo_id, report): a SARIF 2.1.0 document with one run."""
    if max_findings is not None:
        findings = scoring.sort_findings(findings).where(F.col("place") <= max_findings).drop("place")
    rules = scoring.rule_descriptors(findings)
    rule = F.struct(
        F.col("rule_id").alias("id"), F.col("title").alias("name"), F.struct(F.col("title").alias("text")).alias("shortDescription"), F.struct(F.col("full_description").alias("text")).alias("fullDescription"),
        F.col("help_text").alias("helpText"), F.struct("level").alias("defaultConfiguration"), F.struct("category", F.col("security_severity").alias("security-severity")).alias("properties"),
    )
    result = F.struct(
        F.col("rule_id").alias("ruleId"), F.col("rule_index").alias("ruleIndex"), "level", F.struct(F.col("message").alias("text")).alias("message"), F.struct("severity", "category").alias("properties"),
        F.when(F.col("start_line").isNotNull(), F.array(F.struct(F.struct(F.struct("uri").alias("artifactLocation"), F.struct(F.col("start_line").alias("startLine")).alias("region")).alias("physicalLocation")))).alias("locations"),
        F.struct(F.col("fingerprint").alias(f"{TOOL}/v1")).alias("partialFingerprints"),
    )
    gathered = lambda order, value: F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))), lambda s: s["v"])
    by_rule = rules.groupBy("repo_id").agg(gathered("rule_index", rule).alias("rules"))
    by_result = scoring.sarif_results(findings).groupBy("repo_id").agg(gathered("finding_pos", result).alias("results"))
    driver = F.struct(F.lit(TOOL).alias("name"), F.col("rules"))
    run = F.struct(F.struct(driver.alias("driver")).alias("tool"), F.col("results"))
    document = F.struct(F.lit(SARIF_SCHEMA).alias("$schema"), F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))
    return by_rule.join(by_result, "repo_id").select("repo_id", F.to_json(document).alias("report"))


def paged(findings: DataFrame, page: int) -> DataFrame:
    """``findings`` with ``part``, the page from 0 that each stands on, worst first: every page but a repository's last is full."""
    return scoring.sort_findings(findings).withColumn("part", F.floor((F.col("place") - 1) / page).cast("int"))


def to_sarif_pages(findings: DataFrame, page: int = 10_000) -> DataFrame:
    """(repo_id, part, report): all findings of a repository as SARIF documents of at most ``page`` results, each complete with the rules that it names."""
    key = F.concat("repo_id", F.lit("#"), F.lpad(F.col("part").cast("string"), 10, "0"))
    documents = to_sarif(paged(findings, page).withColumn("repo_id", key).drop("place", "part"), None)
    return documents.select(F.expr("substring(repo_id, 1, length(repo_id) - 11)").alias("repo_id"), F.substring("repo_id", -10, 10).cast("int").alias("part"), "report")


def to_json_pages(findings: DataFrame, page: int = 10_000) -> DataFrame:
    """(repo_id, part, report): all findings of a repository as JSON documents of at most ``page``, in the order of its report."""
    fields = ("rule_id", "title", "severity", "file_path", "line_number", "description", "recommendation", "category")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", F.struct(*fields).alias("v")))), lambda x: x["v"])
    pages = paged(findings, page).groupBy("repo_id", "part").agg(listed.alias("findings"))
    return pages.select("repo_id", "part", F.to_json(F.struct("repo_id", "part", "findings"), {"ignoreNullFields": "false"}).alias("report"))


def _line(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def to_markdown(results: DataFrame) -> DataFrame:
    """(repo_id, report): a text of verdict, metadata, technologies, findings, coverage, scores and recommendations."""
    r = lambda c: F.col(f"repository.{c}")
    none = F.expr("cast(array() AS array<string>)")
    title = F.coalesce(r("url"), F.when(r("owner").isNotNull(), F.concat(r("owner"), F.lit("/"), r("name"))), r("name"))
    techs = F.concat(F.col("detected_languages"), F.col("detected_frameworks"))
    tech_rows = F.transform(techs, lambda t: F.concat(F.lit("| "), t["category"], F.lit(" | "), t["name"], F.lit(" | "), F.format_number(t["confidence"], 2), F.lit(" | "), F.array_join(t["evidence"], ", "), F.lit(" |")))
    place = lambda f: F.coalesce(F.concat(f["file_path"], F.when(f["line_number"].isNotNull(), F.concat(F.lit(":"), f["line_number"].cast("string"))).otherwise("")), F.lit("—"))
    finding_rows = F.transform("sorted_findings", lambda f: F.concat(F.lit("| "), F.upper(f["severity"]), F.lit(" | "), f["rule_id"], F.lit(" | "), place(f), F.lit(" | "), F.coalesce(F.element_at(F.split(f["description"], X.BREAK, -1), 1), F.lit("")), F.lit(" |")))
    meta = [("Description", r("description")), ("Stars", r("stars")), ("Forks", r("forks")), ("Open issues + PRs", r("open_issues")), ("License", r("license")), ("Last push", r("pushed_at")), ("Archived", F.when(r("archived"), "yes").when(~r("archived"), "no"))]
    meta_rows = F.filter(F.array(*(F.when(v.isNotNull(), _line(f"| {k} | ", v, " |")) for k, v in meta)), lambda x: x.isNotNull())
    total = sum((F.when(F.col(f"score_breakdown.{a}").isNotNull(), w).otherwise(0) for a, w in C.WEIGHTS), F.lit(0))
    total = F.when(total == 0, 100).otherwise(total)
    uncovered = F.coalesce(F.col("coverage.source_uncovered"), F.lit(False))
    score_rows = F.array(*(
        F.when(F.col(f"score_breakdown.{a}").isNull(), F.lit(f"| {a.capitalize()} | — | n/a |"))
        .otherwise(_line(f"| {a.capitalize()} | ", F.col(f"score_breakdown.{a}"), F.when(uncovered & F.lit(a == "security"), " (code not scanned)").otherwise(""), " | ", F.bround(F.lit(w) * 100 / total, 0).cast("int"), "% |"))
        for a, w in C.WEIGHTS))
    cov = lambda c: F.col(f"coverage.{c}")
    covered = F.when(cov("is_partial"), _line("> **Partial scan.** ", cov("analyzed"), " file(s) inspected; ", cov("not_inspected"), " intended file(s) were not read.")).otherwise(_line("> ", cov("analyzed"), " file(s) inspected."))
    notes = F.filter(F.array(F.when(uncovered, _line("> **No source code inspected.** ", cov("source_files_in_repo"), " source file(s) exist.")), F.when(cov("skipped_large") > 0, _line("- ", cov("skipped_large"), " skipped (too large)")), F.when(cov("skipped_binary") > 0, _line("- ", cov("skipped_binary"), " skipped (binary)"))), lambda x: x.isNotNull())
    text = F.concat(
        F.array(_line("# Audit report: ", title), F.lit(""), F.lit("## Verdict"), F.lit(""), _line("- Risk level: **", F.col("risk_level"), "**"), _line("- Trust score: **", F.col("trust_score"), "/100**"), _line("- Project type: ", F.coalesce("project_type", F.lit("Unknown"))), F.lit(""), F.lit("## Summary"), F.lit(""), F.col("verdict"), F.lit("")),
        F.when(F.size(meta_rows) > 0, F.concat(F.array(F.lit("## Repository Metadata"), F.lit(""), F.lit("| Field | Value |"), F.lit("|---|---|")), meta_rows, F.array(F.lit("")))).otherwise(none),
        F.array(F.lit("## Detected Technologies"), F.lit(""), F.lit("| Category | Name | Confidence | Evidence |"), F.lit("|---|---|---:|---|")), F.when(F.size(techs) > 0, tech_rows).otherwise(F.array(F.lit("| — | — | — | No technologies detected |"))),
        F.array(F.lit(""), F.lit("## Security Findings"), F.lit("")), F.when(F.size("sorted_findings") > 0, F.concat(F.array(F.lit("| Severity | Rule | File | Description |"), F.lit("|---|---|---|---|")), finding_rows)).otherwise(F.array(F.lit("_No findings._"))),
        F.array(F.lit(""), F.lit("## Scan Coverage"), F.lit(""), covered), notes, F.array(F.lit(""), F.lit("## Score Breakdown"), F.lit(""), F.lit("| Area | Score | Weight |"), F.lit("|---|---:|---:|")), score_rows,
        F.array(F.lit(""), F.lit("## Recommendations"), F.lit("")), F.transform("recommendations", lambda x: F.concat(F.lit("- "), x)), F.array(F.lit("")),
    )
    findings = F.expr("array_sort(findings, (a, b) -> CASE WHEN a.severity_rank <> b.severity_rank THEN b.severity_rank - a.severity_rank WHEN a.rule_id <> b.rule_id THEN CASE WHEN a.rule_id < b.rule_id THEN -1 ELSE 1 END WHEN coalesce(a.file_path, '') <> coalesce(b.file_path, '') THEN CASE WHEN coalesce(a.file_path, '') < coalesce(b.file_path, '') THEN -1 ELSE 1 END ELSE coalesce(a.line_number, 0) - coalesce(b.line_number, 0) END)")
    return results.withColumn("sorted_findings", findings).select("repo_id", F.array_join(text, "\n").alias("report"))
