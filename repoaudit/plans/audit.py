"""The full audit: one nested row per repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import catalogs as C
from ..functions import text as X
from ..operators import advisories as A
from ..operators import deps, health, scan, scoring, tech
from .saved import saved


def technologies(files: DataFrame, language_bytes: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Languages, frameworks and project types; the first two are small tables that are written once."""
    counts = tech.language_counts(files)
    if language_bytes is not None:
        counts = tech.merge_language_bytes(counts, language_bytes)
    languages = saved(tech.detect_languages(counts))
    frameworks = saved(tech.detect_frameworks(tech.match_frameworks(tech.all_deps(files)), tech.marker_frameworks(files), tech.hook_signal(tech.javascript_scripts(files))))
    return languages, frameworks, tech.classify_project_type(files, frameworks, languages)


def _gather(df: DataFrame, name: str, order: str, *fields: str) -> DataFrame:
    """(repo_id, name): the fields as an array of structs in the order of a column."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.struct(*fields).alias("v"))))
    return df.groupBy("repo_id").agg(F.transform(rows, lambda s: s["v"]).alias(name))


def findings_of(
    files: DataFrame, repos: DataFrame, docs: DataFrame, cov: DataFrame, as_of: Column, advisories: DataFrame | None = None, advisory_details: DataFrame | None = None,
    advisory_status: DataFrame | None = None, rules: tuple[dict, ...] = C.RULES, max_queries: int | None = None, max_details: int | None = None, max_per_dep: int | None = None,
    advisory_ranges: DataFrame | None = None,
) -> DataFrame:
    """All findings of all repositories as rows, however many one has; ``finding_pos`` is a struct that orders them.

    ``advisory_status`` (repo_id, available) names the repositories whose advisories could not be read: they get a note in place of dependency findings.
    ``advisory_ranges`` adds advisories that give ranges of versions. The three limits are of use only where advisories come from a service that sets them; None, the default, takes all.
    """
    groups = [scan.scan_files(files, rules), health.maintenance_findings(repos, as_of), health.documentation_findings(docs), health.coverage_findings(cov)]
    if advisories is not None:
        pins = saved(deps.extract_versions(files))
        if advisory_status is not None:
            groups.append(A.advisory_gap_findings(pins, advisory_status))
            pins = pins.join(advisory_status.where("NOT available").select("repo_id"), "repo_id", "left_anti")
        hits = A.enrich(A.match_advisories(pins, advisories, max_queries, advisory_ranges), advisory_details, max_details)
        groups.append(A.dependency_findings(hits, max_per_dep))
    out = None
    for i, g in enumerate(groups):
        g = g.select(*scan.FINDING[:1], F.struct(F.lit(i).alias("stage"), F.col("finding_pos").alias("pos")).alias("finding_pos"), *scan.FINDING[2:])
        out = g if out is None else out.unionByName(g)
    return out


def audit(
    files: DataFrame, repos: DataFrame, coverage_inputs: DataFrame, as_of: Column, language_bytes: DataFrame | None = None,
    advisories: DataFrame | None = None, advisory_details: DataFrame | None = None, rules: tuple[dict, ...] = C.RULES, max_findings: int | None = 10_000,
    advisory_status: DataFrame | None = None, max_queries: int | None = None, max_details: int | None = None, max_per_dep: int | None = None,
    advisory_ranges: DataFrame | None = None,
) -> DataFrame:
    """Everything about each row of ``repos``; local repositories take the licence of their files.

    ``max_findings`` bounds the findings that one nested report row holds (worst first), so that a row stays far below what a row may hold; None takes
    all. Scores, risk, counts and verdict always count every finding, and ``findings_of`` gives them all as rows.
    """
    licenses = health.detect_license(files).withColumnRenamed("license", "own_license")
    repos = repos.join(licenses, "repo_id", "left").withColumn("license", F.when(F.col("kind") == "local", F.col("own_license")).otherwise(F.col("license"))).drop("own_license")
    # a row a repository each, that many steps read: without this every one of these plans holds theirs again, and the driver all of them
    repos = saved(repos)
    languages, frameworks, types = technologies(files, language_bytes)
    docs = saved(health.documentation_score(files))
    cov = saved(health.coverage(files, coverage_inputs))
    findings = findings_of(files, repos, docs, cov, as_of, advisories, advisory_details, advisory_status, rules, max_queries, max_details, max_per_dep, advisory_ranges)
    findings = saved(findings)  # scores, risk, counts and reports all read them; the scan of the texts runs once
    base = repos.select("repo_id")
    left = lambda df, other: df.join(other, "repo_id", "left")
    scores = left(left(left(left(base, scoring.security_score(findings)), health.maintenance_score(repos, findings, as_of)), docs), health.popularity_score(repos))
    scores = left(left(scores, health.structure_score(health.structure_signals(files))), scoring.severity_counts(findings))
    scores = scores.fillna({"security": 100, "documentation": 0, "structure": 40, "n_critical": 0, "n_high": 0, "n_findings": 0})
    scores = saved(scoring.trust_score(scores))
    ecosystems = deps.detect_manifests(files).groupBy("repo_id").agg(F.collect_set("ecosystem").alias("ecosystems"))
    names = _gather(frameworks, "frameworks", "place", "name").select("repo_id", F.transform("frameworks", lambda f: f["name"]).alias("frameworks"))
    facts = left(left(left(left(left(scores, repos.select("repo_id", "url", "name", "archived")), types), tech.primary_language(languages)), names), ecosystems)
    facts = saved(facts)
    kept = findings
    if max_findings is not None:
        kept = scoring.sort_findings(findings).where(F.col("place") <= max_findings)
    kept = kept.withColumn("severity_rank", X.severity_rank())
    out = left(facts, scoring.risk_level(scores.select("repo_id", "trust"), findings))
    out = left(out, scoring.verdict(facts))
    out = left(out, scoring.recommendations(scores))
    out = left(out, repos.select("repo_id", F.struct(*(c for c in repos.columns if c != "repo_id")).alias("repository")))
    out = left(out, cov.select("repo_id", F.struct(*(c for c in cov.columns if c != "repo_id")).alias("coverage")))
    technology = ("name", "category", "confidence", "evidence")
    out = left(out, _gather(languages.select("repo_id", "place", F.col("lang").alias("name"), F.lit("Language").alias("category"), "confidence", "evidence"), "detected_languages", "place", *technology))
    out = left(out, _gather(frameworks, "detected_frameworks", "place", *technology))
    out = left(out, _gather(kept, "findings", "finding_pos", "rule_id", "title", "severity", "severity_rank", "file_path", "line_number", "description", "recommendation", "category"))
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(out.schema[c].dataType))
    return out.select(
        "repo_id", "repository", "verdict", F.col("trust").alias("trust_score"), F.col("risk").alias("risk_level"), "project_type", empty("detected_languages").alias("detected_languages"), empty("detected_frameworks").alias("detected_frameworks"),
        empty("findings").alias("findings"), F.struct("security", "maintenance", "documentation", "popularity", "structure").alias("score_breakdown"), "recommendations", "coverage",
    )
