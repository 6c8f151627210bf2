"""Places by ranges and paged reports."""

import json
import time

from pyspark.sql import functions as F

from repoaudit.operators import scoring
from repoaudit.plans.saved import counted, first_row, ranked, saved
from repoaudit.sources import reports

SEVERITIES = ("info", "low", "medium", "high", "critical")


def fleet(spark, large, small):
    """Findings of one repository with ``large`` of them and of ``small`` repositories with a few each."""
    rows = spark.range(large).select(F.lit("mono").alias("repo_id"), F.col("id").alias("finding_pos")).unionByName(spark.range(small * 3).select(F.concat(F.lit("r"), (F.col("id") % small).cast("string")).alias("repo_id"), F.col("id").alias("finding_pos")))
    h = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "repo_id", "finding_pos"), F.lit(n))
    return rows.select(
        "repo_id", "finding_pos", F.concat(F.lit("R"), h(1, 3).cast("string")).alias("rule_id"), F.lit("t").alias("title"), F.element_at(F.array(*map(F.lit, SEVERITIES)), (h(2, 5) + 1).cast("int")).alias("severity"),
        F.when(h(3, 4) > 0, F.concat(F.lit("p#"), h(4, 50).cast("string"))).alias("file_path"), F.when(h(5, 4) > 0, h(6, 9)).cast("int").alias("line_number"), F.lit("d").alias("description"), F.lit("x").alias("recommendation"), F.lit("secret").alias("category"),
    )


def order(r):
    return -SEVERITIES.index(r["severity"]), r["rule_id"], r["file_path"] or "", r["line_number"] or 0, r["finding_pos"]


def test_places_equal_a_plain_sort(spark):
    findings = fleet(spark, 5000, 40).repartition(7)
    rows = scoring.sort_findings(findings).collect()
    by_repo = {}
    for r in rows:
        by_repo.setdefault(r["repo_id"], []).append(r)
    assert len(rows) == 5120 and len(by_repo) == 41
    for members in by_repo.values():
        assert [r["place"] for r in sorted(members, key=order)] == list(range(1, len(members) + 1))
    assert scoring.sort_findings(findings.limit(0)).collect() == []


def test_one_large_group_is_dealt_to_all_tasks(spark):
    """No range holds more than twice its share, though one group holds nearly all rows."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        rows = spark.range(200_000).select(F.lit("mono").alias("g"), F.xxhash64("id").alias("x"), "id")
        dealt = ranked(rows, "g", ["x", "id"])
        assert dealt.selectExpr("min(place)", "max(place)", "count(DISTINCT place)").first()[:] == (1, 200_000, 200_000)
        ranges = rows.repartitionByRange("g", "x", "id").groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.count("*")).first()
        assert ranges[0] < 2 * 200_000 / 16 and ranges[1] == 16
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_pages_hold_every_finding_once(spark):
    findings = fleet(spark, 95, 5)
    want = {}
    for r in findings.collect():
        want.setdefault(r["repo_id"], []).append(r)
    pages = {}
    for r in reports.to_json_pages(findings, 10).collect():
        pages[r["repo_id"], r["part"]] = json.loads(r["report"])
    assert sum(len(p["findings"]) for p in pages.values()) == 110 and {k for k in pages if k[0] == "mono"} == {("mono", i) for i in range(10)}
    for repo, rows in want.items():
        said = [f for part in sorted(p for k, p in pages if k == repo) for f in pages[repo, part]["findings"]]
        assert said == [{c: r[c] for c in ("rule_id", "title", "severity", "file_path", "line_number", "description", "recommendation", "category")} for r in sorted(rows, key=order)]
        assert all(len(pages[repo, p]["findings"]) == 10 for k, p in pages if k == repo and (repo, p + 1) in pages)
    sarif = reports.to_sarif_pages(findings, 10).collect()
    assert {(r["repo_id"], r["part"]) for r in sarif} == set(pages)
    for r in sarif:
        run = json.loads(r["report"])["runs"][0]
        rules = [x["id"] for x in run["tool"]["driver"]["rules"]]
        assert [rules[x["ruleIndex"]] for x in run["results"]] == [x["ruleId"] for x in run["results"]] and set(rules) == {x["ruleId"] for x in run["results"]}
        assert len(run["results"]) == len(pages[r["repo_id"], r["part"]]["findings"])


def test_no_shuffle_files_stay_behind_saved_results_and_numbers(spark):
    """``saved`` is handed DataFrames made before it is called; their shuffle files have to go too."""
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def left():
        return {x for x in blocks.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in x}

    def gone(before):
        end = time.time() + 20  # they are removed in the background
        while left() - before and time.time() < end:
            time.sleep(0.1)
        return not left() - before

    made = lambda: spark.range(0, 1000, 1, 5).groupBy((F.col("id") % 7).alias("k")).agg(F.max("id").alias("m"))
    kept, before = made(), left()
    kept.collect()
    assert left() - before, "a plain query leaves its files, or this test sees none"
    for act in (saved, first_row, counted):
        df, before = made(), left()
        assert act(df)
        assert gone(before), act.__name__
    df = made()
    assert sorted(map(tuple, saved(df).collect())) == sorted(map(tuple, df.collect()))
