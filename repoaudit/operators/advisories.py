"""Pinned dependencies against an advisory table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import catalogs as C
from ..functions import versions as V
from ..plans.saved import saved, scratch

KEY = ["ecosystem", "name", "version"]
DEP = ["repo_id", "dep_pos", *KEY, "source"]
HIT = [*DEP, "vuln_id", "vuln_pos"]
#: Known pins that are broadcast; where there are more, a pin with over ``HEAVY`` dependencies has them dealt into ``SALTS`` parts.
MAX_BROADCAST, HEAVY, SALTS = 200_000, 50_000, 32
#: parts of a package's versions; distinct pins meet ranges, so a part holds at most a share of what was ever published
RANGE_SALTS = 4
#: events of a range (a version each, in one of four fields) and the intervals they come to
EVENT = "struct<introduced:string,fixed:string,last_affected:string,limit:string>"
_INTERVAL = "struct<low:string,high:string,closed:boolean>"


def _first_of_each(deps: DataFrame, most: int | None) -> DataFrame:
    """The first ``most`` dependencies of every repository. Only repositories with more are sorted, and nothing is joined where there are none."""
    if most is None:
        return deps
    large = saved(deps.groupBy("repo_id").count().where(F.col("count") > most).select("repo_id"))
    if large.isEmpty():
        return deps
    place = F.row_number().over(Window.partitionBy("repo_id").orderBy("dep_pos"))
    first = deps.join(large, "repo_id", "left_semi").withColumn("place", place).where(F.col("place") <= most).drop("place")
    return deps.join(large, "repo_id", "left_anti").unionByName(first)


def keyed_events(ranges: DataFrame) -> DataFrame:
    """``ranges`` with ``marks``, their events as (key, kind) in order, and ``problem``, why a range can't be read.

    Kinds at one version: fixed (0), introduced (1), last_affected (2), so a version that is fixed and introduced again is affected. The version ``0`` comes before all.
    """
    kinds = (("fixed", 0), ("introduced", 1), ("last_affected", 2), ("limit", 3))

    def marks(e: Column) -> Column:
        def key(text: Column) -> Column:
            return F.when(text == "0", "").otherwise(V.version_key(F.col("ecosystem"), text))

        return F.filter(F.array(*(F.struct(F.when(e[f].isNotNull(), key(e[f])).alias("key"), F.lit(k).alias("kind"), e[f].alias("text")) for f, k in kinds)), lambda m: m["text"].isNotNull())

    out = ranges.withColumn("marks", F.flatten(F.transform(F.coalesce("events", F.expr(f"cast(array() AS array<{EVENT}>)")), marks)))
    unread = F.exists("marks", lambda m: m["key"].isNull())
    starts = F.exists("marks", lambda m: m["kind"] == 1)
    problem = F.when(~F.col("range_type").isin("SEMVER", "ECOSYSTEM"), "range type").when(~F.col("ecosystem").isin(*V.ORDERS), "ecosystem").when(unread, "version").when(~starts, "no introduced event")
    return out.withColumn("problem", problem).withColumn("marks", F.array_sort(F.transform("marks", lambda m: F.struct(m["key"].alias("key"), m["kind"].alias("kind")))))


def intervals(ranges: DataFrame) -> DataFrame:
    """(vuln_id, vuln_pos, ecosystem, package, low, high, closed, below): the affected versions of readable ranges as intervals of version keys.

    ``low`` belongs to an interval, ``high`` only if it is ``closed``; a null ``high`` has no end. Versions from ``below`` on, where it isn't null, are beyond the range's limits.
    """
    state = lambda low, out: F.struct(low.alias("low"), out.alias("out"))
    interval = lambda a, high, closed: F.concat(a["out"], F.array(F.struct(a["low"].alias("low"), high.alias("high"), F.lit(closed).alias("closed"))))
    nothing = F.lit(None).cast("string")

    def step(a: Column, m: Column) -> Column:
        opened = a["low"].isNotNull()
        return (
            F.when((m["kind"] == 1) & ~opened, state(m["key"], a["out"])).when((m["kind"] == 0) & opened, state(nothing, interval(a, m["key"], False)))
            .when((m["kind"] == 2) & opened, state(nothing, interval(a, m["key"], True))).otherwise(a)
        )

    start = state(nothing, F.expr(f"cast(array() AS array<{_INTERVAL}>)"))
    folded = F.aggregate("marks", start, step, lambda a: F.when(a["low"].isNotNull(), interval(a, nothing, False)).otherwise(a["out"]))
    below = F.array_max(F.transform(F.filter("marks", lambda m: m["kind"] == 3), lambda m: m["key"]))
    # no filter on the problem: it would be pushed down and the keys made twice
    readable = F.when(F.col("problem").isNull(), folded)
    package = V.package_name(F.col("ecosystem"), F.col("name"))
    rows = keyed_events(ranges).select("vuln_id", "vuln_pos", "ecosystem", package.alias("package"), below.alias("below"), F.explode(readable).alias("i"))
    return rows.select("vuln_id", "vuln_pos", "ecosystem", "package", "i.low", "i.high", "i.closed", "below")


def unread_ranges(ranges: DataFrame) -> DataFrame:
    """(vuln_id, ecosystem, name, range_type, problem) of ranges that ``intervals`` leaves out, so that none is lost silently."""
    return keyed_events(ranges).where(F.col("problem").isNotNull()).select("vuln_id", "ecosystem", "name", "range_type", "problem")


def pins_in_ranges(pins: DataFrame, ranges: DataFrame) -> DataFrame:
    """(ecosystem, name, version, vuln_id, vuln_pos) of the distinct of ``pins`` whose version lies in a range of an advisory.

    Packages share most of their version texts, so the distinct texts get keys, not the pins. Then an equi-join on ecosystem and package with comparisons of keys. The versions of a package are dealt into salts which each have the package's intervals, since a
    popular package has many of both.
    """
    of_pin = V.package_name(F.col("ecosystem"), F.col("name"))
    salt = F.pmod(F.xxhash64("version"), F.lit(RANGE_SALTS)).cast("int")
    # merge: Spark guesses the size of exploded rows from the table that they come from, and would broadcast millions of them
    keys = saved(pins.select("ecosystem", "version").distinct().withColumn("key", V.version_key(F.col("ecosystem"), F.col("version"))))
    keys = keys.where(F.col("key").isNotNull())
    keys = F.broadcast(keys) if keys.count() <= MAX_BROADCAST else keys.hint("merge")
    keyed = pins.select(*KEY).distinct().join(keys, ["ecosystem", "version"]).select(*KEY, of_pin.alias("package"), "key", salt.alias("salt"))
    salted = intervals(ranges).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(RANGE_SALTS - 1))))
    high = F.col("high").isNull() | (F.col("key") < F.col("high")) | (F.col("closed") & (F.col("key") == F.col("high")))
    inside = (F.col("low") <= F.col("key")) & high & (F.col("below").isNull() | (F.col("key") < F.col("below")))
    return keyed.join(salted.hint("merge"), ["ecosystem", "package", "salt"]).where(inside).select(*KEY, "vuln_id", "vuln_pos")


def _known(deps: DataFrame, advisories: DataFrame, ranges: DataFrame | None) -> DataFrame:
    """(ecosystem, name, version, vuln_id, vuln_pos) of the distinct pins of ``deps`` that an advisory lists or has in a range, once for both."""
    known = advisories.select(*KEY, "vuln_id", "vuln_pos").join(deps.select(*KEY).distinct(), KEY, "left_semi")
    if ranges is not None:
        known = known.unionByName(pins_in_ranges(deps, ranges)).groupBy(*KEY, "vuln_id").agg(F.min("vuln_pos").alias("vuln_pos"))
    return known


def _meet(deps: DataFrame, known: DataFrame, few: bool) -> DataFrame:
    """``deps`` joined with ``known`` pins: these are broadcast if they are ``few``; else both sides are shuffled, and salted for the few pins that stand in very many repositories."""
    if few:
        return deps.join(F.broadcast(known), KEY)
    heavy = saved(deps.groupBy(*KEY).count().where(F.col("count") > HEAVY).select(*KEY))
    if heavy.isEmpty():
        return deps.join(known.hint("merge"), KEY)
    marked = F.broadcast(heavy.withColumn("heavy", F.lit(True)))  # at most a HEAVY-th of the dependencies
    parts = F.when(F.col("heavy"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    salted = known.join(marked, KEY, "left").withColumn("salt", F.explode(parts)).drop("heavy")
    salt = F.when(F.col("heavy"), F.pmod(F.xxhash64("repo_id"), F.lit(SALTS)).cast("int")).otherwise(0)
    return deps.join(marked, KEY, "left").withColumn("salt", salt).join(salted.hint("merge"), [*KEY, "salt"])


def match_advisories(deps: DataFrame, advisories: DataFrame, max_queries: int | None = C.MAX_QUERIES, ranges: DataFrame | None = None) -> DataFrame:
    """One row per (dependency, advisory). ``max_queries``: the first so many dependencies of a repository; None takes all.

    An advisory meets the versions that it lists (``advisories``, a row each) and those in its ``ranges`` (vuln_id, vuln_pos, ecosystem, name, range_type, events), once for both.
    Fleets share most pins, so distinct pins meet the advisories first, and then the dependencies.
    """
    deps = _first_of_each(saved(deps), max_queries)  # read for the distinct pins and for the join
    known = saved(_known(deps, advisories, ranges))
    return _meet(deps, known, known.count() <= MAX_BROADCAST).select(*HIT)


def _within(hits: DataFrame, most: int) -> DataFrame:
    """``hits``, which are dealt by repository, with ``within``: whether the advisory is among the first ``most`` distinct ones of its repository."""
    first_at = F.min(F.struct("dep_pos", "vuln_pos")).over(Window.partitionBy("repo_id", "vuln_id"))
    place = F.dense_rank().over(Window.partitionBy("repo_id").orderBy("first_at", "vuln_id"))
    return hits.withColumn("first_at", first_at).withColumn("within", F.col("repo_id").isNotNull() & (place <= most)).drop("first_at")


def enrich(hits: DataFrame, details: DataFrame, max_details: int | None = C.MAX_DETAILS) -> DataFrame:
    """Adds the columns of ``details`` (vuln_id, summary, details, severity_label) for the first ``max_details`` distinct advisories of a repository; None takes all.

    Hits are dealt once by repository, for the limit, and once by advisory, for the details.
    """
    fields = [c for c in details.columns if c != "vuln_id"]
    told = details.withColumnRenamed("vuln_id", "told_id").hint("merge")  # never broadcast on a guess of its size
    same = F.col("vuln_id") == F.col("told_id")
    if max_details is None:
        return hits.join(told, same, "left").select(*hits.columns, *fields)
    return _within(hits.repartition("repo_id"), max_details).join(told, same & F.col("within"), "left").select(*hits.columns, *fields)


def _with_beyond(met: DataFrame, most: int) -> DataFrame:
    """Dependencies with ``beyond`` in place of ``known``: those of its advisories that are not among the first ``most`` distinct ones of the repository."""
    rows = met.select(*DEP, "known").repartition("repo_id").withColumn("row", F.monotonically_increasing_id())
    flat = _within(rows.select(*DEP, "row", F.explode("known").alias("k")).select(*DEP, "row", "k.*"), most)
    whole = flat.groupBy("repo_id", "row").agg(*(F.first(c).alias(c) for c in DEP[1:]), F.collect_list(F.when(~F.col("within"), F.col("vuln_id"))).alias("beyond"))
    return whole.drop("row")


def match_and_enrich(
    deps: DataFrame, advisories: DataFrame, details: DataFrame, max_queries: int | None = C.MAX_QUERIES, max_details: int | None = C.MAX_DETAILS, ranges: DataFrame | None = None
) -> DataFrame:
    """The rows of ``enrich(match_advisories(deps, advisories, max_queries, ranges), details, max_details)`` with far less shuffled.

    There are many times more hits than distinct pins with advisories. So the details meet these pins, and a dependency goes with all its advisories in one row: first without details to its repository, for the limit, then to its pin.
    All dependencies are on disk only until those with advisories are known. Give only those columns of ``details`` that are used, and of long texts the part that is (``headlines``).
    """
    fields = [c for c in details.columns if c != "vuln_id"]
    with scratch(deps.sparkSession) as write:
        every = _first_of_each(write(deps.select(*DEP)), max_queries)
        known = saved(_known(every, advisories, ranges).groupBy(*KEY).agg(F.collect_list(F.struct("vuln_id", "vuln_pos")).alias("known")))
        n = known.agg(F.sum(F.size("known"))).first()[0] or 0
        deps = saved(_meet(every, known.select(*KEY), n <= MAX_BROADCAST).select(*DEP))
    if max_details is None:
        deps = deps.withColumn("beyond", F.expr("cast(array() AS array<string>)"))
    else:
        deps = saved(_with_beyond(_meet(deps, known, n <= MAX_BROADCAST), max_details))
    told = details.groupBy("vuln_id").agg(F.collect_list(F.struct(*fields)).alias("told"))
    told = known.select(*KEY, F.explode("known").alias("k")).select(*KEY, "k.*").join(told.hint("merge"), "vuln_id", "left")
    told = told.groupBy(*KEY).agg(F.collect_list(F.struct("vuln_id", "vuln_pos", "told")).alias("known"))
    met = _meet(deps, told, n <= MAX_BROADCAST // 10)  # these rows are wider
    hits = met.select(*DEP, "beyond", F.explode("known").alias("k")).select(*DEP, "beyond", "k.*")
    told = F.when(~F.array_contains("beyond", F.col("vuln_id")), F.col("told"))
    return hits.select(*HIT, F.explode_outer(told).alias("t")).select(*HIT, "t.*")


def headlines(details: DataFrame) -> DataFrame:
    """``details`` with as much of its texts as ``dependency_findings`` uses: the summary, or else the first line of the details."""
    return details.withColumn("details", F.when(F.coalesce("summary", F.lit("")) == "", F.substring_index("details", "\n", 1)))


def advisory_severity(label: str = "severity_label") -> Column:
    """``critical`` is capped to ``high``, as reachability is unknown; anything unknown is ``medium``."""
    low = F.upper(label)
    return F.when(low.isin("CRITICAL", "HIGH"), "high").when(low == "LOW", "low").otherwise("medium")


def advisory_summary(summary: str = "summary", details: str = "details", vuln_id: str = "vuln_id") -> Column:
    head = F.substring_index(details, "\n", 1)
    return F.coalesce(F.when(F.col(summary) != "", F.col(summary)), F.when(head != "", head), F.col(vuln_id))


def dependency_findings(hits: DataFrame, max_per_dep: int | None = C.MAX_PER_DEP) -> DataFrame:
    """A finding for each of the first ``max_per_dep`` advisories of a dependency (None: of all); ``hits`` come from ``enrich``."""
    if max_per_dep is not None:
        place = F.row_number().over(Window.partitionBy("repo_id", *KEY).orderBy("vuln_pos"))
        hits = hits.withColumn("place", place).where(F.col("place") <= max_per_dep).drop("place")
    dep = F.concat("name", F.lit(" "), "version")
    return hits.select(
        "repo_id", (F.col("dep_pos") * 4096 + F.col("vuln_pos")).alias("finding_pos"), F.col("vuln_id").alias("rule_id"),
        F.concat(dep, F.lit(": known vulnerability ("), "vuln_id", F.lit(")")).alias("title"), advisory_severity().alias("severity"),
        F.col("source").alias("file_path"), F.lit(None).cast("int").alias("line_number"),
        F.concat(dep, F.lit(" ("), "ecosystem", F.lit(") is affected by "), "vuln_id", F.lit(": "), advisory_summary()).alias("description"),
        F.concat(F.lit("Upgrade "), "name", F.lit(" to a fixed version.")).alias("recommendation"), F.lit("dependency").alias("category"),
    )


def advisory_gap_findings(deps: DataFrame, status: DataFrame) -> DataFrame:
    """One note for each repository with dependencies whose advisory source (repo_id, available) could not be read."""
    missing = status.where(~F.col("available")).select("repo_id").distinct()
    repos = deps.select("repo_id").distinct().join(missing, "repo_id", "left_semi")
    return repos.select(
        "repo_id", F.lit(0).cast("long").alias("finding_pos"), F.lit("DEP000").alias("rule_id"), F.lit(C.TITLES["DEP000"]).alias("title"),
        F.lit("info").alias("severity"), F.lit(None).cast("string").alias("file_path"), F.lit(None).cast("int").alias("line_number"),
        F.lit("The advisory source was unavailable.").alias("description"), F.lit("Run again, or check the dependencies by hand.").alias("recommendation"), F.lit("coverage").alias("category"),
    )
