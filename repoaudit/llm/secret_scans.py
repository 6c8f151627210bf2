"""Secret scans by a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over trigrams that any match must hold: a literal run asks for
all its trigrams, an alternation for one of its branches, everything else asks for nothing. Documents are indexed once as postings
(trigram, document) of the trigrams that the queries use, taken from the lower-cased text; a document is named by its id and a hash of its text, so
no null or repeated id gathers the postings of many. Intersecting and uniting the postings gives each rule's candidates, and only these are verified with
the full expression. Rules whose query is empty scan every document. All of it is DataFrame and SQL expressions.

Candidates go to the texts, not the texts to them, while their counted number is within ``MAX_BROADCAST``; beyond it both meet in a shuffled join, in which the
candidates are repeated for each of ``SALTS`` parts of the texts, so that copies of one text under one id are several tasks.

Spans are code-point offsets (start, end exclusive) of leftmost non-overlapping matches per kind. To find them the text is marked
before and behind each match and cut at the marks; the two mark characters are replaced in the text by another control
character that no rule matches.

Defined cases: a null text is empty; rows with a null id are scanned like others; repeated rows and rows of one id with different texts are scanned each;
other columns of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table

MAX_BROADCAST = 250_000
SALTS = 16


@dataclass(frozen=True)
class Rule:
    """``least``: fewest characters of ``group`` that a match must have to count; shorter matches are passed over."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    ignore_case: bool = False


#: The three base kinds.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: Public formats of credentials, beside the base kinds.
MORE = (
    Rule("pem", r"-----BEGIN (RSA |EC |DSA |OPENSSH |PGP |ENCRYPTED )?PRIVATE KEY-----"),
    Rule("git_token", r"(ghp_|gho_|ghs_|ghu_)[A-Za-z0-9]+", 0, 40),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("pay_key", r"sk_(live|test)_[A-Za-z0-9]+", 0, 24),
)
RULES = BASE + MORE


# --- Boolean trigram queries ---------------------------------------------------------------------------------------


def _and(parts: list) -> tuple:
    parts = [p for p in parts if p != ("all",)]
    return ("all",) if not parts else parts[0] if len(parts) == 1 else ("and", *dict.fromkeys(parts))


def trigram_query(pattern: str) -> tuple:
    """The query of a regular expression: ('all',), ('tri', t), ('and', ...) or ('or', ...), over lower-cased text.

    Follows the syntax tree of the standard library's parser. Runs of literals, possibly through groups with few
    alternatives, are joined before they are cut into trigrams.
    """
    from re import _parser as P  # the standard library's; it has no public name since the module sre_parse went

    def literals(tree) -> list[str] | None:
        """All texts that ``tree`` can match if these are few, else None."""
        out = [""]
        for op, arg in tree:
            name = str(op)
            if name == "LITERAL":
                more = [chr(arg).lower()]
            elif name == "SUBPATTERN":
                more = literals(arg[3])
            elif name == "BRANCH":
                branches = [literals(x) for x in arg[1]]
                more = None if None in branches else [x for b in branches for x in b]
            elif name == "MAX_REPEAT" and arg[1] == 1:
                inner = literals(arg[2])
                more = None if inner is None else ([""] if arg[0] == 0 else []) + inner
            else:
                more = None
            if more is None or len(out) * len(more) > 16:
                return None
            out = [a + b for a in out for b in more]
        return out

    def of(texts: list[str]) -> tuple:
        parts = [_and([("tri", t[i : i + 3]) for i in range(len(t) - 2)]) for t in texts]
        if ("all",) in parts:
            return ("all",)
        parts = list(dict.fromkeys(parts))
        return parts[0] if len(parts) == 1 else ("or", *parts)

    def query(tree) -> tuple:
        found, run = [], [""]
        for node in [*tree, None]:
            texts = literals([node]) if node is not None else None
            if texts is not None and len(run) * len(texts) <= 16:
                run = [a + b for a in run for b in texts]
                continue
            found.append(of(run))
            run = texts or [""]
            if texts is None and node is not None:
                name, arg = str(node[0]), node[1]
                if name == "SUBPATTERN":
                    found.append(query(arg[3]))
                elif name == "BRANCH":
                    parts = [query(x) for x in arg[1]]
                    found.append(("all",) if ("all",) in parts else ("or", *dict.fromkeys(parts)))
                elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] > 0:
                    found.append(query(arg[2]))
        if run != [""]:
            found.append(of(run))
        return _and(found)

    return query(P.parse(pattern))


def query_trigrams(query: tuple) -> list[str]:
    if query[0] == "tri":
        return [query[1]]
    return sorted({t for q in query[1:] for t in query_trigrams(q)}) if query[0] != "all" else []


def _holds(query: tuple, found: str) -> Column:
    """Whether the trigrams in array column ``found`` satisfy the query."""
    if query[0] == "tri":
        return F.array_contains(found, query[1])
    parts = [_holds(q, found) for q in query[1:]]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if query[0] == "and" else out | p
    return out


# --- Index and search ----------------------------------------------------------------------------------------------


def postings(documents: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, doc_id, th): which documents, told apart by id and hash of the text, hold which of ``trigrams``."""
    low = documents.select("doc_id", F.xxhash64("text").alias("th"), F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    held = F.filter(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams)), lambda t: t.isNotNull())
    return low.select("doc_id", "th", F.explode(held).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, th, kinds): the rules with a trigram query that each document satisfies; documents without any are left out.

    A document has at most as many distinct postings as the queries have trigrams, so gathering them by document is bounded.
    """
    found = index.groupBy("doc_id", "th").agg(F.collect_set("trigram").alias("held"))
    asked = [(r.kind, trigram_query(r.pattern)) for r in rules]
    kinds = F.filter(F.array(*(F.when(_holds(q, "held"), F.lit(k)) for k, q in asked if q != ("all",))), lambda k: k.isNotNull())
    return found.select("doc_id", "th", kinds.alias("kinds")).where(F.size("kinds") > 0)


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def searched(rule: Rule) -> str:
    """The expression to search for: the rule's own, or, for one literal and one greedy run of a class, with the least length
    in the run, as only long runs count and each is taken whole."""
    head, bracket, rest = rule.pattern.partition("[")
    if rule.group == 0 and rule.least > 1 and rest.endswith("]+") and "[" not in rest and not set(head) & set("(.*+?|\\"):
        return f"{rule.pattern[:-1]}{{{rule.least - len(head)},}}"
    return rule.pattern


def spans_of(rule: Rule, text: str = "clean") -> Column:
    """array<struct<start,end>> of the rule's matches in column ``text`` (code points), leftmost first."""
    pattern = ("(?i)" if rule.ignore_case else "") + searched(rule)
    pieces = f"split(regexp_replace({text}, {_sql(pattern)}, '\\u0001$0\\u0002'), '\\u0001', -1)"
    measured = "length(p) - CASE WHEN instr(p, '\\u0002') > 0 THEN 1 ELSE 0 END"
    group = f"length(regexp_extract(substring_index(p, '\\u0002', 1), {_sql(pattern)}, {rule.group}))"
    step = (
        f"aggregate({pieces}, named_struct('at', 0, 'out', cast(array() AS array<struct<start:int,end:int>>)), (a, p) -> named_struct("
        f"'at', a.at + {measured}, 'out', CASE WHEN instr(p, '\\u0002') > 0 AND {group} >= {rule.least} "
        "THEN concat(a.out, array(named_struct('start', a.at, 'end', a.at + instr(p, '\\u0002') - 1))) ELSE a.out END), a -> a.out)"
    )
    return F.expr(f"CASE WHEN regexp_like({text}, {_sql(pattern)}) THEN {step} ELSE cast(array() AS array<struct<start:int,end:int>>) END")


def scan(documents: DataFrame, rules: tuple[Rule, ...] = RULES, columns: list[str] | None = None) -> DataFrame:
    """``columns`` (doc_id if not given) of every row with ``spans``: array<struct<kind,order,start,end>> by start, then rule order."""
    asked = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = [r for r in rules if asked[r.kind] != ("all",)]
    keep = columns or ["doc_id"]
    rows = documents.select(*dict.fromkeys([*keep, "doc_id", "text"]))
    text = F.coalesce("text", F.lit(""))
    clean = F.when(F.contains(text, F.lit("\x01")) | F.contains(text, F.lit("\x02")), F.translate(text, "\x01\x02", "\x03\x03")).otherwise(text)
    if indexed:
        trigrams = sorted({t for r in indexed for t in query_trigrams(asked[r.kind])})
        found = saved(candidates(postings(documents, trigrams), rules)).withColumnsRenamed({"doc_id": "candidate", "th": "candidate_th"})
        same = F.col("doc_id").eqNullSafe(F.col("candidate")) & (F.xxhash64("text") == F.col("candidate_th"))
        if found.count() <= MAX_BROADCAST:
            rows = rows.join(F.broadcast(found), same, "left")
        else:
            found = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            rows = rows.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
            rows = rows.join(found, same & (F.col("part") == F.col("salt")), "left")
    else:
        rows = rows.withColumn("kinds", F.expr("cast(array() AS array<string>)"))
    rows = rows.withColumn("clean", clean)
    none = F.expr("cast(array() AS array<struct<start:int,end:int>>)")
    parts = []
    for order, r in enumerate(rules):
        spans = spans_of(r)
        spans = spans if r not in indexed else F.when(F.array_contains("kinds", r.kind), spans).otherwise(none)
        parts.append(_named(spans, r.kind, order))
    return rows.select(*keep, F.array_sort(F.concat(*parts)).alias("spans"))


def _named(spans: Column, kind: str, order: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def joined(spans: str, kinds: tuple[str, ...] | None = None) -> Column:
    """kind:start:end of the spans, comma-joined, of ``kinds`` only if given."""
    own = F.col(spans) if kinds is None else F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(own, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = tuple(r.kind for r in BASE)
    return out.select("doc_id", *(n(k) for k in base), F.sha2(joined("spans", base), 256).alias("base_sha256"), joined("spans").alias("spans"))


def redact(documents: DataFrame, rules: tuple[Rule, ...] = RULES, mask: str = "[secret]") -> DataFrame:
    """``documents`` with every span in ``text`` replaced by ``mask`` (overlapping spans by one), and ``n_chars`` counted anew."""
    names = documents.columns
    # all columns go along in one struct, so none can clash with what the scan adds
    own = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names))).alias("own_row")
    out = scan(documents.select("doc_id", "text", own), rules, ["text", "own_row"])
    step = (
        "aggregate(spans, named_struct('at', 0, 'out', ''), (a, s) -> named_struct('at', greatest(a.at, s.end), 'out', CASE WHEN s.start < a.at THEN a.out "
        f"ELSE concat(a.out, substring(text, a.at + 1, s.start - a.at), '{mask}') END), a -> concat(a.out, substring(text, a.at + 1)))"
    )
    out = out.withColumn("masked", F.expr(f"CASE WHEN size(spans) > 0 THEN {step} ELSE text END"))
    columns = []
    for i, c in enumerate(names):
        value = F.col(f"own_row.c{i}")
        if c == "text":
            value = F.col("masked")
        elif c == "n_chars":
            value = F.when(F.size("spans") > 0, F.length("masked")).otherwise(value).cast(documents.schema[c].dataType)
        columns.append(value.alias(c))
    return out.select(*columns)


def _oracle() -> str:
    """The same spans in SQL: every rule scans every document, cut at marks round the matches."""
    parts = []
    for order, r in enumerate(RULES):
        quoted = searched(r).replace("'", "''").replace(r"\x20", " ")
        flag = "(?i)" if r.ignore_case else ""
        parts.append(f"""
  SELECT row, '{r.kind}' AS kind, {order} AS ord, m.start AS s, m.start + length(m.hit) AS e FROM (
    SELECT row, unnest(list_transform(range(2, len(p) + 1), lambda i: {{'start': list_sum(list_transform(p[:i - 1], lambda x: length(replace(x, chr(2), '')))), 'hit': split_part(p[i], chr(2), 1)}})) AS m
    FROM (SELECT row, string_split(regexp_replace(c, '{flag}{quoted}', chr(1) || '\\0' || chr(2), 'g'), chr(1)) AS p FROM docs))
  WHERE length(regexp_extract(m.hit, '{flag}{quoted}', {r.group})) >= {r.least}""")
    spans = "\n  UNION ALL".join(parts)
    base = ", ".join(f"'{r.kind}'" for r in BASE)
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    return f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, translate(coalesce(text, ''), chr(1) || chr(2), chr(3) || chr(3)) AS c FROM documents),
spans AS ({spans}),
lists AS (SELECT row, {counts},
  coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) FILTER (kind IN ({base})), '') AS base,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) AS spans FROM spans GROUP BY row)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN lists USING (row)
"""


ORACLE_SQL = _oracle()
