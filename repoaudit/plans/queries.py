"""Registered queries: one or more per operator, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import catalogs as C
from ..functions import text as X
from ..operators import advisories as A
from ..operators import deps, health, masking, paths, scan, scoring, tech
from ..sources import reports, snapshots
from ..sources import testbed as T
from . import audit as audits
from .saved import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def on_files(name: str, op: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    add(name, lambda s, d: op(T.files(s, d)), sql and f"WITH {T.FILES_SQL}{sql if sql.startswith(',') else ' ' + sql}")


def on_findings(name: str, op: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    add(name, lambda s, d: op(T.findings(s, d)), sql and f"WITH {T.FINDINGS_SQL}{sql if sql.startswith(',') else ' ' + sql}")


def as_of():
    return F.lit(T.AS_OF).cast("timestamp")


def _list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


# --- paths -----------------------------------------------------------------------------------------------------------

on_files("f1_path_parts", lambda f: paths.with_path_parts(f).select("repo_id", "file_pos", "path", "name", "suffix"), "SELECT repo_id, file_pos, path, name, suffix FROM files")
on_files(
    "f2_prune_skip_dirs", lambda f: paths.prune_skip_dirs(f).select("repo_id", "file_pos", "path"),
    f"SELECT repo_id, file_pos, path FROM files WHERE NOT list_has_any(list_slice(string_split(path, '/'), 1, -2), [{_list(C.SKIP_DIRECTORIES)}])",
)
on_files("f3_flag_binary", lambda f: paths.flag_binary(f.withColumn("bytes", F.when(F.col("file_pos") % 9 == 0, F.concat(F.lit(b"\x00"), F.col("content").cast("binary"))).otherwise(F.col("content").cast("binary")))).select("repo_id", "file_pos", "path", "is_binary"),
    f"SELECT repo_id, file_pos, path, suffix IN ({_list(C.BINARY_EXTENSIONS)}) OR (file_pos % 9 = 0 AND content IS NOT NULL) AS is_binary FROM files")
on_files(
    "f4_flag_truncated", lambda f: paths.flag_truncated(f, 3000).select("repo_id", "file_pos", "truncated", F.length("content").alias("n_chars")),
    "SELECT repo_id, file_pos, size > 3000 AS truncated, CASE WHEN size <= 3000 THEN length(content) END AS n_chars FROM files",
)


def _broken(f: DataFrame) -> DataFrame:
    """Whole contents as bytes with a stray byte in front or a cut character behind."""
    front, third = F.lit(b"\xff"), F.col("file_pos") % 3 == 0
    return f.withColumn("bytes", F.when(third, F.concat(front, F.col("content").cast("binary"))).otherwise(F.concat(F.col("content").cast("binary"), F.lit(b"\xe2\x82"))))


on_files("f5_decode_text", lambda f: paths.decode_text(_broken(f)).select("repo_id", "file_pos", "content"), "SELECT repo_id, file_pos, CASE WHEN file_pos % 3 = 0 THEN chr(65533) || content ELSE content || chr(65533) END AS content FROM files")
on_files(
    "f6_cap_files", lambda f: paths.cap_files(f, 20).select("repo_id", "file_pos", "path", "total_seen", "cap_reached"),
    """SELECT repo_id, file_pos, path, total_seen, total_seen > 20 AS cap_reached
  FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY file_pos) AS k, count(*) OVER (PARTITION BY repo_id) AS total_seen
  FROM files)
  WHERE k <= 20""",
)
_CURATED = f"path IN ({_list(C.CURATED_FILES)}) OR starts_with(path, '{C.ACTIONS_PREFIX}')"
_DEEP = " OR ".join(f"ends_with(path, '{s}')" for s in C.DEEP_SUFFIXES)
on_files("f7_select_curated", lambda f: paths.select_curated(f), f", c AS (SELECT DISTINCT repo_id, path FROM files WHERE {_CURATED}) SELECT repo_id, path, count(*) OVER (PARTITION BY repo_id) AS intended FROM c")
on_files("f7_select_curated_deep", lambda f: paths.select_curated(f, True), f", c AS (SELECT DISTINCT repo_id, path FROM files WHERE {_CURATED} OR {_DEEP}) SELECT repo_id, path, count(*) OVER (PARTITION BY repo_id) AS intended FROM c")
_SCANNABLE = "content IS NOT NULL AND content <> '' AND NOT is_binary AND NOT truncated"
on_files("f8_scannable", lambda f: paths.scannable(f).select("repo_id", "file_pos", "path"), f"SELECT repo_id, file_pos, path FROM files WHERE {_SCANNABLE}")
_IGNORED = "regexp_matches(array_to_string(list_slice(string_split(content, chr(10)), 1, 20), chr(10)), 'audit:\\s*ignore-file')"
on_files("f9_drop_ignored_files", lambda f: paths.drop_ignored_files(paths.scannable(f)).select("repo_id", "file_pos", "path"), f"SELECT repo_id, file_pos, path FROM files WHERE {_SCANNABLE} AND NOT {_IGNORED}")
_LOW_TRUST = f"(regexp_matches({{p}}, '(?i){C.LOW_TRUST_DIR}') OR regexp_matches({{p}}, '(?i){C.LOW_TRUST_FILE}'))"
on_files("f10_low_trust", lambda f: f.select("repo_id", "file_pos", "path", X.is_low_trust().alias("low_trust")), f"SELECT repo_id, file_pos, path, {_LOW_TRUST.format(p='path')} AS low_trust FROM files")
on_files("f11_is_source", lambda f: f.select("repo_id", "file_pos", "path", X.is_source().alias("is_source")), f"SELECT repo_id, file_pos, path, suffix IN ({_list(C.SOURCE_EXTENSIONS)}) AS is_source FROM files")
_SLUG = "^([A-Za-z0-9_.\\-]+)/([A-Za-z0-9_.\\-]+?)(?:\\.git)?$"


def _targets(s: SparkSession, d: str) -> DataFrame:
    k, one = F.col("page_id") % 4, F.col("page_id").cast("string")
    target = F.when(k == 0, F.col("url")).when(k == 1, F.concat(F.lit("https://github.com/own"), one, F.lit("/repo.git"))).when(k == 2, F.concat(F.lit("git@github.com:own/r"), one, F.lit(".git"))).otherwise(F.concat(F.lit("own/r."), one))
    return paths.parse_targets(T.table(s, d, "pages").select("page_id", target.alias("target")))


add("f12_parse_targets", _targets, f"""
WITH t AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN 'https://github.com/own' || page_id || '/repo.git' WHEN 2 THEN 'git@github.com:own/r' || page_id || '.git' ELSE 'own/r.' || page_id END AS target FROM pages),
s AS (SELECT *, regexp_extract(target, '^https?://([^/?#]*)', 1) AS host, CASE WHEN starts_with(target, 'git@') THEN regexp_replace(target, '^[^:]*:', '') WHEN regexp_matches(target, '^https?://') THEN regexp_extract(target, '^https?://[^/?#]*/*([^?#]*)', 1) ELSE target END AS slug FROM t),
e AS (SELECT *, CASE WHEN regexp_matches(target, '^https?://') AND NOT contains(host, 'github.com') THEN 'unsupported host: ' || host WHEN NOT regexp_matches(slug, '{_SLUG}') THEN 'not a repository reference' END AS error FROM s)
SELECT page_id, target, error, CASE WHEN error IS NULL THEN regexp_extract(slug, '{_SLUG}', 1) END AS owner, CASE WHEN error IS NULL THEN regexp_extract(slug, '{_SLUG}', 2) END AS repo FROM e""")  # fmt: skip

# --- scan ------------------------------------------------------------------------------------------------------------


def _globs(globs: tuple[str, ...]) -> str:
    def one(g: str) -> str:
        return "".join("(?s:.*)" if c == "*" else re.escape(c) if not (c.isalnum() or c in "_/-") else c for c in g)

    return "regexp_matches(path, '^(?:" + "|".join(one(g) for g in globs) + ")$')" if globs else "TRUE"


def _match_sql(rules: tuple[dict, ...], text: str, source: str) -> str:
    """All matches of rules without lookarounds: repo_id, file_pos, path, rule, k, line_number, hit."""
    parts = []
    for i, r in enumerate(rules):
        p = r["pattern"].replace("'", "''")
        parts.append(f"""SELECT repo_id, file_pos, path, {i} AS rule, u.k, u.line_number, u.hit FROM (SELECT repo_id, file_pos, path, unnest(list_transform(range(2, len(p) + 1), lambda k: {{
  'k': k, 'line_number': 1 + length(array_to_string(p[:k - 1], '')) - length(replace(array_to_string(p[:k - 1], ''), chr(10), '')), 'hit': split_part(p[k], chr(2), 1)}})) AS u
  FROM (SELECT *, string_split(regexp_replace({text}, '{p}', chr(1) || '\\0' || chr(2), 'g'), chr(1)) AS p FROM {source} WHERE {_globs(r["globs"])}))""")
    return "\nUNION ALL ".join(parts)


def _bare(pattern: str) -> tuple[str, str | None, str | None]:
    """A pattern without its look-behind and look-ahead, and what these ask: the class that may not stand before, the pattern that may not follow. The second engine knows neither."""
    behind = re.match(r"\(\?<!(\[[^\]]*\])\)", pattern)
    pattern = pattern[behind.end() :] if behind else pattern
    start = pattern.find("(?!")
    if start < 0:
        return pattern, behind and behind[1], None
    depth, end, in_class = 1, start + 3, False
    while depth:
        c = pattern[end]
        in_class = (c == "[" or in_class) and c != "]"
        depth += 0 if in_class or pattern[end - 1] == "\\" else (c == "(") - (c == ")")
        end += 1
    return pattern[:start] + pattern[end:], behind and behind[1], pattern[start + 3 : end - 1]


def _guarded_sql(rules: tuple[dict, ...], source: str) -> str:
    """All matches of any rules, secrets in ``content`` and others in ``masked``: those of the bare pattern whose neighbours are as the pattern asks. No match of these rules lies within one that its neighbours rule out."""
    parts = []
    for i, r in enumerate(rules):
        bare, behind, ahead = _bare(r["pattern"])
        text = _RAW if r["category"] == "secret" else _MASKED
        p = bare.replace("'", "''")
        plain = "replace(array_to_string({}, ''), chr(2), '')".format
        before, after = f"right({plain('p[:k - 1]')}, 1)", f"split_part(p[k], chr(2), 2) || {plain('p[k + 1:]')}"
        # a guard in front of or behind one alternative only
        first = {"RB002": "NOT regexp_matches(hit, '^[%`]')", "JS006": "TRUE"}.get(r["rule_id"], "TRUE")
        last = {"JS006": "ends_with(hit, '=')"}.get(r["rule_id"], "TRUE")
        keep = [f"NOT ({first} AND regexp_matches(before, '^{behind}$'))"] * bool(behind) + [f"NOT ({last} AND regexp_matches(after, '^(?:{ahead})'))"] * bool(ahead)
        parts.append(f"""SELECT repo_id, file_pos, path, {i} AS rule, k, line_number, hit FROM (
  SELECT repo_id, file_pos, path, u.k, u.hit, u.before, u.after, 1 + length(u.front) - length(replace(u.front, chr(10), '')) AS line_number
  FROM (SELECT repo_id, file_pos, path, unnest(list_transform(range(2, len(p) + 1), lambda k: {{
    'k': k, 'front': {plain('p[:k - 1]')}, 'hit': split_part(p[k], chr(2), 1), 'before': {before}, 'after': {after}}})) AS u
  FROM (SELECT *, string_split(regexp_replace({text}, '{p}', chr(1) || '\\0' || chr(2), 'g'), chr(1)) AS p FROM {source} WHERE {_globs(r["globs"])})))
  WHERE {' AND '.join(keep) or 'TRUE'}""")
    return "\nUNION ALL ".join(parts)


def _rules_sql(rules: tuple[dict, ...]) -> str:
    rows = ", ".join("(" + ", ".join([str(i), *(f"'{r[k].replace(chr(39), chr(39) * 2)}'" for k in ("rule_id", "title", "severity", "category", "description", "recommendation")), str(r["redact"]).lower()]) + ")" for i, r in enumerate(rules))
    return f"rules(rule, rule_id, title, severity, category, description, recommendation, redact) AS (VALUES {rows})"


_LINE_MASK = "array_to_string(list_transform(string_split(content, chr(10)), lambda l: CASE WHEN regexp_matches(l, '^\\s*#') THEN repeat(' ', length(l)) ELSE l END), chr(10))"
_RAW, _MASKED = "content", "masked"
_KEPT = f", kept AS (SELECT *, {_LINE_MASK} AS masked FROM files WHERE {_SCANNABLE} AND NOT {_IGNORED})"


def _pack_sql(pack: str) -> str:
    rules = C.pack(pack)
    return f"{_KEPT}, m AS ({_match_sql(rules, _RAW if pack == 'SEC' else _MASKED, 'kept')}), {_rules_sql(rules)} SELECT repo_id, path, rule_id, line_number, hit FROM m JOIN rules USING (rule)"


def _pack(pack: str) -> Callable[[DataFrame], DataFrame]:
    rules = C.pack(pack)

    def run(files: DataFrame) -> DataFrame:
        kept = paths.drop_ignored_files(paths.scannable(files))
        if pack != "SEC":
            kept = kept.where(X.matches_globs("path", tuple(dict.fromkeys(g for r in rules for g in r["globs"]))))
            kept = masking.mask_code(kept) if pack == "PY" else kept.withColumn("masked", {"JS": masking.mask_c_family, "PHP": masking.mask_php, "RB": masking.mask_ruby}.get(pack, masking.mask_lines)(F.col("content")))
        return scan.with_rules(scan.scan_matches(kept, rules), rules).select("repo_id", "path", "rule_id", "line_number", "hit")

    return run


_COUNTED = tuple(r for r in C.RULES if r["globs"])
on_files("m1_match_rules", lambda f: scan.match_rules_to_files(f, scan.rules_frame(f.sparkSession)),
    f""",
  r(rule_id, pattern) AS (VALUES {', '.join(chr(40) + chr(39) + r['rule_id'] + chr(39) + ', ' + chr(39) + (_globs(r['globs']).removeprefix('regexp_matches(path, ' + chr(39)).removesuffix(chr(39) + ')') if r['globs'] else '') + chr(39) + ')' for r in C.RULES)}) SELECT DISTINCT repo_id, path, rule_id
  FROM files
  JOIN r ON regexp_matches(path, pattern)""")  # fmt: skip
on_files("m2_mask_lines", lambda f: f.select("repo_id", "file_pos", masking.mask_lines(F.col("content")).alias("masked")), f"SELECT repo_id, file_pos, {_LINE_MASK} AS masked FROM files")


def _mask_sql(tokens: str, comments: tuple[str, ...], quotes: str) -> str:
    """The mask of ``content`` in SQL: the same tokens, each blanked by its kind."""
    tokens = tokens.replace("(?ds)", "(?s)").replace("++", "+").replace("*+", "*")  # this engine never backtracks
    blank = "regexp_replace({}, '[^\\r\\n]', ' ', 'g')".format
    is_comment = " OR ".join(f"starts_with(t, '{c}')" for c in comments)
    # a back quote left open keeps its last character, unless that is a lone backslash
    open_end = r"regexp_full_match(t, '(?s)`(?:[^`\\]|\\.)*\\')" if "`" in quotes else "FALSE"
    masked = f"""
      CASE WHEN {is_comment} THEN {blank("t")}
        WHEN length(t) < 2 OR substr(t, 1, 1) NOT IN ({_list(quotes)}) THEN t
        WHEN {open_end} THEN substr(t, 1, 1) || {blank("substr(t, 2)")}
        ELSE substr(t, 1, 1) || {blank("substr(t, 2, length(t) - 2)")} || substr(t, -1) END"""
    return f"array_to_string(list_transform(regexp_extract_all(content, {_list([tokens])}), lambda t: {masked}), '')"


_RUBY_NAMES = ("Rakefile", "Gemfile")
_MASKS = {
    "m3_mask_c_family": (lambda: X.suffix().isin(*masking.C_FAMILY), masking.mask_c_family, f"suffix IN ({_list(masking.C_FAMILY)})", (masking.C_TOKENS, ("//", "/*"), "\"'`")),
    "m4_mask_php": (lambda: X.suffix().isin(*masking.PHP), masking.mask_php, f"suffix IN ({_list(masking.PHP)})", (masking.PHP_TOKENS, ("//", "/*", "#"), "\"'")),
    "m5_mask_ruby": (
        lambda: (X.suffix() == ".rb") | X.basename().isin(*_RUBY_NAMES), masking.mask_ruby, f"(suffix = '.rb' OR name IN ({_list(_RUBY_NAMES)}))",
        (masking.RUBY_TOKENS, ("#",), "\"'"),
    ),
}
for _name, (_where, _mask, _where_sql, _parts) in _MASKS.items():
    on_files(
        _name, lambda f, where=_where, mask=_mask: f.where(where()).select("repo_id", "file_pos", mask(F.col("content")).alias("masked")),
        f"SELECT repo_id, file_pos, {_mask_sql(*_parts)} AS masked FROM files WHERE {_where_sql}",
    )
on_files("m6_mask_python", lambda f: f.where(X.suffix() == ".py").select("repo_id", "file_pos", masking.mask_python(F.col("content")).alias("masked")))
on_files("m7_mask_code", lambda f: masking.mask_code(f).select("repo_id", "file_pos", "path", "masked"))
_TITLES = ({"rule_id": "LIC", "title": "licence line", "severity": "info", "pattern": r"\b(?:MIT|Apache) License\b", "globs": (), "literals": (), "redact": False, "category": "secret", "pack": "LIC", "description": "licence", "recommendation": "-"},)
on_files("m8_scan_matches", lambda f: scan.scan_matches(paths.scannable(f), _TITLES).select("repo_id", "path", "line_number", "hit"), f", kept AS (SELECT * FROM files WHERE {_SCANNABLE}), m AS ({_match_sql(_TITLES, 'content', 'kept')}) SELECT repo_id, path, line_number, hit FROM m")
#: what Python's tokenizer blanks in code without triple quotes and f-strings, quotes included
_PY_MASK = "array_to_string(list_transform(regexp_extract_all(content, {}), lambda t: CASE WHEN regexp_matches(t, '^[#\"'']') AND (length(t) > 1 OR starts_with(t, '#')) THEN regexp_replace(t, '[^\\r\\n]', ' ', 'g') ELSE t END), '')".format(_list([masking.RUBY_TOKENS.replace("(?ds)", "(?s)").replace("++", "+").replace("*+", "*")]))
_CODE_MASK = f"CASE WHEN suffix = '.py' THEN {_PY_MASK} " + " ".join(f"WHEN {where} THEN {_mask_sql(*parts)}" for _, _, where, parts in _MASKS.values()) + f" ELSE {_LINE_MASK} END"
_CODE_KEPT = f", kept AS (SELECT *, {_CODE_MASK} AS masked FROM files WHERE {_SCANNABLE} AND NOT {_IGNORED})"


# the fleet's Python files hold neither triple quotes nor f-strings, and no quotes where the tokenizer gives up; tests compare such texts with the tokenizer
SQL["m6_mask_python"] = f"WITH {T.FILES_SQL} SELECT repo_id, file_pos, {_PY_MASK} AS masked FROM files WHERE suffix = '.py'"
SQL["m7_mask_code"] = f"WITH {T.FILES_SQL} SELECT repo_id, file_pos, path, {_CODE_MASK} AS masked FROM files"


def _code_pack_sql(pack: str) -> str:
    rules = C.pack(pack)
    return f"{_CODE_KEPT}, m AS ({_guarded_sql(rules, 'kept')}), {_rules_sql(rules)} SELECT repo_id, path, rule_id, line_number, hit FROM m JOIN rules USING (rule)"


for _m, _p in (("m9_secret_pack", "SEC"), ("m10_python_pack", "PY"), ("m11_javascript_pack", "JS"), ("m12_ruby_pack", "RB"), ("m13_php_pack", "PHP"), ("m14_shell_pack", "SH"), ("m15_docker_pack", "DK"), ("m16_workflow_pack", "GH")):
    on_files(_m, _pack(_p), _pack_sql(_p) if _p in ("SEC", "SH", "DK", "GH") else _code_pack_sql(_p))



def _all_matches(files: DataFrame) -> DataFrame:
    """Every match of every rule, with its rule and line."""
    return scan.with_rules(scan.scan_matches(masking.mask_code(paths.drop_ignored_files(paths.scannable(files))), C.RULES), C.RULES)


_ALL_SQL = f"""{_CODE_KEPT}, hits AS ({_guarded_sql(C.RULES, 'kept')}), {_rules_sql(C.RULES)},
  m AS (SELECT h.*, r.* EXCLUDE (rule), string_split(f.content, chr(10))[h.line_number] AS line_text,
  row_number() OVER (PARTITION BY repo_id, file_pos ORDER BY rule, h.k) - 1 AS match_pos
  FROM hits h
  JOIN rules r USING (rule)
  JOIN files f USING (repo_id, file_pos)),
  told AS (SELECT * FROM (SELECT *, regexp_matches(line_text, 'audit:\\s*ignore') AS marked, regexp_extract(line_text, 'audit:\\s*ignore(?:\\s+([A-Z0-9,\\s]+))?', 1) AS named FROM m)
  WHERE NOT (marked AND (named = '' OR list_contains(list_transform(string_split(named, ','), lambda t: trim(t)), rule_id))))"""
on_files("m17_drop_suppressed", lambda f: scan.drop_suppressed(_all_matches(f)).select("repo_id", "path", "rule_id", "line_number"), f"{_ALL_SQL} SELECT repo_id, path, rule_id, line_number FROM told")
_REDACTED = "CASE WHEN length({c}) <= 4 THEN repeat('*', length({c})) ELSE substr({c}, 1, 4) || repeat('*', greatest(8, length({c}) - 4)) END"
add(
    "m18_redact", lambda s, d: T.table(s, d, "documents").select("doc_id", X.redact("lang").alias("lang"), X.redact("source").alias("source"), X.redact("text").alias("text")),
    f"SELECT doc_id, {_REDACTED.format(c='lang')} AS lang, {_REDACTED.format(c='source')} AS source, {_REDACTED.format(c='text')} AS text FROM documents",
)
add("m18_redact_whole", lambda s, d: T.table(s, d, "documents").select("doc_id", X.redact("text").alias("redacted")), f"SELECT doc_id, {_REDACTED.format(c='text')} AS redacted FROM documents")
_DESCRIBED = f"""CASE
  WHEN severity IN ('high', 'critical') OR redact THEN description || chr(10) || chr(10) || 'Matched value: `' || CASE
  WHEN redact THEN {_REDACTED.format(c='hit')}
  ELSE hit END || '`'
  ELSE description END"""
on_files("m19_describe", lambda f: scan.describe(scan.with_rules(scan.scan_matches(paths.scannable(f), C.pack("SEC")), C.pack("SEC"))).select("repo_id", "path", "rule_id", "line_number", "description"),
    f""",
  kept AS (SELECT *
  FROM files
  WHERE {_SCANNABLE}),
  m AS ({_match_sql(C.pack('SEC'), 'content', 'kept')}), {_rules_sql(C.pack('SEC'))} SELECT repo_id, path, rule_id, line_number, {_DESCRIBED} AS description
  FROM m
  JOIN rules USING (rule)""")  # fmt: skip
_DOWN = f"(coalesce({_LOW_TRUST.format(p='file_path')}, FALSE) AND category IN ('secret', 'code_pattern') AND sev > 0)"
on_findings("m20_path_context", lambda f: scan.apply_path_context(f).select("repo_id", "finding_pos", "severity", "description"),
    f"""SELECT repo_id, finding_pos, CASE
  WHEN {_DOWN} THEN ['info', 'low', 'medium', 'high', 'critical'][sev]
  ELSE severity END AS severity, CASE
  WHEN {_DOWN} THEN description || chr(10) || chr(10) || '{scan.DOWNRANKED.strip()}'
  ELSE description END AS description
  FROM findings""")  # fmt: skip
on_files("m21_install_hooks", lambda f: scan.install_hooks(f).select("repo_id", "rule_id", "title", "severity", "file_path", "description"), """
, h AS (SELECT repo_id, path, unnest(['preinstall', 'install', 'postinstall', 'prepare']) AS hook, content FROM files WHERE name = 'package.json' AND content <> ''), c AS (SELECT *, json_extract_string(content, '$.scripts.' || hook) AS command FROM h)
SELECT repo_id, 'JS100' AS rule_id, 'npm `' || hook || '` script declared' AS title, CASE hook WHEN 'prepare' THEN 'medium' ELSE 'high' END AS severity, path AS file_path, 'The script `' || hook || '` runs on install: `' || substr(command, 1, 200) || '`' AS description FROM c WHERE command IS NOT NULL""")
on_files("m22_env_files", lambda f: scan.env_files(f).select("repo_id", "rule_id", "title", "severity", "file_path", "category"), """SELECT repo_id, 'SEC011' AS rule_id, '`' || name || '` committed to the repository' AS title, 'high' AS severity, path AS file_path, 'secret' AS category
  FROM files
  WHERE name IN ('.env', '.env.local', '.env.production') AND content <> ''""")
on_findings("m23_dedupe", lambda f: scan.dedupe_findings(f.withColumn("repo_id", F.substring_index("repo_id", "@", 1))).select("repo_id", "finding_pos", "rule_id", "file_path", "line_number"),
    """SELECT split_part(repo_id, '@', 1) AS repo_id, min(finding_pos) AS finding_pos, rule_id, file_path, line_number
  FROM findings
  GROUP BY split_part(repo_id, '@', 1), rule_id, file_path, line_number, title""")  # fmt: skip
_POS = "CAST({stage} * 1152921504606846976 + file_pos * 16777216 + {at} AS BIGINT) AS finding_pos".format
_SCAN_SQL = f"""{_ALL_SQL},
  shown AS (SELECT repo_id, file_pos, match_pos, rule_id, title, severity, path AS file_path, line_number, {_DESCRIBED} AS description, recommendation, category,
    list_position(['info', 'low', 'medium', 'high', 'critical'], severity) - 1 AS sev FROM told),
  hooks AS (SELECT *, json_extract_string(content, '$.scripts.' || hook) AS command FROM (
    SELECT repo_id, file_pos, path, content, unnest(['preinstall', 'install', 'postinstall', 'prepare']) AS hook FROM files WHERE name = 'package.json' AND content <> '')),
  found AS (
    SELECT repo_id, {_POS(stage=0, at='match_pos')}, rule_id, title, CASE WHEN {_DOWN} THEN ['info', 'low', 'medium', 'high', 'critical'][sev] ELSE severity END AS severity, file_path, CAST(line_number AS INT) AS line_number,
      CASE WHEN {_DOWN} THEN description || chr(10) || chr(10) || '{scan.DOWNRANKED.strip()}' ELSE description END AS description, recommendation, category FROM shown
    UNION ALL SELECT repo_id, {_POS(stage=1, at="list_position(json_keys(content, '$.scripts'), hook) - 1")}, 'JS100', 'npm `' || hook || '` script declared', CASE hook WHEN 'prepare' THEN 'medium' ELSE 'high' END, path, NULL,
      'The script `' || hook || '` runs on install: `' || substr(command, 1, 200) || '`', 'Read the script before installing.', 'install_hook' FROM hooks WHERE command IS NOT NULL
    UNION ALL SELECT repo_id, {_POS(stage=2, at=0)}, 'SEC011', '`' || name || '` committed to the repository', 'high', path, NULL,
      'Environment files often hold credentials.', 'Move the values to a secret store and ignore the file.', 'secret' FROM files WHERE name IN ('.env', '.env.local', '.env.production') AND content <> '')
SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY repo_id, file_path, rule_id, line_number, title ORDER BY finding_pos) = 1"""
on_files("m24_full_scan", lambda f: scan.scan_files(f), _SCAN_SQL)

# --- dependencies ----------------------------------------------------------------------------------------------------

_DEPS = ("repo_id", "file_pos", "ecosystem", "name", "version", "source")


def on_locks(name: str, parse: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    on_files(name, lambda f: parse(f).select(*_DEPS), sql)


_LINES = "unnest(string_split(content, chr(10)))"
_REQ = "^([A-Za-z0-9._-]+)(?:\\[[^\\]]*\\])?\\s*==\\s*([A-Za-z0-9][A-Za-z0-9._-]*)"
_PIN = {
    "requirements": f"""SELECT repo_id, file_pos, 'PyPI' AS ecosystem, lower(regexp_extract(x, '{_REQ}', 1)) AS name, regexp_extract(x, '{_REQ}', 2) AS version, path AS source
  FROM (SELECT *, trim(split_part(l, '#', 1)) AS x
  FROM (SELECT repo_id, file_pos, path, {_LINES} AS l
  FROM files
  WHERE files.name = 'requirements.txt'))
  WHERE NOT starts_with(x, '-') AND regexp_matches(x, '{_REQ}')""",
    "poetry": """SELECT repo_id, file_pos, 'PyPI' AS ecosystem, lower(regexp_extract(b, '(?m)^\\s*name\\s*=\\s*"([^"]+)"', 1)) AS name, regexp_extract(b, '(?m)^\\s*version\\s*=\\s*"([^"]+)"', 1) AS version, path AS source
  FROM (SELECT repo_id, file_pos, path, unnest(string_split(content, '[[package]]')[2:]) AS b
  FROM files
  WHERE files.name = 'poetry.lock')""",
    "cargo": """SELECT repo_id, file_pos, 'crates.io' AS ecosystem, regexp_extract(b, '(?m)^\\s*name\\s*=\\s*"([^"]+)"', 1) AS name, regexp_extract(b, '(?m)^\\s*version\\s*=\\s*"([^"]+)"', 1) AS version, path AS source
  FROM (SELECT repo_id, file_pos, path, unnest(string_split(content, '[[package]]')[2:]) AS b
  FROM files
  WHERE files.name = 'Cargo.lock')""",
    "pipfile": """SELECT repo_id, file_pos, 'PyPI' AS ecosystem, lower(key) AS name, regexp_extract(v, '^==\\s*([A-Za-z0-9][A-Za-z0-9._-]*)', 1) AS version, path AS source
  FROM (SELECT *, json_extract_string(content, '$.' || s || '."' || key || '".version') AS v
  FROM (SELECT *, unnest(json_keys(content, '$.' || s)) AS key
  FROM (SELECT repo_id, file_pos, path, content, unnest(['default', 'develop']) AS s
  FROM files
  WHERE files.name = 'Pipfile.lock')))
  WHERE regexp_matches(v, '^==')""",
    "npm2": """SELECT repo_id, file_pos, 'npm' AS ecosystem, list_extract(string_split(key, 'node_modules/'), -1) AS name, json_extract_string(content, '$.packages."' || key || '".version') AS version, path AS source
  FROM (SELECT repo_id, file_pos, path, content, unnest(json_keys(content, '$.packages')) AS key
  FROM files
  WHERE files.name = 'package-lock.json' AND json_extract(content, '$.packages') IS NOT NULL)
  WHERE key <> ''""",
    "gems": """SELECT repo_id, file_pos, 'RubyGems' AS ecosystem, regexp_extract(l, '^    ([A-Za-z0-9._-]+) \\(([0-9][^)]*)\\)\\s*$', 1) AS name, regexp_extract(l, '^    ([A-Za-z0-9._-]+) \\(([0-9][^)]*)\\)\\s*$', 2) AS version, path AS source
  FROM (SELECT repo_id, file_pos, path, """ + _LINES + " AS l FROM files WHERE files.name = 'Gemfile.lock') WHERE regexp_matches(l, '^    ([A-Za-z0-9._-]+) \\(([0-9][^)]*)\\)\\s*$')",
    "composer": """SELECT repo_id, file_pos, 'Packagist' AS ecosystem, json_extract_string(p, '$.name') AS name, regexp_replace(json_extract_string(p, '$.version'), '^v+', '') AS version, path AS source
  FROM (SELECT repo_id, file_pos, path, unnest(list_concat(json_extract(content, '$.packages[*]'), json_extract(content, '$."packages-dev"[*]'))) AS p
  FROM files
  WHERE files.name = 'composer.lock')
  WHERE NOT starts_with(json_extract_string(p, '$.version'), 'dev-')""",
    "go": """SELECT repo_id, file_pos, 'Go' AS ecosystem, regexp_extract(x, '^(?:require\\s+)?([^\\s]+)\\s+(v[0-9][^\\s]*)', 1) AS name, regexp_replace(regexp_extract(x, '^(?:require\\s+)?([^\\s]+)\\s+(v[0-9][^\\s]*)', 2), '^v+', '') AS version, path AS source
  FROM (SELECT *, trim(split_part(t, '//', 1)) AS x
  FROM (SELECT *, last_value(CASE
  WHEN starts_with(t, 'require (') THEN 1
  WHEN t = ')' THEN 0 END IGNORE NULLS) OVER (PARTITION BY repo_id, file_pos ORDER BY k) AS open
  FROM (SELECT *, trim(replace(l, chr(9), ' ')) AS t
  FROM (SELECT repo_id, file_pos, path, unnest(string_split(content, chr(10))) AS l, generate_subscripts(string_split(content, chr(10)), 1) AS k
  FROM files
  WHERE files.name = 'go.mod')))
  WHERE (open = 1 OR starts_with(t, 'require ')) AND NOT starts_with(t, 'require (') AND t <> ')')
  WHERE regexp_matches(x, '^(?:require\\s+)?([^\\s]+)\\s+(v[0-9][^\\s]*)')""",
}
_MANIFESTS = "manifests(name, manager, ecosystem) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in C.MANIFESTS) + ")"
on_files("d1_manifests", deps.detect_manifests, f", {_MANIFESTS} SELECT DISTINCT repo_id, path, manager, ecosystem FROM files JOIN manifests USING (name)")
for _d, _fn, _k in (
    ("d2_requirements", deps.parse_requirements, "requirements"),
    ("d3_poetry_lock", deps.parse_poetry_lock, "poetry"),
    ("d4_cargo_lock", deps.parse_cargo_lock, "cargo"),
    ("d5_pipfile_lock", deps.parse_pipfile_lock, "pipfile"),
    ("d6_package_lock_v2", deps.parse_package_lock_v2, "npm2"),
    ("d8_gemfile_lock", deps.parse_gemfile_lock, "gems"),
    ("d9_composer_lock", deps.parse_composer_lock, "composer"),
    ("d10_go_mod", deps.parse_go_mod, "go"),
):
    on_locks(_d, _fn, _PIN[_k])
_PIN["npm1"] = """
SELECT repo_id, file_pos, 'npm' AS ecosystem, key AS name, json_extract_string(tree, '$."' || key || '".version') AS version, path AS source FROM (
  WITH RECURSIVE t(repo_id, file_pos, path, tree) AS (
    SELECT repo_id, file_pos, path, json_extract(content, '$.dependencies') FROM files WHERE files.name = 'package-lock.json' AND json_extract(content, '$.packages') IS NULL
    UNION ALL
    SELECT repo_id, file_pos, path, json_extract(tree, '$."' || key || '".dependencies') FROM (SELECT *, unnest(json_keys(tree)) AS key FROM t WHERE tree IS NOT NULL))
  SELECT *, unnest(json_keys(tree)) AS key FROM t WHERE tree IS NOT NULL)
WHERE json_extract_string(tree, '$."' || key || '".version') IS NOT NULL"""
on_locks("d7_package_lock_v1", deps.parse_package_lock_v1, _PIN["npm1"])
_ALL_PINS = ", pins AS (" + " UNION ALL ".join(_PIN.values()) + ") SELECT repo_id, ecosystem, name, version, arg_min(source, file_pos) AS source FROM pins GROUP BY repo_id, ecosystem, name, version"
for _d in ("d11_extract_versions", "d11_extract_versions_all"):
    on_files(_d, lambda f: deps.extract_versions(f).select("repo_id", "ecosystem", "name", "version", "source"), _ALL_PINS)
_HITS = f"""WITH {T.DEPS_SQL}, {T.ADVISORIES_SQL},
  hits AS (SELECT d.repo_id, d.dep_pos, ecosystem, name, version, source, vuln_id, vuln_pos
  FROM (SELECT *
  FROM dep_versions
  QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY dep_pos) <= 1000) d
  JOIN advisories USING (ecosystem, name, version))"""
_ENRICHED = """,
  seen AS (SELECT repo_id, vuln_id, row_number() OVER (PARTITION BY repo_id ORDER BY first_at, vuln_id) AS k
  FROM (SELECT repo_id, vuln_id, min({'a': dep_pos, 'b': vuln_pos}) AS first_at
  FROM hits
  GROUP BY ALL)),
  enriched AS (SELECT h.*, w.summary, w.details, w.severity_label
  FROM hits h
  LEFT
  JOIN (SELECT repo_id, vuln_id, summary, details, severity_label
  FROM seen
  JOIN advisory_details USING (vuln_id)
  WHERE k <= 100) w USING (repo_id, vuln_id))"""


def _hits(s: SparkSession, d: str) -> DataFrame:
    return A.match_advisories(T.dep_versions(s, d), T.advisories(s, d))


def _enriched(s: SparkSession, d: str, details: DataFrame) -> DataFrame:
    return A.match_and_enrich(T.dep_versions(s, d), T.advisories(s, d), details)


add("d12_match_advisories", lambda s, d: _hits(s, d).select("repo_id", "dep_pos", "ecosystem", "name", "version", "vuln_id", "vuln_pos"), _HITS + " SELECT repo_id, dep_pos, ecosystem, name, version, vuln_id, vuln_pos FROM hits")
_RANGED = ("repo_id", "dep_pos", "ecosystem", "name", "version", "vuln_id", "vuln_pos")
add("d12_version_ranges", lambda s, d: A.match_advisories(T.ranged_pins(s, d), T.advisories(s, d).where("false"), None, T.advisory_ranges(s, d)).select(*_RANGED), f"WITH {T.RANGES_SQL} SELECT {', '.join(_RANGED)} FROM range_hits")
add("d13_enrich", lambda s, d: _enriched(s, d, T.advisory_details(s, d).drop("details")).select("repo_id", "dep_pos", "vuln_id", "summary", "severity_label"), _HITS + _ENRICHED + " SELECT repo_id, dep_pos, vuln_id, summary, severity_label FROM enriched")
_ADV_SEV = "CASE WHEN upper(severity_label) IN ('CRITICAL', 'HIGH') THEN 'high' WHEN upper(severity_label) = 'LOW' THEN 'low' ELSE 'medium' END"
_ADV_SUM = "coalesce(nullif(summary, ''), nullif(split_part(details, chr(10), 1), ''), vuln_id)"
add("d14_advisory_severity", lambda s, d: T.advisory_details(s, d).select("vuln_id", A.advisory_severity().alias("severity")), f"WITH {T.ADVISORIES_SQL} SELECT vuln_id, {_ADV_SEV} AS severity FROM advisory_details")
add("d15_advisory_summary", lambda s, d: T.advisory_details(s, d).select("vuln_id", A.advisory_summary().alias("summary")), f"WITH {T.ADVISORIES_SQL} SELECT vuln_id, {_ADV_SUM} AS summary FROM advisory_details")
add("d16_dependency_findings", lambda s, d: A.dependency_findings(_enriched(s, d, A.headlines(T.advisory_details(s, d)))).select("repo_id", "rule_id", "title", "severity", "description"),
    _HITS + _ENRICHED + f""" SELECT repo_id, vuln_id AS rule_id, name || ' ' || version || ': known vulnerability (' || vuln_id || ')' AS title, {_ADV_SEV} AS severity, name || ' ' || version || ' (' || ecosystem || ') is affected by ' || vuln_id || ': ' || {_ADV_SUM} AS description
  FROM enriched
  QUALIFY row_number() OVER (PARTITION BY repo_id, ecosystem, name, version ORDER BY vuln_pos) <= 10""")  # fmt: skip
add("d17_advisory_gap", lambda s, d: A.advisory_gap_findings(T.dep_versions(s, d), T.table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("repo_id"), (F.col("c_custkey") % 4 > 0).alias("available"))).select("repo_id", "rule_id", "severity", "category"),
    f"""WITH {T.DEPS_SQL} SELECT DISTINCT repo_id, 'DEP000' AS rule_id, 'info' AS severity, 'coverage' AS category
  FROM dep_versions
  WHERE CAST(repo_id AS BIGINT) IN (SELECT c_custkey
  FROM customer
  WHERE c_custkey % 4 = 0)""")  # fmt: skip

# --- technology ------------------------------------------------------------------------------------------------------

_LANGS = "by_name(name, lang) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in C.LANGUAGE_BY_NAME) + "), by_suffix(suffix, lang) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in C.LANGUAGE_BY_SUFFIX) + ")"
_COUNTS = f""", {_LANGS},
  counts AS (SELECT repo_id, lang, sum(n) AS n, list_sort(list(DISTINCT evidence)) AS evidence, min(seen_at) AS first_seen
  FROM (SELECT repo_id, b.lang, 5 AS n, files.name AS evidence, file_pos * 2 AS seen_at
  FROM files
  JOIN by_name b ON files.name = b.name
  UNION ALL SELECT repo_id, b.lang, 1, '`' || b.suffix || '` files', file_pos * 2 + 1
  FROM files
  JOIN by_suffix b ON files.suffix = b.suffix)
  GROUP BY repo_id, lang)"""
on_files("t1_language_counts", lambda f: tech.language_counts(f).withColumn("evidence", F.array_join("evidence", "|")), _COUNTS + " SELECT repo_id, lang, CAST(n AS BIGINT) AS n, array_to_string(evidence, '|') AS evidence, first_seen FROM counts")
# every repository has a count of its own, for a language that its bytes may know or not
_OWN = "SELECT CAST(c_custkey AS VARCHAR) AS repo_id, CASE c_custkey % 4 WHEN 0 THEN 'Go' WHEN 1 THEN 'Shell' WHEN 2 THEN 'Lua' ELSE 'C' END AS lang, c_custkey % 23 AS n, c_custkey AS first_seen FROM customer"
_MERGED = f"""WITH {T.LANGUAGE_BYTES_SQL},
  own AS ({_OWN}),
  scaled AS (SELECT repo_id, lang, CAST(floor(20 * bytes / greatest(1, max(bytes) OVER (PARTITION BY repo_id))) AS BIGINT) AS scaled, lang_pos
  FROM language_bytes),
  merged AS (SELECT repo_id, lang, greatest(coalesce(n, 0), coalesce(scaled, 0)) AS n, coalesce(first_seen, 1099511627776 + lang_pos) AS first_seen
  FROM own
  FULL
  JOIN scaled USING (repo_id, lang))"""


def _merged(s: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    lang = F.when(key % 4 == 0, "Go").when(key % 4 == 1, "Shell").when(key % 4 == 2, "Lua").otherwise("C")
    own = T.table(s, d, "customer").select(key.cast("string").alias("repo_id"), lang.alias("lang"), (key % 23).alias("n"), F.array(F.lit("own")).alias("evidence"), key.alias("first_seen"))
    return tech.merge_language_bytes(own, T.language_bytes(s, d))


_DETECTED = """,
  detected AS (SELECT repo_id, lang, least(0.99, round_even(n / greatest(1, max(n) OVER (PARTITION BY repo_id)), 2)) AS confidence, n, first_seen
  FROM merged),
  placed AS (SELECT repo_id, lang, confidence, row_number() OVER (PARTITION BY repo_id ORDER BY n DESC, first_seen, lang) AS place
  FROM detected
  WHERE confidence >= 0.05)"""
add("t2_merge_language_bytes", lambda s, d: _merged(s, d).select("repo_id", "lang", "n"), _MERGED + " SELECT repo_id, lang, n FROM merged")
add("t3_detect_languages", lambda s, d: tech.detect_languages(_merged(s, d)).select("repo_id", "lang", "confidence", "place"), _MERGED + _DETECTED + " SELECT repo_id, lang, CAST(confidence AS DOUBLE) AS confidence, place FROM placed")
add("t4_primary_language", lambda s, d: tech.primary_language(tech.detect_languages(_merged(s, d))), _MERGED + _DETECTED + " SELECT repo_id, lang AS primary_language FROM placed WHERE place = 1")


def _first(name: str) -> str:
    return f"SELECT repo_id, arg_min(content, file_pos) AS content FROM files WHERE files.name = '{name}' AND content <> '' GROUP BY repo_id"


_PYDEPS = f"""SELECT repo_id, dep, ['requirements.txt', 'pyproject.toml', 'Pipfile', 'setup.py'][min(rank) + 1] AS source FROM (
  SELECT repo_id, lower(regexp_extract(x, '^[^<>=!~\\[\\s]*')) AS dep, 0 AS rank FROM (SELECT repo_id, trim(split_part(l, '#', 1)) AS x FROM (SELECT repo_id, {_LINES} AS l FROM ({_first('requirements.txt')}))) WHERE x <> '' AND NOT starts_with(x, '-')
  UNION ALL SELECT repo_id, lower(unnest(regexp_extract_all(content, '"([A-Za-z0-9_.\\-]+)\\s*(?:[<>=!~\\[].*)?"', 1))), 1 FROM ({_first('pyproject.toml')})
  UNION ALL SELECT repo_id, lower(k), 2 FROM (SELECT repo_id, unnest(regexp_extract_all(content, '(?m)^([A-Za-z0-9_.\\-]+)\\s*=', 1)) AS k FROM ({_first('Pipfile')})) WHERE lower(k) NOT IN ('name', 'url', 'verify_ssl', 'python_version')
  UNION ALL SELECT repo_id, lower(unnest(regexp_extract_all(regexp_extract(content, '(?s)install_requires\\s*=\\s*\\[(.*?)\\]', 1), '[''"]([A-Za-z0-9_.\\-]+)', 1))), 3 FROM ({_first('setup.py')})) WHERE dep <> '' GROUP BY repo_id, dep"""
_JSDEPS = f"""SELECT DISTINCT repo_id, unnest(json_keys(content, '$.' || s)) AS dep
  FROM (SELECT *, unnest(['dependencies', 'devDependencies', 'peerDependencies', 'optionalDependencies']) AS s
  FROM ({_first('package.json')}))
  WHERE json_extract(content, '$.' || s) IS NOT NULL"""
_RBDEPS = f"""SELECT repo_id, dep, min(source) AS source
  FROM (SELECT repo_id, unnest(regexp_extract_all(content, '(?m)^\\s*gem\\s+[''"]([^''"]+)[''"]', 1)) AS dep, 'Gemfile' AS source
  FROM ({_first('Gemfile')})
  UNION ALL SELECT repo_id, unnest(regexp_extract_all(content, '(?m)^\\s{{4}}([A-Za-z0-9_\\-]+)\\s*\\(', 1)), 'Gemfile.lock'
  FROM ({_first('Gemfile.lock')}))
  GROUP BY repo_id, dep"""
_GODEPS = f"""SELECT DISTINCT repo_id, regexp_extract(x, '^\\S+') AS dep
  FROM (SELECT repo_id, trim(replace(l, chr(9), ' ')) AS x
  FROM (SELECT repo_id, {_LINES} AS l
  FROM ({_first('go.mod')})))
  WHERE x <> '' AND NOT regexp_matches(x, '^(?:module |go |//)')"""
_RSDEPS = f"""SELECT DISTINCT repo_id, trim(trim(split_part(x, '=', 1)), '"') AS dep FROM (SELECT *, last_value(CASE WHEN starts_with(x, '[') AND ends_with(x, ']') THEN CAST(contains(x, 'dependencies') AS INT) END IGNORE NULLS) OVER (PARTITION BY repo_id ORDER BY k) AS inside FROM (
  SELECT repo_id, trim(unnest(string_split(content, chr(10)))) AS x, generate_subscripts(string_split(content, chr(10)), 1) AS k FROM ({_first('Cargo.toml')}))) WHERE inside = 1 AND NOT (starts_with(x, '[') AND ends_with(x, ']')) AND contains(x, '=') AND NOT starts_with(x, '#')"""
_BLOB = "SELECT repo_id, string_agg(content, chr(10) ORDER BY k) AS blob FROM (" + " UNION ALL ".join(f"SELECT repo_id, content, {i} AS k FROM ({_first(n)})" for i, n in enumerate(("pom.xml", "build.gradle", "build.gradle.kts", "settings.gradle"))) + ") GROUP BY repo_id"
_PHPDEPS = f"""SELECT DISTINCT repo_id, unnest(json_keys(content, '$."' || s || '"')) AS dep
  FROM (SELECT *, unnest(['require', 'require-dev']) AS s
  FROM ({_first('composer.json')}))
  WHERE json_extract(content, '$."' || s || '"') IS NOT NULL"""
on_files("t5_python_deps", tech.python_deps, _PYDEPS)
on_files("t6_javascript_deps", tech.javascript_deps, _JSDEPS)
on_files("t6_javascript_scripts", tech.javascript_scripts, f"""SELECT repo_id, script, command
  FROM (SELECT *, json_extract_string(content, '$.scripts.' || script) AS command
  FROM (SELECT repo_id, content, unnest(json_keys(content, '$.scripts')) AS script
  FROM ({_first('package.json')})))
  WHERE command <> ''""")
on_files("t7_ruby_deps", tech.ruby_deps, _RBDEPS)
on_files("t8_go_deps", tech.go_deps, _GODEPS)
on_files("t9_rust_deps", tech.rust_deps, _RSDEPS)
on_files("t10_java_blob", tech.java_blob, _BLOB)
on_files("t11_php_deps", tech.php_deps, _PHPDEPS)
on_files("t12_first_content", lambda f: tech.first_content(f, "package-lock.json").select("repo_id", "content"), _first("package-lock.json"))
_ENTRIES = "entries(kind, name, category, key, rank, place) AS (VALUES " + ", ".join(f"('{k}', '{n}', '{c}', '{key}', {r}, {i})" for i, (k, n, c, keys) in enumerate(C.FRAMEWORKS) for r, key in enumerate(keys)) + ")"
_ALL_DEPS = f"""alldeps AS (SELECT repo_id, 'python' AS kind, dep, source
  FROM ({_PYDEPS})
  UNION ALL SELECT repo_id, 'javascript', dep, 'package.json'
  FROM ({_JSDEPS})
  UNION ALL SELECT repo_id, 'ruby', dep, source
  FROM ({_RBDEPS})
  UNION ALL SELECT repo_id, 'go', dep, 'go.mod'
  FROM ({_GODEPS})
  UNION ALL SELECT repo_id, 'rust', dep, 'Cargo.toml'
  FROM ({_RSDEPS})
  UNION ALL SELECT repo_id, 'java', blob, 'pom.xml/build.gradle'
  FROM ({_BLOB})
  UNION ALL SELECT repo_id, 'php', dep, 'composer.json'
  FROM ({_PHPDEPS}))"""
_MATCHED = f""", {_ENTRIES}, {_ALL_DEPS},
  matched AS (SELECT repo_id, e.name, e.category, CASE
  WHEN e.kind = 'java' THEN 0.85
  ELSE 0.9 END AS confidence, min({{'rank': e.rank, 'key': e.key, 'source': d.source}}) AS m, e.place
  FROM alldeps d
  JOIN entries e ON d.kind = e.kind AND CASE e.kind
  WHEN 'go' THEN starts_with(d.dep, e.key)
  WHEN 'java' THEN contains(d.dep, e.key)
  ELSE d.dep = e.key END
  GROUP BY repo_id, e.kind, e.name, e.category, e.place)"""
on_files("t13_match_frameworks", lambda f: tech.match_frameworks(tech.all_deps(f)).select("repo_id", "name", "category", "confidence", "evidence"), _MATCHED + " SELECT repo_id, name, category, CAST(confidence AS DOUBLE) AS confidence, '`' || m.key || '` in ' || m.source AS evidence FROM matched")
_MARKS = """marked AS (SELECT DISTINCT repo_id, u.name AS name, u.category AS category, CAST(u.confidence AS DOUBLE) AS confidence, u.evidence AS evidence, u.place AS place
  FROM (SELECT repo_id, unnest(list_filter([""" + ", ".join(f"CASE WHEN {cond} THEN {{'name': '{n}', 'category': '{c}', 'confidence': {p}, 'evidence': '{e}', 'place': {k}}} END" for n, c, p, e, cond, k in (
    ("Vite", "Tooling", 0.85, "vite.config.* present", "ends_with(path, 'vite.config.ts') OR ends_with(path, 'vite.config.js')", 100),
    ("Next.js", "Framework", 0.9, "next.config.* present", "ends_with(path, 'next.config.js') OR ends_with(path, 'next.config.mjs')", 101),
    ("Nuxt", "Framework", 0.9, "nuxt.config.* present", "ends_with(path, 'nuxt.config.ts') OR ends_with(path, 'nuxt.config.js')", 102),
    ("Angular", "Framework", 0.9, "angular.json present", "path = 'angular.json'", 103), ("Docker", "Runtime", 0.8, "Dockerfile present", "name = 'Dockerfile'", 900), ("Docker Compose", "Runtime", 0.7, "compose file present", "name IN ('docker-compose.yml', 'compose.yml')", 901))) + "], lambda x: x IS NOT NULL)) AS u FROM files))"
on_files("t14_marker_frameworks", lambda f: tech.marker_frameworks(f).drop("place"), f", {_MARKS} SELECT repo_id, name, category, confidence, evidence FROM marked")
_HOOKS = f"""hooked AS (SELECT repo_id, 'npm install hook' AS name, 'Tooling' AS category, CAST(0.6 AS DOUBLE) AS confidence, 'package.json scripts.' || h AS evidence, 103 + k AS place
  FROM (SELECT repo_id, content, unnest(['preinstall', 'install', 'postinstall', 'prepare']) AS h, unnest([1, 2, 3, 4]) AS k
  FROM ({_first('package.json')}))
  WHERE json_extract_string(content, '$.scripts.' || h) <> '')"""
on_files("t15_hook_signal", lambda f: tech.hook_signal(tech.javascript_scripts(f)).drop("place"), f", {_HOOKS} SELECT repo_id, name, category, confidence, evidence FROM hooked")
_N_EARLY = sum(k in ("python", "javascript") for k, *_ in C.FRAMEWORKS)
_FRAMEWORKS = f"""{_MATCHED}, {_MARKS}, {_HOOKS},
  signals AS (SELECT repo_id, name, category, CAST(confidence AS DOUBLE) AS confidence, '`' || m.key || '` in ' || m.source AS evidence, CASE
  WHEN place >= {_N_EARLY} THEN place + 200
  ELSE place END AS seen_at
  FROM matched
  UNION ALL SELECT *
  FROM marked
  UNION ALL SELECT *
  FROM hooked),
  frameworks AS (SELECT repo_id, name, arg_min(category, seen_at) AS category, max(confidence) AS confidence, string_agg(evidence, '|' ORDER BY seen_at) AS evidence
  FROM signals
  GROUP BY repo_id, name)"""


def _profile(f: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    return audits.technologies(f)


on_files("t16_detect_frameworks", lambda f: _profile(f)[1].withColumn("evidence", F.array_join("evidence", "|")), _FRAMEWORKS + " SELECT repo_id, name, category, confidence, evidence, row_number() OVER (PARTITION BY repo_id ORDER BY confidence DESC, name) AS place FROM frameworks")
_FILE_LANGS = """,
  langs AS (SELECT repo_id, list(lang) AS lg
  FROM (SELECT repo_id, lang, least(0.99, round_even(n / greatest(1, max(n) OVER (PARTITION BY repo_id)), 2)) AS c
  FROM counts)
  WHERE c >= 0.05
  GROUP BY repo_id)"""
on_files("t17_project_type", lambda f: _profile(f)[2], _FRAMEWORKS + _COUNTS + _FILE_LANGS + f"""
, p AS (SELECT f.*, coalesce(fw, []) AS fw, coalesce(lg, []) AS lg FROM (SELECT repo_id, bool_or(ends_with(path, '.tf')) AS tf, bool_or(name = 'Chart.yaml') AS helm, bool_or(ends_with(path, '.ipynb')) AS nb, bool_or(name IN ('pyproject.toml', 'setup.py')) AS py, bool_or(name = 'package.json') AS npm, bool_or(name = 'Dockerfile') AS docker FROM files GROUP BY repo_id) f
  LEFT JOIN (SELECT repo_id, list(name) AS fw FROM frameworks GROUP BY repo_id) USING (repo_id) LEFT JOIN langs USING (repo_id)),
q AS (SELECT *, list_has_any(fw, [{_list(C.FRONTEND)}]) AS front, list_has_any(fw, [{_list(C.BACKEND)}]) AS back FROM p)
SELECT repo_id, CASE WHEN tf OR helm THEN 'Infrastructure/devops repo' WHEN nb AND list_contains(lg, 'Python') THEN 'Data science notebook repo' WHEN front AND back THEN 'Fullstack app' WHEN front THEN 'Frontend app' WHEN back THEN 'Backend API'
  WHEN list_has_any(fw, ['Typer', 'Click']) THEN 'CLI tool' WHEN list_contains(fw, 'Clap') AND list_contains(lg, 'Rust') THEN 'CLI tool' WHEN list_contains(fw, 'Cobra') AND list_contains(lg, 'Go') THEN 'CLI tool' WHEN py THEN 'Library/package' WHEN npm AND list_contains(fw, 'Electron') THEN 'Desktop app' WHEN docker THEN 'Dockerized service'
  WHEN list_has_any(lg, ['Swift', 'Kotlin', 'Dart']) THEN 'Mobile app' ELSE 'Unknown' END AS project_type FROM q""")

# --- health ----------------------------------------------------------------------------------------------------------

_LICENSE = "CASE " + " ".join(f"WHEN regexp_matches(head, '(?i){p.replace(chr(39), chr(39) * 2)}') THEN '{n}'" for n, p in C.LICENSES) + " ELSE 'Detected' END"
on_files("h1_detect_license", health.detect_license, f"""SELECT repo_id, {_LICENSE} AS license
  FROM (SELECT repo_id, substr(arg_min(content, file_pos), 1, 4096) AS head
  FROM files
  WHERE NOT contains(path, '/') AND lower(path) IN ({_list(C.LICENSE_NAMES)})
  GROUP BY repo_id)""")
add("h2_days_since", lambda s, d: T.repos(s, d).select("repo_id", health.days_since(F.col("pushed_at"), as_of()).alias("days")), f"WITH {T.REPOS_SQL} SELECT repo_id, days FROM repos")
_MN = f"""WITH {T.REPOS_SQL},
  mn AS (SELECT repo_id, u.*
  FROM (SELECT repo_id, unnest(list_filter([CASE
  WHEN archived THEN {{'rule_id': 'MN001', 'severity': 'medium', 'lost': 15}} END, CASE
  WHEN license IS NULL THEN {{'rule_id': 'MN002', 'severity': 'medium', 'lost': 15}} END, CASE
  WHEN days > 365 THEN {{'rule_id': 'MN003', 'severity': 'medium', 'lost': 15}}
  WHEN days > 180 THEN {{'rule_id': 'MN004', 'severity': 'low', 'lost': 5}} END, CASE
  WHEN open_issues > 500 THEN {{'rule_id': 'MN005', 'severity': 'low', 'lost': 5}} END], lambda x: x IS NOT NULL)) AS u
  FROM repos))"""
add("h3_maintenance_findings", lambda s, d: health.maintenance_findings(T.repos(s, d), as_of()).select("repo_id", "rule_id", "severity"), _MN + " SELECT repo_id, rule_id, severity FROM mn")
_MAINT = "CAST(least(100, greatest(0, 100 - coalesce(lost, 0) + CASE WHEN days IS NULL THEN -5 WHEN days < 30 THEN 5 ELSE 0 END)) AS INT)"
add("h4_maintenance_score", lambda s, d: health.maintenance_score(T.repos(s, d), health.maintenance_findings(T.repos(s, d), as_of()), as_of()), _MN + f" SELECT repo_id, {_MAINT} AS maintenance FROM repos LEFT JOIN (SELECT repo_id, sum(lost) AS lost FROM mn GROUP BY repo_id) USING (repo_id)")
_POP = "CASE WHEN kind <> 'local' THEN CAST(CASE WHEN stars = 0 AND forks = 0 THEN 25 ELSE least(100, greatest(0, CAST(trunc(log10(stars + forks + 1) * 20) AS INT) + 25)) END AS INT) END"
add("h5_popularity_score", lambda s, d: health.popularity_score(T.repos(s, d)), f"WITH {T.REPOS_SQL} SELECT repo_id, {_POP} AS popularity FROM repos")
_DOC_POINTS = " + ".join(
    [f"CASE WHEN bool_or(NOT contains(path, '/') AND lower(path) IN ({_list(n)})) THEN {p} ELSE 0 END" for _, n, p in C.DOCUMENTS]
    + [f"CASE WHEN bool_or(contains(path, '/') AND split_part(lower(path), '/', 1) IN ({_list(n)})) THEN {p} ELSE 0 END" for n, p in C.DOCUMENT_DIRS]
)
_DOC = f""", docs AS (
  SELECT repo_id, CAST(least(100, {_DOC_POINTS}) AS INT) AS documentation,
    bool_or(NOT contains(path, '/') AND lower(path) IN ({_list(C.DOCUMENTS[0][1])})) AS has_readme, bool_or(path = 'SECURITY.md') AS has_security_policy
  FROM files GROUP BY repo_id)"""
on_files("h6_documentation_score", health.documentation_score, _DOC + " SELECT * FROM docs")
on_files("h6_documentation_findings", lambda f: health.documentation_findings(health.documentation_score(f)).select("repo_id", "rule_id", "severity"), _DOC + " SELECT repo_id, 'DOC001' AS rule_id, 'medium' AS severity FROM docs WHERE NOT has_readme UNION ALL SELECT repo_id, 'DOC002', 'low' FROM docs WHERE NOT has_security_policy")
_SIGNALS = f""",
  signals AS (SELECT repo_id, count(*) AS file_count, bool_or(starts_with(path, 'tests/') OR starts_with(path, 'test/') OR starts_with(path, 'spec/') OR contains(path, '/tests/') OR contains(path, '/test/')) AS has_tests, bool_or(starts_with(path, '{C.ACTIONS_PREFIX}')) AS has_ci, bool_or(name IN ({_list(m[0] for m in C.MANIFESTS)})) AS has_manifest
  FROM files
  GROUP BY repo_id)"""
on_files("h7_structure_signals", health.structure_signals, _SIGNALS + " SELECT * FROM signals")
_STRUCT = """CAST(least(100, 40 + CASE
  WHEN file_count >= 5 THEN 15
  ELSE 0 END + CASE
  WHEN file_count >= 20 THEN 10
  ELSE 0 END + CASE
  WHEN has_manifest THEN 15
  ELSE 0 END + CASE
  WHEN has_tests THEN 10
  ELSE 0 END + CASE
  WHEN has_ci THEN 10
  ELSE 0 END) AS INT)"""
on_files("h8_structure_score", lambda f: health.structure_score(health.structure_signals(f)), _SIGNALS + f" SELECT repo_id, {_STRUCT} AS structure FROM signals")


def _coverage_inputs(files: DataFrame) -> DataFrame:
    n = F.count("*")
    return files.groupBy("repo_id").agg((n + F.expr("count(*) % 3") * 2).alias("intended"), (n > 55).alias("cap_reached"), F.lit(False).alias("deep"), F.when(n % 2 == 0, n).alias("source_files_in_repo"))


_COV = f""", i AS (
  SELECT repo_id, count(*) AS loaded, count(*) + count(*) % 3 * 2 AS wanted, count(*) > 55 AS cap_reached, FALSE AS deep, CASE WHEN count(*) % 2 = 0 THEN count(*) END AS in_repo,
    count(*) FILTER (content IS NOT NULL AND NOT is_binary AND NOT truncated) AS analyzed, count(*) FILTER (is_binary) AS skipped_binary, count(*) FILTER (truncated) AS skipped_large,
    count(*) FILTER (content IS NOT NULL AND suffix IN ({_list(C.SOURCE_EXTENSIONS)})) AS source_files_inspected
  FROM files GROUP BY repo_id),
cov AS (
  SELECT repo_id, greatest(wanted, loaded) AS intended, analyzed, skipped_binary, skipped_large, greatest(0, wanted - loaded) AS not_inspected, cap_reached, deep,
    greatest(coalesce(in_repo, source_files_inspected), source_files_inspected) AS source_files_in_repo, source_files_inspected, cap_reached OR wanted > loaded AS is_partial,
    greatest(coalesce(in_repo, source_files_inspected), source_files_inspected) > 0 AND source_files_inspected = 0 AS source_uncovered
  FROM i)"""
on_files("h9_coverage", lambda f: health.coverage(f, _coverage_inputs(f)), _COV + " SELECT * FROM cov")
on_files("h10_coverage_findings", lambda f: health.coverage_findings(health.coverage(f, _coverage_inputs(f))).select("repo_id", "rule_id", "severity", "description"),
    _COV + """ SELECT repo_id, 'COV001' AS rule_id, 'low' AS severity, not_inspected || ' file(s) were not read.' AS description
  FROM cov
  WHERE is_partial
  UNION ALL SELECT repo_id, 'COV002', 'low', skipped_large || ' file(s) are over the size limit.'
  FROM cov
  WHERE skipped_large > 0
  UNION ALL SELECT repo_id, 'COV003', 'medium', source_files_in_repo || ' source file(s) were not read.'
  FROM cov
  WHERE source_uncovered""")  # fmt: skip

# --- scoring ---------------------------------------------------------------------------------------------------------

_PEN = "CASE category WHEN 'code_pattern' THEN [0, 1, 3, 6, 10][sev + 1] WHEN 'dependency' THEN [0, 3, 8, 15, 25][sev + 1] ELSE [0, 5, 12, 22, 40][sev + 1] END"
_SECURITY = f""",
  ranked AS (SELECT repo_id, {_PEN} AS pen, row_number() OVER (PARTITION BY repo_id, category ORDER BY sev DESC) AS k
  FROM findings
  WHERE category NOT IN ({_list(C.NOT_SECURITY)})),
  security AS (SELECT f.repo_id, CAST(least(100, greatest(0, round_even(100 - coalesce(lost, 0), 0))) AS INT) AS security
  FROM (SELECT DISTINCT repo_id
  FROM findings) f
  LEFT
  JOIN (SELECT repo_id, sum(pen * CASE
  WHEN k <= 2 THEN 1
  WHEN k <= 5 THEN 0.5
  ELSE 0.25 END) AS lost
  FROM ranked
  GROUP BY repo_id) l ON f.repo_id = l.repo_id)"""
on_findings("g1_security_score", scoring.security_score, _SECURITY + " SELECT * FROM security")


def _by_user(f: DataFrame) -> DataFrame:
    return f.withColumn("repo_id", F.substring_index("repo_id", "@", 1))



def _breakdown(s: SparkSession, d: str) -> DataFrame:
    repos = T.repos(s, d)
    out = repos.select("repo_id", (F.col("stars") % 101).cast("int").alias("security")).join(health.maintenance_score(repos, health.maintenance_findings(repos, as_of()), as_of()), "repo_id").join(health.popularity_score(repos), "repo_id")
    return out.withColumn("documentation", (F.col("repo_id").cast("long") % 97).cast("int")).withColumn("structure", (F.col("repo_id").cast("long") % 61 + 40).cast("int"))


_BREAKDOWN = _MN + f""",
  breakdown AS (SELECT repo_id, CAST(stars % 101 AS INT) AS security, {_MAINT} AS maintenance, {_POP} AS popularity, CAST(CAST(repo_id AS BIGINT) % 97 AS INT) AS documentation, CAST(CAST(repo_id AS BIGINT) % 61 + 40 AS INT) AS structure
  FROM repos
  LEFT
  JOIN (SELECT repo_id, sum(lost) AS lost
  FROM mn
  GROUP BY repo_id) USING (repo_id)),
  trusted AS (SELECT *, CAST(round_even((35 * security + 25 * maintenance + 20 * documentation + 10 * coalesce(popularity, 0) + 10 * structure) / (90 + CASE
  WHEN popularity IS NULL THEN 0
  ELSE 10 END), 0) AS INT) AS trust
  FROM breakdown)"""
add("g2_trust_score", lambda s, d: scoring.trust_score(_breakdown(s, d)).select("repo_id", "trust"), _BREAKDOWN + " SELECT repo_id, trust FROM trusted")


def _risk(s: SparkSession, d: str) -> DataFrame:
    """Each user's day over all its findings, with the trust of the user."""
    findings, trust = T.findings(s, d), scoring.trust_score(_breakdown(s, d)).select(F.col("repo_id").alias("user"), "trust")
    days = findings.select("repo_id", F.substring_index("repo_id", "@", 1).alias("user")).distinct()
    return scoring.risk_level(days.join(trust, "user").select("repo_id", "trust"), findings)


_DAYS = f", {T.FINDINGS_SQL}, days AS (SELECT repo_id, bool_or(severity = 'critical') AS critical, bool_or(sev >= 3 AND category IN ('secret', 'install_hook')) AS grave FROM findings GROUP BY repo_id)"
add("g3_risk_level", _risk, _BREAKDOWN + _DAYS + """
SELECT days.repo_id, CASE WHEN critical THEN 'Critical' WHEN grave OR trust < 45 THEN 'High' WHEN trust < 65 THEN 'Medium' ELSE 'Low' END AS risk
FROM days JOIN trusted t ON t.repo_id = split_part(days.repo_id, '@', 1)""")
_ALL_FLAGS = """,
  flags AS (SELECT CAST(user_id AS VARCHAR) AS repo_id, bool_or(event_type = 'purchase') AS critical, bool_or(event_type IN ('error', 'purchase') AND event_id % 6 < 2) AS grave
  FROM events
  GROUP BY 1)"""
add("g3_risk_level_all", lambda s, d: scoring.risk_level(scoring.trust_score(_breakdown(s, d)).select("repo_id", "trust"), _by_user(T.findings(s, d))),
    _BREAKDOWN + _ALL_FLAGS + """ SELECT t.repo_id, CASE
  WHEN coalesce(critical, FALSE) THEN 'Critical'
  WHEN coalesce(grave, FALSE) OR trust < 45 THEN 'High'
  WHEN trust < 65 THEN 'Medium'
  ELSE 'Low' END AS risk
  FROM trusted t
  LEFT
  JOIN flags f USING (repo_id)""")  # fmt: skip
_REC = [
    ("n_critical > 0", "Treat this repository as untrusted until its critical findings are resolved."), ("n_high > 0", "Inspect every HIGH finding before installing or building."), ("security < 60", "Review scripts and install hooks before running anything."),
    ("documentation < 50", "Ask the maintainer for setup and security guidance: documentation is thin."), ("maintenance < 50", "Maintenance is weak; consider a maintained fork or another project."),
]
add("g4_recommendations", lambda s, d: scoring.recommendations(_breakdown(s, d).withColumn("n_critical", F.col("security") % 3).withColumn("n_high", F.col("security") % 2)).withColumn("recommendations", F.array_join("recommendations", "|")),
    _BREAKDOWN + " SELECT repo_id, coalesce(nullif(array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{t}' END" for c, t in _REC) + """], lambda x: x IS NOT NULL), '|'), ''), 'No major issues found. Still review the code before granting privileges.') AS recommendations
  FROM (SELECT *, security % 3 AS n_critical, security % 2 AS n_high
  FROM breakdown)""")  # fmt: skip


def _verdicts(s: SparkSession, d: str) -> DataFrame:
    k = F.col("repo_id").cast("long")
    rows = T.repos(s, d).select(
        "repo_id", "url", "name", "archived", F.when(k % 4 == 0, "Unknown").otherwise("CLI tool").alias("project_type"), F.when(k % 6 > 0, "Go").alias("primary_language"), (k % 3).alias("n_critical"), (k % 2).alias("n_high"), (k % 5).alias("n_findings"),
        F.when(k % 3 == 0, F.array(F.lit("Gin"), F.lit("Fiber"), F.lit("Cobra"), F.lit("Tokio"))).otherwise(F.expr("cast(array() AS array<string>)")).alias("frameworks"), F.when(k % 2 == 0, F.array(F.lit("Rust"), F.lit("Go"))).alias("ecosystems"),
    )
    return scoring.verdict(rows)


def _say(part: str, *values: str) -> str:
    """A sentence of the verdict as SQL, with expressions in its places."""
    return f"printf({_list([C.VERDICT[part]])}{''.join(', ' + v for v in values)})"


add("g5_verdict", _verdicts, f"""
WITH {T.REPOS_SQL}, v AS (SELECT *, CAST(repo_id AS BIGINT) AS k FROM repos)
SELECT repo_id, concat_ws(' ',
  {_say("first", "coalesce(url, name)", f"CASE WHEN k % 4 = 0 THEN {_say('no_type')} ELSE 'CLI tool' END", f"CASE WHEN k % 6 > 0 THEN 'Go' ELSE {_say('no_language')} END",
        f"CASE WHEN k % 3 = 0 THEN {_say('using', _list(['Gin, Fiber, Cobra']))} ELSE '' END")},
  CASE WHEN archived THEN {_say("archived")} END,
  CASE WHEN k % 5 = 0 THEN {_say("none")} WHEN k % 3 > 0 OR k % 2 > 0 THEN {_say("grave", "k % 3", "k % 2")} ELSE {_say("low")} END,
  CASE WHEN k % 2 = 0 THEN {_say("manifests", _list(["Go, Rust"]))} END) AS verdict FROM v""")  # fmt: skip
on_findings("g6_gate", lambda f: scoring.gate(f, "medium"), f"SELECT repo_id, ['info', 'low', 'medium', 'high', 'critical'][max(CASE WHEN category IN ({_list(C.GATED)}) AND sev >= 2 THEN sev END) + 1] AS worst FROM findings GROUP BY repo_id")
on_findings("g7_sort_findings", lambda f: scoring.sort_findings(f).select("repo_id", "finding_pos", "place"), "SELECT repo_id, finding_pos, row_number() OVER (PARTITION BY repo_id ORDER BY sev DESC, rule_id, coalesce(file_path, ''), coalesce(line_number, 0), finding_pos) AS place FROM findings")
on_findings("g8_severity_counts", scoring.severity_counts, "SELECT repo_id, count(*) FILTER (severity = 'critical') AS n_critical, count(*) FILTER (severity = 'high') AS n_high, count(*) AS n_findings FROM findings GROUP BY repo_id")
_LEVELS, _SEVS = "['note', 'note', 'warning', 'error', 'error'][sev + 1]", "['0.0', '2.0', '5.0', '8.0', '9.5'][sev + 1]"
_DESCRIPTORS = f""",
  d AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY finding_pos) - 1 AS rule_index
  FROM (SELECT *
  FROM findings
  QUALIFY row_number() OVER (PARTITION BY repo_id, rule_id ORDER BY finding_pos) = 1))"""
on_findings("g9_rule_descriptors", scoring.rule_descriptors, _DESCRIPTORS + f" SELECT repo_id, rule_id, rule_index, title, split_part(description, chr(10), 1) AS full_description, recommendation AS help_text, {_LEVELS} AS level, category, {_SEVS} AS security_severity FROM d")
on_findings("g10_sarif_results", scoring.sarif_results, _DESCRIPTORS + f""" SELECT f.repo_id, f.finding_pos, f.rule_id, d.rule_index, {_LEVELS.replace('sev', 'f.sev')} AS level, split_part(f.description, chr(10), 1) AS message, f.severity, f.category, f.file_path AS uri, CASE
  WHEN f.file_path IS NOT NULL THEN greatest(1, coalesce(f.line_number, 1)) END AS start_line, f.rule_id || ':' || coalesce(f.file_path, '') || ':' || coalesce(f.line_number, 0) AS fingerprint
  FROM findings f
  JOIN d ON f.repo_id = d.repo_id AND f.rule_id = d.rule_id""")
add("g11_effective_weights", lambda s, d: scoring.effective_weights(_breakdown(s, d)), _BREAKDOWN + """ SELECT repo_id, u.area AS area, u.score AS score, CASE
  WHEN u.score IS NOT NULL THEN CAST(round_even(100.0 * u.w / (90 + CASE
  WHEN popularity IS NULL THEN 0
  ELSE 10 END), 0) AS INT) END AS weight
  FROM (SELECT repo_id, popularity, unnest([""" + ", ".join(f"{{'area': '{a}', 'score': {a}, 'w': {w}}}" for a, w in C.WEIGHTS) + "]) AS u FROM breakdown)")


# --- the whole audit, sinks and sources ------------------------------------------------------------------------------


def fleet(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files of the fleet, its repositories and what was meant to be read of them."""
    files = T.files(s, d)
    ids = T.table(s, d, "documents").select("source", F.expr(f"doc_id div 20 div {len(T.SLOTS)}").alias("g")).distinct()
    k = F.xxhash64("source", "g")
    repos = ids.select(
        F.concat("source", F.lit("/"), F.col("g").cast("string")).alias("repo_id"), F.col("source").alias("name"), F.lit("fleet").alias("owner"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("description"), F.lit("main").alias("default_branch"),
        F.pmod(k, F.lit(5000)).alias("stars"), F.pmod(k, F.lit(70)).alias("forks"), F.lit(None).cast("long").alias("watchers"), F.pmod(k, F.lit(900)).alias("open_issues"), F.lit(None).cast("string").alias("license"), (F.pmod(k, F.lit(9)) == 0).alias("archived"),
        F.lit("2001-06-01 00:00:00").alias("pushed_at"), F.when(F.pmod(k, F.lit(2)) == 0, "local").otherwise("github").alias("kind"),
    )
    return files, repos, _coverage_inputs(files)


def _audit(s: SparkSession, d: str) -> DataFrame:
    files, repos, inputs = fleet(s, d)
    return audits.audit(files, repos, inputs, as_of(), advisories=T.advisories(s, d), advisory_details=T.advisory_details(s, d))


def secret_risk(s: SparkSession, d: str) -> DataFrame:
    """Which repositories leak secrets, and how risky are they?"""
    found = scan.dedupe_findings(scan.rule_findings(T.files(s, d), C.pack("SEC")).withColumn("finding_pos", F.col("file_pos") * F.lit(1 << 24) + F.col("match_pos")))
    return scoring.severity_counts(found).join(scoring.security_score(found), "repo_id")


add("flagship_secret_risk", secret_risk)
add("g12_audit", lambda s, d: _audit(s, d).select("repo_id", "trust_score", "risk_level", "project_type", F.size("findings").alias("n_findings"), "verdict"))
add("s5_json_report", lambda s, d: reports.to_json_report(_audit(s, d)))
_RESULT_ROWS = SQL["g10_sarif_results"].split(_DESCRIPTORS)[1]
_SARIF_SQL = _DESCRIPTORS + rf"""
, r AS ({_RESULT_ROWS}),
by_rule AS (SELECT repo_id, string_agg('{{"id":' || to_json(rule_id) || ',"name":' || to_json(title) || ',"shortDescription":{{"text":' || to_json(title) || '}},"fullDescription":{{"text":' || to_json(split_part(description, chr(10), 1))
  || '}},"helpText":' || to_json(recommendation) || ',"defaultConfiguration":{{"level":' || to_json({_LEVELS}) || '}},"properties":{{"category":' || to_json(category) || ',"security-severity":' || to_json({_SEVS}) || '}}}}', ',' ORDER BY rule_index) AS rules
  FROM d GROUP BY repo_id),
by_result AS (SELECT repo_id, string_agg('{{"ruleId":' || to_json(rule_id) || ',"ruleIndex":' || rule_index || ',"level":' || to_json(level) || ',"message":{{"text":' || to_json(message) || '}},"properties":{{"severity":' || to_json(severity)
  || ',"category":' || to_json(category) || '}}' || CASE WHEN start_line IS NOT NULL THEN ',"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":' || to_json(uri) || '}},"region":{{"startLine":' || start_line || '}}}}}}]' ELSE '' END
  || ',"partialFingerprints":{{"{reports.TOOL}/v1":' || to_json(fingerprint) || '}}}}', ',' ORDER BY finding_pos) AS results FROM r GROUP BY repo_id)
SELECT repo_id, '{{"$schema":"{reports.SARIF_SCHEMA}","version":"2.1.0","runs":[{{"tool":{{"driver":{{"name":"{reports.TOOL}","rules":[' || rules || ']}}}},"results":[' || results || ']}}]}}' AS report
FROM by_rule JOIN by_result USING (repo_id)"""
on_findings("s6_sarif_report", lambda f: reports.to_sarif(f, None), _SARIF_SQL)
# pages of three findings; the second engine places them by a window
_PLACE = "row_number() OVER (PARTITION BY repo_id ORDER BY sev DESC, rule_id, coalesce(file_path, ''), coalesce(line_number, 0), finding_pos)"
_PAGED_SQL = f"WITH {T.FINDINGS_SQL.replace('findings AS', 'all_findings AS', 1)}, placed AS (SELECT *, {_PLACE} AS place FROM all_findings)"
add("s6_sarif_pages", lambda s, d: reports.to_sarif_pages(T.findings(s, d), 3), f"""
SELECT split_part(repo_id, '#', 1) AS repo_id, CAST(split_part(repo_id, '#', 2) AS INT) AS part, report FROM (
{_PAGED_SQL}, findings AS (SELECT * REPLACE (repo_id || '#' || lpad(CAST((place - 1) // 3 AS VARCHAR), 10, '0') AS repo_id) FROM placed){_SARIF_SQL})""")
add("s5_json_pages", lambda s, d: reports.to_json_pages(T.findings(s, d), 3), f"""{_PAGED_SQL}
SELECT repo_id, CAST((place - 1) // 3 AS INT) AS part, to_json({{'repo_id': repo_id, 'part': CAST((place - 1) // 3 AS INT), 'findings': list({{'rule_id': rule_id, 'title': title, 'severity': severity, 'file_path': file_path,
  'line_number': line_number, 'description': description, 'recommendation': recommendation, 'category': category}} ORDER BY place)}})::VARCHAR AS report FROM placed GROUP BY repo_id, (place - 1) // 3""")
add("s7_markdown_report", lambda s, d: reports.to_markdown(_audit(s, d)))


def _raw_repos(s: SparkSession, d: str) -> DataFrame:
    r, k = T.repos(s, d), F.col("repo_id").cast("long")
    raw = F.struct(
        F.col("name"), F.struct(F.col("kind").alias("login")).alias("owner"), F.col("url").alias("html_url"), F.col("stars").alias("stargazers_count"),
        F.col("forks").alias("forks_count"), (k % 3).alias("subscribers_count"), F.col("stars").alias("watchers_count"), F.col("open_issues").alias("open_issues_count"),
        F.when(k % 5 > 0, F.struct(F.col("license").alias("spdx_id"))).alias("license"), "archived", "pushed_at",
    )
    return r.select("repo_id", F.to_json(raw).alias("json"))


add("s3_normalize_metadata", lambda s, d: snapshots.normalize_metadata(_raw_repos(s, d)).select("repo_id", "name", "owner", "url", "stars", "forks", "watchers", "open_issues", "license", "archived"),
    f"""WITH {T.REPOS_SQL} SELECT repo_id, name, kind AS owner, url, stars, forks, CASE
  WHEN CAST(repo_id AS BIGINT) % 3 = 0 THEN stars
  ELSE CAST(repo_id AS BIGINT) % 3 END AS watchers, open_issues, license, archived
  FROM repos""")  # fmt: skip


def _trees(s: SparkSession, d: str) -> DataFrame:
    entry = F.struct("path", F.when(F.col("is_binary"), "tree").otherwise("blob").alias("type"), "size")
    return T.files(s, d).groupBy("repo_id").agg(F.to_json(F.struct(F.collect_list(entry).alias("tree"))).alias("json"))


add("s4_tree_paths", lambda s, d: snapshots.tree_paths(_trees(s, d)), f"WITH {T.FILES_SQL} SELECT repo_id, path, size FROM files WHERE NOT is_binary")


def _packed(files: DataFrame) -> DataFrame:
    """(repo_id, content): an archive of each repository's texts."""
    import io
    import tarfile

    import pandas as pd

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        buffer = io.BytesIO()
        with tarfile.open(fileobj=buffer, mode="w:gz") as tar:
            for path, content in zip(rows["path"], rows["content"]):
                data = (content or "").encode()
                info = tarfile.TarInfo(f"root/{path}")
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
        return pd.DataFrame({"repo_id": [key[0]], "content": [buffer.getvalue()]})

    return files.select("repo_id", "file_pos", "path", "content").groupBy("repo_id").applyInPandas(pack, "repo_id string, content binary")


def _write_files(rows: DataFrame, root: str) -> None:
    """Writes each row's ``bytes`` to the file ``at`` under ``root``, from the tasks and through the storage that ``root`` names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        n, made = 0, set()
        for batch in batches:
            for at, data in zip(batch.column("at").to_pylist(), batch.column("bytes").to_pylist()):
                folder, _, _ = f"{base}/{at}".rpartition("/")
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                with store.open_output_stream(f"{base}/{at}", compression=None) as out:
                    out.write(data)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    rows.select("at", "bytes").mapInArrow(run, "n long").agg(F.sum("n")).collect()


def _folder(s: SparkSession, name: str) -> str:
    shared = shared_folder(s)
    return f"{shared if ':' in shared.split('/')[0] else 'file://' + shared}/{name}-{uuid.uuid4().hex}"


_MEMBERS = ("repo_id", "path", "size", "is_binary", "truncated")


def _archives(s: SparkSession, d: str) -> DataFrame:
    """The fleet's files packed as one archive per repository in a table, then read from there."""
    return snapshots.read_archives(_packed(T.files(s, d)), max_files=None).select(*_MEMBERS, F.length("content").alias("n_chars"))


def _archive_files(s: SparkSession, d: str) -> DataFrame:
    """The same archives as files in the shared folder, streamed by the data source with a bound on the files of a repository."""
    root = _folder(s, "archives")
    _write_files(_packed(T.files(s, d)).select(F.concat(F.regexp_replace("repo_id", "/", "-"), F.lit(".tar.gz")).alias("at"), F.col("content").alias("bytes")), root)
    found = snapshots.load_archives(s, f"{root}/*.tar.gz", max_files=30)
    return found.groupBy("repo_id", "beyond_cap").agg(F.count("*").alias("n_files"), F.sum("size").alias("n_bytes"), F.max("file_pos").alias("last"), F.count_if("is_binary").alias("n_binary"), F.sum(F.length("content")).alias("n_chars"))


_ARCHIVED = f"""
WITH {T.FILES_SQL}, kept AS (SELECT *, coalesce(content, '') AS body, suffix IN ({_list(C.BINARY_EXTENSIONS)}) AS binary_name FROM files
  WHERE NOT list_has_any(list_slice(string_split(path, '/'), 1, -2), [{_list(C.SKIP_DIRECTORIES)}]))"""
add("s2_read_archives", _archives, f"""{_ARCHIVED}
SELECT repo_id, path, CAST(strlen(body) AS BIGINT) AS size, binary_name AS is_binary, FALSE AS truncated, CASE WHEN NOT binary_name THEN length(body) END AS n_chars FROM kept""")
# members stand in an archive in no order that a second engine could know, so only counts of those within the bound are compared
add("s2_load_archives", lambda s, d: _archive_files(s, d).groupBy("repo_id").agg(F.sum("n_files").alias("n_files"), F.sum("n_bytes").alias("n_bytes"), F.max(F.when(~F.col("beyond_cap"), F.col("n_files"))).alias("within"), F.max("last").alias("last")),
    f"""{_ARCHIVED}
SELECT replace(repo_id, '/', '-') AS repo_id, count(*) AS n_files, CAST(sum(strlen(body)) AS BIGINT) AS n_bytes, least(30, count(*)) AS within, count(*) - 1 AS last FROM kept GROUP BY 1""")  # fmt: skip


def _snapshots(s: SparkSession, d: str) -> DataFrame:
    """Every file of the fleet written into a folder of checked-out repositories, some with a NUL in front and some oversize, then read by the snapshot source.

    A path that comes twice in a repository is one file, with the least of its contents.
    """
    front, big = F.when(F.col("file_pos") % 9 == 0, F.lit(b"\x00")).otherwise(F.lit(b"")), F.lit("x" * 300_000)
    body = F.when(F.col("truncated"), big).otherwise(F.coalesce("content", F.lit("")))
    files = T.files(s, d).select(F.concat(F.regexp_replace("repo_id", "/", "-"), F.lit("/"), "path").alias("at"), front.alias("front"), body.alias("body"))
    root = _folder(s, "snapshots")
    _write_files(files.groupBy("at").agg(F.min(F.struct("front", "body")).alias("f")).select("at", F.concat("f.front", F.col("f.body").cast("binary")).alias("bytes")), root)
    return snapshots.read_snapshots(s, root, "*").select("repo_id", "file_pos", *_MEMBERS[1:], F.length("content").alias("n_chars"))


add("s1_read_snapshots", _snapshots, f"""
WITH {T.FILES_SQL}, one AS (SELECT replace(repo_id, '/', '-') AS repo_id, path, any_value(suffix) AS suffix,
  min({{'front': CASE file_pos % 9 WHEN 0 THEN 1 ELSE 0 END, 'body': CASE WHEN truncated THEN repeat('x', 300000) ELSE coalesce(content, '') END}}) AS f FROM files GROUP BY ALL),
kept AS (SELECT repo_id, path, f.front + strlen(f.body) AS size, suffix IN ({_list(C.BINARY_EXTENSIONS)}) OR f.front = 1 AS looks_binary, length(f.body) AS n_chars,
  list_transform(string_split(path, '/'), lambda p, i: CASE WHEN i = len(string_split(path, '/')) THEN '0' ELSE '1' END || p) AS walk
  FROM one WHERE NOT list_has_any(list_slice(string_split(path, '/'), 1, -2), [{_list(C.SKIP_DIRECTORIES)}]))
SELECT repo_id, row_number() OVER (PARTITION BY repo_id ORDER BY walk) - 1 AS file_pos, path, CAST(size AS BIGINT) AS size, looks_binary AND size <= 200000 AS is_binary, size > 200000 AS truncated,
  CASE WHEN size <= 200000 AND NOT looks_binary THEN n_chars END AS n_chars FROM kept""")
