"""Text helpers as column expressions: paths, lines, globs, redaction, severities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..catalogs import LOW_TRUST_DIR, LOW_TRUST_FILE, SEVERITIES, SOURCE_EXTENSIONS

#: where a line ends: the breaks that Python's splitlines knows
BREAK = r"(?:\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029])"


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def strip(column: str | Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(column, r"(?U)\A\s+|\s+\z", "")


def basename(path: str = "path") -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: str = "path") -> Column:
    """Lower-case last suffix with its dot; none for dot-files and trailing dots."""
    return F.lower(F.regexp_extract(basename(path), r"^(?s:.+)(\.[^.]+)$", 1))


def lines(content: str) -> Column:
    """The lines of a text without their ends; a final break opens no line."""
    parts = F.split(content, BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def glob_pattern(glob: str) -> str:
    """A regular expression for a shell glob on the whole path; the star crosses slashes."""
    out = "".join("(?s:.*)" if c == "*" else "(?s:.)" if c == "?" else ("\\" + c if not (c.isalnum() or c in "_/-") else c) for c in glob)
    return f"\\A{out}\\z"


def matches_globs(path: str, globs: tuple[str, ...]) -> Column:
    if not globs:
        return F.lit(True)
    return F.col(path).rlike("|".join(f"(?:{glob_pattern(g)})" for g in globs))


def is_low_trust(path: str = "path") -> Column:
    return F.coalesce(F.col(path).rlike("(?i)" + LOW_TRUST_DIR) | F.col(path).rlike("(?i)" + LOW_TRUST_FILE), F.lit(False))


def is_source(path: str = "path") -> Column:
    return suffix(path).isin(*SOURCE_EXTENSIONS)


def redact(column: str, keep: int = 4) -> Column:
    """The first ``keep`` characters and at least eight stars; only stars for texts no longer than that."""
    n = F.length(column)
    stars = F.repeat(F.lit("*"), F.greatest(F.lit(8), n - keep))
    return F.when(n <= keep, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.substring(column, 1, keep), stars))


def severity_rank(column: str = "severity") -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col(column)).cast("int") - 1


def first_line(column: str) -> Column:
    return F.coalesce(F.element_at(F.split(column, BREAK, -1), 1), F.lit(""))
