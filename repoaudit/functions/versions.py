"""Version texts as sort keys: ``key(a) < key(b)`` by bytes wherever version a comes before b in its ecosystem, so ranges become plain comparisons.

A number is written as its length and its digits; what may follow is marked by characters that sort as the parts they announce. Texts that are no version have no key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: which order an ecosystem's versions have; a suffix such as in ``Alpine:v3.18`` belongs to no name here
ORDERS = {"npm": "semver", "Go": "semver", "crates.io": "semver", "Hex": "semver", "PyPI": "pep440", "RubyGems": "gem", "Packagist": "composer"}


def number_key(digits: Column) -> Column:
    """Digits of any length (up to 999) so that bytes sort as numbers; an empty text is zero."""
    plain = F.regexp_replace(F.when(digits == "", "0").otherwise(digits), "^0+(?=[0-9])", "")
    return F.concat(F.lpad(F.length(plain).cast("string"), 3, "0"), plain)


def _numbers(dotted: Column, least: int) -> Column:
    """The keys of dotted numbers, at least so many."""
    parts = F.split(dotted, r"\.")
    padded = F.concat(parts, F.slice(F.array(*[F.lit("0")] * least), F.lit(1), F.greatest(F.lit(0), F.lit(least) - F.size(parts))))
    return F.transform(padded, number_key)


def semver_key(version: Column) -> Column:
    """MAJOR.MINOR.PATCH[-pre][+build]; fewer numbers are padded, a release comes after its pre-releases, build texts don't count."""
    pattern = r"^\s*[vV=]*([0-9]+(?:\.[0-9]+)*)(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?\s*$"
    pre = F.regexp_extract(version, pattern, 2)
    part = lambda x: F.when(x.rlike("^[0-9]+$"), F.concat(F.lit("0"), number_key(x))).otherwise(F.concat(F.lit("1"), x))
    named = F.transform(F.split(pre, r"\."), lambda x: F.concat(part(x), F.lit(" ")))
    # '-' before '/' before digits: pre-release, release, further numbers
    end = F.when(pre == "", "/").otherwise(F.concat(F.lit("-"), F.array_join(named, "")))
    return F.when(version.rlike(pattern), F.concat(F.array_join(_numbers(F.regexp_extract(version, pattern, 1), 3), ""), end))


_PEP440 = (
    r"^\s*v?(?:([0-9]+)!)?([0-9]+(?:\.[0-9]+)*)(?:[-_.]?(alpha|beta|preview|pre|rc|a|b|c)[-_.]?([0-9]*))?"
    r"((?:-(?=[0-9])|[-_.]?(?:post|rev|r)[-_.]?)([0-9]*))?([-_.]?dev[-_.]?([0-9]*))?(?:\+([a-z0-9]+(?:[-_.][a-z0-9]+)*))?\s*$"
)


def pep440_key(version: Column) -> Column:
    """[epoch!]release[pre][post][dev][+local] by PEP 440: development, alpha, beta, candidate, final, post."""
    low = F.lower(version)
    part = lambda i: F.regexp_extract(low, _PEP440, i)
    release = F.regexp_replace(part(2), r"(?:\.0+)+$", "")
    numbers = F.transform(F.split(release, r"\."), lambda x: F.concat(F.lit("1"), number_key(x)))
    pre, post, dev, local = part(3), part(5), part(7), part(9)
    rank = F.when(pre.isin("a", "alpha"), "1").when(pre.isin("b", "beta"), "2").when(pre != "", "3")
    pre_key = F.when(pre != "", F.concat(rank, number_key(part(4)))).when((post == "") & (dev != ""), "0").otherwise("4")
    post_key = F.when(post == "", "0").otherwise(F.concat(F.lit("1"), number_key(part(6))))
    dev_key = F.when(dev == "", "1").otherwise(F.concat(F.lit("0"), number_key(part(8))))
    segments = F.transform(F.split(local, "[-_.]"), lambda x: F.when(x.rlike("^[0-9]+$"), F.concat(F.lit("2"), number_key(x))).otherwise(F.concat(F.lit("1"), x, F.lit(" "))))
    local_key = F.when(local == "", "0").otherwise(F.concat(F.lit("1"), F.array_join(segments, "")))
    return F.when(low.rlike(_PEP440), F.concat(number_key(part(1)), F.array_join(numbers, ""), F.lit("0"), pre_key, post_key, dev_key, local_key))


def gem_key(version: Column) -> Column:
    """Segments of digits and letters; letters come before the end, which is like a zero, and that before other numbers. A ``-`` opens a pre-release."""
    valid = version.rlike(r"^\s*[0-9]+(?:\.[0-9a-zA-Z]+)*(?:-[0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*)?\s*$")
    found = F.regexp_extract_all(F.replace(version, F.lit("-"), F.lit(".pre.")), F.lit("[0-9]+|[a-zA-Z]+"), F.lit(0))
    is_word = lambda x: x.rlike("^[a-zA-Z]")
    first_word = F.array_position(F.transform(found, is_word), True)
    numbered = F.reverse(F.transform(found, lambda x, i: F.struct(x.alias("part"), (i + 1).alias("at"))))
    state = lambda key, follows: F.struct(key.alias("key"), F.lit(follows).alias("follows"))

    def step(a: Column, x: Column) -> Column:
        """From the last segment to the first; ``follows`` is what stands behind the zeros: the end, a word or a number."""
        zero = x["part"].rlike("^0+$")
        return (
            F.when(is_word(x["part"]), state(F.concat(F.lit("0"), x["part"], F.lit(" "), a["key"]), "word"))
            .when(zero & ((a["follows"] == "end") | ((a["follows"] == "word") & (x["at"] < first_word))), a)
            .when(zero & (a["follows"] == "word"), state(F.concat(F.lit("0~"), a["key"]), "word"))
            .otherwise(state(F.concat(F.lit("2"), number_key(x["part"]), a["key"]), "number"))
        )

    return F.when(valid, F.aggregate(numbered, state(F.lit("1"), "end"), step, lambda a: a["key"]))


def composer_key(version: Column) -> Column:
    """Up to four numbers, padded with zeros, then dev, alpha, beta, RC, (none), patch with their numbers."""
    low = F.lower(version)
    pattern = r"^\s*v?([0-9]+(?:\.[0-9]+)*)[-_.+]?(?:(dev|alpha|beta|rc|patch|pl|p|a|b)[-_.]?([0-9]*(?:\.[0-9]+)*))?(?:[-.]?dev)?(?:\+.*)?\s*$"
    word = F.regexp_extract(low, pattern, 2)
    rank = F.when(word == "dev", "0").when(word.isin("a", "alpha"), "1").when(word.isin("b", "beta"), "2").when(word == "rc", "3").when(word == "", "4").otherwise("5")
    numbers = F.array_join(_numbers(F.regexp_extract(low, pattern, 1), 4), "")
    behind = F.when(word == "", "").otherwise(F.array_join(F.transform(F.split(F.regexp_extract(low, pattern, 3), r"\."), number_key), ""))
    # '.' before digits: a fifth number makes a version later than one that ends
    return F.when(low.rlike(pattern), F.concat(numbers, F.lit("."), rank, behind))


KEYS: dict[str, Callable[[Column], Column]] = {"semver": semver_key, "pep440": pep440_key, "gem": gem_key, "composer": composer_key}


def version_key(ecosystem: Column, version: Column) -> Column:
    """The key of a version in its ecosystem; null where the ecosystem's order is not known or the text is no version."""
    out = F.lit(None).cast("string")
    for order, key in KEYS.items():
        out = F.when(ecosystem.isin(*(e for e, o in ORDERS.items() if o == order)), key(version)).otherwise(out)
    return out


def package_name(ecosystem: Column, name: Column) -> Column:
    """Names as ecosystems compare them: PyPI's without case and with ``-`` for runs of ``-_.``, Packagist's without case."""
    return F.when(ecosystem == "PyPI", F.regexp_replace(F.lower(name), "[-_.]+", "-")).when(ecosystem == "Packagist", F.lower(name)).otherwise(name)
