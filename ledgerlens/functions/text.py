"""Text normalisation as Column expressions: all of it stays inside generated JVM code."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accent_map() -> tuple[str, str]:
    """Precomposed Latin letters and their base letters, from the Unicode decomposition rule."""
    src, dst = "đĐ", "dD"
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFD", chr(code))
        if len(base) > 1 and all(unicodedata.combining(c) for c in base[1:]):
            src, dst = src + chr(code), dst + base[0]
    return src, dst


_FROM, _TO = _accent_map()
#: Legal forms before company names, longest wording first.
COMPANY_PREFIXES = ("tong cong ty co phan", "tong cong ty", "cong ty co phan", "cong ty tnhh", "ngan hang thuong mai co phan", "ngan hang tmcp", "ngan hang", "tap doan", "cong ty", "ctcp")


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once a row: Spark computes it again wherever a branch or a lambda names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip_diacritics(text: Column) -> Column:
    return F.translate(F.regexp_replace(text, r"\p{M}", ""), _FROM, _TO)


def norm(text: Column) -> Column:
    """Lower case without accents; only letters, digits, / and % stay, single spaces; null is empty."""
    plain = F.lower(strip_diacritics(F.coalesce(text, F.lit(""))))
    return F.trim(F.regexp_replace(F.regexp_replace(plain, "[^0-9a-z\\s/%]", " "), "\\s+", " "))


def tokens(text: Column) -> Column:
    return F.filter(F.split(norm(text), " "), lambda x: x != "")


def strip_company_prefixes(name: Column) -> Column:
    return F.regexp_replace(norm(name), "^(?:(?:" + "|".join(COMPANY_PREFIXES) + ") )+", "")


def compact(text: Column) -> Column:
    return F.regexp_replace(norm(text), "[^0-9a-z]", "")


def coverage(label: Column, metric: Column) -> Column:
    """Share of the distinct metric tokens that the label has."""
    wanted = F.array_distinct(tokens(metric))
    return F.size(F.array_intersect(tokens(label), wanted)) / F.greatest(F.size(wanted), F.lit(1))


def extract_years(text: Column, first: int = 2010, last: int = 2026) -> Column:
    """Distinct years in order; "2019-2022" and the like stand for every year between, in either direction."""
    ranges = F.regexp_extract_all(text, F.lit(r"\b(20[0-9]{2})\s*(?:-|–|den|to)\s*(?:nam\s*)?(20[0-9]{2})\b"), F.lit(0))
    spans = F.flatten(F.transform(ranges, lambda r: F.sequence(F.substring(r, 1, 4).cast("int"), F.substring(r, -4, 4).cast("int"))))
    single = F.transform(F.regexp_extract_all(text, F.lit(r"\b(20[0-9]{2})\b"), F.lit(1)), lambda y: y.cast("int"))
    return F.filter(F.array_distinct(F.concat(spans, single)), lambda y: (y >= first) & (y <= last))


def canonical_code(code: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(F.trim(code), "\\.0$", ""), "^0+", "")
    return F.when(out == "", F.lit("0")).otherwise(out)


#: Unit words of amounts in a question.
MONEY_UNITS = {"nghin ty": 1e12, "tram ty": 1e11, "ty": 1e9, "trieu": 1e6, "nghin": 1e3}


def money_literals(question: Column) -> Column:
    """Amounts named in a question ("1,5 nghin ty" is 1.5e12), in order."""
    unit = "(nghin\\s+ty|tram\\s+ty|ty|trieu|nghin)"
    amount = rf"(?<![0-9.,])([-+]?[0-9]+(?:[.,][0-9]+)?)\s*{unit}(?:\s*(?:dong|vnd))?(?![0-9a-z])"
    plain = F.lower(strip_diacritics(F.coalesce(question, F.lit(""))))
    scale = F.create_map(*(F.lit(x) for kv in MONEY_UNITS.items() for x in kv))
    numbers, units = (F.regexp_extract_all(plain, F.lit(amount), F.lit(i)) for i in (1, 2))
    return F.zip_with(numbers, units, lambda n, u: F.replace(n, F.lit(","), F.lit(".")).cast("double") * F.element_at(scale, F.regexp_replace(u, r"\s+", " ")))
