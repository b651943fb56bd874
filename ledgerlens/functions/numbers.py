"""Locale numbers, units and formulas as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens import config
from ledgerlens.functions.text import strip_diacritics


def parse_number(raw: Column) -> Column:
    """Number in local or English notation; null where the text is not one.

    Both separators: the last one is the decimal one. Dots alone: thousands if they split groups of three
    (but 0.xxx is a decimal), else a decimal with one or two places. One comma is a decimal, more are
    thousands. Parentheses or a minus make it negative; a percent sign is dropped.
    """
    s = F.regexp_replace(F.lower(raw), r"\(\*+\)", "")
    s = F.regexp_replace(F.regexp_replace(s, r"[\s   ]", ""), "[–—−]", "-")
    s = F.regexp_replace(s, "(vnd|vnđ|đ|dong|đồng)$", "")
    negative = s.rlike(r"^\(.*\)$") | s.startswith("-")
    s = F.regexp_replace(s, "[()%+-]", "")
    dots, commas = F.length(s) - F.length(F.replace(s, F.lit("."))), F.length(s) - F.length(F.replace(s, F.lit(",")))
    point = (
        F.when((dots > 0) & (commas > 0), F.when(F.locate(",", F.reverse(s)) < F.locate(".", F.reverse(s)), F.replace(F.replace(s, F.lit(".")), F.lit(","), F.lit("."))).otherwise(F.replace(s, F.lit(","))))
        .when((dots == 1) & s.rlike(r"^0?\.[0-9]+$"), s)
        .when((dots > 0) & s.rlike(r"^[0-9]{1,3}(\.[0-9]{3})+$"), F.replace(s, F.lit(".")))
        .when((dots == 1) & s.rlike(r"\.[0-9]{1,2}$"), s)
        .when(dots > 0, F.replace(s, F.lit(".")))
        .when((commas == 1) & s.rlike("^[0-9]+,[0-9]+$"), F.replace(s, F.lit(","), F.lit(".")))
        .when(commas > 0, F.replace(s, F.lit(",")))
        .otherwise(s)
    )
    value = F.when(point.rlike(r"^[0-9]*\.?[0-9]+$"), point.try_cast("double"))
    return F.when(negative, -value).otherwise(value)


def year_like(value: Column) -> Column:
    return (value == F.floor(value)) & value.between(1990, 2035)


def detect_unit(context: Column) -> Column:
    """Scale named in a normalized context (see text.norm), most specific wording first; null if none."""
    rules = (("nghin ty", 1e12), ("tram ty", 1e11), ("ty (dong|vnd)", 1e9), ("(trieu|tr) (dong|vnd)", 1e6), ("(nghin|ngan) (dong|vnd)", 1e3), ("(don vi|dvt)( tinh)? (dong|vnd)|vnd$", 1.0))
    out = F.lit(None).cast("double")
    for wording, scale in reversed(rules):
        out = F.when(context.rlike(rf"\b{wording}" if not wording.endswith("$") else wording), F.lit(scale)).otherwise(out)
    return out


def percent_from_cell(value: Column, label: Column) -> Column:
    """A cell that is a percent already stays; a ratio is multiplied by 100."""
    return F.when(label.contains("%") | (F.abs(value) > 1.5), value).otherwise(value * 100)


def convert(value: Column, scale: Column, question_scale: Column) -> Column:
    return F.round(value * scale / question_scale, 2)


def growth_percent(base: Column, end: Column) -> Column:
    return F.when(base != 0, (end - base) / F.abs(base) * 100)


def cagr_percent(base: Column, end: Column, years: Column) -> Column:
    return F.when((base > 0) & (end > 0) & (years > 0), (F.pow(end / base, F.lit(1.0) / years) - 1) * 100)


def agrees(a: Column, b: Column) -> Column:
    """Two answers are the same within the tolerance."""
    return F.abs(a - b) <= F.greatest(F.lit(config.ANSWER_TOLERANCE), config.AGREE_RELATIVE * F.greatest(F.abs(a), F.abs(b)))


_MULTIPLES = "nghin ty|ngan ty|tram ty|ty|trieu|nghin|ngan|trillion|billion|million|thousand"


def terminal_vnd(context: Column) -> Column:
    """The context of a table ends in VND without a multiple before it."""
    plain = F.trim(F.regexp_replace(F.lower(strip_diacritics(F.coalesce(context, F.lit("")))), r"\s+", " "))
    tail = r"vnd\s*[\]\[(){}.,:;_-]*\s*$"
    return plain.rlike(rf"\b{tail}") & ~plain.rlike(rf"\b(?:{_MULTIPLES}) {tail}")


def resolve_unit(scale: Column, source: Column, context: Column) -> Column:
    """Struct scale, source, changed: a scale that is only carried on gives way to VND at the end of the context.

    A missing, not finite or not positive scale counts as 1.
    """
    stored = F.when(F.isnan(scale) | (scale <= 0) | (scale == float("inf")), 1.0).otherwise(F.coalesce(scale, F.lit(1.0)))
    source = F.coalesce(source, F.lit("none"))
    over = (source == "sticky") & terminal_vnd(context)
    return F.struct(F.when(over, 1.0).otherwise(stored).alias("scale"), F.when(over, "terminal_vnd").otherwise(source).alias("source"), (over & (stored != 1.0)).alias("changed"))


def scalar(text: Column) -> Column:
    """Number of an answer written as text (thousands commas are dropped); null for NaN, infinities and words."""
    value = F.replace(F.trim(text), F.lit(",")).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
