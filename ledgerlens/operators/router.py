"""Question routing: output type, unit, operation, ratio parts, facts and evidence budget, as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.text import extract_years, norm, strip_diacritics
from ledgerlens.operators.joins import tiered

#: Fixed values, in order: normalized wording -> scale and name of the unit a question asks for.
UNITS = (("nghin ty", 1e12, "nghin_ty"), ("tram ty", 1e11, "tram_ty"), ("ty dong|ty vnd", 1e9, "ty"), ("trieu dong|trieu vnd", 1e6, "trieu"), ("nghin dong|ngan dong", 1e3, "nghin"), ("dong|vnd", 1.0, "dong"))
#: Fixed values, in order: normalized wording -> operation; the first that matches counts.
OPS = (
    ("cagr|tang truong kep", "cagr"),
    ("neu .*(tang|giam)|gia su", "hypothetical"),
    ("tang truong|toc do tang|tang bao nhieu (phan tram|%)|giam bao nhieu (phan tram|%)", "growth_pct"),
    ("bien loi nhuan|ty suat", "margin"),
    ("cao nhat|thap nhat|lon nhat|nho nhat", "ranking"),
    ("bao nhieu (cong ty|nam|doanh nghiep)|so luong", "count"),
    ("trung binh|binh quan", "average"),
    ("tong cong|tong gia tri", "sum"),
    ("chenh lech|nhieu hon|it hon", "difference"),
    ("ty le|ty trong|chiem|gap bao nhieu lan", "ratio"),
)


def _ladder(text: Column, rules, otherwise) -> Column:
    out = F.lit(otherwise)
    for wording, value in reversed(rules):
        out = F.when(text.rlike(rf"\b(?:{wording})(?:\b|$)"), F.lit(value)).otherwise(out)
    return out


def detect_op(plain: Column) -> Column:
    return _ladder(plain, OPS, "lookup")


def output_type(plain: Column) -> Column:
    """Year, count, turns by their wording; else the first marker after the question word; else a percentage that is named anywhere."""
    named = (("nam nao", "year"), ("bao nhieu (?:cong ty|nam|doanh nghiep)", "count"), ("bao nhieu (?:lan|vong)|gap may lan", "ratio"))
    anywhere = (("diem phan tram", "percentage_point"), ("phan tram|%", "percent"))
    return F.coalesce(F.nullif(_ladder(plain, named, ""), F.lit("")), first_marker(plain), _ladder(plain, anywhere, "number"))


#: Wordings of what an answer is counted in; at one place the earlier row counts.
MARKERS = (("percentage_point", r"\bdiem\s+phan\s+tram\b"), ("percent", r"\bphan\s+tram\b|%"), ("ratio", r"\blan\b"), ("number", r"(?:nghin|ngan)\s*ty|\btram\s*ty\b|\bty\s*(?:dong|vnd)\b|\btrieu\s+(?:dong|vnd|usd)\b|\b(?:trieu\s+|nghin\s+|ngan\s+)?(?:co phieu|co phan|dong|vnd|usd)\b"))


def first_marker(plain: Column) -> Column:
    """What the answer is counted in, by the first marker after the last "bao nhieu" (in the whole text if there is none); null without one.

    Conditions before the question ("tren 5 phan tram ... bao nhieu ty dong") therefore do not decide.
    """
    tail = F.element_at(F.split(F.coalesce(plain, F.lit("")), "bao nhieu"), -1)
    place = lambda wording: F.when(tail.rlike(wording), F.length(F.get(F.split(tail, wording, 2), F.lit(0))))
    found = [F.when(place(wording).isNotNull(), F.struct(place(wording).alias("at"), F.lit(i).alias("i"), F.lit(kind).alias("kind"))) for i, (kind, wording) in enumerate(MARKERS)]
    return F.array_min(F.array_compact(F.array(*found)))["kind"]


def split_ratio(metric: Column) -> Column:
    """Numerator and denominator of a ratio wording; empty if it is none."""
    body = F.regexp_replace(metric, "^(?:ty le|ty trong|he so|ty so) ", "")
    parts = F.split(body, " (?:tren tong|so voi tong|chia cho|tren) ", 2)
    return F.when((F.size(parts) == 2) & (F.length(F.get(parts, F.lit(0))) >= 3) & (F.length(F.get(parts, F.lit(1))) >= 3), parts).otherwise(F.array().cast("array<string>"))


def route(questions: DataFrame, text: str = "question") -> DataFrame:
    """Adds plain, years, op, output_type, unit_scale and unit_name."""
    df = questions.withColumn("plain", norm(F.col(text)))
    return df.select(
        "*",
        extract_years(F.lower(strip_diacritics(F.col(text)))).alias("years"),  # norm drops the dash of ranges
        detect_op(F.col("plain")).alias("op"),
        output_type(F.col("plain")).alias("output_type"),
        _ladder(F.col("plain"), tuple((w, s) for w, s, _ in UNITS), 1.0).alias("unit_scale"),
        _ladder(F.col("plain"), tuple((w, n) for w, _, n in UNITS), "none").alias("unit_name"),
    )


def find_entities(questions: DataFrame, aliases: DataFrame, key: str) -> DataFrame:
    """(key, ticker): aliases contained in the text at word boundaries.

    Aliases (alias, ticker) meet questions on their first word, so no pair is compared without one; an
    alias inside a longer one that also occurs at the same place gives way to it.
    """
    words = questions.select(key, "plain", F.posexplode(F.split("plain", " ")).alias("at", "word"))
    named = aliases.select("alias", "ticker", F.get(F.split("alias", " "), F.lit(0)).alias("word"), F.size(F.split("alias", " ")).alias("n"))
    hits = words.join(named, "word").filter(F.array_join(F.slice(F.split("plain", " "), F.col("at") + 1, F.col("n")), " ") == F.col("alias"))
    w = Window.partitionBy(key).orderBy("at", F.desc("n"), "ticker").rowsBetween(Window.unboundedPreceding, -1)
    free = hits.withColumn("until", F.max(F.col("at") + F.col("n")).over(w)).filter(F.col("until").isNull() | (F.col("at") >= F.col("until")))
    return free.select(key, "ticker", "alias", "at").dropDuplicates([key, "ticker"])


def plan_facts(routed: DataFrame, key: str, entities: str = "tickers") -> DataFrame:
    """One row per fact: entity x year x component, with its role.

    A change of one entity (growth, cagr, difference) that names one year gets the prior year too; several entities
    are compared in the year named.
    """
    years = F.when((F.size("years") == 1) & (F.size(entities) == 1) & F.col("op").isin("growth_pct", "cagr", "difference"), F.array(F.get("years", F.lit(0)), F.get("years", F.lit(0)) - 1)).otherwise(F.col("years"))
    parts = F.when(F.col("op").isin("ratio", "margin") & (F.size(split_ratio(F.col("metric"))) == 2), split_ratio(F.col("metric"))).otherwise(F.array("metric"))
    rows = routed.withColumn("fact_years", years).withColumn("parts", parts)
    rows = rows.select(key, "op", F.size("parts").alias("n_parts"), F.explode(entities).alias("ticker"), "fact_years", "parts").select(key, "op", "n_parts", "ticker", F.explode("fact_years").alias("year"), "parts")
    rows = rows.select(key, "op", "n_parts", "ticker", "year", F.posexplode("parts").alias("part", "metric"))
    role = F.when(F.col("n_parts") == 2, F.when(F.col("part") == 0, "numerator").otherwise("denominator")).otherwise("value")
    return rows.withColumn("role", role).drop("n_parts", "part")


#: Kinds of report that stand for one that is not there, in order.
OTHER_KINDS = {"consolidated": ("separate", "aggregated", "other"), "separate": ("consolidated", "aggregated", "other"), "aggregated": ("consolidated", "other"), "other": ("consolidated", "aggregated")}
LOCK_NOTES = ("exact", "other_kind", "next_year", "missing")


def lock_reports(asked: DataFrame, reports: DataFrame, key: str) -> DataFrame:
    """(key, ticker, year, doc_type, report_id, note): the reports that answer for each ticker and year asked.

    All reports of the kind asked, else of the first other kind that there is, else those that the same ladder finds a year
    later (their prior-year column holds the year), else one row without a report. asked: key, ticker, year,
    doc_type; reports: report_id, ticker, year, doc_type. Rows asked twice are answered once.
    """
    one = asked.select(key, "ticker", "year", "doc_type").distinct()
    ladder = F.lit(None).cast("int")
    for kind, others in OTHER_KINDS.items():
        for at, other in enumerate((kind, *others)):
            ladder = F.when((F.col("doc_type") == kind) & (F.col("kind") == other), F.lit(at)).otherwise(ladder)
    ladder = F.when(F.col("doc_type") == F.col("kind"), F.lit(0)).otherwise(ladder)
    there = reports.select("report_id", "ticker", F.col("year").alias("of"), F.col("doc_type").alias("kind"))
    later = F.col("of") - F.col("year")
    pairs = one.withColumn("of", F.explode(F.array(F.col("year"), F.col("year") + 1))).join(there, ["ticker", "of"])
    best = tiered(pairs, [key, "ticker", "year", "doc_type"], 10 * later + ladder)
    found = best.select(key, "ticker", "year", "doc_type", "report_id", F.when(F.col("tier") == 0, "exact").when(F.col("tier") < 10, "other_kind").otherwise("next_year").alias("note"))
    # null-safe: a question without a ticker or year is answered by "missing"
    same = lambda c: F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    lost = one.alias("a").join(found.select(key, "ticker", "year", "doc_type").distinct().alias("b"), same(key) & same("ticker") & same("year") & same("doc_type"), "left_anti")
    return found.unionByName(lost.withColumn("note", F.lit("missing")), allowMissingColumns=True)


def evidence_budget(n_facts: Column) -> Column:
    """Tables to keep for a question: 4 and two for each further fact, 12 at most."""
    return F.least(F.lit(12), 4 + 2 * F.greatest(n_facts - 1, F.lit(0)))
