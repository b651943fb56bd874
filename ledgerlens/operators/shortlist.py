"""Scores of candidate cells for a fact, as Column arithmetic; the fuzzy part comes in as ``lexical``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.text import let, norm, tokens


#: Words that tell near-identical line items apart.
QUALIFIERS = ("ngan han", "dai han", "hop nhat", "rieng")
#: Wording of a line item -> its standard codes; the longest wording in a metric counts.
CODES = (
    ("luu chuyen tien thuan tu hoat dong kinh doanh", "20"),
    ("dong tien thuan tu hoat dong kinh doanh", "20"),
    ("doanh thu thuan", "10"),
    ("doanh thu ban hang va cung cap dich vu", "01 1"),
    ("gia von hang ban", "11"),
    ("loi nhuan gop", "20"),
    ("chi phi tai chinh", "22"),
    ("chi phi ban hang", "25"),
    ("chi phi quan ly doanh nghiep", "26"),
    ("loi nhuan thuan tu hoat dong kinh doanh", "30"),
    ("loi nhuan truoc thue", "50"),
    ("loi nhuan sau thue", "60"),
    ("lai co ban tren co phieu", "70"),
    ("tien va cac khoan tuong duong tien", "110"),
    ("hang ton kho", "140 141"),
    ("tai san ngan han", "100"),
    ("tai san dai han", "200"),
    ("tong tai san", "270"),
    ("tong cong tai san", "270"),
    ("no phai tra", "300"),
    ("no ngan han", "310"),
    ("no dai han", "330"),
    ("von chu so huu", "400 410"),
    ("von gop cua chu so huu", "411"),
    ("loi nhuan sau thue chua phan phoi", "421"),
)
#: Words that say nothing about which metric is meant.
GROUNDING_STOP = "cua tai vao den ngay nam cuoi dau trong cho theo tinh ghi nhan so tien muc la co cac va bao nhieu lon nho cao thap it hon khong bang tu tren".split()
_YEARS = r"(?<![0-9])((?:19|20)[0-9]{2})(?![0-9])"


def qualifier_bonus(label: Column, metric: Column, qualifiers: tuple[str, ...] = QUALIFIERS) -> Column:
    """A shared qualifier +8; different ones -25; one that only the metric has -3; else 0."""
    among = lambda text: let(norm(text), lambda plain: F.filter(F.array(*map(F.lit, qualifiers)), lambda q: F.contains(plain, q)))
    scored = lambda v: F.when(F.arrays_overlap(v["have"], v["want"]), 8).when(F.size(v["want"]) == 0, 0).when(F.size(v["have"]) > 0, -25).otherwise(-3)
    return let(F.struct(among(label).alias("have"), among(metric).alias("want")), scored)


def expected_codes(metric: Column) -> Column:
    """Codes of the longest wording that the metric contains, first of ties; empty if there is none."""

    def of(plain: Column) -> Column:
        out = F.array().cast("array<string>")
        for wording, codes in sorted(reversed(CODES), key=lambda x: len(x[0])):  # the longest is asked first
            out = F.when(plain.contains(wording), F.array(*map(F.lit, codes.split()))).otherwise(out)
        return out

    return let(norm(metric), of)


def content_terms(text: Column, stop: list[str] | None = None) -> Column:
    """Distinct tokens without stop words, single characters and numbers."""
    words = F.array_except(tokens(text), F.array(*map(F.lit, GROUNDING_STOP if stop is None else stop)))
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.rlike("^[0-9]+$"))


def period_role(text: Column) -> Column:
    """ending, beginning, mixed or same_period."""
    return let(norm(text), _period_role)


def _period_role(plain: Column) -> Column:
    end, start = plain.rlike(r"so du cuoi|cuoi nam|cuoi ky|31\s*/\s*12"), plain.rlike(r"so du dau|dau nam|dau ky|(?<![0-9])0?1\s*/\s*0?1(?![0-9])")
    return F.when(end & start, "mixed").when(end, "ending").when(start, "beginning").otherwise("same_period")


def year_reason(header: Column, context: Column, report_year: Column, year: Column) -> Column:
    """Why a cell does or does not belong to ``year``; the reasons of success do not hold a colon."""
    texts = F.struct(norm(header).alias("header"), norm(context).alias("context"))
    return let(texts, lambda v: _year_reason(v["header"], v["context"], report_year, year))


def _year_reason(header: Column, context: Column, report_year: Column, year: Column) -> Column:
    own = F.transform(F.regexp_extract_all(header, F.lit(_YEARS), F.lit(1)), lambda y: y.cast("int"))
    around = F.array_distinct(F.transform(F.regexp_extract_all(context, F.lit(_YEARS), F.lit(1)), lambda y: y.cast("int")))
    said = F.when(header.rlike("nam nay|ky nay"), report_year).when(header.rlike("nam truoc|ky truoc|so du dau|dau nam|dau ky"), report_year - 1)
    either = lambda ok, good, bad: F.when(ok, good).otherwise(bad)
    return (
        F.when(year.isNull(), "year_not_requested")
        .when(F.size(own) > 0, either(F.array_contains(own, year), "explicit_column_year", "year_mismatch:column"))
        .when(said.isNotNull(), either(said == year, "relative_column_year", "year_mismatch:relative"))
        .when(F.size(around) == 1, either(F.array_contains(around, year), "explicit_context_year", "year_mismatch:context"))
        .when(F.size(around) > 1, "year_ambiguous:context")
        .when(report_year != year, "year_mismatch:report")
        .otherwise("report_year_match")
    )


def metric_grounding(label: Column, header: Column, code: Column, metric: Column, period: Column, score: Column) -> Column:
    """Reason why a cell is or is not the metric of a fact; ``score`` is its direct label score (0 to 100).

    The reasons of success are exact_vas_code, metric_match:ending_balance_column_layout and metric_match:direct.
    """
    direct = F.concat_ws(" ", label, header)
    once = F.struct(norm(direct).alias("plain"), norm(label).alias("label"), norm(header).alias("header"), norm(metric).alias("metric"), content_terms(metric).alias("terms"), expected_codes(metric).alias("expected"), tokens(direct).alias("said"), period_role(direct).alias("seen"))
    return let(once, lambda v: _metric_grounding(v, code, period, score))


def _metric_grounding(v: Column, code: Column, period: Column, score: Column) -> Column:
    plain, label_plain, header_plain, metric_plain, terms, expected, seen = (v[x] for x in ("plain", "label", "header", "metric", "terms", "expected", "seen"))
    share = F.size(F.array_intersect(terms, v["said"])) / F.greatest(F.size(terms), F.lit(1))
    code = F.regexp_replace(F.trim(F.coalesce(code, F.lit(""))), r"\.0$", "")
    digits = code.rlike("^[0-9]+$")
    provision = metric_plain.contains("chi phi du phong rui ro tin dung")
    matched = F.when(F.size(terms) == 1, (F.length(F.get(terms, F.lit(0))) >= 4) & (share == 1)).when(F.size(terms) == 2, share == 1).otherwise((share >= 0.75) & (score >= 35))
    return (
        F.when(F.size(terms) == 0, "metric_has_no_content_terms")
        .when((period == "ending") & (seen == "beginning"), "period_contradiction:expected_ending")
        .when((period == "beginning") & (seen == "ending"), "period_contradiction:expected_beginning")
        .when(metric_plain.contains("no vay") & plain.rlike("tien tra no goc vay|tra no vay|luu chuyen tien"), "metric_domain_mismatch:cashflow_not_debt")
        .when(header_plain.rlike("so da trinh bay|so trinh bay lai|dieu chinh"), "presentation_state_ambiguous")
        .when(provision & label_plain.contains("loi nhuan"), "metric_domain_mismatch:profit_not_provision")
        .when(provision & ~label_plain.contains("chi phi"), "metric_domain_mismatch:stock_not_expense")
        .when(provision & header_plain.rlike("mien bac|mien trung|mien nam"), "metric_scope_mismatch:segment_not_total")
        .when((F.size(expected) > 0) & digits & ~F.array_contains(expected, code), "vas_code_mismatch")
        .when((F.size(expected) > 0) & ~digits & (share < 0.8), "vas_code_missing_with_weak_metric_match")
        .when(F.array_contains(expected, code) & (share >= 0.35), "exact_vas_code")
        .when(metric_plain.startswith("con lai cua ") & label_plain.contains("so du cuoi") & (share >= 0.6), "metric_match:ending_balance_column_layout")
        .when(matched, "metric_match:direct")
        .otherwise("metric_mismatch:direct")
    )


def extra_penalty(label: Column, metric: Column) -> Column:
    """Three points for each label token beyond one that the metric lacks, 18 at most."""
    extra = F.size(F.array_except(tokens(label), tokens(metric)))
    return F.least(F.lit(18), 3 * F.greatest(F.lit(0), extra - 1))


def year_bonus(header: Column, year: Column) -> Column:
    named = F.regexp_extract(header, r"\b(20[0-9]{2})\b", 1)
    return F.when(named == "", -6).when(named == year.cast("string"), 10).otherwise(-30)


def code_bonus(code: Column, expected: Column) -> Column:
    return let(expected, lambda e: F.when(F.array_contains(e, code), 12).when(code.rlike("^[0-9]+$") & (F.size(e) > 0), -10).otherwise(0))


def score(lexical: Column, semantic: Column, *bonuses: Column) -> Column:
    s = F.coalesce(semantic, F.lit(0.0))
    out = F.greatest(lexical, s) + 0.25 * F.least(lexical, s)
    for b in bonuses:
        out = out + b
    return out


def year_grounding(header: Column, context: Column, report_year: Column) -> Column:
    """Year of a column: its own, else relative words, else the only year of the context, else the report's."""
    own = F.regexp_extract(header, r"\b(20[0-9]{2})\b", 1).try_cast("int")
    relative = F.when(header.rlike("nam nay|cuoi (nam|ky)|so cuoi"), report_year).when(header.rlike("nam truoc|dau (nam|ky)|so dau"), report_year - 1)
    around = F.array_distinct(F.regexp_extract_all(context, F.lit(r"\b(20[0-9]{2})\b"), F.lit(1)))
    return F.coalesce(own, relative, F.when(F.size(around) == 1, F.get(around, F.lit(0)).try_cast("int")), report_year)


def column_role(header: Column) -> Column:
    """note or code, date, year, current or prior, else unknown."""
    return (
        F.when(header.rlike("^(thuyet minh|tm|ghi chu)$"), "note")
        .when(header.rlike("^(ma so|ma|code)$"), "code")
        .when(header.rlike(r"[0-9]{1,2}/[0-9]{1,2}/20[0-9]{2}"), "date")
        .when(header.rlike(r"\b20[0-9]{2}\b"), "year")
        .when(header.rlike("nam nay|cuoi (nam|ky)"), "current")
        .when(header.rlike("nam truoc|dau (nam|ky)"), "prior")
        .otherwise("unknown")
    )


def unique_best(df: DataFrame, by: list[str], confidence: str) -> DataFrame:
    """The row of highest confidence of each group, if it is the only one."""
    w = Window.partitionBy(*by)
    top = df.withColumn("best", F.max(confidence).over(w)).filter(F.col(confidence) == F.col("best"))
    return top.withColumn("n", F.count(F.lit(1)).over(w)).filter("n = 1").drop("best", "n")


def date_year(header: Column) -> Column:
    """Year that a balance date stands for: 31/12/Y is Y, 1/1/Y is the year before; else null."""
    end = F.regexp_extract(header, r"(?:31 ?/ ?12 ?/ ?|31 thang 12 nam )((?:19|20)[0-9]{2})", 1)
    start = F.regexp_extract(header, r"(?:1 ?/ ?0?1 ?/ ?|1 thang 1 nam )((?:19|20)[0-9]{2})", 1)
    return F.when(end != "", end.try_cast("int")).when(start != "", start.try_cast("int") - 1)


def period_column(header: Column, report_year: Column, year: Column, first: Column) -> Column:
    """Struct role, year, confidence of a value column for the year asked for; ``first``: it is the first of its row.

    role: target_value, other_period, ambiguous or unknown; confidence 4 for dates and years, 3 for wording,
    1 for the place alone, else 0.
    """
    return let(norm(header), lambda plain: _period_column(plain, report_year, year, first))


def _period_column(plain: Column, report_year: Column, year: Column, first: Column) -> Column:
    years = F.array_distinct(F.regexp_extract_all(plain, F.lit(_YEARS), F.lit(1)))
    dated = F.coalesce(date_year(plain), F.when(F.size(years) == 1, F.get(years, F.lit(0)).try_cast("int")))
    several = date_year(plain).isNull() & (F.size(years) > 1)
    worded = F.when(plain.rlike("nam nay|ky nay|cuoi (?:nam|ky)|so cuoi"), report_year).when(plain.rlike("nam truoc|ky truoc|dau (?:nam|ky)|so dau"), report_year - 1)
    mapped = F.coalesce(dated, worded)
    placed = first & (report_year == year)
    role = F.when(several, "ambiguous").when(mapped.isNotNull(), F.when(mapped == year, "target_value").otherwise("other_period")).when(placed, "target_value").otherwise("unknown")
    sure = F.when(several, 0).when(dated.isNotNull(), 4).when(worded.isNotNull(), 3).when(placed, 1).otherwise(0)
    return F.struct(role.alias("role"), F.when(~several, F.coalesce(mapped, F.when(placed, year))).alias("year"), sure.alias("confidence"))


def fill_missing(strict: DataFrame, rescue: DataFrame, slots: DataFrame, by: str, slot: str, cell: list[str], score: str, most: int) -> DataFrame:
    """strict and, for slots (by, slot) that it lacks, the rescued rows by score, up to ``most`` rows a question.

    A cell that is in strict already, or comes twice, is not added again. Strict rows come first.
    """
    lacking = slots.select(by, slot).distinct().join(strict.select(by, slot), [by, slot], "left_anti")
    once = Window.partitionBy(by, *cell).orderBy(F.desc(score), slot)
    more = rescue.join(lacking, [by, slot], "left_semi").join(strict.select(by, *cell), [by, *cell], "left_anti")
    more = more.withColumn("__once", F.row_number().over(once)).filter("__once = 1").drop("__once")
    both = strict.withColumn("rescue", F.lit(False)).unionByName(more.withColumn("rescue", F.lit(True)))
    w = Window.partitionBy(by).orderBy("rescue", F.desc(score), slot, *cell)
    return both.withColumn("rank", F.row_number().over(w)).filter(~F.col("rescue") | (F.col("rank") <= most))
