"""Atomic slots: the cells a question needs, expanded from formula families, as Columns without a shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.text import norm
from ledgerlens.operators.router import split_ratio

MAX_SLOTS = 24
#: Family, wording in a normalized question, components "metric: role" (":+1" is the year after).
FAMILIES = (
    ("quick_ratio", r"(?:he so|kha nang) thanh toan nhanh", ("tai san ngan han:rank", "hang ton kho:rank", "no ngan han:denominator")),
    ("current_ratio", r"(?:he so|kha nang) thanh toan (?:hien hanh|ngan han)", ("tai san ngan han:numerator", "no ngan han:denominator")),
    ("operating_cashflow_to_current_debt", r"(?:he so )?(?:dong tien|luu chuyen tien).*hoat dong.*(?:tren|so voi).*no ngan han", ("luu chuyen tien thuan tu hoat dong kinh doanh:project:+1", "no ngan han:denominator:+1")),
    ("cfo_margin", r"cfo margin|bien (?:dong tien|luu chuyen tien).*hoat dong", ("luu chuyen tien thuan tu hoat dong kinh doanh:numerator", "doanh thu thuan:denominator")),
    ("earnings_per_share", r"(?:loi nhuan|lai)\s+(?:co ban\s+)?tren moi co phieu|eps\b", ("loi nhuan sau thue phan bo cho co dong:numerator", "so luong co phieu dang luu hanh:denominator")),
    ("debt_to_assets", r"no vay.*(?:tren|so voi).*tong tai san", ("no vay:numerator", "tong tai san:denominator")),
    ("gross_margin", r"bien loi nhuan gop", ("loi nhuan gop:numerator", "doanh thu thuan:denominator")),
    ("net_margin", r"bien loi nhuan (?:rong|sau thue)|\bros\b", ("loi nhuan sau thue:numerator", "doanh thu thuan:denominator")),
    ("debt_to_equity", r"(?:ty so |he so )?d\s*/?\s*e\b|no phai tra.*(?:tren|so voi).*von chu so huu", ("no phai tra:filter", "von chu so huu:denominator")),
    ("interest_coverage", r"(?:he so |kha nang )?thanh toan lai vay|interest coverage", ("loi nhuan truoc thue:numerator", "chi phi lai vay:denominator")),
    ("effective_tax_rate", r"thue suat thuc te", ("chi phi thue thu nhap doanh nghiep:numerator", "loi nhuan truoc thue:denominator")),
    ("roe", r"\broe\b|ty suat loi nhuan.*von chu so huu", ("loi nhuan sau thue:numerator", "von chu so huu:denominator")),
    ("roa", r"\broa\b|ty suat loi nhuan.*tong tai san", ("loi nhuan sau thue:numerator", "tong tai san:denominator")),
    ("depreciation_admin_share", r"ty trong chi phi khau hao.*(?:trong|tren).*chi phi quan ly", ("chi phi khau hao tai san co dinh:numerator", "chi phi quan ly doanh nghiep:denominator")),
    ("segment_asset_share", r"ty trong tai san bo phan .*?(?:tren|trong) tong tai san", ("tai san bo phan:numerator", "tong tai san:denominator")),
)
#: Quantity named in a question -> metrics of which one must be planned (several groups: each of them).
REQUIRED = (
    ("operating_cash_flow", r"(?:luu chuyen|dong) tien thuan tu hoat dong kinh doanh", (("luu chuyen tien thuan tu hoat dong kinh doanh", "dong tien thuan tu hoat dong kinh doanh"),)),
    ("net_profit", r"loi nhuan sau thue", (("loi nhuan sau thue",),)),
    ("revenue", r"doanh thu thuan", (("doanh thu thuan",),)),
    ("current_assets", r"tai san ngan han", (("tai san ngan han",),)),
    ("current_debt", r"no ngan han", (("no ngan han",),)),
    ("total_assets", r"tong (?:cong )?tai san", (("tong tai san", "tong cong tai san"),)),
    ("borrowings", r"no vay", (("no vay",),)),
    ("liabilities", r"no phai tra", (("no phai tra",),)),
    ("equity", r"von chu so huu", (("von chu so huu",),)),
    ("interest_expense", r"chi phi lai vay", (("chi phi lai vay",),)),
    ("pretax_profit", r"loi nhuan (?:ke toan )?truoc thue", (("loi nhuan truoc thue", "loi nhuan ke toan truoc thue"),)),
    ("credit_provision", r"chi phi du phong rui ro tin dung", (("chi phi du phong rui ro tin dung",),)),
    ("preprovision_profit", r"loi nhuan truoc du phong", (("loi nhuan truoc du phong",),)),
    ("sga", r"\bs\s*&\s*g\s*&\s*a\b|\bsg\s*&?\s*a\b", (("chi phi ban hang",), ("chi phi quan ly doanh nghiep",), ("doanh thu thuan",))),
    ("pretax_margin", r"bien loi nhuan truoc thue", (("loi nhuan truoc thue", "loi nhuan ke toan truoc thue"), ("doanh thu thuan",))),
)
_COMPARED = r"(?:lon hon|nho hon|cao hon|thap hon|nhieu hon|it hon|khong nho hon|khong lon hon|bang|tu)\s+[-+]?[0-9]"
_COMPONENT = "array<struct<metric:string,role:string,offset:int,family:string>>"


def counted_metric(plain: Column) -> Column:
    """Metric of a count question, between the last "ghi nhan" or "co" and a comparison; null if there is none."""
    found = F.regexp_extract(plain, rf"^.*(?:\bghi nhan\b|\bco\b)\s+(.+?)\s+{_COMPARED}", 1)
    metric = F.regexp_replace(found, r"^(?:so tien|gia tri|muc)\s+", "")
    return F.when(metric.contains(" "), metric)


def components(plain: Column) -> Column:
    """Components of all families that the question words, first family of equal components."""
    parts = []
    for name, wording, items in FAMILIES:
        rows = [x.split(":") for x in items]
        struct = lambda m, role, off="+0", name=name: F.struct(F.lit(m).alias("metric"), F.lit(role).alias("role"), F.lit(int(off)).alias("offset"), F.lit(name).alias("family"))
        parts.append(F.when(plain.rlike(wording), F.array(*(struct(*r) for r in rows))).otherwise(F.array().cast(_COMPONENT)))
    return _first_of(F.concat(*parts), "metric", "role", "offset")


def _first_of(items: Column, *fields: str) -> Column:
    """Items whose fields do not occur earlier in the array."""
    key = lambda x: F.concat_ws("|", *(F.coalesce(x[f].cast("string"), F.lit("")) for f in fields))
    keys = F.transform(items, key)
    return F.filter(items, lambda x, i: F.array_position(keys, key(x)) == i + 1)


def missing_leaves(plain: Column, metrics: Column) -> Column:
    """Required quantities of the question that no planned metric covers, as name:metric."""
    out = []
    for name, wording, groups in REQUIRED:
        for group in groups:
            out.append(F.when(plain.rlike(wording) & ~_names_one(metrics, group), F.lit(f"{name}:{group[0]}")))
    return F.array_distinct(F.array_compact(F.array(*out)))


def _names_one(metrics: Column, group: tuple[str, ...]) -> Column:
    """Some metric contains, or is contained in, a wording of the group."""
    fits = lambda m: reduce(lambda a, b: a | b, [F.contains(m, F.lit(g)) | F.contains(F.lit(g), m) for g in group])
    return F.exists(metrics, lambda m: (m != "") & fits(m))


def period(plain: Column) -> Column:
    return (
        F.when(plain.rlike(r"cuoi nam|cuoi ky|31\s*/\s*12|31\s+thang\s+12"), "ending")
        .when(plain.rlike(r"dau nam|dau ky|(?<![0-9])0?1\s*/\s*0?1(?![0-9])|1\s+thang\s+1"), "beginning")
        .when(plain.rlike("nam truoc|ky truoc"), "prior")
        .when(plain.rlike("nam nay|ky nay"), "current")
        .otherwise("same_period")
    )


def plan_slots(routed: DataFrame, key: str) -> DataFrame:
    """One row a slot (F1..Fn, 24 at most a question): ticker, year, metric, role, period_role, family, missing, truncated.

    routed: key, question, tickers, years, metric, op, output_type. A question that words a family gets its
    components; else the parts of an explicit ratio; else its metric. ``missing`` names quantities that the
    question asks for and no slot has: such a plan is not grounded. A question without entities or years
    has a null in their place; one without a metric has no slot.
    """
    c, plain = F.col, norm(F.col("question"))
    fallback = F.when((c("op") == "count") | (c("output_type") == "count"), "filter").when((c("op") == "ranking") | (c("output_type") == "year"), "rank").otherwise("value")
    metric = F.when(c("output_type") == "count", F.coalesce(counted_metric(plain), norm(c("metric")))).otherwise(norm(c("metric")))
    ratio = split_ratio(F.regexp_replace(metric, r"^(?:gia tri )?trung binh\s+(?:ty le\s+)?", ""))
    component = lambda m, role, family: F.struct(m.alias("metric"), role.alias("role"), F.lit(0).alias("offset"), F.lit(family).alias("family"))
    df = routed.select("*", plain.alias("__plain"), components(plain).alias("__families"), metric.alias("__metric"), ratio.alias("__ratio"))
    parts = (
        F.when(F.size("__families") > 0, c("__families"))
        .when(F.size("__ratio") == 2, F.array(component(F.get("__ratio", F.lit(0)), F.lit("numerator"), "explicit_ratio"), component(F.get("__ratio", F.lit(1)), F.lit("denominator"), "explicit_ratio")))
        .otherwise(F.filter(F.array(component(c("__metric"), fallback, "routed_fact")), lambda x: x["metric"] != ""))
    )
    following = F.when(c("__plain").rlike("nam sau nam|nam tiep theo"), 1).otherwise(0)
    df = df.withColumn("__parts", parts).withColumn("__next", following)
    df = df.withColumn("__missing", missing_leaves(c("__plain"), F.transform("__parts", lambda x: x["metric"])))
    one = lambda a, kind: F.when(F.size(F.coalesce(a, F.array().cast(f"array<{kind}>"))) > 0, a).otherwise(F.array(F.lit(None).cast(kind)))

    def slot(ticker, year, x):
        offset = x["offset"] * c("__next")
        role = F.when(offset > 0, "next_period").when(x["family"] == "routed_fact", period(c("__plain"))).otherwise("same_period")
        return F.struct(ticker.alias("ticker"), (year + offset).alias("year"), x["metric"].alias("metric"), x["role"].alias("role"), role.alias("period_role"), x["family"].alias("family"))

    grid = F.flatten(F.transform(one(c("tickers"), "string"), lambda t: F.flatten(F.transform(one(c("years").cast("array<int>"), "int"), lambda y: F.transform("__parts", lambda x: slot(t, y, x))))))
    df = df.withColumn("__slots", _first_of(grid, "ticker", "year", "metric", "role", "period_role"))
    rows = df.select(key, c("__missing").alias("missing"), (F.size("__slots") > MAX_SLOTS).alias("truncated"), F.posexplode(F.slice("__slots", 1, MAX_SLOTS)).alias("at", "s"))
    return rows.select(key, F.concat(F.lit("F"), (c("at") + 1).cast("string")).alias("slot"), "s.*", "missing", "truncated")
