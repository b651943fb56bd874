"""Registered queries of nested programs, candidate cuts, resolvers and answer checks, each beside its SQL.

Importing this module adds them to the catalog.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import fuzzy, text
from ledgerlens.operators import evidence, lineage, serialize
from ledgerlens.plans import ir
from ledgerlens.plans.catalog import _CELLS, QUERIES, SQL, _facts, _program_facts, _status, f, op, query, t

_YEARS = 4
_NAMES = ("revenue", "discount", "tax")
_WIDE = _CELLS + """, ranked as (select *, row_number() over (partition by entity order by year) as i from cells),
  p as (select entity, """ + ", ".join(f"max({m}) filter (i = {i}) as {m}_{i}" for m in _NAMES for i in range(1, _YEARS + 1)) + " from ranked group by entity)"
_R, _D, _T = ([f(f"{m}_{i}") for i in range(1, _YEARS + 1)] for m in _NAMES)


def _leaves(node) -> set[str]:
    if isinstance(node, dict):
        return ({node["fact"]} if "fact" in node else set()).union(*map(_leaves, node.values()))
    return set().union(*map(_leaves, node)) if isinstance(node, list) else set()


def _shape(name: str, root: dict, output: str, sql: str, **bindings) -> None:
    """A program over the first four years of each nation; its facts are the leaves it names."""
    program = {"facts": _facts(*sorted(_leaves(root) | _leaves(bindings))), "bindings": bindings, "root": root, "output": output}

    def run(spark, d):
        return ir.answer(_program_facts(spark, d, list(_NAMES), _YEARS), program, ["entity"])

    QUERIES[name], SQL[name] = run, f"with {_WIDE} {_status(sql)}"


def _pick(best: str, scores: list[str], results: list[str], when: list[str] | None = None) -> str:
    """SQL: the result beside the extreme score, the first of ties."""
    rows = ", ".join(f"{{'s': case when {w} then {s} end, 'p': {-i}, 'r': {r}}}" for i, (s, r, w) in enumerate(zip(scores, results, when or ["true"] * len(scores))))
    sign = "" if best == "max" else "-"
    return f"(list_sort([{{'s': {sign}x.s, 'p': x.p, 'r': x.r}} for x in [{rows}] if x.s is not null], 'desc')[1]).r"


def _y(pattern: str, *years: int) -> list[str]:
    """SQL of a pattern for some years: {i} is the year, {b} the one before."""
    return [pattern.format(i=i, b=i - 1) for i in years]


def _project(best: str, scores: list, results: list, when: list | None = None) -> dict:
    return {"op": f"arg{best}_project", "scores": scores, "results": results} | ({"when": when} if when else {})


_dr, _tr = [op("divide", a, b) for a, b in zip(_D, _R)], [op("divide", a, b) for a, b in zip(_T, _R)]
_grow = lambda xs, i, j: op("growth_percent", xs[i], xs[j])
_g = lambda m, a, b: f"case when {m}_{a} <> 0 then ({m}_{b} - {m}_{a}) / abs({m}_{a}) * 100 end"
_mean = lambda *xs: op("average", *xs)
_zero = {"lit": 0}

_shape("shape_improving_above_median", op("count_true", *(op("and", op("gt", _dr[i], _dr[i - 1]), op("gt", _dr[i], {"var": "m"})) for i in (1, 2))), "count",
       " + ".join(f"(discount_{i} / revenue_{i} > discount_{i - 1} / revenue_{i - 1} and discount_{i} / revenue_{i} > list_aggregate([{', '.join(_y('discount_{i} / revenue_{i}', 1, 2, 3))}], 'median'))::int::double" for i in (2, 3)), m=op("median", *_dr[:3]))
_shape("shape_filter_argmin_rescale", op("divide", _project("min", _tr[:3], _R[:3], [op("gt", d, x) for d, x in zip(_dr[:3], _tr)]), {"lit": 1000}), "money",
       _pick("min", _y("tax_{i} / revenue_{i}", 1, 2, 3), _y("revenue_{i}", 1, 2, 3), _y("discount_{i} / revenue_{i} > tax_{i} / revenue_{i}", 1, 2, 3)) + " / 1000")
_shape("shape_margin_difference", _project("max", [op("subtract", d, x) for d, x in zip(_dr, _tr)], [op("divide", x, d) for x, d in zip(_T, _D)]), "ratio",
       _pick("max", _y("discount_{i} / revenue_{i} - tax_{i} / revenue_{i}", 1, 2, 3, 4), _y("tax_{i} / discount_{i}", 1, 2, 3, 4)))
_shape("shape_return_on_average", _project("max", [op("divide", _T[i], _mean(_R[i - 1], _R[i])) for i in (1, 2, 3)], [op("divide", _R[i], {"lit": 1.1}) for i in (1, 2, 3)]), "money",
       _pick("max", _y("tax_{i} / ((revenue_{b} + revenue_{i}) / 2)", 2, 3, 4), _y("revenue_{i} / 1.1::double", 2, 3, 4)))
_members, _mg = (_R, _D, _T), [_grow(x, 0, 1) for x in (_R, _D, _T)]
_shape("shape_above_median_growth", op("divide", op("sum", *(op("if_else", op("gt", g, {"var": "m"}), x[1], _zero) for g, x in zip(_mg, _members))), _project("max", _mg, [x[1] for x in _members])), "ratio",
       "(" + " + ".join(f"case when {_g(m, 1, 2)} > list_aggregate([{', '.join(_g(n, 1, 2) for n in _NAMES)}], 'median') then {m}_2 else 0 end" for m in _NAMES) + ") / " + _pick("max", [_g(m, 1, 2) for m in _NAMES], [f"{m}_2" for m in _NAMES]), m=op("median", *_mg))
_low = [op("lt", _T[i], _D[i]) for i in (1, 2, 3)]
_shape("shape_conditional_accrual", op("divide", op("sum", *(op("if_else", c, op("divide", op("subtract", _D[i], _T[i]), _mean(_R[i - 1], _R[i])), _zero) for i, c in zip((1, 2, 3), _low))), op("count_true", *_low)), "ratio",
       "(" + " + ".join(_y("case when tax_{i} < discount_{i} then (discount_{i} - tax_{i}) / ((revenue_{b} + revenue_{i}) / 2) else 0 end", 2, 3, 4)) + ") / nullif(" + " + ".join(_y("(tax_{i} < discount_{i})::int::double", 2, 3, 4)) + ", 0)")
_shape("shape_filtered_minimum", _project("min", _R, _R, [op("gt", d, x) for d, x in zip(_dr, _tr)]), "money",
       _pick("min", _y("revenue_{i}", 1, 2, 3, 4), _y("revenue_{i}", 1, 2, 3, 4), _y("discount_{i} / revenue_{i} > tax_{i} / revenue_{i}", 1, 2, 3, 4)))
_shape("shape_argmax_other_metric", _project("max", _D, _T), "money", _pick("max", _y("discount_{i}", 1, 2, 3, 4), _y("tax_{i}", 1, 2, 3, 4)))
_shape("shape_argmax_growth_of_other", _project("max", _R[1:], [_grow(_D, i - 1, i) for i in (1, 2, 3)]), "percent",
       _pick("max", _y("revenue_{i}", 2, 3, 4), [_g("discount", i - 1, i) for i in (2, 3, 4)]))
_shape("shape_argmax_coverage", _project("max", _dr, [op("divide", r, x) for r, x in zip(_R, _T)]), "ratio", _pick("max", _y("discount_{i} / revenue_{i}", 1, 2, 3, 4), _y("revenue_{i} / tax_{i}", 1, 2, 3, 4)))
_held = [op("and", *(op("gt", x, _zero) for x in xs)) for xs in (_D, _T)]
_score = [_mean(*xs) for xs in (_dr, _tr)]
_shape("shape_positive_all_years", _project("max", _score, _score, _held), "percent",
       _pick("max", *[[f"({' + '.join(_y(m + '_{i} / revenue_{i}', 1, 2, 3, 4))}) / 4" for m in ("discount", "tax")]] * 2, [" and ".join(_y(m + "_{i} > 0", 1, 2, 3, 4)) for m in ("discount", "tax")]) + " * 100")
_up = [op("gt", _R[i], _R[i - 1]) for i in (1, 2, 3)]
_shape("shape_mean_change_of_growing", op("divide", op("sum", *(op("if_else", c, op("percentage_point", _dr[i], _dr[i - 1]), _zero) for i, c in zip((1, 2, 3), _up))), op("count_true", *_up)), "percentage_point",
       "(" + " + ".join(_y("case when revenue_{i} > revenue_{b} then (discount_{i} / revenue_{i} - discount_{b} / revenue_{b}) * 100 else 0 end", 2, 3, 4)) + ") / nullif(" + " + ".join(_y("(revenue_{i} > revenue_{b})::int::double", 2, 3, 4)) + ", 0)")
_days = [op("divide", op("multiply", {"lit": 365}, _mean(_D[i - 1], _D[i])), op("abs", _R[i])) for i in (1, 2, 3)]
_day = "365 * ((discount_{b} + discount_{i}) / 2) / abs(revenue_{i})"
_shape("shape_argmax_of_change", _project("max", [op("subtract", _days[i], _days[i - 1]) for i in (1, 2)], [op("percentage_point", _tr[i], _tr[i - 1]) for i in (2, 3)]), "percentage_point",
       _pick("max", [f"{_y(_day, i)[0]} - {_y(_day, i - 1)[0]}" for i in (3, 4)], _y("(tax_{i} / revenue_{i} - tax_{b} / revenue_{b}) * 100", 3, 4)))
_shape("ir_power", op("power", _dr[0], {"lit": 2}), "ratio", "pow(discount_1 / revenue_1, 2)")

_FIRST_VALID = [
    "not json",
    {"facts": _facts("revenue_1"), "root": op("multiply", _R[0], {"lit": 3.5}), "output": "money"},  # 3.5 is not in the question
    {"facts": _facts("revenue_1", "revenue_2"), "root": _project("max", _R[:2], _R[:2], [op("gt", _R[0], _R[1]), op("lt", _R[0], _zero)]), "output": "money"},
    {"facts": _facts("revenue_2"), "root": op("multiply", _R[1], {"lit": 3}), "output": "money"},
]


@query(f"""with {_WIDE} select entity, round(case when revenue_1 > revenue_2 then revenue_1 else revenue_2 * 3 end, 2) as answer, 'ok' as status,
case when revenue_1 > revenue_2 then 3 else 4 end as sample, case when revenue_1 > revenue_2 then 'schema_error,grounding_error,ok' else 'schema_error,grounding_error,execution_failed,ok' end as trace from p""")
def first_valid_sample(spark, d):
    out = ir.answer_first(_program_facts(spark, d, ["revenue"], 2), _FIRST_VALID, ["entity"], "Doanh thu gấp 3 lần là bao nhiêu?")
    return out.withColumn("trace", F.array_join(F.transform("trace", lambda x: x["reason"]), ","))


@query("select p_brand, p_partkey from part qualify row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) <= 75")
def candidates_precut(spark, d):
    return evidence.pre_cut(t(spark, d, "part"), ["p_brand"], "p_retailprice", "p_partkey", 25).select("p_brand", "p_partkey")


@query("""with c as (select o_custkey as q, month(o_orderdate) as fact, o_totalprice as s, o_orderkey as k from orders),
n as (select q, count(distinct fact) as facts, greatest(6, least(count(distinct fact), 24)) as n from c group by q),
r as (select *, row_number() over (partition by q, fact order by s desc, k) <= greatest(1, n // facts) as own from c join n using (q)),
o as (select *, row_number() over (partition by q order by own desc, case when own then fact end nulls last, s desc, k) as rank from r)
select q, fact::int as fact, k, row_number() over (partition by q order by fact, s desc, k) as place from o where rank <= n""")
def shortlist_per_fact(spark, d):
    o = t(spark, d, "orders").select(F.col("o_custkey").alias("q"), F.month("o_orderdate").alias("fact"), F.col("o_totalprice").alias("s"), F.col("o_orderkey").alias("k"))
    return evidence.fact_quota(o, "q", "fact", "s", "k", 6).select("q", "fact", "k", F.col("place").cast("long").alias("place"))


@query("""with c as (select *, case when o_orderpriority like '1%' then 1e9 else 1 end as scale from orders)
select o_orderkey from c qualify not (scale >= 1e6 and o_totalprice * 4 < 1e6) or bool_and(scale >= 1e6 and o_totalprice * 4 < 1e6) over (partition by o_custkey)""")
def magnitude_filter(spark, d):
    scale = F.when(F.col("o_orderpriority").startswith("1"), 1e9).otherwise(1.0)
    return evidence.magnitude_sane(t(spark, d, "orders"), "o_custkey", F.col("o_totalprice") * 4, scale).select("o_orderkey")


@query()
def cell_finder(spark, d):
    p = t(spark, d, "part")
    cells = p.select(F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("label"), F.col("p_size").alias("scope"))
    asked = p.filter("p_partkey % 20 = 0").select(F.concat_ws(" ", "p_type", "p_name").alias("query"), F.col("p_size").alias("scope"))  # the stated query set
    return evidence.find_cells(cells, asked, ["scope"], 10).withColumn("rank", F.col("rank").cast("long"))


@query("""with w as (select distinct o_custkey, o_orderpriority from orders where o_custkey % 3 = 0), n as (select o_custkey, o_orderpriority, count(*) as n, min(o_orderkey) as o_orderkey from orders where o_orderstatus <> 'P' group by all)
select o_custkey, o_orderpriority, case when n is null then 'missing' when n > 1 then 'duplicate' else 'ok' end as status, case when n = 1 then n.o_orderkey end as o_orderkey from w left join n using (o_custkey, o_orderpriority)""")
def exact_cell_lookup(spark, d):
    o = t(spark, d, "orders")
    keys = ["o_custkey", "o_orderpriority"]
    return evidence.exactly_one(o.filter("o_orderstatus <> 'P'").select(*keys, "o_orderkey"), o.filter("o_custkey % 3 = 0"), keys)


@query("""with c as (select l_orderkey, l_linenumber, l_partkey, year(l_shipdate) as y, l_quantity as label_score, unnest([0, 1, 2, 3]) as col from lineitem),
h as (select *, case col when 0 then null when 1 then case when l_linenumber % 2 = 0 then 40.0 else 0.0 end when 2 then 30.0 else -30.0 end - 0.01 * col as points from c),
b as (select * from h where points is not null qualify row_number() over (partition by l_orderkey, l_linenumber, l_partkey, label_score, y order by points desc, col) = 1)
select l_orderkey, l_linenumber, l_partkey, col, round(label_score + points, 4) as score from b qualify row_number() over (partition by l_orderkey order by round(label_score + points, 4) desc, l_linenumber, l_partkey, label_score, y) = 1""")
def row_resolver(spark, d):
    own = F.when(F.col("l_linenumber") % 2 == 0, F.year("l_shipdate").cast("string")).otherwise("khac")
    headers = F.array(F.lit("Mã số"), F.concat(F.lit("Năm "), own), F.lit("Số cuối năm"), F.lit("Số đầu năm"))
    cells = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.year("l_shipdate").alias("y"), F.col("l_quantity").alias("label_score"), F.posexplode(headers).alias("col", "col_name"))
    return evidence.best_by_row(cells, ["l_orderkey"], ["l_linenumber", "l_partkey", "label_score", "y"], "label_score", "y").select("l_orderkey", "l_linenumber", "l_partkey", "col", "score")


@query("""select o_orderkey, case when o_orderkey % 4 = 0 and lower(o_orderstatus) = 'f' then 'foreign_currency_usd' when o_orderkey % 4 = 1 and o_totalprice > 100000 then 'ownership_percentage' end as kind from orders""")
def direct_aliases(spark, d):
    usd, odd = F.col("o_orderkey") % 4 == 0, F.col("o_orderkey") % 4 == 1
    metric = F.when(usd, "Ngoại tệ USD").when(odd, "Tỷ lệ sở hữu của Alpha").otherwise("Doanh thu thuần")
    label = F.when(usd & (F.col("o_orderstatus") == "F"), "Đô la Mỹ (USD)").when(usd, "Đồng Euro").otherwise("Công ty Alpha")
    header = F.when(F.col("o_totalprice") > 100000, "Tỷ lệ lợi ích (%)").otherwise("Giá trị")
    kind = evidence.direct_alias(metric, label, header, F.lit("Thuyết minh"), F.when(usd, "number").otherwise("percent"))
    return t(spark, d, "orders").select("o_orderkey", kind.alias("kind"))


@query("""select event_id, event_type = 'error' and user_id % 2 = 0 and value < 50 as gone from events""")
def structural_none(spark, d):
    source = F.when(F.col("event_type") == "error", " None ").otherwise("rule")
    status = F.when(F.col("user_id") % 2 == 0, "FAILED").otherwise("ok")
    written = F.when(F.col("value") < 25, "0.0").when(F.col("value") < 50, F.lit(None)).otherwise("df1.value.iloc[0] * 0")
    return t(spark, d, "events").select("event_id", evidence.placeholder(source, status, F.lit(0.0), written).alias("gone"))


@query("""select event_id, value is null or value < 78 as weak, (value is null or value < 78) and coalesce(value, 0) < 60 as first from (select event_id, case when user_id % 5 > 0 then value end as value from events)""")
def model_targets(spark, d):
    known = F.when(F.col("user_id") % 5 > 0, F.col("value"))
    weak = evidence.still_wanted("weak", known.isNotNull(), known)
    return t(spark, d, "events").select("event_id", weak.alias("weak"), (evidence.still_wanted("weak", known.isNotNull(), known, True) & (F.coalesce(known, F.lit(0.0)) < 60)).alias("first"))


@query("""select c_custkey, ([1.0, 1e6, 1e9])[1 + ('0x' || sha256('scale|s|' || c_custkey || '|' || c_mktsegment)[1:8])::bigint % 3]::double as scale from customer""")
def scale_by_hash(spark, d):
    return t(spark, d, "customer").select("c_custkey", evidence.requested_scale("s", "c_custkey", "c_mktsegment").alias("scale"))


@query(r"""select doc_id, left(t, 200) as preview, length(t)::int as chars, length(t) > 200 as cut, sha256(coalesce(text, '')) as sha256 from (select doc_id, text, regexp_replace(coalesce(text, ''), '[\x00-\x08\x0b\x0c\x0e-\x1f]', '�', 'g') as t from documents)""")
def trace_text(spark, d):
    return t(spark, d, "documents").select("doc_id", evidence.bounded_text(F.col("text"), 200).alias("x")).select("doc_id", "x.*")


@query("""select count(*) as rows, count(*) filter (n > 0) as nonempty, count(*) filter (n = 0) as empty, count(*) filter (good) as good, min(chars) as chars_min, median(chars) as chars_median, max(chars) as chars_max,
min(took) as took_min, median(took) as took_median, max(took) as took_max, round(sum(took), 3) as took_total from (select length(text) % 7 as n, length(text)::bigint as chars, (doc_id % 100 / 4.0)::double as took, lang = 'en' as good from documents where text is not null)""")
def shortlist_report(spark, d):
    x = t(spark, d, "documents").filter("text is not null").select((F.length("text") % 7).alias("n"), F.length("text").cast("long").alias("chars"), (F.col("doc_id") % 100 / 4).alias("took"), (F.col("lang") == "en").alias("good"))
    return evidence.shortlist_audit(x, "n", "chars", "took", ["good"])


@query("""select l_orderkey, l_linenumber, l_partkey, l_discount <= 0.05 as recovered from lineitem""")
def forensic_cells(spark, d):
    li = t(spark, d, "lineitem")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice"]
    tidy = li.filter("l_discount > 0.05").select(*keys, F.lit("10").alias("code"))
    return evidence.dropped_cells(li.filter("l_discount <= 0.05").select(*keys), tidy, keys).select("l_orderkey", "l_linenumber", "l_partkey", "recovered")


@query("""select count(*) as n, count(*) filter (l_linenumber = 1) as right, count(*) filter (l_linenumber = 2 and l_extendedprice >= 2) as ratio_mistakes from lineitem""")
def answer_accuracy(spark, d):
    given = F.when(F.col("l_linenumber") == 1, F.col("l_extendedprice")).when(F.col("l_linenumber") == 2, F.col("l_extendedprice") / 100).otherwise(F.lit(-5.0))
    return evidence.ratio_mistakes(t(spark, d, "lineitem"), given, F.col("l_extendedprice"), F.lit("percent"))


@query("""select o_orderkey, case o_orderkey % 4 when 0 then 'df1,df2' when 1 then 'df1' when 2 then '' else '' end as used,
case o_orderkey % 4 when 1 then 'unknown_table' when 2 then 'no_table' when 3 then 'invalid_syntax' else '' end as errors,
concat_ws(',', case when o_orderkey % 4 = 2 then 'dead_table' end, case when o_totalprice > 10000 then 'large_percent' end) as warnings from orders""")
def answer_lineage(spark, d):
    code = F.element_at(F.array(*map(F.lit, ("(df1.iloc[0, 2] - df2.iloc[0, 2]) * 100", "x = df1\ny = x.sum()\nanswer = y", "x = df2\nanswer = 0", "answer = (")), ), (F.col("o_orderkey") % 4 + 1).cast("int"))
    there = F.when(F.col("o_orderkey") % 4 == 1, F.array(F.lit("df2"))).otherwise(F.array(F.lit("df1"), F.lit("df2")))
    o = t(spark, d, "orders").select("o_orderkey", "o_totalprice", code.alias("code"), there.alias("there"))
    out = lineage.check_answers(o, "code", "there", "o_totalprice", F.lit("percent"))
    return out.select("o_orderkey", *(F.array_join(c, ",").alias(c) for c in ("used", "errors", "warnings")))


@query(r"""select p_partkey, regexp_replace(lower(p_type || p_brand), '[^0-9a-z]', '', 'g') as compact, case when ltrim(p_size::varchar, '0') = '' then '0' else ltrim(p_size::varchar, '0') end as code from part""")
def label_keys(spark, d):
    padded = F.concat(F.lit("00"), F.col("p_size").cast("string"), F.lit(".0"))
    return t(spark, d, "part").select("p_partkey", text.compact(F.concat_ws(" ", "p_type", "p_brand")).alias("compact"), text.canonical_code(padded).alias("code"))
