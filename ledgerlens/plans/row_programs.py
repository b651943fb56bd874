"""Registered queries of programs as a column: every order has its own program text over the prices of its lines.

Importing this module adds them to the catalog.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.plans import rows
from ledgerlens.plans.catalog import f, op, query, t

#: Stands for a number that differs from row to row.
K = "@k@"
_P, _Q = [f(f"p{i}") for i in (1, 2, 3)], [f(f"q{i}") for i in (1, 2, 3)]


def _named(x) -> set[str]:
    if isinstance(x, dict):
        return ({x["fact"]} if "fact" in x else set()).union(*map(_named, x.values()))
    return set().union(*map(_named, x)) if isinstance(x, list) else set()


def _text(root: dict, output: str | None = None, facts: dict | None = None, **bindings) -> str:
    named = {n: {"type": "money" if n[0] == "p" else "number"} for n in sorted(_named(root) | _named(bindings))}
    made = {"facts": named | (facts or {}), "bindings": bindings, "root": root} | ({"output": output} if output else {})
    return re.sub(f'"({K}[0-9.]*)"', r"\1", json.dumps(made))


def _lit(kind: str = "number", shown: str = K) -> dict:
    return {"lit": shown, "type": kind}


def _deep(n: int) -> dict:
    return op("abs", _deep(n - 1)) if n else _P[0]


_ratio = lambda a, b: op("divide", a, b)
_mean = "((p1 + p2 + p3) / 3)"
_third = 0.3333333
#: (program text, SQL of its value or null, SQL of its reason code or null)
SHAPES = [
    (_text(op("lookup", _P[0])), "p1", None),
    (_text(op("add", *_P[:2])), "p1 + p2", None),
    (_text(op("subtract", *_P[:2]), "money"), "p1 - p2", None),
    (_text(op("multiply", _P[0], _lit())), "p1 * k", None),
    (_text(_ratio(*_P[:2]), "percent"), "case when p2 <> 0 then p1 / p2 end * 100", None),
    (_text(op("growth_percent", *_P[:2])), "case when p1 <> 0 then (p2 - p1) / abs(p1) * 100 end", None),
    (_text(op("growth_percent", _P[1], _P[0])), None, "case when p1 is not null and p2 is not null then 'period_error' else 'execution_failed' end"),
    (_text(op("cagr", _P[0], _P[2], {"lit": 2})), "case when p1 > 0 and p3 > 0 then (pow(p3 / p1, 1.0 / 2) - 1) * 100 end", None),
    (_text(op("cagr", *_P[:2], {"lit": 9})), None, "case when p1 is not null and p2 is not null then 'period_error' when p1 > 0 and p2 > 0 then null else 'execution_failed' end"),
    (_text(op("average", *_P)), _mean, None),
    (_text(op("median", *_P)), "case when p1 is not null and p2 is not null and p3 is not null then list_aggregate([p1, p2, p3], 'median') when num_nulls = 1 then greatest(p1, p2, p3) end", None),
    (_text(op("subtract", op("max", *_P), op("min", *_P))), "greatest(p1, p2, p3) - least(p1, p2, p3)", None),
    (_text(op("count_true", op("gt", *_P[:2]), op("le", _P[0], _lit("money", f"{K}000")))), "(p1 > p2)::int + (p1 <= k * 1000)::int", None),
    (_text(op("if_else", op("ge", *_P[:2]), op("multiply", _P[0], _lit()), _P[1])), "case when p1 >= p2 then p1 * k else p2 end", None),
    (_text({"op": "argmax_project", "scores": _P, "results": _Q}), "(list_sort([x for x in [{'s': p1, 'p': 0, 'r': q1}, {'s': p2, 'p': -1, 'r': q2}, {'s': p3, 'p': -2, 'r': q3}] if x.s is not null], 'desc')[1]).r", None),
    (_text({"op": "argmin_project", "scores": _Q[:2], "results": _P[:2], "when": [op("gt", _P[0], _lit("money", f"{K}000")), op("gt", *_P[:2])]}), "(list_sort([x for x in [{'s': case when p1 > k * 1000 then -q1 end, 'p': 0, 'r': p1}, {'s': case when p1 > p2 then -q2 end, 'p': -1, 'r': p2}] if x.s is not null], 'desc')[1]).r", None),
    (_text(op("percentage_point", _ratio(_P[1], _P[2]), _ratio(_P[0], _P[2]))), "(case when p3 <> 0 then p2 / p3 end - case when p3 <> 0 then p1 / p3 end) * 100", None),
    (_text(op("increase_percent", _P[0], _lit("percent", f"{K}.3333333"))), f"p1 + p1 * (k + {_third}::double) / 100", None),
    (_text(op("add", op("abs", op("subtract", _P[0], {"var": "m"})), op("abs", op("subtract", _P[1], {"var": "m"}))), m=op("average", *_P)), f"abs(p1 - {_mean}) + abs(p2 - {_mean})", None),
    (_text(op("if_else", op("and", op("lt", *_P[:2]), op("not", op("eq", *_Q[:2]))), _Q[0], op("multiply", _Q[1], _lit()))), "case when p1 < p2 and not q1 = q2 then q1 else q2 * k end", None),
    (_text(op("power", _ratio(*_P[:2]), {"lit": 2})), "pow(case when p2 <> 0 then p1 / p2 end, 2)", None),
    ("Here it is:\n```json\n" + _text(op("negate", op("multiply", _P[0], _lit()))) + "\n```", "-(p1 * k)", None),
    (_text(op("add", *_P[:2]), facts={"p1": {"type": "money", "entity": "A"}}), "p1 + p2", "case when e1 <> 'A' then 'entity_error' end"),
    (_text(_P[1], facts={"p2": {"type": "money", "period": 2001}}), None, "case when p2 is not null then 'period_error' else 'execution_failed' end"),
    (_text(_P[0])[:-1] + f', "k": {K}', None, "'parse_error'"),
    (f"I can not tell ({K}).", None, "'parse_error'"),
    (_text(op("add", _P[0], _Q[0])), None, "'type_error'"),
    (_text(op("sum", op("gt", *_P[:2]), _P[0])), None, "'type_error'"),
    (_text(op("sum", _P[0])).replace('"fact": "p1"', f'"fact": "p{K}"'), None, "'grounding_error'"),
    (_text(_P[0], facts={"p2": {"type": "money"}}), None, "'grounding_error'"),
    (_text(op("sum", _P[0], {"var": "a"}), a={"var": "b"}, b=op("abs", {"var": "a"})), None, "'binding_error'"),
    (_text(op("subtract", *_P)), None, "'operation_error'"),
    (_text(op("divide", _P[0], {"lit": 0})), None, "'operation_error'"),
    (_text(op("root_of", *_P[:2])), None, "'operation_error'"),
    (_text(op("add", *_P[:2]), "year"), None, "'output_type_error'"),
    (_text(op("gt", *_P[:2])), None, "'output_type_error'"),
    (_text(_deep(20)), None, "'limit_error'"),
    (json.dumps({"root": {"op": "none"}, "why": f"line {K}"}), None, "'model_none'"),
    (_text({"args": [_P[0], _lit()]}), None, "'schema_error'"),
]


def _programs(orders: DataFrame, shape) -> DataFrame:
    """o_orderkey, program: the text of a shape with the row's own number."""
    texts = F.array(*(F.lit(x) for x, _, _ in SHAPES))
    number = F.col("o_orderkey") % 97 + 3
    return orders.select("o_orderkey", F.replace(F.get(texts, (shape % len(SHAPES)).cast("int")), F.lit(K), number.cast("string")).alias("program"))


def _cells(spark, d) -> DataFrame:
    """Price and quantity of each line as facts of its order; the line's number is its period, its flag the entity."""
    li = t(spark, d, "lineitem")
    fact = lambda name, value: F.struct(F.concat(F.lit(name), F.col("l_linenumber").cast("string")).alias("slot"), F.col(value).alias("value"))
    cells = li.select(F.col("l_orderkey").alias("o_orderkey"), (2000 + F.col("l_linenumber")).alias("period"), F.col("l_returnflag").alias("entity"), F.explode(F.array(fact("p", "l_extendedprice"), fact("q", "l_quantity"))).alias("x"))
    return cells.select("o_orderkey", "x.slot", "x.value", "period", "entity")


_LINE = lambda i, x: f"case when count(*) filter (l_linenumber = {i}) = 1 then max({x}) filter (l_linenumber = {i}) end"
_FACTS = "cells as (select o_orderkey, o_orderkey % 97 + 3 as k, o_orderkey as shape, count(l_orderkey) as n, " + ", ".join(f"{_LINE(i, x)} as {name}{i}" for name, x in (("p", "l_extendedprice"), ("q", "l_quantity"), ("e", "l_returnflag")) for i in (1, 2, 3)) + " from orders left join lineitem on l_orderkey = o_orderkey group by all), facts as (select *, (p1 is null)::int + (p2 is null)::int + (p3 is null)::int as num_nulls from cells)"


def _case(i: str) -> str:
    """SQL: value and reason code of the shape with this number, as columns of ``facts``."""
    values = " ".join(f"when {at} then {v}" for at, (_, v, _) in enumerate(SHAPES) if v)
    codes = " ".join(f"when {at} then {c}" for at, (_, _, c) in enumerate(SHAPES) if c)
    return f"case {i} {values} end as x, case when n = 0 then 'no_candidates' else case {i} {codes} end end as code"


_STATUS = "case when code is null then round(x, 2) + 0.0 end as answer, coalesce(code, case when x is null then 'execution_failed' else 'ok' end) as status"
_N = len(SHAPES)


@query(f"with {_FACTS}, a as (select o_orderkey, {_case(f'(o_orderkey % {_N})')} from facts) select o_orderkey, {_STATUS} from a")
def program_per_row(spark, d):
    """Each order's own program: shape, literals and text differ from row to row."""
    samples = _programs(t(spark, d, "orders"), F.col("o_orderkey")).withColumn("sample", F.lit(1))
    return rows.attempts(samples, _cells(spark, d), "o_orderkey").select("o_orderkey", "answer", "status")


def _samples(spark, d) -> DataFrame:
    o = t(spark, d, "orders")
    return _programs(o, F.col("o_orderkey") + 24).withColumn("sample", F.lit(1)).unionByName(_programs(o, F.col("o_orderkey") + 31).withColumn("sample", F.lit(2))).unionByName(_programs(o, F.col("o_orderkey") + 5).withColumn("sample", F.lit(3)))


_TRIED = _FACTS + ", a as (" + " union all ".join(f"select o_orderkey, {s} as sample, {_case(f'((o_orderkey + {by}) % {_N})')} from facts" for s, by in ((1, 24), (2, 31), (3, 5))) + f"), tried as (select o_orderkey, sample, {_STATUS} from a)"
_FIRST = "select o_orderkey, min(sample) filter (status = 'ok') as sample, arg_min(answer, sample) filter (status = 'ok') as answer, case when bool_or(status = 'ok') then 'ok' else arg_max(status, sample) end as status from tried group by o_orderkey"


@query(f"with {_TRIED}, first as ({_FIRST}) select first.*, trace from first join (select t.o_orderkey, string_agg(case when t.sample > f.sample then 'not_evaluated_after_acceptance' else t.status end, ',' order by t.sample) as trace from tried t join first f on t.o_orderkey = f.o_orderkey group by t.o_orderkey) using (o_orderkey)")
def program_samples(spark, d):
    """Three saved replies for each order, replayed: the first that answers, and what became of each."""
    tried = rows.attempts(_samples(spark, d), _cells(spark, d), "o_orderkey")
    shown = F.array_join(F.transform("trace", lambda x: x["status"]), ",")
    return rows.replayed(tried, "o_orderkey").select("o_orderkey", "sample", "answer", "status", shown.alias("trace"))


@query(f"with {_TRIED}, first as ({_FIRST}), was as (select o_orderkey, status as was from tried where sample = 1) select was, status as now, count(*) as questions from was join first using (o_orderkey) group by was, now")
def replay_transitions(spark, d):
    """From the status of the first reply alone to that of all replies."""
    tried = rows.attempts(_samples(spark, d), _cells(spark, d), "o_orderkey")
    # each order has a first reply, so what it gave alone stands beside the answer of all
    return rows.replayed(tried, "o_orderkey").groupBy(F.col("alone").alias("was"), F.col("status").alias("now")).agg(F.count(F.lit(1)).alias("questions"))


# --- units, scales and routed questions

_SHARE = op("divide", _P[0], _Q[0])
#: (program text, unit asked or null, SQL of its value, SQL of the reason code of its units)
UNIT_SHAPES = [
    (_text(op("add", *_P[:2])), "vnd", "s1 + s2", "case when c1 <> c2 or coalesce(c1, c2) <> 'vnd' then 'unit_error' end"),
    (_text(_ratio(*_P[:2]), "percent"), None, "case when s2 <> 0 then s1 / s2 end * 100", "case when c1 <> c2 then 'unit_error' end"),
    (_text(_SHARE), "vnd / share", "case when q1 <> 0 then s1 / q1 end", "case when c1 <> 'vnd' then 'unit_error' end"),
    (_text(op("multiply", _SHARE, _Q[1])), "vnd", "case when q1 <> 0 then s1 / q1 end * q2", "case when c1 <> 'vnd' and q2 is not null then 'unit_error' end"),
    (_text(op("if_else", op("gt", *_P[:2]), op("multiply", _P[0], {"lit": 2}), _P[1])), "vnd", "case when s1 > s2 then s1 * 2 else s2 end", "case when c1 <> c2 or coalesce(c1, c2) <> 'vnd' then 'unit_error' end"),
    (_text(op("average", _P[0], _SHARE)), None, "s1", "case when c1 is not null then 'unit_error' end"),
    (_text(op("power", _ratio(*_P[:2]), {"lit": 2})), None, "pow(case when s2 <> 0 then s1 / s2 end, 2)", "case when c1 <> c2 then 'unit_error' end"),
    (_text({"op": "argmax_project", "scores": _Q[:2], "results": _P[:2]}), None, "case when q1 >= q2 or q2 is null then s1 else s2 end", "case when c1 <> c2 then 'unit_error' end"),
    (_text(op("growth_percent", *_P[:2])), None, "case when s1 <> 0 then (s2 - s1) / abs(s1) * 100 end", "case when c1 <> c2 then 'unit_error' end"),
    (_text(op("subtract", _P[0], {"lit": 0, "type": "money"})), "vnd", "s1", "case when c1 <> 'vnd' then 'unit_error' end"),
]
_U = len(UNIT_SHAPES)
_SEVERAL = [at for at, (text, *_) in enumerate(UNIT_SHAPES) if '"p2"' in text]
_SECOND = [at for at, (text, *_) in enumerate(UNIT_SHAPES) if '"p2"' in text or '"q2"' in text]
_in = lambda ats: f"shape in ({', '.join(map(str, ats))})"
_scale = "pow(10, l_partkey % 3 * 3)"
_over = "(l_suppkey % 2 = 0 and l_suppkey % 5 = 0 and l_partkey % 4 < 2)"
_fault = f"case when l_suppkey % 2 = 0 and l_suppkey % 5 = 0 then {_scale} <> 1 and not {_over} or {_scale} = 1 and {_over} else l_suppkey % 17 = 0 end"
_cur = "case when l_returnflag = 'R' then 'usd' else 'vnd' end"
_label = "case when l_partkey % 3 = 0 then 'no' else 'tai' end"


@query(f"""with lines as (select *, l_extendedprice * case when {_over} then 1 else {_scale} end as s, {_cur} as c, {_fault} as x, {_label} as label from lineitem),
facts as (select o_orderkey, o_orderkey % {_U} as shape, count(l_orderkey) as n, {", ".join(f"{_LINE(i, e)} as {name}{i}" for i in (1, 2) for name, e in (("s", "s"), ("q", "l_quantity"), ("c", "c"), ("x", "x"), ("l", "label")))} from orders left join lines on l_orderkey = o_orderkey group by all),
a as (select o_orderkey, shape, case shape {" ".join(f"when {i} then {v}" for i, (_, _, v, _) in enumerate(UNIT_SHAPES))} end / case when shape in (1, 6, 8) then 1 else 1000 end as x,
case when n = 0 then 'no_candidates' when o_orderkey % 30 >= 20 and shape <> 7 then 'operation_error' when x1 and (shape <> 7) then 'unit_provenance_error'
 when x2 and {_in(_SEVERAL)} and shape <> 7 then 'unit_provenance_error' when shape = 7 and (x1 or x2) then 'unit_provenance_error'
 when shape = 5 and c1 is not null then 'unit_error' when shape in (0, 1, 4, 7, 8) and c1 <> c2 then case when shape = 1 then null else 'unit_error' end end as early,
case when o_orderkey % 7 = 0 and (l1 is not null or ({_in(_SECOND)} and l2 is not null)) and (coalesce(l1, 'no') = 'no' or ({_in(_SECOND)} and coalesce(l2, 'no') = 'no')) then 'metric_anchor_error' end as anchor,
case when o_orderkey % 11 = 0 then 'output_type_error' end as no_scale, case shape {" ".join(f"when {i} then {c}" for i, (_, _, _, c) in enumerate(UNIT_SHAPES))} end as other from facts),
b as (select o_orderkey, x, coalesce(early, anchor, no_scale, other) as code from a)
select o_orderkey, {_STATUS} from b""")
def program_units(spark, d):
    """Each order's program over prices of two currencies and three scales: units inferred, scales traced, routes held to."""
    o, li = t(spark, d, "orders"), t(spark, d, "lineitem")
    at = lambda values: F.get(F.array(*map(F.lit, values)), (F.col("o_orderkey") % _U).cast("int"))
    samples = o.select("o_orderkey", F.lit(1).alias("sample"), at([x for x, *_ in UNIT_SHAPES]).alias("program"))
    route = o.select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 30 >= 20, "ranking").otherwise("lookup").alias("op"),
        F.when(F.col("o_orderkey") % 7 == 0, "Tổng tài sản là bao nhiêu?").otherwise("Giá là bao nhiêu?").alias("question"),
        at([u for _, u, *_ in UNIT_SHAPES]).alias("unit"),
        F.when(F.col("o_orderkey") % 11 == 0, 0.0).otherwise(1000.0).alias("unit_scale"),
    )
    stored, over = F.pow(F.lit(10.0), F.col("l_partkey") % 3 * 3), F.expr(_over)
    ends, sticky = F.col("l_suppkey") % 5 == 0, F.col("l_suppkey") % 2 == 0
    fact = lambda name, value, unit, scale: F.struct(F.concat(F.lit(name), F.col("l_linenumber").cast("string")).alias("slot"), F.col(value).alias("value"), unit.alias("unit"), scale.alias("unit_scale"), F.lit(name == "p").alias("money"))
    cells = li.select(
        F.col("l_orderkey").alias("o_orderkey"),
        (2000 + F.col("l_linenumber")).alias("period"),
        F.when(F.col("l_partkey") % 3 == 0, "Nợ").otherwise("Tổng cộng tài sản").alias("label"),
        F.lit("tài sản").alias("metric"),
        F.explode(F.array(fact("p", "l_extendedprice", F.expr(_cur), F.when(over, 1.0).otherwise(stored)), fact("q", "l_quantity", F.lit("share"), F.lit(1.0)))).alias("f"),
        # a scale of another number than the stored one, unexplained, on every 17th
        F.when(over, stored).otherwise(F.when((F.col("l_suppkey") % 17 == 0) & ~(ends & sticky), stored + 1).otherwise(stored)).alias("stored"),
        F.when(sticky, "sticky").otherwise("explicit").alias("unit_source"),
        F.when(over, "terminal_vnd").when(sticky, "sticky").otherwise("explicit").alias("effective_source"),
        F.when(over, rows.OVERRIDE).otherwise("stored_unit").alias("resolution"),
        ends.alias("terminal"),
    )
    price = F.col("f.money")
    plain = lambda name, other: F.when(price, F.col(name)).otherwise(F.lit(other)).alias(name)
    facts = cells.select("o_orderkey", "f.slot", "f.value", "f.unit", "f.unit_scale", "period", "label", "metric", F.when(price, F.col("stored")).otherwise(1.0).alias("stored_scale"), plain("unit_source", "explicit"), plain("effective_source", "explicit"), plain("resolution", "stored_unit"), "terminal")
    return rows.attempts(samples, facts, "o_orderkey", route=route).select("o_orderkey", "answer", "status")
