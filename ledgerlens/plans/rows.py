"""Programs as a column: every row has its own typed program, and all are evaluated by one plan.

``parse`` reads program texts in Arrow batches and writes each as a list of steps in the order in which they are
evaluated (children before their operation; a binding where it is first named, then saved and loaded). ``attempts``
joins the facts that the programs name and folds over the steps with a stack of typed cells, in Spark's own
expressions: types, literals and reporting periods are inferred beside the values, so a program that breaks a
rule ends with its reason code and no program needs a plan, a job or Python of its own.

Reason codes, in the order in which they are looked for: ``no_candidates`` (no facts at all), ``parse_error`` or
``generation_truncated`` (no program in the text), ``model_none``, then the first of ``schema_error``,
``limit_error``, ``grounding_error``, ``binding_error``, ``unit_provenance_error``, ``operation_error``, ``type_error``,
``unit_error``, ``period_error`` that the steps meet, ``metric_anchor_error``, ``output_type_error``, ``unit_error`` of the
result, ``entity_error`` and ``period_error`` of a fact that is not the one declared, ``execution_failed`` (no value). Else the
status is ``ok``. An ``operation_error`` of a routed operation comes before those of the steps.

Units are inferred beside the types where facts have a ``unit`` ("vnd", "vnd/share", "a*b/c"; empty: a plain number; null: not
known). Terms that are added, compared or chosen between must agree, factors multiply and cancel, and a result that is a
share, a percentage or a count may have none left. A literal agrees with any unit and counts as a plain number in
products. Values are in units of ``unit_scale``, so facts of different scales meet in the base unit.

A null text has no program. A slot with more or less than one cell of a question is null. Samples may repeat;
their order is that of their number, then of nothing else, so numbers should differ within a question.
"""

from __future__ import annotations

import json
import sys
from functools import reduce
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerlens import config
from ledgerlens.functions.text import norm
from ledgerlens.plans.ir import NUMERIC, literal_grounded

STEP = "struct<op:string,n:int,k:int,w:int,name:string,num:double,type:string>"
PARSED = f"code string, steps array<{STEP}>, declared array<struct<name:string,entity:string,period:int>>, output string"
CELL = "struct<v:double,t:string,c:double,p:int,u:array<string>>"
COMPARED, FOLDED = ("gt", "ge", "lt", "le", "eq", "ne"), ("sum", "add", "average", "min", "max", "median")
#: Least and most arguments of an operation; others take two.
_ARITY = {"and": (2, 99), "or": (2, 99), "not": (1, 1), "if_else": (3, 3), "count_true": (1, 99), "add": (2, 99), "cagr": (3, 3)} | {o: (1, 99) for o in FOLDED if o != "add"} | {o: (1, 1) for o in ("lookup", "abs", "negate")}
_KEPT_TEXTS = 4096
#: Name, wording that both the question and each label of a plan of one metric must have.
ANCHORS = (
    ("total_assets", r"\btong(?: cong)? tai san\b"),
    ("income_tax_payable", r"\bthue thu nhap(?: doanh nghiep)? phai nop\b"),
)
#: Routed operations whose facts are of one metric, and the name of a scale that gave way.
ONE_METRIC = ("lookup", "difference", "average", "growth", "growth_pct", "cagr", "ranking")
OVERRIDE = "terminal_bare_vnd_overrides_sticky"


class _Stop(Exception):
    """Ends the steps of a program with a reason code."""


# --- texts to steps


def programs_in(text: str):
    """JSON objects of a reply, from left to right."""
    decoder, at = json.JSONDecoder(), text.find("{")
    while at >= 0:
        try:
            found, end = decoder.raw_decode(text, at)
            yield found
        except (ValueError, RecursionError):
            end = at + 1
        at = text.find("{", end)


def steps_of(text: str | None, question: str | None = None) -> tuple[str | None, list[tuple], list[tuple], str | None]:
    """(reason code or null, steps, declared facts, output type) of the first program of a reply."""
    program = next((p for p in programs_in(text or "") if "root" in p or "facts" in p), None)
    if program is None:
        return "parse_error", [], [], None
    root, facts, bindings, output = program.get("root"), program.get("facts"), program.get("bindings", {}), program.get("output")
    if isinstance(root, dict) and root.get("op") == "none":
        return "model_none", [], [], None
    kinds_ok = isinstance(facts, dict) and all(isinstance(f, dict) and isinstance(f.get("type", "money"), str) and f.get("type", "money") in NUMERIC for f in facts.values())
    if "root" not in program or not kinds_ok or not isinstance(bindings, dict) or not (output is None or isinstance(output, str)):
        return "schema_error", [], [], None
    steps: list[tuple] = []
    saved: dict[str, int] = {}
    opened: list[str] = []
    used: set[str] = set()
    nodes = 0

    def stop(code: str):
        steps.append(("error", 0, 0, 0, code, None, None))
        raise _Stop

    def visit(node, depth: int) -> None:
        nonlocal nodes
        nodes += 1
        if nodes > config.MAX_NODES or depth > config.MAX_DEPTH:
            stop("limit_error")
        if not isinstance(node, dict):
            stop("schema_error")
        if "fact" in node:
            name = node["fact"]
            if not isinstance(name, str) or name not in facts:
                stop("grounding_error")
            used.add(name)
            steps.append(("fact", 0, 0, 0, name, None, facts[name].get("type", "money")))
        elif "lit" in node:
            value, kind = node["lit"], node.get("type", "number")
            if isinstance(value, bool) or not isinstance(value, (int, float)) or not abs(value) <= sys.float_info.max or not isinstance(kind, str):
                stop("schema_error")
            if question is not None and not literal_grounded(float(value), question, kind):
                stop("grounding_error")
            steps.append(("lit", 0, 0, 0, None, float(value), kind))
        elif "var" in node:
            name = node["var"]
            if not isinstance(name, str) or name in opened or name not in bindings:
                stop("binding_error")
            if name in saved:
                steps.append(("load", saved[name], 0, 0, None, None, None))
                return
            opened.append(name)
            visit(bindings[name], depth + 1)
            opened.pop()
            saved[name] = len(saved)
            steps.append(("save", 0, 0, 0, None, None, None))
        elif "op" in node:
            op, projects = str(node["op"]), node["op"] in ("argmax_project", "argmin_project")
            parts = [node.get(x, ()) for x in (("scores", "results", "when") if projects else ("args",))]
            if not all(isinstance(p, (list, tuple)) for p in parts):
                stop("schema_error")
            for p in parts:
                for a in p:
                    visit(a, depth + 1)
            least, most = (len(parts[0]), len(parts[2])) if projects else _ARITY.get(op, (2, 2))
            steps.append((op, sum(map(len, parts)), least, most, str(len(parts[1])) if projects else None, None, None))
        else:
            stop("schema_error")

    try:
        visit(root, 0)
        if set(facts) - used:
            stop("grounding_error")
    except _Stop:
        pass
    whole = lambda x: x if isinstance(x, int) and not isinstance(x, bool) and abs(x) < 1 << 31 else None
    declared = [(n, f.get("entity") if isinstance(f.get("entity"), str) else None, whole(f.get("period"))) for n, f in facts.items() if isinstance(n, str)]
    return None, steps, declared, output


_STEP_COLUMNS = (("op", pa.string()), ("n", pa.int32()), ("k", pa.int32()), ("w", pa.int32()), ("name", pa.string()), ("num", pa.float64()), ("type", pa.string()))
_DECLARED_COLUMNS = (("name", pa.string()), ("entity", pa.string()), ("period", pa.int32()))


def _lists(rows: list[list[tuple]], columns: tuple) -> pa.Array:
    """Lists of structs from lists of tuples."""
    ends = pa.array([0, *accumulate(map(len, rows))], pa.int32())
    flat = [x for row in rows for x in row]
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array([x[i] for x in flat], kind) for i, (_, kind) in enumerate(columns)], names=[n for n, _ in columns]))


def _parsed_rows(parsed: list[tuple]) -> pa.StructArray:
    """What ``steps_of`` gives for some texts, as the columns of ``PARSED``."""
    code, output = (pa.array([p[i] for p in parsed], pa.string()) for i in (0, 3))
    return pa.StructArray.from_arrays([code, _lists([p[1] for p in parsed], _STEP_COLUMNS), _lists([p[2] for p in parsed], _DECLARED_COLUMNS), output], names=["code", "steps", "declared", "output"])


def parse(samples: DataFrame, keys: list[str], program: str = "program", question: str | None = None) -> DataFrame:
    """keys, reason code, steps, declared facts and output type of each row's program text.

    ``question``: the column with the text in which literals must be grounded.
    """
    schema = StructType([*samples.select(*keys).schema, *StructType.fromDDL(PARSED)])

    def run(batches):
        # parsed texts stay as Arrow rows, and each row of a batch takes the one of its text
        place: dict = {}
        pool = _parsed_rows([])
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                texts = part.column(len(keys)).to_pylist()
                asked = part.column(len(keys) + 1).to_pylist() if question else [None] * len(texts)
                if len(place) > _KEPT_TEXTS:
                    place, pool = {}, _parsed_rows([])
                found = list(zip(texts, asked))
                fresh = [k for k in dict.fromkeys(found) if k not in place]
                if fresh:
                    place |= {k: len(pool) + i for i, k in enumerate(fresh)}
                    pool = pa.concat_arrays([pool, _parsed_rows([steps_of(t, (q or "") if question else None) for t, q in fresh])])
                made = pool.take(pa.array([place[k] for k in found], pa.int32())).flatten()
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keys)], *made], names=schema.names)

    return samples.select(*keys, program, *([question] if question else [])).mapInArrow(run, schema)


# --- the fold


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _at(xs: Column, i: int, field: str) -> Column:
    return F.get(xs, F.lit(i))[field]


def _kinds(cells: Column) -> Column:
    """Types that must agree: a literal zero agrees with any."""
    return F.array_distinct(F.transform(F.filter(cells, lambda x: x["c"].isNull() | (x["c"] != 0)), lambda x: x["t"]))


def unit_atoms(unit: Column) -> Column:
    """Sorted factors of a unit as written; those below the line have a minus before them."""
    sides = F.split(F.lower(F.replace(unit, F.lit(" "))), "/")
    above, below = F.split(F.get(sides, F.lit(0)), r"\*"), F.flatten(F.transform(F.slice(sides, F.lit(2), F.size(sides)), lambda x: F.split(x, r"\*")))
    return F.when(unit.isNotNull(), _cancelled(F.concat(F.filter(above, lambda x: ~x.isin("", "1")), F.transform(F.filter(below, lambda x: x != ""), lambda x: F.concat(F.lit("-"), x)))))


def _cancelled(atoms: Column) -> Column:
    """What is left of factors above and below the line, sorted."""
    times = lambda x: F.size(F.filter(atoms, lambda y: y == x))
    rest = lambda b: times(b) - times(F.concat(F.lit("-"), b))
    bases = F.array_distinct(F.transform(atoms, lambda x: F.regexp_replace(x, "^-", "")))
    left = F.flatten(F.transform(bases, lambda b: _let(rest(b), lambda n: F.array_repeat(F.when(n > 0, b).otherwise(F.concat(F.lit("-"), b)), F.abs(n)))))
    return F.array_sort(left)


def _below(atoms: Column) -> Column:
    return F.transform(atoms, lambda x: F.when(x.startswith("-"), F.substr(x, F.lit(2))).otherwise(F.concat(F.lit("-"), x)))


def _units(cells: Column) -> Column:
    """Units that must agree; unknown ones agree with any."""
    return F.array_distinct(F.filter(F.transform(cells, lambda x: x["u"]), lambda u: u.isNotNull()))


def unit_fault(has: list[str]) -> Column:
    """True where a fact's scale is no scale, or differs from the stored one without the one reason that allows it.

    A scale that was only carried on gives way to VND at the end of the context, and to nothing else; where it could
    have given way it must.
    """
    of = lambda name, default: F.coalesce(F.col(name), default) if name in has else default
    now = of("unit_scale", F.lit(1.0)).cast("double")
    stored = of("stored_scale", now).cast("double")
    source = of("unit_source", F.lit("unknown"))
    last, why, ends, context = of("effective_source", source), of("resolution", F.lit("stored_unit")), of("terminal", F.lit(False)), of("context_sha256", F.lit(""))
    is_scale = lambda x: ~F.isnan(x) & (x > 0) & (x < float("inf"))
    gave_way = (source == "sticky") & (last == "terminal_vnd") & ends & (stored != now) & (now == 1.0)
    as_stored = (stored == now) & ~((source == "sticky") & ends & (stored != 1.0))
    return ~(is_scale(now) & is_scale(stored) & ((context == "") | context.rlike(r"^[0-9a-f]{64}\z")) & F.when(why == OVERRIDE, gave_way).otherwise(as_stored))


def _double(condition: Column) -> Column:
    return condition.cast("int").cast("double")


def _all(v: Column) -> Column:
    return F.when(F.exists(v, lambda x: x == 0), 0.0).when(F.exists(v, lambda x: x.isNull()), F.lit(None)).otherwise(1.0)


def _any(v: Column) -> Column:
    return F.when(F.exists(v, lambda x: x == 1), 1.0).when(F.exists(v, lambda x: x.isNull()), F.lit(None)).otherwise(0.0)


def _total(v: Column) -> Column:
    return F.reduce(v, F.lit(0.0), lambda acc, x: acc + x)


def _apply(s: Column, a: Column, units: bool = False) -> Column:
    """struct<code, cell> of an operation s on its arguments a; ``units``: infer units too."""
    op, n, least, most = s["op"], s["n"], s["k"], s["w"]
    is_ = lambda *names: op.isin(*names)
    t0, t1, c0, c1, c2, p0, p1 = _at(a, 0, "t"), _at(a, 1, "t"), _at(a, 0, "c"), _at(a, 1, "c"), _at(a, 2, "c"), _at(a, 0, "p"), _at(a, 1, "p")
    kinds = _kinds(a)
    same = F.coalesce(F.get(kinds, F.lit(0)), F.lit("number"))
    differ = lambda cells: F.when(F.size(_units(cells)) > 1, "unit_error") if units else F.lit(None).cast("string")
    mixed = F.when(F.size(kinds) > 1, "type_error").otherwise(differ(a))
    bad, all_bool, has_bool = (n < least) | (n > most), F.forall(a, lambda x: x["t"] == "bool"), F.exists(a, lambda x: x["t"] == "bool")
    plain = lambda t: t.isin("number", "ratio", "count")
    # projections: scores, results, conditions
    scores, results, when = F.slice(a, F.lit(1), least), F.slice(a, least + 1, n - least - most), F.slice(a, n - most + 1, most)
    n_results = n - least - most
    project = is_("argmax_project", "argmin_project")
    of_projection = (
        F.when((least < 2) | (least != n_results) | ((most > 0) & (most != least)), "operation_error")
        .when(F.exists(when, lambda x: x["t"] != "bool") | (F.size(_kinds(scores)) > 1) | (F.size(_kinds(results)) > 1), "type_error")
        .otherwise(F.coalesce(differ(scores), differ(results)))
    )
    ordered = F.when((p0 >= p1) | (is_("cagr") & (c2 != p1 - p0)), "period_error")
    u0 = _at(a, 0, "u")
    has_unit = F.size(F.coalesce(u0, F.array())) > 0
    of_pair = (
        F.when(is_("power"), F.when(c1.isNull() | (F.abs(c1) > 8) | ~t0.isin("number", "ratio"), "operation_error").when(has_unit & ((c1 < 0) | (c1 != F.floor(c1))), "unit_error"))
        .when((is_("divide", "ratio") & (c1 == 0)) | (is_("growth_percent") & (c0 == 0)), "operation_error")
        .when(is_("subtract", "difference"), F.when(~F.forall(a, lambda x: x["t"] == "percent"), mixed))
        .when(is_("multiply"), F.when(~plain(t0) & ~plain(t1), "type_error"))
        .when(is_("divide", "ratio"), F.when((t0 != t1) & ~plain(t1), "type_error"))
        .when(is_("growth_percent"), F.coalesce(mixed, ordered))
        .when(is_("percentage_point"), mixed)
        .when(is_("cagr"), F.when(c2.isNull() | ~c2.between(1, 30), "grounding_error").otherwise(F.coalesce(differ(F.slice(a, F.lit(1), F.lit(2))), ordered)))
        .when(~is_("apply_percent", "increase_percent", "decrease_percent"), "operation_error")
    )
    code = (
        F.when(project, of_projection)
        .when(is_("and", "or", "not", "count_true"), F.when(bad, "operation_error").when(~all_bool, "type_error"))
        .when(is_("if_else"), F.when(bad, "operation_error").when((t0 != "bool") | (F.size(_kinds(F.slice(a, 2, 2))) > 1), "type_error").otherwise(differ(F.slice(a, 2, 2))))
        .when(has_bool, "type_error")
        .when(bad, "operation_error")
        .when(is_(*COMPARED, *FOLDED), mixed)
        .when(~is_("lookup", "abs", "negate"), of_pair)
    )
    kind = (
        F.when(project, F.coalesce(F.get(_kinds(results), F.lit(0)), F.lit("number")))
        .when(is_("and", "or", "not", *COMPARED), "bool")
        .when(is_("count_true"), "count")
        .when(is_("if_else"), F.coalesce(F.get(_kinds(F.slice(a, 2, 2)), F.lit(0)), F.lit("number")))
        .when(is_("growth_percent", "cagr"), "percent")
        .when(is_("percentage_point") | (is_("subtract", "difference") & F.forall(a, lambda x: x["t"] == "percent")), "percentage_point")
        .when(is_("subtract", "difference", *FOLDED), same)
        .when(is_("multiply"), F.when(plain(t0), t1).otherwise(t0))
        .when(is_("divide", "ratio"), F.when(t0 == t1, "ratio").otherwise(t0))
        .otherwise(t0)
    )
    plain_unit = F.array().cast("array<string>")
    factors = F.transform(a, lambda x: F.coalesce(x["u"], F.when(x["c"].isNotNull(), plain_unit)))
    f0, f1 = F.get(factors, F.lit(0)), F.get(factors, F.lit(1))
    agreed = lambda cells: F.get(_units(cells), F.lit(0))
    unit = (
        F.when(project, agreed(results))
        .when(is_("if_else"), agreed(F.slice(a, 2, 2)))
        .when(is_("subtract", "difference", *FOLDED), agreed(a))
        .when(is_("multiply"), _cancelled(F.concat(f0, f1)))
        .when(is_("divide", "ratio"), _cancelled(F.concat(f0, _below(f1))))
        .when(is_("power") & has_unit, F.array_sort(F.flatten(F.array_repeat(u0, c1.cast("int")))))
        .when(is_("lookup", "abs", "negate", "power", "apply_percent", "increase_percent", "decrease_percent"), u0)
        .otherwise(plain_unit)
        if units
        else F.lit(None).cast("array<string>")
    )
    sign = F.when(is_("argmax_project"), 1.0).otherwise(-1.0)
    held = lambda i: F.coalesce(F.get(when, i)["v"], F.when(most == 0, 1.0), F.lit(0.0))
    places = F.transform(F.sequence(F.lit(0), least - 1), lambda i: F.struct((sign * F.get(scores, i)["v"]).alias("s"), (-i).alias("p"), F.get(results, i)["v"].alias("r"), held(i).alias("w")))
    projected = F.array_max(F.filter(places, lambda x: (x["w"] == 1) & x["s"].isNotNull()))["r"]
    def valued(v: Column) -> Column:
        v0, v1, v2 = (F.get(v, F.lit(i)) for i in range(3))
        in_order = F.array_sort(v)
        middle = (n / 2).cast("int")
        median = F.when(n % 2 == 1, F.get(in_order, middle)).otherwise((F.get(in_order, middle - 1) + F.get(in_order, middle)) / 2)
        part = v0 * v1 / 100
        by_op = [
            ("and", _all(v)), ("or", _any(v)), ("not", 1 - v0), ("if_else", F.when(v0 == 1, v1).otherwise(v2)), ("count_true", _total(v)),
            ("gt", _double(v0 > v1)), ("ge", _double(v0 >= v1)), ("lt", _double(v0 < v1)), ("le", _double(v0 <= v1)), ("eq", _double(v0 == v1)), ("ne", _double(v0 != v1)),
            ("sum", _total(v)), ("add", _total(v)), ("average", _total(v) / n), ("min", F.array_min(v)), ("max", F.array_max(v)), ("median", median),
            ("lookup", v0), ("abs", F.abs(v0)), ("negate", -v0), ("power", F.pow(v0, v1)),
            ("subtract", v0 - v1), ("difference", v0 - v1), ("multiply", v0 * v1), ("divide", F.when(v1 != 0, v0 / v1)), ("ratio", F.when(v1 != 0, v0 / v1)),
            ("growth_percent", F.when(F.abs(v0) != 0, (v1 - v0) / F.abs(v0)) * 100),
            ("cagr", F.when((v0 > 0) & (v1 > 0), (F.pow(v1 / v0, F.lit(1.0) / v2) - 1) * 100)),
            ("percentage_point", (v0 - v1) * F.when(same == "ratio", 100.0).otherwise(1.0)),
            ("apply_percent", part), ("increase_percent", v0 + part), ("decrease_percent", v0 - part),
        ]
        return reduce(lambda c, x: c.when(op == x[0], x[1]), by_op, F.when(project, projected))

    value = _let(F.transform(a, lambda x: x["v"]), valued)
    periods = F.array_distinct(F.filter(F.transform(a, lambda x: x["p"]), lambda p: p.isNotNull()))
    return _let(code, lambda c: F.struct(c.alias("code"), F.struct(F.when(c.isNull(), value).alias("v"), kind.alias("t"), F.lit(None).cast("double").alias("c"), F.when(F.size(periods) == 1, F.get(periods, F.lit(0))).alias("p"), unit.alias("u")).cast(CELL).alias("cell")))


def fold(steps: Column, facts: Column, units: bool = False) -> Column:
    """struct<code, cell>: the first reason code that the steps meet, else the value of the program.

    ``facts``: map of slot to struct<v,p,u,x>, x a reason code why the fact can not be used.
    """
    none = F.array().cast(f"array<{CELL}>")
    state = f"struct<stack:array<{CELL}>,saved:array<{CELL}>,code:string>"
    start = F.struct(none.alias("stack"), none.alias("saved"), F.lit(None).cast("string").alias("code")).cast(state)
    null = lambda kind: F.lit(None).cast(kind)

    def step(st: Column, s: Column) -> Column:
        stack, saved, op = st["stack"], st["saved"], s["op"]
        fact = F.try_element_at(facts, s["name"])
        leaf = (
            F.when(op == "fact", F.struct(fact["v"].alias("v"), s["type"].alias("t"), null("double").alias("c"), fact["p"].alias("p"), fact["u"].alias("u")).cast(CELL))
            .when(op == "lit", F.struct(s["num"].alias("v"), s["type"].alias("t"), s["num"].alias("c"), null("int").alias("p"), null("array<string>").alias("u")).cast(CELL))
            .when(op == "load", F.get(saved, s["n"]))
        )
        pushed = F.struct(F.concat(stack, F.array(leaf)).alias("stack"), saved.alias("saved"), F.when(op == "fact", fact["x"]).alias("code")).cast(state)
        kept = F.struct(stack.alias("stack"), F.concat(saved, F.slice(stack, F.size(stack), F.lit(1))).alias("saved"), null("string").alias("code")).cast(state)
        failed = F.struct(none.alias("stack"), none.alias("saved"), s["name"].alias("code")).cast(state)
        done = _let(F.slice(stack, F.size(stack) - s["n"] + 1, s["n"]), lambda a: _let(_apply(s, a, units), lambda r: F.struct(F.concat(F.slice(stack, F.lit(1), F.size(stack) - s["n"]), F.array(r["cell"])).alias("stack"), saved.alias("saved"), r["code"].alias("code")).cast(state)))
        return F.when(st["code"].isNotNull(), st).when(op.isin("fact", "lit", "load"), pushed).when(op == "save", kept).when(op == "error", failed).otherwise(done)

    return F.reduce(steps, start, step, lambda st: F.struct(st["code"].alias("code"), F.get(st["stack"], F.lit(0)).alias("cell")))


# --- facts, attempts, answers


def named_facts(parsed: DataFrame, facts: DataFrame, qid: str) -> DataFrame:
    """qid, found (map slot -> value and period of the slots that programs name): one row for each question with facts.

    ``facts``: qid, slot, value, optionally entity, period, unit, label, metric and the columns of ``unit_fault``. Slots are counted before they meet, so a question
    may have any number of cells; the map has at most the slots that its programs name.
    """
    has = facts.columns
    extra = lambda name, kind: (F.max(name) if name in has else F.lit(None)).cast(kind)
    scale = F.max(F.coalesce(F.col("unit_scale"), F.lit(1.0)).cast("double")) if "unit_scale" in has else F.lit(1.0)
    wanted = F.col("slot").isNotNull()
    atoms = F.max(F.when(wanted, unit_atoms(F.col("unit")))) if "unit" in has else F.lit(None).cast("array<string>")
    fault = F.max(F.when(wanted & unit_fault(has), "unit_provenance_error")) if {"unit_scale", "stored_scale"} & set(has) else F.lit(None).cast("string")
    names = parsed.select(qid, F.col("declared.name").alias("names")).groupBy(qid).agg(F.array_distinct(F.flatten(F.collect_set("names"))).alias("names"))
    # dealt by question alone, so one exchange serves the join and both counts; slots that no program names count as one
    met = facts.join(names, qid, "left").withColumn("slot", F.when(F.array_contains("names", F.col("slot")), F.col("slot")))
    slots = met.groupBy(qid, "slot").agg(F.count(F.lit(1)).alias("cells"), (F.max("value").cast("double") * scale).alias("v"), extra("period", "int").alias("p"), extra("entity", "string").alias("e"), atoms.alias("u"), fault.alias("x"), extra("label", "string").alias("l"), extra("metric", "string").alias("m"))
    one = F.when(wanted, F.struct("slot", F.when(F.col("cells") == 1, F.struct("v", "p", "e", "u", "x", "l", "m")).alias("x")))
    return slots.groupBy(qid).agg(F.map_from_entries(F.collect_list(one)).alias("found"))


def attempts(samples: DataFrame, facts: DataFrame, qid: str, sample: str = "sample", program: str = "program", question: str | None = None, truncated: str | None = None, route: DataFrame | None = None) -> DataFrame:
    """qid, sample, answer and status of each row's program over the facts of its question.

    ``truncated``: a boolean column, true where a reply ended before its time. ``route``: qid and any of op (the routed
    operation: a ranking needs a projection at its root), question (with op: its anchors must be in the labels of
    facts of one metric), unit (the one that the answer must have) and unit_scale (what money and plain
    numbers are divided by; not a positive number is an ``output_type_error``). Of several rows of a question in the
    route the largest counts; a question without one is not held against it.
    """
    more = [truncated] if truncated else []
    parsed = parse(samples, [qid, sample, *more], program, question)
    rows = parsed.join(named_facts(parsed, facts, qid), qid, "left")
    units = "unit" in facts.columns
    rows = rows.withColumn("r", F.when(F.col("code").isNull(), fold(F.col("steps"), F.col("found"), units)))
    asked = {} if route is None else {n: k for n, k in (("op", "string"), ("question", "string"), ("unit", "string"), ("unit_scale", "double")) if n in route.columns}
    if asked:
        rows = rows.join(route.groupBy(qid).agg(F.max(F.struct(*(F.col(n).cast(k).alias(n) for n, k in asked.items()))).alias("route")), qid, "left")
    routed = lambda n, k: F.col(f"route.{n}") if n in asked else F.lit(None).cast(k)
    cell, want = F.col("r.cell"), F.coalesce("output", F.col("r.cell.t"))
    kind = cell["t"]
    to_percent = (kind == "ratio") & want.isin("percent", "percentage_point")
    loose = ("number", "money", "ratio", "count")
    out = F.when((kind == "bool") | ((kind != want) & ~to_percent & ~(kind.isin(*loose) & want.isin(*loose))), "output_type_error")
    bound = lambda d: F.try_element_at(F.col("found"), d["name"])
    root = F.element_at(F.filter("steps", lambda s: s["op"] != "save"), -1)["op"]
    first = F.when((routed("op", "string") == "ranking") & (F.size("steps") > 0) & ~root.isin("argmax_project", "argmin_project", "error"), "operation_error")
    metrics = F.array_distinct(F.filter(F.transform("declared", lambda d: norm(bound(d)["m"])), lambda m: m != ""))
    labels = F.transform("declared", lambda d: norm(bound(d)["l"]))
    lacks = lambda wording: F.exists(labels, lambda x: ~x.rlike(wording))
    missed = [norm(routed("question", "string")).rlike(wording) & lacks(wording) for _, wording in ANCHORS]
    anchor = F.when(routed("op", "string").isin(*ONE_METRIC) & (F.size(metrics) == 1) & reduce(lambda a, b: a | b, missed), "metric_anchor_error")
    scale = routed("unit_scale", "double")
    no_scale = F.when(F.isnan(scale) | (scale <= 0) | (scale == float("inf")), "output_type_error")
    free = (F.size(cell["u"]) > 0) & kind.isin("ratio", "percent", "percentage_point", "count", "year")
    other_unit = F.when(free | (cell["u"] != unit_atoms(routed("unit", "string"))), "unit_error") if units else F.lit(None).cast("string")
    other = F.when(F.exists("declared", lambda d: d["entity"] != bound(d)["e"]), "entity_error").when(F.exists("declared", lambda d: d["period"] != bound(d)["p"]), "period_error")
    early = F.when((F.col("code") == "parse_error") & F.col(truncated), "generation_truncated").otherwise(F.col("code")) if truncated else F.col("code")
    reason = F.coalesce(F.when(F.col("found").isNull(), "no_candidates"), early, first, F.col("r.code"), anchor, out, no_scale, other_unit, other)
    shown = cell["v"] / F.when(kind.isin("money", "number"), F.coalesce(F.when(scale > 0, scale), F.lit(1.0))).otherwise(1.0)
    value = F.round(F.when(to_percent, cell["v"] * 100).otherwise(shown), 2) + 0.0
    rows = rows.select(qid, sample, reason.alias("reason"), value.alias("value"))
    return rows.select(qid, sample, F.when(F.col("reason").isNull(), F.col("value")).alias("answer"), F.coalesce("reason", F.when(F.col("value").isNull(), "execution_failed"), F.lit("ok")).alias("status"))


def first_answers(tried: DataFrame, qid: str, sample: str = "sample") -> DataFrame:
    """qid, answer, status, sample: the first sample of a question that gives an answer, else the last one's reason."""
    ok = F.col("status") == "ok"
    hit = F.min(F.when(ok, F.struct(sample, "answer"))).alias("hit")
    found = tried.groupBy(qid).agg(hit, F.max(F.struct(sample, "status")).alias("last"))
    return found.select(qid, F.col("hit.answer").alias("answer"), F.when(F.col("hit").isNull(), F.col("last.status")).otherwise("ok").alias("status"), F.col(f"hit.{sample}").alias(sample))


def replayed(tried: DataFrame, qid: str, sample: str = "sample") -> DataFrame:
    """``first_answers`` with ``trace``, an array of (sample, status) as ``trace`` has them, and ``alone``, the status of the
    first sample: one pass over the attempts of a question, which are computed once."""
    x, ok = F.col("x"), F.filter("x", lambda r: r["status"] == "ok")
    found = tried.groupBy(qid).agg(F.array_sort(F.collect_list(F.struct(F.col(sample).alias("sample"), "answer", "status"))).alias("x"))
    found = found.withColumn("hit", F.get(ok, F.lit(0)))
    late = lambda r: F.coalesce(r["sample"] > F.col("hit.sample"), F.lit(False))
    shown = F.transform(x, lambda r: F.struct(r["sample"].alias("sample"), F.when(late(r), "not_evaluated_after_acceptance").otherwise(r["status"]).alias("status")))
    status = F.when(F.col("hit").isNull(), F.element_at("x", -1)["status"]).otherwise("ok")
    return found.select(qid, F.col("hit.answer").alias("answer"), status.alias("status"), F.col("hit.sample").alias(sample), shown.alias("trace"), F.get(x, F.lit(0))["status"].alias("alone"))


def trace(tried: DataFrame, qid: str, sample: str = "sample") -> DataFrame:
    """The attempts, those after the accepted one as ``not_evaluated_after_acceptance`` and without an answer."""
    first = F.min(F.when(F.col("status") == "ok", F.col(sample))).over(Window.partitionBy(qid))
    late = F.coalesce(F.col(sample) > first, F.lit(False))
    rows = tried.withColumn("late", late)
    return rows.select(qid, sample, F.when(~F.col("late"), F.col("answer")).alias("answer"), F.when(F.col("late"), "not_evaluated_after_acceptance").otherwise(F.col("status")).alias("status"))


def transitions(before: DataFrame, after: DataFrame, qid: str) -> DataFrame:
    """was, now, questions: how many questions went from one status to another when saved replies were replayed; null where one side lacks it."""
    b, a = before.select(qid, F.col("status").alias("was")), after.select(qid, F.col("status").alias("now"))
    return b.join(a, qid, "full").groupBy("was", "now").agg(F.count(F.lit(1)).alias("questions"))
