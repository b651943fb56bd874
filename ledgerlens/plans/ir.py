"""Typed expression programs over facts, compiled to Columns.

A program is JSON: {"facts": {"F1": {"type": "money"}, ...}, "bindings": {name: node}, "root": node,
"output": type}. A node is {"fact": name}, {"var": name}, {"lit": number} or {"op": name, "args": [...]},
for projections also "when": [...]. Facts are columns of a one-row-per-question frame. A program that
breaks a rule is rejected with a stable reason code; nothing of it runs.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens import config
from ledgerlens.functions.text import MONEY_UNITS

NUMERIC = {"money", "number", "ratio", "percent", "percentage_point", "count", "year"}


class Rejected(ValueError):
    """A program that fails a check; ``code`` is its reason code."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}")
        self.code = code


@dataclass(frozen=True)
class Typed:
    column: Column
    type: str
    constant: float | None = None


#: Literals that need no ground.
FREE_LITERALS = (-1.0, 0.0, 1.0, 2.0, 100.0)


def numbers_in(text: str) -> list[float]:
    """Numbers of a text, each as it can be read: 1.234.567 and 1,234,567 as grouped, 1.5 and 1,5 as decimals, 1.500 as both."""
    found = []
    for sign, digits in re.findall(r"(?<![\d.,])([-+]?)(\d+(?:[.,]\d+)*)", text):
        marks, parts = re.findall("[.,]", digits), re.split("[.,]", digits)
        grouped = len(set(marks)) < 2 and all(len(p) == 3 for p in parts[1:])
        readings = {float("".join(parts))} if grouped else set()
        if marks and marks.count(marks[-1]) == 1 and len(set(marks[:-1])) < 2:  # the last mark may be the decimal one
            readings.add(float("".join(parts[:-1]) + "." + parts[-1]))
        found += [x if s != "-" else -x for x in readings for s in ("+", sign)]
    return found


def literal_grounded(value: float, question: str, kind: str = "number") -> bool:
    """Whether a literal is a number of the question, or an amount of money that stands there with its unit."""
    known = list(numbers_in(question))
    if kind == "money":
        plain = "".join(c for c in unicodedata.normalize("NFD", question.lower()) if not unicodedata.combining(c))
        units = "|".join(sorted((u.replace(" ", r"\s+") for u in MONEY_UNITS), key=len, reverse=True))
        for shown, unit in re.findall(rf"(?<![\d.,])([-+]?\d+(?:[.,]\d+)*)\s*({units})(?![0-9a-z])", plain):
            known += [x * MONEY_UNITS[" ".join(unit.split())] for x in numbers_in(shown)]
    return value in FREE_LITERALS or any(math.isclose(value, x, rel_tol=1e-12, abs_tol=1e-9) for x in known)


def _same(args: list[Typed]) -> str:
    kinds = {a.type for a in args if a.constant != 0}
    if len(kinds) > 1:
        raise Rejected("type_error", f"{sorted(kinds)} do not mix")
    return kinds.pop() if kinds else "number"


def _product(a: str, b: str) -> str:
    plain = {"number", "ratio", "count"}
    if a in plain or b in plain:
        return b if a in plain else a
    raise Rejected("type_error", f"{a} x {b}")


def _quotient(a: str, b: str) -> str:
    if a == b:
        return "ratio"
    if b in ("number", "ratio", "count"):
        return a
    raise Rejected("type_error", f"{a} / {b}")


def _divide(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def _median(cols: list[Column]) -> Column:
    s, n = F.array_sort(F.array(*cols)), len(cols)
    return F.get(s, F.lit(n // 2)) if n % 2 else (F.get(s, F.lit(n // 2 - 1)) + F.get(s, F.lit(n // 2))) / 2


class Compiler:
    """``question``: where it is given, literals must be grounded in it."""

    def __init__(self, program: str | dict, question: str | None = None):
        self.question = question
        try:
            self.program = json.loads(program) if isinstance(program, str) else program
            self.facts, self.bindings, self.root = self.program["facts"], self.program.get("bindings", {}), self.program["root"]
        except (ValueError, KeyError, TypeError) as e:
            raise Rejected("schema_error", str(e)) from e
        for name, fact in self.facts.items():
            if not isinstance(fact, dict) or fact.get("type", "money") not in NUMERIC:
                raise Rejected("schema_error", name)
        self.done: dict[str, Typed] = {}
        self.open: list[str] = []
        self.used: set[str] = set()
        self.nodes = 0

    def compile(self, scale: Column | None = None) -> Typed:
        """``scale``: what money and plain numbers are divided by before they are rounded."""
        out = self.node(self.root, 0)
        if unused := set(self.facts) - self.used:
            raise Rejected("grounding_error", f"unused {sorted(unused)}")
        want = self.program.get("output", out.type)
        if scale is not None and out.type in ("money", "number"):
            out = Typed(out.column / scale, out.type)
        if (out.type, want) in (("ratio", "percent"), ("ratio", "percentage_point")):
            out = Typed(out.column * 100, want)
        elif out.type == "bool" or out.type != want and not {out.type, want} <= {"number", "money", "ratio", "count"}:
            raise Rejected("output_type_error", f"{out.type} is not {want}")
        return Typed(F.round(out.column, 2) + 0.0, want)  # no negative zero

    def node(self, node, depth: int) -> Typed:
        self.nodes += 1
        if self.nodes > config.MAX_NODES or depth > config.MAX_DEPTH:
            raise Rejected("limit_error")
        if not isinstance(node, dict):
            raise Rejected("schema_error", repr(node))
        if "fact" in node:
            if node["fact"] not in self.facts:
                raise Rejected("grounding_error", node["fact"])
            self.used.add(node["fact"])
            return Typed(F.col(node["fact"]), self.facts[node["fact"]].get("type", "money"))
        if "lit" in node:
            if isinstance(node["lit"], bool) or not isinstance(node["lit"], (int, float)) or not math.isfinite(node["lit"]):
                raise Rejected("schema_error", "literal")
            if self.question is not None and not literal_grounded(float(node["lit"]), self.question, node.get("type", "number")):
                raise Rejected("grounding_error", f"literal {node['lit']}")
            return Typed(F.lit(float(node["lit"])), node.get("type", "number"), float(node["lit"]))
        if "var" in node:
            return self.name(node["var"], depth)
        if "op" in node:
            return self.op(node, depth)
        raise Rejected("schema_error", repr(node))

    def name(self, name: str, depth: int) -> Typed:
        if name in self.open:
            raise Rejected("binding_error", f"cycle at {name}")
        if name not in self.bindings:
            raise Rejected("binding_error", name)
        if name not in self.done:
            self.open.append(name)
            self.done[name] = self.node(self.bindings[name], depth + 1)
            self.open.pop()
        return self.done[name]

    def op(self, node: dict, depth: int) -> Typed:
        op = node["op"]
        if op in ("argmax_project", "argmin_project"):
            return self.projection(node, depth)
        args = [self.node(a, depth + 1) for a in node.get("args", ())]
        cols = [a.column for a in args]

        def need(least: int, most: int | None = None):
            if len(args) < least or len(args) > (least if most is None else most):
                raise Rejected("operation_error", f"{op} takes {least}")

        if op in ("and", "or", "not"):
            need(1 if op == "not" else 2, 1 if op == "not" else 99)
            if any(a.type != "bool" for a in args):
                raise Rejected("type_error", op)
            return Typed(~cols[0] if op == "not" else reduce(lambda a, b: a & b if op == "and" else a | b, cols), "bool")
        if op == "if_else":
            need(3)
            if args[0].type != "bool":
                raise Rejected("type_error", "condition")
            return Typed(F.when(cols[0], cols[1]).otherwise(cols[2]), _same(args[1:]))
        if op == "count_true":
            need(1, 99)
            if any(a.type != "bool" for a in args):
                raise Rejected("type_error", op)
            return Typed(reduce(lambda a, b: a + b, [c.cast("int").cast("double") for c in cols]), "count")
        if any(a.type == "bool" for a in args):
            raise Rejected("type_error", f"{op} of a condition")
        if op in ("gt", "ge", "lt", "le", "eq", "ne"):
            need(2)
            _same(args)
            a, b = cols
            return Typed({"gt": a > b, "ge": a >= b, "lt": a < b, "le": a <= b, "eq": a == b, "ne": a != b}[op], "bool")
        if op in ("sum", "add", "average", "min", "max", "median"):
            need(1 if op != "add" else 2, 99)
            kind, total = _same(args), reduce(lambda a, b: a + b, cols)
            value = {"average": total / len(cols), "min": F.array_min(F.array(*cols)), "max": F.array_max(F.array(*cols)), "median": _median(cols)}.get(op, total)
            return Typed(value, kind)
        if op in ("lookup", "abs", "negate"):
            need(1)
            return Typed({"lookup": cols[0], "abs": F.abs(cols[0]), "negate": -cols[0]}[op], args[0].type)
        if op == "power":
            need(2)
            if args[1].constant is None or abs(args[1].constant) > 8 or args[0].type not in ("number", "ratio"):
                raise Rejected("operation_error", op)
            return Typed(F.pow(*cols), args[0].type)
        need(3 if op == "cagr" else 2)
        a, b = cols[0], cols[1]
        if op in ("divide", "ratio", "growth_percent") and args[1 if op != "growth_percent" else 0].constant == 0:
            raise Rejected("operation_error", "division by zero")
        if op in ("subtract", "difference"):
            return Typed(a - b, "percentage_point" if {x.type for x in args} == {"percent"} else _same(args))
        if op == "multiply":
            return Typed(a * b, _product(args[0].type, args[1].type))
        if op in ("divide", "ratio"):
            return Typed(_divide(a, b), _quotient(args[0].type, args[1].type))
        if op == "growth_percent":  # base, end
            _same(args)
            return Typed(_divide(b - a, F.abs(a)) * 100, "percent")
        if op == "cagr":  # base, end, years
            if args[2].constant is None or not 1 <= args[2].constant <= 30:
                raise Rejected("grounding_error", "years")
            return Typed(F.when((a > 0) & (b > 0), (F.pow(b / a, F.lit(1.0) / cols[2]) - 1) * 100), "percent")
        if op == "percentage_point":
            kind = _same(args)
            return Typed((a - b) * (100 if kind == "ratio" else 1), "percentage_point")
        if op in ("apply_percent", "increase_percent", "decrease_percent"):
            part = a * b / 100
            return Typed({"apply_percent": part, "increase_percent": a + part, "decrease_percent": a - part}[op], args[0].type)
        raise Rejected("operation_error", op)

    def projection(self, node: dict, depth: int) -> Typed:
        """Result that stands beside the extreme score; filtered by "when"; the first of ties; null if none is left."""
        scores = [self.node(a, depth + 1) for a in node.get("scores", ())]
        results = [self.node(a, depth + 1) for a in node.get("results", ())]
        when = [self.node(a, depth + 1) for a in node.get("when", ())]
        if len(scores) < 2 or len(scores) != len(results) or (when and len(when) != len(scores)):
            raise Rejected("operation_error", node["op"])
        if any(w.type != "bool" for w in when):
            raise Rejected("type_error", "when")
        _same(scores)
        sign = 1 if node["op"] == "argmax_project" else -1
        items = [F.struct((sign * s.column).alias("s"), F.lit(-i).alias("p"), r.column.alias("r")) for i, (s, r) in enumerate(zip(scores, results))]
        if when:
            items = [F.when(w.column, x) for w, x in zip(when, items)]
        return Typed(F.array_max(F.filter(F.array(*items), lambda x: x.isNotNull() & x["s"].isNotNull()))["r"], _same(results))


def answer(facts: DataFrame, program: str | dict, keys: list[str]) -> DataFrame:
    """keys, answer and status of one program over a frame with a column per fact."""
    try:
        compiled = Compiler(program).compile()
    except Rejected as e:
        return facts.select(*keys, F.lit(None).cast("double").alias("answer"), F.lit(e.code).alias("status"))
    return facts.select(*keys, compiled.column.alias("answer")).withColumn("status", F.when(F.col("answer").isNull(), "execution_failed").otherwise("ok"))


def answer_first(facts: DataFrame, samples: list, keys: list[str], question: str | None = None) -> DataFrame:
    """keys, answer, status, sample and trace: the first of some programs that gives a row an answer.

    The trace has (sample, reason) up to the accepted one: the reason code of a rejected program,
    execution_failed or ok.
    """
    tried = []
    for i, program in enumerate(samples, 1):
        try:
            value = Compiler(program, question).compile().column
            tried.append((i, value, F.when(value.isNull(), "execution_failed").otherwise("ok")))
        except Rejected as e:
            tried.append((i, F.lit(None).cast("double"), F.lit(e.code)))
    attempts = F.array(*(F.struct(F.lit(i).alias("sample"), reason.alias("reason"), value.alias("value")) for i, value, reason in tried)) if tried else F.array().cast("array<struct<sample:int,reason:string,value:double>>")
    df = facts.select(*keys, attempts.alias("a")).withColumn("hit", F.get(F.filter("a", lambda x: x["reason"] == "ok"), F.lit(0)))
    seen = F.filter("a", lambda x: x["sample"] <= F.coalesce(F.col("hit.sample"), F.lit(len(samples))))
    last = F.coalesce(F.get(F.transform("a", lambda x: x["reason"]), F.size("a") - 1), F.lit("no_samples"))
    trace = F.transform(seen, lambda x: F.struct(x["sample"].alias("sample"), x["reason"].alias("reason")))
    return df.select(*keys, F.col("hit.value").alias("answer"), F.coalesce(F.col("hit.reason"), last).alias("status"), F.col("hit.sample").alias("sample"), trace.alias("trace"))


def pivot_facts(cells: DataFrame, keys: list[str], slot: str, value: str, slots: list[str]) -> DataFrame:
    """One row per question with a column for each slot; a slot with more or less than one cell is null."""
    one = [F.when(F.count_if(F.col(slot) == s) == 1, F.max(F.when(F.col(slot) == s, F.col(value)))).alias(s) for s in slots]
    return cells.groupBy(*keys).agg(*one)
