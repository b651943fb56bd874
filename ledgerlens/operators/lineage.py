"""Does a written answer depend on the tables it names? Names are read from its syntax tree; nothing is run."""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from ledgerlens import config

TABLE = re.compile(r"df[0-9]+")
_READ = StructType().add("used", ArrayType(StringType())).add("named", ArrayType(StringType())).add("error", StringType())
YEARS_AROUND = 1
#: Largest plausible sizes of answers; beyond them there is a warning.
LARGEST = {"percent": 10_000.0, "percentage_point": 10_000.0, "ratio": 1_000.0}


class _Flow:
    """Tables that each name depends on, statement by statement; where ways part, a name has what it has on any of them."""

    def __init__(self):
        self.has: dict[str, frozenset[str]] = {}

    def of(self, node: ast.AST | None) -> frozenset[str]:
        names = [n.id for n in ast.walk(node) if isinstance(n, ast.Name)] if node is not None else []
        return frozenset().union(*(self.has.get(n, frozenset([n]) if TABLE.fullmatch(n) else frozenset()) for n in names))

    def give(self, target: ast.AST, tables: frozenset[str]) -> None:
        """A name is set anew; a part of one (x.a, x[i]) adds to it; of a tuple, each."""
        if isinstance(target, ast.Name):
            self.has[target.id] = tables
        elif isinstance(target, (ast.Tuple, ast.List)):
            for x in target.elts:
                self.give(x, tables)
        elif isinstance(target, ast.Starred):
            self.give(target.value, tables)
        elif isinstance(target, (ast.Attribute, ast.Subscript)):
            inner = target.value
            while isinstance(inner, (ast.Attribute, ast.Subscript)):
                inner = inner.value
            if isinstance(inner, ast.Name):
                self.has[inner.id] = self.of(inner) | tables

    def ways(self, *blocks: list[ast.stmt]) -> None:
        """Any one of some blocks is run."""
        ends, start = [], self.has
        for block in blocks:
            self.has = dict(start)
            self.run(block)
            ends.append(self.has)
        own = lambda end, n: end.get(n, frozenset([n]) if TABLE.fullmatch(n) else frozenset())
        self.has = {n: frozenset().union(*(own(e, n) for e in ends)) for n in set().union(*ends)}

    def run(self, block: list[ast.stmt]) -> None:
        for s in block:
            if isinstance(s, ast.Assign):
                for target in s.targets:
                    self.give(target, self.of(s.value))
            elif isinstance(s, ast.AnnAssign) and s.value is not None:
                self.give(s.target, self.of(s.value))
            elif isinstance(s, ast.AugAssign):
                self.give(s.target, self.of(s.target) | self.of(s.value))
            elif isinstance(s, ast.If):
                self.ways(s.body, s.orelse)
            elif isinstance(s, (ast.For, ast.While)):
                while True:  # until another round adds nothing
                    before = dict(self.has)
                    if isinstance(s, ast.For):
                        self.ways([ast.Assign([s.target], s.iter), *s.body], [])
                    else:
                        self.ways(s.body, [])
                    if self.has == before:
                        break
                self.run(s.orelse)
            elif isinstance(s, ast.With):
                for x in s.items:
                    if x.optional_vars is not None:
                        self.give(x.optional_vars, self.of(x.context_expr))
                self.run(s.body)
            elif isinstance(s, ast.Try):
                self.ways(s.body + s.orelse, *(h.body for h in s.handlers))
                self.run(s.finalbody)


def tables_of(code: str) -> tuple[list[str], list[str]]:
    """(tables that the answer depends on, all tables named). An answer is an expression or what ``answer`` is last set to."""
    tree, flow = ast.parse(code), _Flow()
    named = {n.id for n in ast.walk(tree) if isinstance(n, ast.Name) and TABLE.fullmatch(n.id)}
    if len(tree.body) == 1 and isinstance(tree.body[0], ast.Expr):
        return sorted(flow.of(tree.body[0].value)), sorted(named)
    flow.run(tree.body)
    return sorted(flow.has.get("answer", ())), sorted(named)


@F.pandas_udf(_READ)
def _read(code: pd.Series) -> pd.DataFrame:
    out = []
    for c in code:
        try:
            out.append((*tables_of(c or ""), None))
        except (SyntaxError, ValueError, RecursionError):
            out.append(([], [], "invalid_syntax"))
    return pd.DataFrame(out, columns=["used", "named", "error"])


def check_answers(answers: DataFrame, code: str, available: str, answer: str, output_type: Column) -> DataFrame:
    """Adds used (tables), errors and warnings (reason codes in a fixed order) and ok to written answers."""
    df = answers.withColumn("__r", _read(F.col(code)))
    used, named, x = F.col("__r.used"), F.col("__r.named"), F.col(answer)
    whole = F.abs(x - F.round(x)) <= 1e-6
    found = F.col("__r.error").isNull()
    year = output_type == "year"
    in_range = F.round(x).between(config.FIRST_YEAR - YEARS_AROUND, config.LAST_YEAR + YEARS_AROUND)
    infinite = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    errors = [
        ("invalid_syntax", ~found),
        ("no_table", found & (F.size(used) == 0)),
        ("unknown_table", F.size(F.array_except(used, F.col(available))) > 0),
        ("not_finite", infinite),
        ("year_not_whole", year & ~infinite & ~whole),
        ("year_out_of_range", year & ~infinite & whole & ~in_range),
        ("count_not_whole", (output_type == "count") & ~infinite & ((x < 0) | ~whole)),
    ]
    warnings = [("dead_table", F.size(F.array_except(named, used)) > 0)]
    warnings += [(f"large_{k}", (output_type == k) & (F.abs(x) > most)) for k, most in LARGEST.items()]

    def codes(checks):
        return F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), n) for n, c in checks)), lambda c: c.isNotNull())

    out = df.withColumn("used", used).withColumn("errors", codes(errors)).withColumn("warnings", codes(warnings)).drop("__r")
    return out.withColumn("ok", F.size("errors") == 0)
