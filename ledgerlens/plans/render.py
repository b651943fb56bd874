"""One-line pandas expressions of programs, for answers that others replay on the evidence tables."""

from __future__ import annotations

from ledgerlens.plans.ir import Compiler, Rejected

_INFIX = {"add": "+", "subtract": "-", "difference": "-", "multiply": "*", "divide": "/", "ratio": "/", "power": "**", "gt": ">", "ge": ">=", "lt": "<", "le": "<=", "eq": "==", "ne": "!="}


def cell(variable: str, row: int, col: int) -> str:
    """Value of one cell of a tidy table in the base unit."""
    at = f"{variable}.loc[({variable}['row'] == {row}) & ({variable}['col'] == {col})"
    return f"(float({at}, 'value'].iloc[0]) * float({at}, 'unit_scale'].iloc[0]))"


class _Writer:
    def __init__(self, program: dict, cells: dict[str, tuple[str, int, int]]):
        self.bindings, self.cells = program.get("bindings", {}), cells

    def many(self, nodes) -> list[str]:
        return [self(n) for n in nodes]

    def __call__(self, node: dict) -> str:
        if "fact" in node:
            if node["fact"] not in self.cells:
                raise Rejected("grounding_error", node["fact"])
            return cell(*self.cells[node["fact"]])
        if "lit" in node:
            return repr(float(node["lit"]))
        if "var" in node:
            return self(self.bindings[node["var"]])
        op, a = node["op"], self.many(node.get("args", ()))
        if op in _INFIX and op != "add":
            return f"({a[0]} {_INFIX[op]} {a[1]})"
        if op in ("and", "or"):
            return "(" + f" {op} ".join(a) + ")"
        if op in ("sum", "add"):
            return "(" + " + ".join(a) + ")"
        if op in ("argmax_project", "argmin_project"):
            return self.projection(node)
        return {
            "average": lambda: f"(({' + '.join(a)}) / {len(a)})",
            "min": lambda: f"min([{', '.join(a)}])",
            "max": lambda: f"max([{', '.join(a)}])",
            "median": lambda: f"((lambda v: (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2)(sorted([{', '.join(a)}])))",
            "count_true": lambda: f"float(sum([{', '.join(a)}]))",
            "lookup": lambda: a[0],
            "abs": lambda: f"abs({a[0]})",
            "negate": lambda: f"(-{a[0]})",
            "not": lambda: f"(not {a[0]})",
            "if_else": lambda: f"({a[1]} if {a[0]} else {a[2]})",
            "growth_percent": lambda: f"(({a[1]} - {a[0]}) / abs({a[0]}) * 100)",
            "cagr": lambda: f"((({a[1]} / {a[0]}) ** (1 / {a[2]}) - 1) * 100)",
            "apply_percent": lambda: f"({a[0]} * {a[1]} / 100)",
            "increase_percent": lambda: f"({a[0]} + {a[0]} * {a[1]} / 100)",
            "decrease_percent": lambda: f"({a[0]} - {a[0]} * {a[1]} / 100)",
            "percentage_point": lambda: f"(({a[0]} - {a[1]}) * {100 if self.ratio(node['args'][0]) else 1})",
        }[op]()

    def ratio(self, node: dict) -> bool:
        """A difference of shares, not of percents."""
        node = self.bindings[node["var"]] if "var" in node else node
        return node.get("op") in ("divide", "ratio") or node.get("type") == "ratio"

    def projection(self, node: dict) -> str:
        when = self.many(node.get("when", ())) or ["True"] * len(node["scores"])
        items = ", ".join(f"({s}, {r}, {w})" for s, r, w in zip(self.many(node["scores"]), self.many(node["results"]), when))
        return f"{'max' if node['op'] == 'argmax_project' else 'min'}([x for x in [{items}] if x[2]], key=lambda x: x[0])[1]"


def to_pandas(program: dict, cells: dict[str, tuple[str, int, int]]) -> str:
    """Expression of a valid program; ``cells`` gives variable, row and column of each fact."""
    kind = Compiler(program).compile().type  # rejects what breaks a rule
    body = _Writer(program, cells)(program["root"])
    inner = Compiler({k: v for k, v in program.items() if k != "output"}).compile().type
    return f"round(float({body}){' * 100' if inner == 'ratio' and kind in ('percent', 'percentage_point') else ''}, 2)"
