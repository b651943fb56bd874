"""Units, scales and routes of programs as a column."""

import json

from ledgerlens.plans import rows


def op(name, *args):
    return {"op": name, "args": list(args)}


A, B, N = {"fact": "a"}, {"fact": "b"}, {"fact": "n"}
FACTS = "q int, slot string, value double, unit string, unit_scale double, stored_scale double, unit_source string, effective_source string, resolution string, terminal boolean, label string, metric string"


def fact(value, unit="vnd", scale=1.0, **more):
    return {"value": float(value), "unit": unit, "scale": scale, "stored": scale} | more


def labelled(x):
    return fact(7, label=x, metric="tài sản")


PER, SQUARE = op("divide", A, N), op("power", N, {"lit": 2})
SHARES = [("a", fact(12, "vnd")), ("n", fact(4, "share"))]
STICKY = {"source": "sticky", "terminal": True}
OVER = STICKY | {"effective": "terminal_vnd", "resolution": rows.OVERRIDE}
BOTH, ASKED = [("a", labelled("Tổng cộng tài sản")), ("b", labelled("Tài sản ngắn hạn"))], "Chênh lệch tổng tài sản?"
TOP = {"op": "argmax_project", "scores": [A, B], "results": [A, B]}


def pair(a, b):
    return [("a", fact(8, a)), ("b", fact(8, b))]


#: root, facts, route (op, question, unit, scale) or null, status, answer
CASES = [
    (op("add", A, B), [("a", fact(2, scale=1e6)), ("b", fact(5, scale=1e3))], (None, None, "vnd", 1e3), "ok", 2005.0),
    (op("add", A, B), pair("vnd", "usd"), None, "unit_error", None),
    (op("add", A, B), pair("vnd", None), (None, None, "vnd", None), "ok", 16.0),
    (op("if_else", op("gt", A, B), A, A), pair("vnd", "usd"), None, "unit_error", None),
    (op("divide", A, B), pair("vnd", "usd"), None, "unit_error", None),
    (op("divide", A, B), pair("vnd", "vnd"), None, "ok", 1.0),
    (op("divide", A, N), [("a", fact(8)), ("n", fact(2, "person"))], (None, None, "vnd/share", None), "unit_error", None),
    (op("subtract", A, {"lit": 0, "type": "money"}), pair("vnd", None)[:1], (None, None, "usd", None), "unit_error", None),
    (op("multiply", A, {"lit": 3}), pair("vnd", None)[:1], (None, None, "VND", None), "ok", 24.0),
    (PER, SHARES, (None, None, "vnd / share", None), "ok", 3.0),
    (op("multiply", PER, N), SHARES, (None, None, "vnd", None), "ok", 12.0),
    (SQUARE, SHARES[1:], (None, None, "share*share", None), "ok", 16.0),
    (op("power", N, {"lit": 0.5}), SHARES[1:], None, "unit_error", None),
    (A, [("a", fact(7) | {"stored": 1e9} | OVER)], None, "ok", 7.0),
    (A, [("a", fact(7) | {"stored": 1e9} | OVER | {"terminal": False})], None, "unit_provenance_error", None),
    (A, [("a", fact(7, scale=1e3) | {"stored": 1e9} | OVER)], None, "unit_provenance_error", None),
    (A, [("a", fact(7) | OVER)], None, "unit_provenance_error", None),
    (A, [("a", fact(7) | {"stored": 1e9})], None, "unit_provenance_error", None),
    (A, [("a", fact(7, scale=1e9) | STICKY)], None, "unit_provenance_error", None),
    (A, [("a", fact(7, scale=1e9) | STICKY | {"source": "explicit"})], None, "ok", 7e9),
    (A, [("a", fact(7, scale=float("nan")))], None, "unit_provenance_error", None),
    (A, [("a", fact(7, scale=-1.0))], None, "unit_provenance_error", None),
    (A, [("a", fact(7, scale=None))], None, "ok", 7.0),
    (op("add", A, B), BOTH, ("difference", ASKED, None, None), "metric_anchor_error", None),
    (op("add", A, B), BOTH, ("ratio", ASKED, None, None), "ok", 14.0),
    (op("add", A, B), [BOTH[0], ("b", labelled("Tổng tài sản"))], ("difference", ASKED, None, None), "ok", 14.0),
    (op("max", A, B), BOTH, ("ranking", "", None, None), "operation_error", None),
    (TOP, BOTH, ("ranking", "", None, None), "ok", 7.0),
    (A, BOTH[:1], ("lookup", "", None, 0.0), "output_type_error", None),
]


def test_units_scales_and_routes(spark):
    """All cases are questions of one run."""
    fields = ("value", "unit", "scale", "stored", "source", "effective", "resolution", "terminal", "label", "metric")
    samples, facts, routes = [], [], []
    for q, (root, used, route, *_) in enumerate(CASES):
        samples.append((q, 1, json.dumps({"facts": {s: {"type": "number" if s == "n" else "money"} for s, _ in used}, "root": root})))
        facts += [(q, s, *(x.get(f) for f in fields)) for s, x in used]
        routes += [(q, *route)] if route else []
    r = spark.createDataFrame(routes, "q int, op string, question string, unit string, unit_scale double")
    got = rows.attempts(spark.createDataFrame(samples, "q int, sample int, program string"), spark.createDataFrame(facts, FACTS), "q", route=r).collect()
    assert {x["q"]: (x["status"], x["answer"]) for x in got} == {q: (status, answer) for q, (*_, status, answer) in enumerate(CASES)}
