"""Programs as a column against the compiler of single programs, on random programs with every kind of fault."""

import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.plans import ir, rows

OPS = ["and", "or", "not", "if_else", "count_true", "gt", "ge", "lt", "le", "eq", "ne", "sum", "add", "average", "min", "max", "median", "lookup", "abs", "negate", "power", "subtract", "difference", "multiply", "divide", "ratio", "growth_percent", "cagr", "percentage_point", "apply_percent", "increase_percent", "decrease_percent", "argmax_project", "argmin_project", "what"]
RIGHT = {"not": 1, "if_else": 3, "lookup": 1, "abs": 1, "negate": 1, "cagr": 3}
CONDITIONS = ["gt", "ge", "lt", "le", "eq", "ne"]
TYPES = {"a": "money", "b": "money", "c": "number", "d": "ratio", "e": "percent"}
QUESTION = "gap 3 lan, 7,5 phan tram, 10 nam, 1.234.567 dong"


def condition(rnd, depth):
    return {"op": rnd.choice(CONDITIONS), "args": [{"fact": "a"}, rnd.choice([{"fact": "b"}, {"lit": 0}])]}


def node(rnd, depth):
    x = rnd.random()
    if depth == 0 or x < 0.3:
        return rnd.choice([*({"fact": f} for f in "aabbcde"), {"fact": "a"}, {"lit": rnd.choice([0, 1, 2, 3, 7.5, 10, 0.5])}, {"lit": 2, "type": "percent"}, {"var": "m"}])
    if x < 0.33:
        return rnd.choice([{"fact": "zz"}, {"lit": "x"}, {"lit": True}, {"var": "none"}, {"var": "loop"}, 5, {}, {"lit": 11}])
    op = rnd.choice(OPS)
    if op.endswith("project"):
        k = rnd.choice([1, 2, 2, 3])
        made = {"op": op, "scores": [node(rnd, depth - 1) for _ in range(k)], "results": [node(rnd, depth - 1) for _ in range(rnd.choice([k, k, k, 1]))]}
        return made | ({"when": [condition(rnd, 0) for _ in range(rnd.choice([k, k, 0, 1]))]} if rnd.random() < 0.5 else {})
    n = RIGHT.get(op, rnd.choice([2, 2, 3]) if op in ("and", "or", "count_true", "sum", "add", "average", "min", "max", "median") else 2)
    n = n if rnd.random() < 0.95 else rnd.randint(0, 4)
    logic = op in ("and", "or", "not", "count_true")
    args = [condition(rnd, 0) if logic and rnd.random() < 0.9 or op == "if_else" and i == 0 else node(rnd, depth - 1) for i in range(n)]
    if op in ("cagr", "power") and args and rnd.random() < 0.9:
        args[-1] = {"lit": rnd.choice([2, 3, 10])}
    return {"op": op, "args": args}


def facts_of(x):
    return {x["fact"]} if isinstance(x, dict) and "fact" in x else set().union(*map(facts_of, x.values() if isinstance(x, dict) else x)) if isinstance(x, (dict, list)) else set()


def programs(seed, n):
    rnd = random.Random(seed)
    for _ in range(n):
        root, m = node(rnd, rnd.randint(1, 4)), node(rnd, 1)
        text = json.dumps(root)
        named = (facts_of(root) | (facts_of(m) if '"m"' in text else set())) & set(TYPES)
        if rnd.random() < 0.05:
            named |= {"a"}
        program = {"facts": {f: {"type": TYPES[f]} for f in named}, "bindings": {"m": m, "loop": {"op": "abs", "args": [{"var": "loop"}]}}, "root": root}
        out = rnd.choice([None, None, "percent", "money", "number", "ratio", "year"])
        yield program | ({"output": out} if out else {})


CELLS = {1: {"a": 120.0, "b": 100.0, "c": 3.0, "d": 0.25, "e": 12.5}, 2: {"a": -5.0, "b": 0.0, "c": 2.0, "d": 1.5, "e": 0.0}, 3: {"a": None, "b": 7.0, "c": None, "d": 0.1, "e": 4.0}, 4: {"b": 40.0, "a": 40.0}}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_programs(spark, seed):
    made = list(programs(seed, 150))
    samples = spark.createDataFrame([(q, i, json.dumps(p), QUESTION) for q in CELLS for i, p in enumerate(made)], "q int, sample int, program string, question string")
    facts = spark.createDataFrame([(q, s, v) for q, c in CELLS.items() for s, v in c.items()], "q int, slot string, value double")
    got = {(r["q"], r["sample"]): (r["status"], r["answer"]) for r in rows.attempts(samples, facts, "q", question="question").collect()}
    wide = spark.createDataFrame([(q, *(c.get(s) for s in "abcde")) for q, c in CELLS.items()], "q int, a double, b double, c double, d double, e double")
    columns, codes = [], {}
    for i, p in enumerate(made):
        try:
            columns.append(ir.Compiler(p, QUESTION).compile().column.alias(str(i)))
        except ir.Rejected as e:
            codes[i] = e.code
    values = {r["q"]: r for r in wide.select("q", *columns).collect()}
    seen = set()
    for q in CELLS:
        for i, p in enumerate(made):
            want = (codes[i], None) if i in codes else ("ok", values[q][str(i)]) if values[q][str(i)] is not None else ("execution_failed", None)
            assert got[q, i] == pytest.approx(want), (q, p)
            seen.add(want[0])
    assert seen >= {"ok", "execution_failed", "schema_error", "grounding_error", "binding_error", "operation_error", "type_error", "output_type_error"}


def leaf(name):
    return {"fact": name}


def test_replies(spark):
    good = {"facts": {"a": {}}, "root": leaf("a")}
    deep = {"facts": {"a": {}}, "root": leaf("a")}
    for _ in range(20):
        deep["root"] = {"op": "abs", "args": [deep["root"]]}
    texts = {
        "plain": (json.dumps(good), "ok"),
        "fenced": ("The answer {is} this:\n```json\n" + json.dumps(good) + "\n``` and {not: this}", "ok"),
        "null": (None, "parse_error"),
        "cut": (json.dumps(good)[:-3], "parse_error"),
        "late": (json.dumps(good)[:-2], "generation_truncated"),
        "none": ('{"root": {"op": "none"}}', "model_none"),
        "no facts": ('{"root": {"lit": 1}}', "schema_error"),
        "huge": ('{"facts": {}, "root": {"lit": 1' + "0" * 400 + "}}", "schema_error"),
        "nan": ('{"facts": {}, "root": {"lit": NaN}}', "schema_error"),
        "deep": (json.dumps(deep), "limit_error"),
        "nested": ("[" * 100_000 + "{" * 2000, "parse_error"),
        "condition": (json.dumps({"facts": {"a": {}}, "root": {"op": "gt", "args": [leaf("a"), {"lit": 0}]}}), "output_type_error"),
        "twice": (json.dumps({"facts": {"x": {}}, "root": leaf("x")}), "execution_failed"),
    }
    samples = spark.createDataFrame([(1, n, t, n == "late", "x") for n, (t, _) in texts.items()] + [(9, "other", json.dumps(good), False, "x")], "q int, sample string, program string, short boolean, answer string")
    facts = spark.createDataFrame([(1, "a", 5.0), (1, "x", 1.0), (1, "x", 1.0), (2, "a", 1.0)], "q int, slot string, value double")
    got = {r["sample"]: r["status"] for r in rows.attempts(samples, facts, "q", truncated="short").collect()}
    assert got == {n: s for n, (_, s) in texts.items()} | {"other": "no_candidates"}
    assert rows.attempts(samples.limit(0), facts, "q").count() == 0


def test_periods_and_entities(spark):
    def growth(base, end, op="growth_percent", *more, **declared):
        return {"facts": {n: declared.get(n, {}) for n in (base, end)}, "root": {"op": op, "args": [leaf(base), leaf(end), *more]}}

    cases = [
        (growth("a", "b"), "ok"),
        (growth("b", "a"), "period_error"),
        (growth("a", "n"), "ok"),  # a fact without a period
        (growth("a", "b", "cagr", {"lit": 2}), "ok"),
        (growth("a", "b", "cagr", {"lit": 3}), "period_error"),
        ({"facts": {"a": {}, "b": {}}, "root": {"op": "growth_percent", "args": [{"op": "sum", "args": [leaf("b"), leaf("b")]}, leaf("a")]}}, "period_error"),  # a sum of one period has it
        (growth("a", "b", a={"entity": "X"}), "ok"),
        (growth("a", "b", a={"entity": "Y"}), "entity_error"),
        (growth("a", "b", b={"period": 2022}), "ok"),
        (growth("a", "b", b={"period": 2021}), "period_error"),
    ]
    facts = spark.createDataFrame([(1, "a", 4.0, 2020, "X"), (1, "b", 9.0, 2022, "X"), (1, "n", 8.0, None, None)], "q int, slot string, value double, period int, entity string")
    samples = spark.createDataFrame([(1, i, json.dumps(p)) for i, (p, _) in enumerate(cases)], "q int, sample int, program string")
    got = {r["sample"]: r["status"] for r in rows.attempts(samples, facts, "q").collect()}
    assert got == {i: s for i, (_, s) in enumerate(cases)}


def test_first_answers_and_trace(spark):
    tried = spark.createDataFrame([(1, 1, None, "parse_error"), (1, 2, 5.0, "ok"), (1, 3, 6.0, "ok"), (2, 1, None, "type_error"), (2, 2, None, "execution_failed")], "q int, sample int, answer double, status string")
    first = rows.first_answers(tried, "q")
    assert sorted(map(tuple, first.collect())) == [(1, 5.0, "ok", 2), (2, None, "execution_failed", None)]
    late = [r for r in rows.trace(tried, "q").collect() if r["status"] == "not_evaluated_after_acceptance"]
    assert [(r["q"], r["sample"], r["answer"]) for r in late] == [(1, 3, None)]
    was = spark.createDataFrame([(1, "parse_error"), (3, "ok")], "q int, status string")
    assert sorted(map(tuple, rows.transitions(was, first, "q").collect()), key=str) == [("ok", None, 1), ("parse_error", "ok", 1), (None, "execution_failed", 1)]


def test_one_plan_for_any_number_of_programs(spark):
    def jobs(n):
        group = f"rows-{n}"
        spark.sparkContext.setJobGroup(group, group)
        samples = spark.createDataFrame([(1, i, json.dumps({"facts": {"a": {}}, "root": {"op": "add", "args": [leaf("a"), {"lit": i, "type": "money"}]}})) for i in range(n)], "q int, sample int, program string")
        facts = spark.createDataFrame([(1, "a", 5.0)], "q int, slot string, value double")
        assert rows.attempts(samples, facts, "q").agg(F.sum("answer")).first()[0] == sum(5 + i for i in range(n))
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(3) == jobs(300)


def test_replayed_is_answers_and_trace_in_one_pass(spark):
    tried = spark.createDataFrame([(1, 2, 5.0, "ok"), (1, 1, None, "parse_error"), (1, 3, 7.0, "ok"), (2, 1, None, "type_error"), (2, 2, None, "unit_error")], "q int, sample int, answer double, status string")
    got = {r["q"]: r for r in rows.replayed(tried, "q").collect()}
    assert {q: (r["answer"], r["status"], r["sample"]) for q, r in got.items()} == {r["q"]: (r["answer"], r["status"], r["sample"]) for r in rows.first_answers(tried, "q").collect()}
    assert {(q, x["sample"], x["status"]) for q, r in got.items() for x in r["trace"]} == {(r["q"], r["sample"], r["status"]) for r in rows.trace(tried, "q").collect()}
    assert {q: r["alone"] for q, r in got.items()} == {1: "parse_error", 2: "type_error"}


def test_more_texts_than_are_kept(spark, monkeypatch):
    """Texts come again after the kept ones were let go."""
    monkeypatch.setattr(rows, "_KEPT_TEXTS", 3)
    texts = [f'{{"facts": {{}}, "root": {{"lit": {i % 9}}}}}' for i in range(3000)]
    parsed = rows.parse(spark.createDataFrame(list(enumerate(texts)), "q int, program string").coalesce(1), ["q"])
    assert {r["q"]: r["steps"][0]["num"] for r in parsed.collect()} == {i: float(i % 9) for i in range(3000)}
