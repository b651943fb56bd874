"""Serialization, packages, rendered expressions and repairs on small cases."""

import json
import zipfile

import pandas as pd
import pytest

from ledgerlens.operators import joins, repair, serialize
from ledgerlens.plans import expressions, ir, render
from ledgerlens.sources import submission

CELLS = [("r1", 0, 1, "Doanh thu", "10", 1, "2023", 5.0, 1e6), ("r1", 0, 2, "Lãi, lỗ", "60", 1, "2023", -2.0, 1e6), ("r2", 3, 1, "Nợ", "", 2, "2022", 4.0, None)]
COLS = "report_id string, table_pos int, row int, label string, row_code string, col int, col_name string, value double, unit_scale double"


@pytest.mark.parametrize(
    "expression",
    ["(E1 - E2) / abs(E2) * 100", "average(E1, E2, 7) if E1 > E2 or E2 == 0 else -E1", "median(E1, E2, 1, 2)", "count_true(E1 > 2, not E2 >= 2)", "argmax_project(E1, 7, E2, 8) + argmin_project(E1, 7, E2, 8)", "min(E1, E2) ** 2 - max(E1, E2)"],
)
def test_rendered_expressions_replay(spark, expression):
    program = expressions.to_program(expression)
    want = ir.answer(spark.createDataFrame([(1, 5e6, -2e6)], "q int, E1 double, E2 double"), program, ["q"]).first()["answer"]
    df1 = pd.DataFrame({"row": [1, 2], "col": [1, 1], "value": [5.0, -2.0], "unit_scale": [1e6, 1e6]})
    assert eval(render.to_pandas(program, {"E1": ("df1", 1, 1), "E2": ("df1", 2, 1)}), {"df1": df1}) == pytest.approx(want)


def test_rendered_growth_and_shares(spark):
    df1 = pd.DataFrame({"row": [1, 2], "col": [1, 1], "value": [5.0, 4.0], "unit_scale": [1.0, 1.0]})
    at = {"a": ("df1", 1, 1), "b": ("df1", 2, 1)}
    money = {n: {"type": "money"} for n in at}
    a, b = {"fact": "a"}, {"fact": "b"}
    for root, output, want in (({"op": "growth_percent", "args": [b, a]}, "percent", 25.0), ({"op": "divide", "args": [b, a]}, "percent", 80.0), ({"op": "cagr", "args": [b, a, {"lit": 1}]}, "percent", 25.0)):
        assert eval(render.to_pandas({"facts": money, "root": root, "output": output}, at), {"df1": df1}) == pytest.approx(want)


def test_package(spark, tmp_path):
    tidied = serialize.tidy(spark.createDataFrame(CELLS, COLS))
    questions = spark.createDataFrame([(1, "Một?"), (2, "Hai?")], "id int, question string")
    ranked = spark.createDataFrame([(1, 1, "r1", 0), (1, 2, "r2", 3), (2, 1, "r1", 0)], "id int, rank int, report_id string, table_pos int")
    answers = spark.createDataFrame([(1, 1.234, "round(1.0, 2)"), (2, 0.0, None)], "id int, answer double, pandas_query string")
    used = spark.createDataFrame([(1, "df2", "r2", 3)], "id int, variable string, report_id string, table_pos int")
    lines = spark.createDataFrame([("r1", 0, 11), ("r2", 3, 90)], "report_id string, table_pos int, line_no int")
    out = submission.entries(questions, ranked, answers, used, lines, k=1)
    files = submission.package(out, tidied, str(tmp_path / "s.zip"))
    assert sorted(files) == ["data/r2_table_90.csv", "results.json"]
    with zipfile.ZipFile(tmp_path / "s.zip") as z:
        first, second = json.loads(z.read("results.json"))
        assert z.read("data/r2_table_90.csv").decode().splitlines() == ["row,label,code,col,col_name,value,unit_scale", "1,Nợ,,2,2022,4.0,1.0"]
    assert first == {"id": 1, "question": "Một?", "answer": 1.23, "relevant_docs": ["r1", "r2"], "relevant_tables": ["r1|11", "r2|90"], "evidence": [{"variable": "df2", "csv_path": "data/r2_table_90.csv"}], "pandas_query": "round(1.0, 2)"}
    assert (second["relevant_tables"], second["evidence"], second["pandas_query"]) == (["r1|11"], [], "0.0")
    with pytest.raises(FileExistsError):
        submission.package(out, tidied, str(tmp_path / "s.zip"))
    bad = submission.entries(questions, ranked, answers.filter("id = 1").unionByName(answers.filter("id = 1")), used, lines.filter("table_pos = 0"))
    assert {r["id"]: r["status"] for r in bad.collect()} == {1: "duplicate_id", 2: "missing_answer"}
    with pytest.raises(ValueError, match="duplicate_id"):
        submission.package(bad, tidied, str(tmp_path / "t.zip"))
    assert not (tmp_path / "t.zip").exists()


def test_manifest(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_text("one")
    (tmp_path / "y.txt").write_text("two")
    found = submission.manifest(spark, str(tmp_path))
    before = found.collect()
    assert {r["path"] for r in before} == {"a/x.txt", "y.txt"}
    (tmp_path / "y.txt").write_text("2")
    (tmp_path / "z.txt").write_text("new")
    now = submission.manifest(spark, str(tmp_path))
    expected = spark.createDataFrame(before, found.schema)
    assert {(r["path"], r["status"]) for r in submission.verify(now, expected).collect()} == {("y.txt", "changed"), ("z.txt", "added")}


def test_serialize(spark):
    grid = [["Item", "Code", "2023"], ["Net profit", "60", "5"], ["12", "x", ""]]
    tables = spark.createDataFrame([("r", 0, "Unit: VND", grid), ("s", 0, None, [[]])], "report_id string, table_pos int, context string, grid array<array<string>>")
    cells = spark.createDataFrame([("r", 0, 1, "Net profit", "60", 2, "2023", 5.0, 1.0)], COLS)
    keys = ["report_id", "table_pos"]
    terms = {r["report_id"]: r["terms"] for r in serialize.table_terms(tables, cells, keys).collect()}
    assert terms == {"r": ["unit", "vnd", "item", "code", "2023", "net", "profit"], "s": []}
    more = serialize.with_dropped_cells(serialize.tidy(cells), tables, keys)
    assert {(r["row"], r["col"], r["value"]) for r in more.collect()} == {(0, 2, 2023.0), (1, 1, 60.0), (1, 2, 5.0), (2, 0, 12.0)}
    assert {r["label"] for r in serialize.label_vocabulary(tables).collect()} == {"Item", "Net profit"}


def test_near_pairs_lose_nothing(spark):
    values = [0.0, 0.4, -0.5, 1.0, 98.9, 99.5, 100.0, 100.9, 101.0, 101.02, -100.0, -101.0, 5e3, 5049.0, 5050.6, 1e9, 1.0099e9, 1.02e9, None]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "g int, k int, v double")
    near = lambda a, b: a is not None and b is not None and abs(a - b) <= max(1.0, 0.01 * abs(b))
    want = {(i, j) for i, a in enumerate(values) for j, b in enumerate(values) if i < j and near(a, b)}
    got = [tuple(r) for r in joins.near_pairs(df, ["g"], "k", "v", 0.01).collect()]
    assert len(got) == len(want) and set(got) == want


def test_repairs(spark):
    facts = [(q, f, "A", y, "separate", m, 1.0) for q, m in ((1, "doanh thu thuần"), (2, "hàng tồn kho")) for f, y in enumerate((2021, 2020))]
    facts = spark.createDataFrame(facts, "qid int, fact int, ticker string, year int, doc_type string, metric string, question_scale double")
    rows = [("r1", 1, 2021, "Doanh thu thuần", 150.0), ("r2", 1, 2021, "Doanh thu thuần", 150.0), ("r1", 1, 2020, "Doanh thu thuần", 100.0), ("r1", 2, 2021, "Hàng tồn kho", 7.0), ("r2", 2, 2021, "Hàng tồn kho", 8.0), ("r1", 3, 2021, "Thuế", 9.0)]
    cells = spark.createDataFrame([("A", "separate", y, r, 0, row, 2022 - y, label, "", v, 1.0, 4) for r, row, y, label, v in rows], "ticker string, doc_type string, year int, report_id string, table_pos int, row int, col int, label string, context string, value double, unit_scale double, confidence int")
    found = repair.resolve(facts, cells).cache()
    assert {(r["qid"], r["fact"]): (r["status"], r["support"], r["amount"], r["report_id"]) for r in found.collect()} == {(1, 0): ("accepted", 2, 150.0, "r1"), (1, 1): ("accepted", 1, 100.0, "r1"), (2, 0): ("competing_answer_clusters", 2, None, None), (2, 1): ("missing_metric_cell", 0, None, None)}
    answers = spark.createDataFrame([(1, "growth_pct", 3.0, 1.0), (2, "difference", 4.0, 1.0), (3, "median", None, 1.0)], "qid int, op string, answer double, question_scale double")
    got = {r["qid"]: (r["answer"], r["repaired"], r["status"]) for r in repair.proposals(answers, found).collect()}
    assert got == {1: (50.0, True, "accepted"), 2: (4.0, False, "unresolved_operand"), 3: (None, False, "unsupported_operation")}
