import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import numbers, text
from ledgerlens.operators import extract
from ledgerlens.plans import ir

NUMBERS = {"1.234.567": 1234567, "12,5": 12.5, "5,832": 5.832, "0.123": 0.123, "24.643,992": 24643.992, "(1.839,25)": -1839.25, "1,234,567.89": 1234567.89, "66,67%": 66.67, "": None, "-": None, "không có": None, "12abc": None}


def test_numbers(spark):
    df = spark.createDataFrame([(k,) for k in NUMBERS], "raw string")
    got = {r["raw"]: r["v"] for r in df.select("raw", numbers.parse_number(F.col("raw")).alias("v")).collect()}
    assert got == pytest.approx(NUMBERS)


def test_text(spark):
    df = spark.createDataFrame([("Công ty CP  Đầu tư 10%!", "năm 2019-2021 và 2023")], "a string, b string")
    r = df.select(text.norm(F.col("a")).alias("n"), text.extract_years(F.col("b")).alias("y"), text.strip_company_prefixes(F.lit("Tổng công ty Sữa")).alias("p")).first()
    assert r["n"].split()[:4] == ["cong", "ty", "cp", "dau"] and r["y"] == [2019, 2020, 2021, 2023] and r["p"] == "sua"


def test_grid_and_cells(spark):
    html = "<table><tr><th>Item</th><th>Code</th><th>2023</th></tr><tr><td>Net profit</td><td>60</td><td>(1.839,25)</td></tr><tr><td rowspan=2>Cash</td><td>110</td><td>5</td></tr><tr><td>111</td><td>7</td></tr></table>"
    assert extract.parse_grid(html)[3] == ["Cash", "111", "7"]
    tables = extract.find_tables(spark.createDataFrame([("d", "x\nPAGE 4\n" + html), ("e", None)], "doc_key string, text string"))
    t = tables.first()
    assert (t["page"], t["line_no"], t["table_pos"]) == (4, 3, 0)
    got = {(r["label"], r["row_code"], r["col_name"], r["value"]) for r in extract.cells(tables.select("doc_key", "grid")).filter("row > 0").collect()}
    assert got == {("Net profit", "60", "2023", -1839.25), ("Cash", "110", "2023", 5.0), ("Cash", "111", "2023", 7.0)}


def test_sticky_unit(spark):
    df = spark.createDataFrame([("r", 0, None), ("r", 1, 1e6), ("r", 2, None)], "report_id string, pos int, unit_scale double")
    got = [(r["unit_scale"], r["unit_source"]) for r in extract.sticky_unit(df, "report_id", "pos").orderBy("pos").collect()]
    assert got == [(None, "none"), (1e6, "explicit"), (1e6, "sticky")]


F1 = {"fact": "F1"}
MONEY = {"F1": {"type": "money"}}


@pytest.mark.parametrize(
    "program, code",
    [
        ("{", "schema_error"),
        ({"facts": MONEY, "root": {"op": "nope", "args": [F1, F1]}}, "operation_error"),
        ({"facts": MONEY, "root": {"op": "multiply", "args": [F1, F1]}}, "type_error"),
        ({"facts": MONEY, "root": {"fact": "F2"}}, "grounding_error"),
        ({"facts": MONEY, "root": {"lit": 1}}, "grounding_error"),
        ({"facts": MONEY, "bindings": {"a": {"var": "b"}, "b": {"var": "a"}}, "root": {"var": "a"}}, "binding_error"),
        ({"facts": MONEY, "root": {"op": "divide", "args": [F1, {"lit": 0}]}}, "operation_error"),
        ({"facts": MONEY, "root": F1, "output": "year"}, "output_type_error"),
    ],
)
def test_rejected_programs(spark, program, code):
    r = ir.answer(spark.createDataFrame([(1, 2.0)], "q int, F1 double"), program, ["q"]).first()
    assert (r["answer"], r["status"]) == (None, code)


def test_projection_ties_and_filters(spark):
    facts = {n: {"type": "money"} for n in ("a", "b", "c")}
    nodes = [{"fact": n} for n in facts]
    frame = spark.createDataFrame([(1, 5.0, 5.0, 1.0), (2, None, None, None)], "q int, a double, b double, c double")
    top = {"facts": facts, "root": {"op": "argmax_project", "scores": nodes, "results": [{"lit": 10}, {"lit": 20}, {"lit": 30}]}}
    assert [(r["answer"], r["status"]) for r in ir.answer(frame, top, ["q"]).orderBy("q").collect()] == [(10.0, "ok"), (None, "execution_failed")]
    top["root"]["when"] = [{"op": "lt", "args": [n, {"lit": 2, "type": "money"}]} for n in nodes]
    assert ir.answer(frame, top, ["q"]).orderBy("q").first()["answer"] == 30.0


def test_streaming_ingest_takes_each_id_once(spark, tmp_path):
    from ledgerlens.streaming.ingest import ingest

    src = tmp_path / "in"
    src.mkdir()
    for n, ids in enumerate(([1, 2, 2], [2, 3])):
        (src / f"{n}.json").write_text("\n".join(f'{{"report_id": {i}}}' for i in ids))
        ingest(spark, str(src), "report_id long", str(tmp_path / "out"), str(tmp_path / "ck"))
    assert sorted(r[0] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3]


def test_store(spark, tmp_path):
    from ledgerlens.sources import store

    d = tmp_path / "r" / "aaa" / "2024" / "rep1"
    d.mkdir(parents=True)
    (d / "x_consolidated_extracted.txt").write_text("hello")
    df = store.scan_reports(spark, str(tmp_path / "r"), ["AAA"])
    r = df.first()
    assert (r["ticker"], r["year"], r["doc_type"], r["report_id"], r["text"]) == ("AAA", 2024, "consolidated", "rep1", "hello")
    store.write_store(df, str(tmp_path / "s"))
    assert store.read_store(spark, str(tmp_path / "s"), ["AAA"], ["rep1"]).count() == 1
