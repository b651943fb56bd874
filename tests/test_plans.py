"""Front-ends of programs, flat selections, slots, metric phrases and grounding on small cases."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import metric, text
from ledgerlens.operators import ranking, selection, shortlist, slots
from ledgerlens.plans import expressions, ir


@pytest.mark.parametrize(
    "expression, value",
    [
        ("(E1 - E2) / abs(E2) * 100", 50.0),
        ("sum(E1, E2, 1) if E1 > E2 and not E2 == 0 else -E1", 6.0),
        ("median(E1, E2, 10)", 3.0),
        ("count_true(E1 > 2, E2 >= 2, E1 <= E2)", 2.0),
        ("argmax_project(E1, 7, E2, 8)", 7.0),
        ("argmin_project(E1, 7, E2, 8) ** 2", 64.0),
        ("E1 / (E2 - 2)", None),
    ],
)
def test_expressions(spark, expression, value):
    frame = spark.createDataFrame([(1, 3.0, 2.0)], "q int, E1 double, E2 double")
    assert ir.answer(frame, expressions.to_program(expression), ["q"]).first()["answer"] == value


@pytest.mark.parametrize(
    "expression, code",
    [("E1 +", "parse_error"), ("x + 1", "grounding_error"), ("E1 // 2", "schema_error"), ("open(E1)", "operation_error"), ("E1.real", "schema_error"), ("argmax_project(E1, 2)", "operation_error"), ("True + E1", "schema_error"), ("+".join(["E1"] * 300), "limit_error"), ("E1 < E2 < 3", "schema_error")],
)
def test_rejected_expressions(expression, code):
    with pytest.raises(ir.Rejected) as e:
        expressions.to_program(expression)
    assert e.value.code == code


def test_operations():
    assert expressions.operations(expressions.to_program("sum(E1, E2) / sum(E1, -E2)")) == {"divide": 1, "sum": 2, "negate": 1}


SELECTIONS = {
    ("lookup", (1,), "number"): (3e6, "ok"),
    ("lookup", (3,), "percent"): (50.0, "ok"),
    ("sum", (1, 2), "number"): (5e6, "ok"),
    ("average", (1, 2), "number"): (2.5e6, "ok"),
    ("growth_pct", (1, 2), "percent"): (50.0, "ok"),
    ("ratio_times", (1, 2), "ratio"): (1.5, "ok"),
    ("argmin", (1, 2), "year"): (2020.0, "ok"),
    ("ranking_max", (1, 2), "year"): (2021.0, "ok"),
    ("count", (1, 2), "count"): (2.0, "ok"),
    ("percentage_point", (1, 2), "percentage_point"): (1.0, "ok"),
    ("guess", (1,), "number"): (None, "unknown_op"),
    ("lookup", (1, 2), "number"): (None, "wrong_arity"),
    ("sum", (1, 1), "number"): (None, "duplicate_operands"),
    ("sum", (1, 9), "number"): (None, "operand_out_of_range"),
    ("sum", (1, 4), "number"): (None, "duplicate_cells"),
    ("sum", (1, 2), "year"): (None, "incompatible_output"),
    ("argmax", (1, 5), "year"): (None, "ambiguous_years"),
    ("ratio", (1, 6), "percent"): (None, "division_by_zero"),
}


def test_selections(spark):
    cells = [(1, "a", 3.0, 1e6, "x", 2021), (2, "b", 2.0, 1e6, "x", 2020), (3, "c", 0.5, 1.0, "x", 2020), (4, "a", 3.0, 1e6, "x", 2021), (5, "e", 1.0, 1.0, "x", None), (6, "f", 0.0, 1.0, "x", 2019)]
    asked = [(i, op, list(operands), kind, 1.0) for i, (op, operands, kind) in enumerate(SELECTIONS)]
    s = spark.createDataFrame(asked, "qid int, op string, operands array<int>, output_type string, question_scale double")
    c = spark.createDataFrame(cells, "idx int, cell string, value double, unit_scale double, label string, year int").crossJoin(s.select("qid"))
    got = {r["qid"]: (r["answer"], r["status"]) for r in selection.answers(s, c).collect()}
    assert [got[i] for i in range(len(asked))] == list(SELECTIONS.values())


def test_metric_phrases(spark):
    asked = {
        "Số dư trả trước cho người bán của CTCP ABC năm 2023 là bao nhiêu tỷ đồng?": ("tra truoc cho nguoi ban", "so du tra truoc cho nguoi ban"),
        "Năm 2015, doanh thu thuần của công ty là bao nhiêu?": ("doanh thu thuan", "doanh thu thuan"),
        "Cho biết hàng tồn kho ngày 31/12/2020?": ("hang ton kho", "hang ton kho"),
        "Tổng nợ": ("tong no", "tong no"),
        None: ("", ""),
    }
    df = spark.createDataFrame([(k,) for k in asked], "q string").select("q", metric.metric_phrases(F.col("q"))["core"].alias("core"), metric.metric_phrases(F.col("q"))["wide"].alias("wide"))
    assert {r["q"]: (r["core"], r["wide"]) for r in df.collect()} == asked


def test_slots(spark):
    rows = [
        (1, "Năm nào hệ số dòng tiền từ hoạt động kinh doanh trên nợ ngắn hạn của năm sau năm 2020 cao nhất?", ["A"], [2020], "x", "ranking", "year"),
        (2, "Bao nhiêu công ty có lợi nhuận gộp lớn hơn 5 tỷ?", ["A", "B"], [2020], "x", "count", "count"),
        (3, None, None, None, None, None, None),
        (4, "Doanh thu", [f"T{i}" for i in range(30)], [2020], "doanh thu", "lookup", "number"),
    ]
    df = spark.createDataFrame(rows, "qid int, question string, tickers array<string>, years array<int>, metric string, op string, output_type string")
    got = slots.plan_slots(df, "qid").collect()
    first = {(r["metric"], r["year"], r["period_role"]) for r in got if r["qid"] == 1}
    assert first == {("luu chuyen tien thuan tu hoat dong kinh doanh", 2021, "next_period"), ("no ngan han", 2021, "next_period")}
    assert {(r["ticker"], r["metric"], r["role"]) for r in got if r["qid"] == 2} == {("A", "loi nhuan gop", "filter"), ("B", "loi nhuan gop", "filter")}
    assert not [r for r in got if r["qid"] == 3]
    assert [r["truncated"] for r in got if r["qid"] == 4] == [True] * 24


def test_grounding_of_provisions(spark):
    cases = {("lợi nhuận trước chi phí dự phòng", ""): "metric_domain_mismatch:profit_not_provision", ("dự phòng rủi ro", ""): "metric_domain_mismatch:stock_not_expense", ("chi phí dự phòng rủi ro tín dụng", "Miền Bắc"): "metric_scope_mismatch:segment_not_total", ("chi phí dự phòng rủi ro tín dụng", "2020"): "metric_match:direct"}
    df = spark.createDataFrame(list(cases), "label string, header string")
    reason = shortlist.metric_grounding(F.col("label"), F.col("header"), F.lit(None).cast("string"), F.lit("chi phí dự phòng rủi ro tín dụng"), F.lit("same_period"), F.lit(90.0))
    assert {(r["label"], r["header"]): r["r"] for r in df.select("*", reason.alias("r")).collect()} == cases


def test_money_literals_of_odd_texts(spark):
    df = spark.createDataFrame([("1,5 tỷ đồng; 3 tỷx 12 nghìn",), (None,), ("",)], "q string")
    assert [r["m"] for r in df.select(text.money_literals(F.col("q")).alias("m")).collect()] == [[1.5e9, 12e3], [], []]


def test_cosine_blocks(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0]), (4, None), (5, [0.0, 0.0])], "vec_id long, embedding array<double>")
    got = ranking.cosine_top_k(v, v, 2, block_bytes=16).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == [(1, 1, 1.0, 1), (1, 2, 1.0, 2), (2, 1, 1.0, 1), (2, 2, 1.0, 2), (3, 3, 1.0, 1), (3, 1, 0.0, 2)]
    assert ranking.cosine_top_k(v.limit(0), v, 2).count() == 0
