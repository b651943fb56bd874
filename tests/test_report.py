"""Whole reports: tables, units that carry on, quarantine, limits."""

from pyspark.sql import functions as F

from ledgerlens.operators import extract, report

CELL = "<table><tr><td>{}</td></tr></table>"


def test_parse():
    text = "PAGE 3\n" + CELL.format("a") + "\n<table><tr><td>b\nPAGE 9" + CELL.format("c") + "PAGE 4\n<TABLE></TABLE><table><tr>"
    got = [(r[0], r[1], r[2], r[4], r[6]) for r in report.parse(text)]
    assert got == [(0, 3, 2, [["a"]], None), (1, 3, 3, None, "unclosed_table"), (2, 3, 4, [["c"]], None), (3, 4, 5, None, "empty_table"), (4, 4, 5, None, "unclosed_table")]
    assert [r[6] for r in report.parse("no table")] == ["no_table"] and [r[6] for t in (None, "", " \n") for r in report.parse(t)] == ["empty_report"] * 3


def test_cut_grids_are_reported(spark):
    long = "<table>" + "<tr><td>1</td></tr>" * 601 + "</table>"
    wide = "<table><tr>" + "<td>1</td>" * 41 + "</tr></table>"
    fits = "<table>" + ("<tr>" + "<td>1</td>" * 40 + "</tr>") * 600 + "</table>"
    assert [(len(g), len(g[0]), cut) for g, cut in map(extract.grid_of, (long, wide, fits))] == [(600, 1, True), (1, 40, True), (600, 40, False)]
    df = spark.createDataFrame([("d", long + fits)], "doc_key string, text string")
    assert [r["truncated"] for r in extract.find_tables(df).orderBy("table_pos").collect()] == [True, False]


def test_units_and_quarantine(spark):
    rows = [("r1", "A", "Đơn vị: triệu đồng" + CELL.format("1") + CELL.format("2") + "<table>"), ("r2", "A", CELL.format("tỷ đồng")), ("r3", "A", None), ("r4", "B", "x"), ("r5", "B", CELL.format("5"))]
    df = spark.createDataFrame(rows, "report_id string, ticker string, text string")
    tables, quarantine = report.parse_reports(df)
    got = sorted((r["report_id"], r["table_pos"], r["unit_scale"], r["unit_source"]) for r in tables.collect())
    assert got == [("r1", 0, 1e6, "explicit"), ("r1", 1, 1e6, "sticky"), ("r2", 0, 1e9, "explicit"), ("r5", 0, None, "none")]
    assert sorted((r["report_id"], r["problem"]) for r in quarantine.collect()) == [("r1", "unclosed_table"), ("r3", "empty_report"), ("r4", "no_table")]
    tables, quarantine = report.parse_reports(df, per_ticker=1)
    assert {r["report_id"] for r in tables.collect()} | {r["report_id"] for r in quarantine.collect()} == {"r1", "r4"}
    assert all(x.count() == 0 for x in report.parse_reports(df.limit(0)))


def test_sql_name(spark):
    report.register(spark, "tables_of_report")
    spark.createDataFrame([("r", CELL.format("1"))], "id string, text string").createOrReplaceTempView("some_reports")
    got = spark.sql("select id, t.table_pos, t.grid from some_reports, lateral tables_of_report(text) t").select(F.col("grid")[0][0].alias("x")).collect()
    assert [r["x"] for r in got] == ["1"]


def test_each_report_is_parsed_once(spark, tmp_path):
    """Tables and quarantine of one frame come from one pass: its plan has one Python step."""
    df = spark.createDataFrame([("r1", "A", "Đơn vị: triệu đồng" + CELL.format("1") + "<table>" + CELL.format("2")), ("r2", "A", None)], "report_id string, ticker string, text string")
    found = report.parsed_reports(df)
    got = sorted((r["report_id"], r["table_pos"] or 0, r["unit_source"], r["problem"]) for r in found.collect())
    assert got == [("r1", 0, "explicit", None), ("r1", 1, None, "unclosed_table"), ("r1", 2, "sticky", None), ("r2", 0, None, "empty_report")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
