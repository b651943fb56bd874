"""Generated questions: every program gives its gold, classes are whole, digests do not depend on the order of rows."""

from collections import Counter

from pyspark.sql import functions as F

from ledgerlens.plans import generate, rows


def cells(spark, rows_):
    return spark.createDataFrame(rows_, "entity string, year int, metric string, value double")


def data():
    made = [(f"E{i}", y, m, float((i * 37 + y * 11 + len(m) * 5) % 97 - 20) * 1e5) for i in range(11) for y in (2019, 2020, 2022) for m in ("profit", "revenue")]
    twice = [("E1", 2019, "profit", 5.0)]
    bad = [(None, 2020, "profit", 9.0), ("E20", None, "profit", 9.0), ("E21", 2020, None, 9.0), ("E22", 2020, "profit", None), ("E23", 2020, "profit", float("nan")), ("E24", 2020, "profit", 0.5)]
    return made, twice, bad


def test_generated(spark):
    made, twice, bad = data()
    good = {x[:3]: x[3] for x in made if x[:3] not in {y[:3] for y in twice} and abs(x[3]) >= 1}
    out = generate.generate(cells(spark, made + twice + bad), [("profit", "revenue")]).cache()
    got = Counter(r["klass"] for r in out.select("klass").collect())
    sizes = Counter(k[1:] for k in good)
    assert got == {
        "lookup": len(good),
        "growth_pct": sum(1 for e, y, m in good if good.get((e, y - 1, m), 0) > 0),
        "ratio": sum(1 for e, y, m in good if m == "profit" and (e, y, "revenue") in good),
        "difference": sum(n // 2 for n in sizes.values()),
        "ranking": sum(n // 4 + (n % 4 == 3) for n in sizes.values()),
    }
    tried = rows.attempts(out.withColumn("sample", F.lit(1)), generate.cells_of(out), "qid", route=out.select("qid", "unit_scale"))
    checked = out.join(tried, "qid").select("klass", "gold", "answer", "status").collect()
    assert len(checked) == sum(got.values()) and all(r["status"] == "ok" and r["answer"] == r["gold"] for r in checked)
    for r in out.select("facts").collect():
        assert all(good[f["entity"], f["period"], f["metric"]] == f["value"] for f in r["facts"])
    shuffled = generate.generate(cells(spark, (made + twice)[::-1]), [("profit", "revenue")])
    assert out.select("qid", "question", "gold").exceptAll(shuffled.select("qid", "question", "gold")).isEmpty()
    few = generate.balanced(out, 5)
    first = {k: sorted(r["qid"] for r in out.filter(F.col("klass") == k).collect())[:5] for k in got}
    assert {k: sorted(r["qid"] for r in few.filter(F.col("klass") == k).collect()) for k in got} == first


def test_empty(spark):
    assert generate.generate(cells(spark, []), [("a", "b")]).isEmpty()
    assert {r["klass"] for r in generate.generate(cells(spark, [("A", 2020, "x", 5.0)]), []).collect()} == {"lookup"}


def test_answered_by_root_as_from_text(spark):
    made, twice, _ = data()
    out = generate.generate(cells(spark, made + twice), [("profit", "revenue")]).cache()
    assert {r["root"] for r in out.select("root").distinct().collect()} == {r[0] for r in generate._ROOTS}
    tried = rows.attempts(out.withColumn("sample", F.lit(1)), generate.cells_of(out), "qid", route=out.select("qid", "unit_scale")).select("qid", "answer", "status")
    done = generate.answered(out, ["qid"])
    assert done.count() == out.count() and done.exceptAll(tried).isEmpty() and tried.exceptAll(done).isEmpty()


def test_questions_are_not_sent_to_be_answered(spark, tmp_path):
    import __spark_entry__ as e

    orders = [(i, i % 40, 1000.0 + i * 7 % 300, f"{2019 + i % 4}-03-01 00:00:00") for i in range(400)]
    made = spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate string")
    made.withColumn("o_orderdate", F.to_timestamp("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    asked = e.queries()["generated_questions"](spark, str(tmp_path))
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert "InArrow" not in plan and "hashpartitioning(qid" not in plan
    assert plan.count("FileScan") <= 3 and plan.count("Exchange hashpartitioning") <= 5
    got = asked.collect()
    assert got and all(r["status"] == "ok" and r["answer"] == r["gold"] for r in got)
