"""Mentions against all intervals, the entity guard, and markers by place."""

import random

from pyspark.sql import functions as F

from ledgerlens.operators import guards, router

NAMES = [("AAA", "An Binh"), ("BBB", "Chứng khoán An Bình"), ("CCC", "An Bình Hà Nội"), ("DDD", "An"), ("EEE", "an  bình"), ("FFF", ""), (None, "x"), ("GGG", None), ("AAA", "An Binh")]


def brute(words):
    hits = set()
    for ticker, alias in NAMES:
        name = {"AAA": "an binh", "BBB": "chung khoan an binh", "CCC": "an binh ha noi", "DDD": "an", "EEE": "an binh"}.get(ticker, "").split()
        hits |= {(i, i + len(name), ticker) for i in range(len(words)) if name and words[i : i + len(name)] == name}
    return {h for h in hits if not any((g[0], g[1]) != (h[0], h[1]) and g[0] <= h[0] and g[1] >= h[1] for g in hits)}


def test_mentions(spark):
    rnd = random.Random(3)
    texts = {i: [rnd.choice("chung khoan an binh ha noi cua".split()) for _ in range(rnd.randint(0, 14))] for i in range(120)}
    q = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()] + [(999, None)], "qid int, question string")
    got = {(r["qid"], r["at"], r["until"], r["ticker"]) for r in guards.mentions(q, spark.createDataFrame(NAMES, "ticker string, alias string"), "qid").collect()}
    assert got == {(i, *h) for i, t in texts.items() for h in brute(t)}


def test_guard(spark):
    asked = [
        (1, "Lợi nhuận của Vinamilk (VNM) năm 2020?", ["vnm "], True, ["VNM"], [], None, []),
        (2, "Lợi nhuận của Vinamilk và (HPG)?", ["VNM"], False, ["HPG", "VNM"], ["HPG"], None, ["entity_absent"]),
        (3, "Lợi nhuận công ty mẹ A trừ đi B?", ["A"], False, [], [], None, ["one_entity"]),
        (4, "Công ty mẹ A và công ty mẹ B?", ["A", None, "a"], False, [], [], None, ["one_entity"]),
        (5, "Tiền gửi tại Ngân hàng Quân đội Hà Nội của Công ty X?", ["X"], True, [], [], "quan doi ha noi", []),
        (6, None, None, True, [], [], None, []),
        (7, "Vốn của An Bình?", ["EEE"], True, ["AAA", "EEE"], [], None, []),
        (8, "Vốn của chứng khoán An Bình?", ["AAA"], False, ["BBB"], ["BBB"], None, ["entity_absent"]),
    ]
    routed = spark.createDataFrame([x[:3] for x in asked], "qid int, question string, tickers array<string>")
    got = guards.entity_guard(routed, spark.createDataFrame(NAMES, "ticker string, alias string"), "qid")
    shown = {r["qid"]: (r["ok"], r["mentioned"], r["absent"], r["anchor"], r["reasons"]) for r in got.collect()}
    assert shown == {x[0]: x[3:] for x in asked}
    slots = spark.createDataFrame([(1, []), (2, ["revenue:x"]), (50, None)], "qid int, missing array<string>")
    kept = {r["qid"]: (r["grounded"], r["reasons"]) for r in guards.guarded_slots(slots, got, "qid").collect()}
    assert kept == {1: (True, []), 2: (False, ["entity_absent", "leaf_missing"]), 50: (False, ["not_guarded"])}
    held = spark.createDataFrame([("Tiền gửi Quân đội Hà Nội", "quan doi ha noi"), ("Quân đội Hà Nội 2", "quan doi ha no"), (None, None), (None, "a b")], "t string, a string")
    assert [r[0] for r in held.select(guards.holds_object(F.col("t"), F.col("a"))).collect()] == [True, False, True, False]


def test_first_marker(spark):
    asked = {
        "cac cong ty co bien tren 5 phan tram dat bao nhieu ty dong": "number",
        "tang bao nhieu diem phan tram": "percentage_point",
        "bao nhieu phan tram cua 3 trieu dong": "percent",
        "gap bao nhieu lan": "ratio",
        "bao nhieu ty": None,
        "doanh thu": None,
        "": None,
        "ty le % theo lan": "percent",
    }
    df = spark.createDataFrame([(k,) for k in asked] + [(None,)], "t string")
    typed = {r[0]: r[1] for r in df.select("t", router.output_type(F.col("t"))).collect()}
    assert typed["cac cong ty co bien tren 5 phan tram dat bao nhieu ty dong"] == "number" and typed["bao nhieu ty"] == "number" and typed["doanh thu"] == "number"
    assert {r[0]: r[1] for r in df.select("t", router.first_marker(F.col("t"))).collect()} == asked | {None: None}


def test_questions_are_not_broadcast_to_the_names(spark, tmp_path):
    """Words of questions look as small as their file: at 1 GB, 2.8 GB of them went through the driver."""
    from __spark_entry__ import queries

    spark.createDataFrame([(i, f"{'red blue hot'.split()[i % 3]} plate") for i in range(60)], "p_partkey long, p_name string").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    df = queries()["entity_guard"](spark, str(tmp_path))
    assert df.count() == 60
    joins = [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "HashJoin [__first" in x]
    assert joins and all("BuildRight" in x for x in joins)
