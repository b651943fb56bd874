"""Bucketed stores, chunked runs and seals: plans, faults and order."""

import json
import os

import pytest
from pyspark.sql import functions as F

from ledgerlens.sources import bucketed, chunks
from ledgerlens.sources.shared import Files

CELLS = [(f"R{i % 40}", i % 7, f"v{i}") for i in range(900)] + [(None, 3, "null"), ("R1\x1fx", 2, "odd")]


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    df = spark.createDataFrame(CELLS, "report_id string, table_pos int, value string")
    out = bucketed.BucketedStore.write(df, f"{tmp_path_factory.mktemp('kept')}/store", ["report_id", "table_pos"], 8)
    yield out
    out.close()


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def rows_scanned(df):
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    return leaf.metrics().apply("numOutputRows").value()


def test_lookup_reads_one_bucket(spark, store):
    got = store.lookup("R5", 3)
    assert sorted(r["value"] for r in got.collect()) == sorted(v for r, t, v in CELLS if (r, t) == ("R5", 3))
    sizes = [r["count"] for r in store.table().groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) == 8 and rows_scanned(store.lookup("R5", 3)) <= max(sizes) < rows_scanned(store.table()) == len(CELLS)
    # a join keeps the buckets, and says how many it reads
    asked = spark.createDataFrame([("R5", 3)], "report_id string, table_pos int")
    pruned = store.join(asked).filter("report_id = 'R5' and table_pos = 3")
    assert "SelectedBucketsCount: 8 out of 8" in plan(pruned)
    assert [r["value"] for r in store.lookup(None, 3).collect()] == ["null"] and store.lookup("no", 1).count() == 0


def test_joins_do_not_move_the_store(spark, store, tmp_path):
    asked = [("R5", 3, 1), ("R5", 3, 2), ("R9", 1, 3), ("none", 1, 4)]
    other = spark.createDataFrame(asked, "report_id string, table_pos int, rank int")
    want = sorted((r, t, n, v) for r, t, n in asked for a, b, v in CELLS if (a, b) == (r, t))
    joined = store.join(other)
    assert sorted(tuple(x) for x in joined.select("report_id", "table_pos", "rank", "value").collect()) == want
    assert plan(joined).split("Initial Plan")[0].count("Exchange") == 1  # of the candidates
    both = bucketed.BucketedStore.write(other, f"{tmp_path}/asked", ["report_id", "table_pos"], 8)
    kept = store.join(both.table())
    assert sorted(tuple(x) for x in kept.select("report_id", "table_pos", "rank", "value").collect()) == want
    assert "Exchange" not in plan(kept)
    both.close()


def test_opened_again(spark, store):
    again = bucketed.BucketedStore(spark, store.folder)
    assert rows_scanned(again.lookup("R1", 1)) < len(CELLS) / 4 and again.table().count() == len(CELLS)
    again.close()
    with pytest.raises(Exception):
        bucketed.BucketedStore.write(store.table(), store.folder, ["report_id"], 4)


def test_stopped_run_goes_on(spark, tmp_path):
    folder, made = f"{tmp_path}/run", []
    df = spark.range(1000)

    def chunk(i, fails=False):
        def make():
            made.append(i)
            rows = df.filter(F.col("id") % 5 == i)
            return rows.withColumn("id", F.when(F.col("id") < 500, F.col("id")).otherwise(F.raise_error(F.lit("stopped")))) if fails else rows

        return make

    first = chunks.ChunkedRun(spark, folder, {"a": 1, "b": [2]})
    with pytest.raises(Exception, match="stopped"):
        first.run({f"c{i}": chunk(i, i == 2) for i in range(5)})
    assert first.published() == ["c0", "c1"] and os.listdir(f"{folder}/_staging")
    assert sorted(r["id"] for r in first.read().collect()) == [i for i in range(1000) if i % 5 < 2]
    made.clear()
    again = chunks.ChunkedRun(spark, folder, {"b": [2], "a": 1})
    assert again.run({f"c{i}": chunk(i) for i in range(5)}) == ["c2", "c3", "c4"] and made == [2, 3, 4]
    assert sorted(r["id"] for r in again.read().collect()) == list(range(1000))
    assert again.run({f"c{i}": chunk(i) for i in range(5)}) == []
    with pytest.raises(chunks.OtherRun):
        chunks.ChunkedRun(spark, folder, {"a": 2, "b": [2]})


def test_two_writers_of_one_chunk(spark, tmp_path):
    files = Files(spark, f"{tmp_path}/x")
    assert files.write("a.json", "1") and not files.write("a.json", "2") and files.read("a.json") == "1"
    run = chunks.ChunkedRun(spark, f"{tmp_path}/x", {})

    def late():
        chunks.ChunkedRun(spark, f"{tmp_path}/x", {}).run({"c": lambda: spark.range(3)})
        return spark.range(5)

    assert run.run({"c": late}) == [] and run.read().count() == 3


def test_hashed_chunks_hold_every_row(spark):
    df = spark.createDataFrame([(i if i % 3 else None,) for i in range(50)], "k int")
    parts = chunks.hashed_chunks(df, "k", 4)
    assert sum(p().count() for p in parts.values()) == 50


def test_seal_is_independent_of_order(spark):
    rows = [(i % 2, i, json.dumps({"a": i, "b": {"y": 1, "x": [i, 2]}})) for i in range(60)]
    turned = [(s, i, json.dumps({"b": {"x": [i, 2], "y": 1}, "a": i})) for s, i, _ in reversed(rows)]
    of = lambda r, cols="split int, n int, props string": {x["split"]: (x["seal"], x["rows"]) for x in chunks.seal(spark.createDataFrame(r, cols).repartition(3), ["n", "props"], ["split"], 8).collect()}
    assert of(rows) == of(turned) == of([(s, p, n) for s, n, p in rows], "split int, props string, n int")
    changed = [(s, i, p.replace('"y": 1', '"y": 2') if i == 7 else p) for s, i, p in rows]
    assert of(changed)[0] == of(rows)[0] and of(changed)[1] != of(rows)[1]
    assert of(rows + rows[:1])[0] != of(rows)[0]
    assert chunks.seal(spark.createDataFrame([(None, 1)], "a string, b int"), ["a"]).first()["seal"] != chunks.seal(spark.createDataFrame([("", 1)], "a string, b int"), ["a"]).first()["seal"]
