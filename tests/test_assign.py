"""Assignments of any size against all permutations and, on whole orders, against the falling order of prices."""

import itertools
import random

import duckdb

from ledgerlens.operators import assign
from ledgerlens.plans import catalog

DATA = "/root/testdata/sf0.001"


def brute(scores, n):
    totals = [(round(sum(scores[p] for p in enumerate(way)), 8), way) for way in itertools.permutations(range(n)) if all(p in scores for p in enumerate(way))]
    best = [way for total, way in totals if total == max(totals)[0]]
    return best[0] if len(best) == 1 else None


def test_best_assignment_is_that_of_all_permutations():
    rng = random.Random(1)
    for n in [1, 2, 3, 4, 5, 6, 7] * 30:
        kind = rng.choice((lambda: rng.randint(-2, 6), lambda: rng.randint(0, 9) / 10, lambda: rng.uniform(55, 100)))
        scores = {(i, j): float(kind()) for i in range(n) for j in range(n) if rng.random() < 0.8}
        assert assign.best_assignment(scores, n) == brute(scores, n)


def test_query_answers_orders_of_every_size(spark):
    want = duckdb.sql(f"""with f as (select l_orderkey as qid, row_number() over (partition by l_orderkey order by l_linenumber, l_extendedprice, l_partkey) - 1 as i, l_extendedprice as v from '{DATA}/lineitem.parquet'),
    one as (select qid from f group by qid having count(distinct v) = count(*))
    select qid, i, row_number() over (partition by qid order by v desc) - 1 from f join one using (qid)""").fetchall()
    assert sorted(map(tuple, catalog.QUERIES["optimal_assignment"](spark, DATA).collect())) == sorted(want)


def test_pairs_are_never_rows_that_are_sorted(spark, tmp_path):
    """The square of the lines of an order, as rows, went through two sorts and spilled."""
    from __spark_entry__ import queries

    rows = [(1, i, 10 + i, float(i)) for i in range(4)] + [(2, 1, 5, 3.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    df = queries()["optimal_assignment"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange") == 1
    assert sorted(map(tuple, df.collect())) == [(1, 0, 3), (1, 1, 2), (1, 2, 1), (1, 3, 0), (2, 0, 0)]


def test_repeated_pairs_in_a_list(spark):
    nan = float("nan")
    pairs = [(1, 0, 0, 1.0), (1, 0, 0, 5.0), (1, 0, 1, 4.0), (1, 1, 0, 3.0), (1, 1, 1, None), (1, 1, 1, 0.5), (2, 0, 0, nan), (2, 0, 0, 9.0), (3, 0, 0, 1.0), (3, 1, 1, None)]
    df = spark.createDataFrame(pairs, "qid long, fact long, leaf long, score double")
    assert sorted(map(tuple, assign.assign(df).collect())) == [(1, 0, 1), (1, 1, 0)]
