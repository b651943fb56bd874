"""Stratified allocation on skewed strata: a reserve for each, capacities, and the exact total."""

import math

import pytest

from ledgerlens.operators import sampling


def brute(counts, total):
    base = {k: int(total >= sum(n > 0 for n in counts.values()) and n > 0) for k, n in counts.items()}
    cap = {k: n - base[k] for k, n in counts.items()}
    rest, room = total - sum(base.values()), sum(cap.values())
    ideal = {k: rest * cap[k] / room if room else 0.0 for k in counts}
    got = {k: base[k] + min(cap[k], math.floor(ideal[k])) for k in counts}
    left = total - sum(got.values())
    for k in sorted((k for k in counts if got[k] < counts[k]), key=lambda k: (math.floor(ideal[k]) - ideal[k], k))[:left]:
        got[k] += 1
    return got


SKEWED = {"a": 99_900, "b": 40, "c": 3, "d": 1, "e": 0}


@pytest.mark.parametrize("counts, total", [(SKEWED, 100), (SKEWED, 3), (SKEWED, 0), (SKEWED, 99_944), ({"x": 2, "y": 2, "z": 5}, 8), ({"x": 1, "y": 1}, 2)])
def test_allocation(spark, counts, total):
    df = spark.createDataFrame(list(counts.items()), "s string, n long")
    got = {r["s"]: r["quota"] for r in sampling.allocate(df, "s", "n", total).collect()}
    assert got == brute(counts, total) and sum(got.values()) == total
    assert all(got[k] <= n for k, n in counts.items())
    assert total < 4 or all(got[k] for k, n in counts.items() if n)


def test_more_than_the_population_fails(spark):
    with pytest.raises(Exception, match="cannot allocate 7 rows from population 6"):
        sampling.allocate(spark.createDataFrame([("x", 1), ("y", 5)], "s string, n long"), "s", "n", 7).collect()
