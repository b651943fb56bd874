"""Quotas of groups in one exchange."""

from ledgerlens.operators import ranking


def test_quota_needs_one_exchange_and_no_join(spark):
    rows = [(1, "a", 9.0, 1), (1, "a", 8.0, 2), (1, "a", 7.0, 3), (1, "b", 1.0, 4), (1, None, 6.0, 5), (2, "a", 3.0, 1), (2, "a", 3.0, 2), (3, None, 2.0, 1), (3, None, 1.0, 2)]
    out = ranking.quota_top_k(spark.createDataFrame(rows, "q int, g string, score double, pos int"), "q", "g", "score", "pos", 3)
    # of query 1 both named groups, and the rows without one, have a place before the rest
    assert sorted((r["q"], r["pos"]) for r in out.collect()) == [(1, 1), (1, 4), (1, 5), (2, 1), (2, 2), (3, 1), (3, 2)]
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
