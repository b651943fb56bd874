"""The ladder of reports that stand in for one another."""

import pytest

from ledgerlens.operators import router

HAVE = [("c20", "A", 2020, "consolidated"), ("s20", "A", 2020, "separate"), ("s20b", "A", 2020, "separate"), ("o21", "A", 2021, "other"), ("g22", "A", 2022, "aggregated"), ("s25", "A", 2025, "separate")]


@pytest.mark.parametrize(
    "year, kind, want",
    [
        (2020, "consolidated", {("c20", "exact")}),
        (2020, "separate", {("s20", "exact"), ("s20b", "exact")}),
        (2020, "aggregated", {("c20", "other_kind")}),
        (2021, "separate", {("o21", "other_kind")}),
        (2021, "aggregated", {("o21", "other_kind")}),
        (2019, "other", {("c20", "next_year")}),
        (2019, "separate", {("s20", "next_year"), ("s20b", "next_year")}),
        (2024, "aggregated", {(None, "missing")}),  # a separate report does not stand for an aggregated one
        (2023, "separate", {(None, "missing")}),
        (None, "separate", {(None, "missing")}),
    ],
)
def test_ladder(spark, year, kind, want):
    schema = "q int, ticker string, year int, doc_type string"
    asked = spark.createDataFrame([(1, "A", year, kind), (1, "A", year, kind)], schema)
    got = router.lock_reports(asked, spark.createDataFrame(HAVE, "report_id string, ticker string, year int, doc_type string"), "q").collect()
    assert {(r["report_id"], r["note"]) for r in got} == want and len(got) == len(want)
