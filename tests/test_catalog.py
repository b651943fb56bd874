"""Every registered query of the question-answering part against DuckDB."""

import duckdb
import pandas as pd
import pytest

from ledgerlens.plans import catalog, guarded, kept, nested, row_programs  # noqa: F401

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    clean = lambda v: None if pd.isna(v) else v
    cols = sorted(frame.columns)
    return sorted((tuple(map(clean, r)) for r in frame[cols].astype(object).values.tolist()), key=str)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for x in TABLES:
        c.sql(f"create view {x} as select * from '{DATA}/{x}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query(spark, duck, name):
    assert rows(catalog.QUERIES[name](spark, DATA).toPandas()) == rows(duck.sql(catalog.SQL[name]).df())


def test_fuzzy_and_entry(spark):
    assert catalog.QUERIES["fuzzy_label_match"](spark, DATA).filter("score < 70").count() == 0
    assert catalog.entry(spark, DATA).count() > 0
