"""Registered corpus queries: SQL where there is some, and the pipeline against brute force."""

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from ledgerlens.llm import decontamination, packing, quality, queries

DATA = "/root/testdata/sf0.001"
TABLES = "documents benchmark labels conversations pages".split()


def rows(frame):
    cols = sorted(frame.columns)
    return sorted((tuple(None if pd.isna(v) else v for v in r) for r in frame[cols].astype(object).values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    c = duckdb.connect()
    for x in TABLES:
        c.sql(f"create view {x} as select * from '{DATA}/{x}.parquet'")
    assert rows(queries.QUERIES[name](spark, DATA).toPandas()) == rows(c.sql(queries.SQL[name]).df())


def near_root(texts):
    """Least id that Jaccard similarities of 0.8 or more over 5-word shingles reach, from all pairs."""
    words = {i: t.encode().lower().split() for i, t in texts.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items()}
    near = {i: [j for j in sets if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in sets}
    root = {i: i for i in sets}
    for _ in sets:
        changed = {i: min(root[j] for j in near[i]) for i in sets}
        if changed == root:
            return root
        root = changed
    return root


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = corpus_pipeline.run(spark, DATA).collect()
    model = quality.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    left = {r["doc_id"]: r["text"] or "" for r in quality.score(docs, model).filter("keep").collect()}
    last = {}
    for i, t in sorted(left.items()):
        last[t.encode().lower()] = i
    left = {i: left[i] for i in last.values()}
    root = near_root(left)
    left = {i: t for i, t in left.items() if root[i] == i}
    items = duckdb.sql(f"select item_id, text from '{DATA}/benchmark.parquet'").fetchall()
    index = decontamination.Passages(items)
    left = {i: t for i, t in left.items() if not decontamination.matches([t.encode().lower()], index)}
    encode = packing.encoder(packing.default_tokenizer())
    want = {i: len(encode(t)) + 1 for i, t in left.items()}
    sizes = {}
    for r in got:
        sizes[r["doc_id"]] = sizes.get(r["doc_id"], 0) + r["length"]
    assert sizes == want


def test_stages_survive_awkward_rows(spark, tmp_path):
    d = str(tmp_path)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(1, "x", "en", "s", 1), (1, "x", "en", "s", 1), (None, None, None, None, None), (2, "", "en", "s", 0)], schema).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    wide = docs.selectExpr("*", "1 as __row", "'x' as keep", "2 as quality_score", "'r' as root")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, wide, d).columns == list(corpus_pipeline.COLUMNS)
        assert stage(spark, docs, d).columns == list(corpus_pipeline.COLUMNS)
        assert stage(spark, docs.limit(0), d).count() == 0
    assert len(corpus_pipeline.run(spark, d).collect()) == 2
