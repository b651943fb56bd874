"""Working tables leave the shared folder once a result no longer asks for them."""

import os

import corpus_pipeline
from ledgerlens.llm import exact_dedup, near_dedup, quality
from ledgerlens.llm.common import discard, materialize, shared_dir


def tables(spark):
    folder = shared_dir(spark).removeprefix("file:")
    return {n for n in os.listdir(folder) if os.path.isdir(f"{folder}/{n}")}


def test_discard_removes_one_table(spark):
    before = tables(spark)
    kept, gone = materialize(spark.range(5), "kept"), materialize(spark.range(0), "gone")
    discard(gone)
    assert [n.split("-")[0] for n in tables(spark) - before] == ["kept"] and kept.count() == 5


def test_near_copies_leave_only_their_edges(spark):
    before = tables(spark)
    texts = ["one two three four five six", "one two three four five six", "a b c d e f g", None, ""]
    out = near_dedup.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert [n.split("-")[0] for n in tables(spark) - before] == ["edges"]
    assert sorted(tuple(r) for r in out.collect()) == [(0, 0), (1, 0), (3, 3), (4, 3)]


def test_quality_leaves_no_features(spark):
    before = tables(spark)
    rows = [(i, "plain words here " * 9 if i % 2 else "*** " * 20, "en", "s", 9) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    assert not tables(spark) - before and quality.score(docs, model).count() == 60


def test_exact_dedup_names_its_tables(spark):
    before = tables(spark)
    out = exact_dedup.exact_dedup(spark.createDataFrame([(1, "a"), (2, "A"), (3, None)], "doc_id long, text string"))
    kept = materialize(out.filter("kept").select("doc_id"), "kept")
    discard(*out.working)
    assert [n.split("-")[0] for n in tables(spark) - before] == ["kept"] and sorted(r[0] for r in kept.collect()) == [2, 3]


def test_pipeline_leaves_one_copy_of_the_corpus(spark):
    """Stages that are done with are gone: what packing reads, its tokens and what slim tables are left."""
    before = tables(spark)
    pieces = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    left = sorted(n.rsplit("-", 1)[0] for n in tables(spark) - before)
    assert set(left) == {"benchmark-decontamination", "contaminated", "edges", "kept", "tokens"} and pieces.count() > 0
