"""The near-dedup stage of the pipeline against brute-force Jaccard of 5-word shingles."""

import random

import pytest

import corpus_pipeline
from ledgerlens.llm import near_dedup, simhash_dedup

DATA = "/root/testdata/sf0.01"


def brute(texts):
    """Place of the first member of each text's group."""
    def cut(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets, root = [cut(t) for t in texts], list(range(len(texts)))
    where = {}
    for i, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for g in s for j in where[g] if j < i}:
            if len(s & sets[j]) / len(s | sets[j]) >= 0.8 and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


def near_texts():
    rng, out = random.Random(3), []
    for _ in range(40):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.randint(3, 200))]
        for _ in range(4):  # copies with 0 to 4 words changed: on both sides of 0.8
            out.append(" ".join(words))
            words = list(words)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(4000)}"
    rng.shuffle(out)
    return [*out, "", None, " \t", "One Two", "one two", "one two three"]


@pytest.mark.parametrize("source", ["edited", "documents"])
def test_stage_keeps_first_of_each_group(spark, source):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    if source == "edited":
        docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(near_texts())], schema).repartition(3)
    else:
        docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect() if r["text"] is not None) + [(r["doc_id"], None) for r in docs.collect() if r["text"] is None]
    rows.sort(key=lambda r: r[0])
    root = brute([t for _, t in rows])
    want = [i for n, (i, _) in enumerate(rows) if root[n] == n]
    assert len(want) < len(rows)
    assert sorted(r["doc_id"] for r in corpus_pipeline.simhash_stage(spark, docs, DATA).collect()) == want


def test_forest_at_the_threshold():
    import numpy as np

    a = np.arange(100, dtype=np.uint64)
    sets = [a, a[:80], a[:79], np.arange(900, 910, dtype=np.uint64), a]
    assert sorted(near_dedup.forest(sets)) == [(0, 1), (0, 4), (1, 2)]
    assert near_dedup.joined(5, [(1, 2), (0, 4), (2, 4)]).tolist() == [True, True, True, False, True]
    # only what pairs with the first two sets join
    assert sorted(near_dedup.forest([sets[3], sets[0], sets[1], sets[2]], home=1)) == []
    assert sorted(near_dedup.forest([sets[3], sets[1], sets[2], sets[0]], home=2)) == [(1, 2), (1, 3)]


@pytest.mark.parametrize("limit", ["CHUNK", "CHUNK_SHINGLES"])
def test_entries_dealt_to_chunks(spark, monkeypatch, limit):
    """Chains of close texts whose ends are far apart: entries that a chunk does not join to their first."""
    monkeypatch.setattr(near_dedup, limit, {"CHUNK": 3, "CHUNK_SHINGLES": 150}[limit])
    rng, texts = random.Random(5), near_texts()
    for _ in range(6):
        words = [f"c{rng.randrange(4000)}" for _ in range(90)]
        for at in range(0, 60, 2):
            words = [*words[:at], f"y{rng.randrange(4000)}", *words[at + 1 :]]
            texts.append(" ".join(words))
    rng.shuffle(texts)
    bands = spark.createDataFrame([(i, 50, [1, 2]) for i in range(10)], "__rid long, size long, keys array<long>")
    dealt = near_dedup._entries(bands).collect()
    assert len({r["key"] for r in dealt}) == 1 and {r["__rid"] for r in dealt} == set(range(10))
    assert all(any(r["__rid"] == 0 and r["chunk"] == c for r in dealt) for c in range(4)) and {r["chunks"] for r in dealt} == {4}

    seen = []
    real = near_dedup._open_members
    monkeypatch.setattr(near_dedup, "_open_members", lambda *a: seen.append(1) or real(*a))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["node"]: r["root"] for r in near_dedup.near_copies(docs).collect()}
    assert seen and [got.get(i, i) for i in range(len(texts))] == brute(texts)


def test_stage_takes_candidates_of_simhash(spark, monkeypatch):
    """Without bands, SimHash proposes close copies, and whole texts decide."""
    import numpy as np

    monkeypatch.setattr(near_dedup, "band_keys", lambda hashes: np.zeros(0, np.int64))
    rng = random.Random(7)
    words = [f"w{rng.randrange(4000)}" for _ in range(3000)]
    line = "the same seven words over and over " * 300
    # one word of 3,000 changed; tails of their own after one line over and over: near fingerprints, sets of shingles apart
    texts = [" ".join(words), " ".join([*words[:1500], "other", *words[1501:]]), *(line + " ".join(f"{tail}{i}" for i in range(12)) for tail in "ab")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    found = simhash_dedup.simhash_groups(docs).collect()
    assert sorted(tuple(r) for r in found) == [(0, 0), (1, 0), (2, 2), (3, 2)]
    assert sorted(r["doc_id"] for r in corpus_pipeline.simhash_stage(spark, docs, DATA).collect()) == [0, 2, 3]
