"""Shards of token ids: exact round trips, any stretch of ids, and the tokenizer's own ids."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlens.llm import token_files as T


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 200_000])
@pytest.mark.parametrize("most", [1, 2, 300, 50_000, 2**32])
def test_round_trip(n, most):
    rng = np.random.default_rng(n + most)
    ids = np.minimum(rng.integers(0, most, n), rng.integers(0, most, n)).astype(np.uint32)
    if n > 3:
        ids[rng.integers(0, n, 1 + n // 50)] = most - 1  # outliers
    cut = np.sort(rng.integers(0, n + 1, 5))
    parts = [(None if i == 2 else i - 9, x) for i, x in enumerate(np.split(ids, cut))]
    shard = T.Shard(T.shard_bytes(parts))
    assert shard.n_ids == n
    got = list(shard.documents())
    assert [d for d, _, _ in got] == [d for d, _ in parts]
    assert all(np.array_equal(x, y) for (_, _, x), (_, y) in zip(got, parts))
    assert [s for _, s, _ in got] == [0, *cut.tolist()]
    for _ in range(20):
        a, b = sorted(rng.integers(0, n + 1, 2).tolist())
        assert np.array_equal(shard.ids(a, b), ids[a:b])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=700), st.sampled_from([8, 64, 256]), st.sampled_from([0.1, 0.5, 0.9, 1.0]))
def test_any_ids(ids, block, share):
    shard = T.Shard(T.shard_bytes([(1, np.array(ids, np.uint32))], block, share))
    assert shard.ids(0, len(ids)).tolist() == ids


def test_outliers_are_exceptions():
    ids = np.full(256, 1000, np.uint32)
    ids[::2] += 7
    assert len(T.pack_blocks(ids)[0]) == 8 + 256 * 3 // 8
    ids[5] = 4_000_000_000
    assert len(T.pack_blocks(ids)[0]) == 8 + 256 * 3 // 8 + 1 + 4


def test_cut_file():
    data = T.shard_bytes([(1, np.arange(500))])
    with pytest.raises(ValueError):
        T.Shard(data[:-3])
    with pytest.raises(IndexError):
        T.Shard(data).ids(0, 501)


TEXTS = [None, "", " ", "Hello, World. it's 42!", "a.b,c.d e..f ,.x", "naïve café. Straße, ÀÉ.ÿ,", "é. x́,y  z w\x1cq\x85r\x0bs\tt\ru\nv", "ΣΑΣ. İi, ﬁ", "<|endoftext|> a, b. <|startoftext|>", "1.5,2 3rd. 'll 's. don't,", "字,字。 x", "�., \U0001f600.", "ab. " * 5000]


def test_encoder_is_the_tokenizer():
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(T.default_tokenizer())
    encode = T.encoder(T.default_tokenizer())
    texts = [t or "" for t in TEXTS]
    rng = np.random.default_rng(1)
    alphabet = list("aZé.,' \n\t1-<|>́ Σß字\x1c")
    texts += ["".join(rng.choice(alphabet, 40)) for _ in range(2000)]
    for text, got in zip(texts, encode(texts)):
        assert got.tolist() == full.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("kind", ["unique", "awkward", "empty"])
def test_files(spark, kind):
    from tokenizers import Tokenizer

    rows = [] if kind == "empty" else [(i, t, "f", 1) for i, t in enumerate(TEXTS)]
    if kind == "awkward":
        rows += [(3, "x", "f", 1), (3, "x", "f", 1), (None, "y", "f", 1), (None, None, "f", 1), (-5, "z", "f", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, file string, base int").repartition(3)
    manifest = T.write(df, shard_ids=40)
    got = [tuple(r) for r in T.read(manifest).collect()]
    full = Tokenizer.from_file(T.default_tokenizer())
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, start = [], 0
    for doc, text, *_ in rows:
        ids = np.array([*full.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    assert manifest.count() == len({r["file"] for r in manifest.collect()}) and (kind == "empty" or manifest.count() > 1)


def test_table(spark):
    """All of the small table, whatever its order of rows."""
    d = "/root/testdata/sf0.001"
    from tokenizers import Tokenizer

    full, start = Tokenizer.from_file(T.default_tokenizer()), 0
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in T.op11_token_files(spark, d).collect()}
    for r in spark.read.parquet(f"{d}/documents.parquet").orderBy("doc_id").collect():
        ids = np.array([*full.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        assert got.pop(r["doc_id"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert not got
