"""Runs against a search of all periods at all places."""

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlens.llm import periodic_runs as P


def brute(w, least=6, times=4):
    """Stretches of words that equal those q before them, as long as they go; not those whose period is not the smallest."""
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, times * q):
                run = w[i : j + q]
                if not any(all(run[k] == run[k + s] for k in range(len(run) - s)) for s in range(1, q)):
                    out.append((i, len(run), q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def numbered(w):
    number = {x: i for i, x in enumerate(dict.fromkeys(w))}
    return np.array([number[x] for x in w], np.int64)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=60), max_size=6), st.sampled_from([(2, 2), (6, 4), (1, 3)]))
def test_small_alphabets(docs, least):
    assert P.find_runs([numbered(d) for d in docs], *least) == [brute(d, *least) for d in docs]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abcd"), min_size=1, max_size=9), st.integers(1, 12)), max_size=8))
def test_powers(parts):
    w = [x for p, k in parts for x in p * k]
    assert P.find_runs([numbered(w)] * 2) == [brute(w)] * 2
    assert P.find_runs([numbered(w)], 2, 2) == [brute(w, 2, 2)]


def test_long_words_of_known_shape():
    fib = ["a", "ab"]
    while len(fib[-1]) < 400:
        fib.append(fib[-1] + fib[-2])
    rng = np.random.default_rng(3)
    texts = [fib[-1], "a" * 500, "ab" * 300 + "c" + "abc" * 200, "".join(rng.choice(list("ab"), 700)), "x" + "abcdefghij" * 70 + "y"]
    for least in ((2, 2), (6, 4)):
        assert P.find_runs([numbered(t) for t in texts], *least) == [brute(t, *least) for t in texts]


def test_large_document_is_near_linear():
    rng = np.random.default_rng(4)
    w = rng.integers(0, 40_000, 300_000)
    w[50_000:] = w[50_000 + np.arange(250_000) % 31_250]
    _, numbers = np.unique(w, return_inverse=True)
    assert P.find_runs([numbers]) == [[(50_000, 250_000, 31_250)]] or P.find_runs([numbers])[0][0][2] == 31_250


def sha(b):
    return hashlib.sha256(b).hexdigest()


def want(doc, text):
    w = (text or "").encode().split()
    h, n = (zlib.crc32(str(doc).encode()), len(w)) if doc is not None else (1, 0)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = brute(w)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = b" ".join(x for i, x in enumerate(w) if i not in dropped)
    return (doc, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()), sha(kept))


COLUMNS = "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()


@pytest.mark.parametrize("kind", ["awkward", "empty"])
def test_rows(spark, tmp_path, kind):
    texts = [None, "", " \t\n ", "one", "la " * 9, "la la la la la la la la ho " * 5, "x y " * 40 + "z", "é\x1cé é\x85é " * 9, "a\x0bb\x0ca\x0db a b a b a b"]
    rows = [(i, texts[i % len(texts)], "s", [], 1) for i in range(120)] if kind == "awkward" else []
    if rows:
        rows += [(None, "ab " * 7, "s", [], 1), (3, "q", "s", [], 1), (3, "q", "s", [], 1), (-1, "w " * 30, "s", [], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, w string, runs array<int>, n_words int")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r[c] for c in COLUMNS) for r in P.op13_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted((want(*r[:2]) for r in rows), key=str)
    if rows:
        assert sum(r[1] > 0 for r in got) > 20


def test_table(spark):
    d = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    short = [x for x in docs if len((x[1] or "").split()) < 600]
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in P.op13_periodic_runs(spark, d).collect()}
    assert len(got) == len(docs)
    assert [got[i] for i, _ in short] == [want(*x) for x in short]
