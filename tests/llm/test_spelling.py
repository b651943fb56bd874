"""Near words, forms and roots against all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest

from ledgerlens.llm import spelling as S


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def want(count, ratio=10):
    near = {w: [v for v in count if one_edit(w, v)] for w in count}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-count[v], v), default=None)
        form[w] = best if best is not None and count[best] >= ratio * count[w] else None
    out = []
    for w in count:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, count[w], len(near[w]), count[form[w]] if form[w] is not None else None))
    return sorted(out)


COLUMNS = "word form root n n_near form_n".split()


def rows(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


@pytest.mark.parametrize("seed, alphabet, longest, size", [(1, "ab", 6, 90), (2, "abcé", 4, 250), (3, "abcdefgh", 3, 300), (4, "a", 12, 12)])
def test_words_of_small_alphabets(spark, seed, alphabet, longest, size):
    rnd = random.Random(seed)
    words = {"".join(rnd.choices(alphabet, k=rnd.randint(0, longest))) for _ in range(size)}
    count = {w: rnd.choice([1, 2, 5, 9, 20, 50, 100, 500, 3000]) for w in words}
    df = spark.createDataFrame([(w, n, "x") for w, n in count.items()], "word string, n long, c string")
    assert rows(S.variants(df)) == want(count)


def test_long_words(spark):
    rnd = random.Random(5)
    base = "".join(rnd.choices("abcdefghijklmnop", k=3000))
    count = {base: 1000, base[:1500] + base[1501:]: 100, base[:7] + "z" + base[8:]: 10, base + "q": 1, base[1:]: 1, base[:2999]: 3}
    assert rows(S.variants(spark.createDataFrame(list(count.items()), "word string, n long"))) == want(count)


def counted(docs, damaged):
    found = Counter()
    for doc, text, *_ in docs:
        for w in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % damaged == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            found[w] += 1
    return {w: n for w, n in found.items() if n >= 2 and len(w) >= 7}


@pytest.mark.parametrize("kind", ["awkward", "empty"])
def test_documents(spark, kind):
    rnd = random.Random(6)
    words = ["Spelling", "spelling", "spellings", "Élégance", "élégance", "variant", "variants", "short", "a×b÷cdefg", "grouping", "groupings", "regrouping"]
    docs = [(rnd.choice([i, i, None]), rnd.choice([" ", ",", "1", "\n", "ł"]).join(rnd.choices(words, k=60)), "w", 1) for i in range(80)]
    docs += [(1, None, "w", 1), (None, None, "w", 1), (2, "", "w", 1), (3, "spelling " * 50, "w", 1), (3, "spelling " * 50, "w", 1)]
    docs = docs if kind == "awkward" else []
    df = spark.createDataFrame(docs, "doc_id long, text string, word string, n int").repartition(3)
    assert rows(S.variants(S.word_counts(df, damaged=3))) == want(counted(docs, 3))


def test_table(spark):
    d = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    count = counted(docs, 31)
    got = rows(S.op12_spelling(spark, d))
    assert {r[0]: r[3] for r in got} == count
    # all pairs by what is left after one character is taken out
    left = {}
    for w in count:
        for v in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            left.setdefault(v, []).append(w)
    near = {w: {v for x in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))} for v in left[x] if one_edit(w, v)} for w in count}
    assert {r[0]: r[4] for r in got} == {w: len(v) for w, v in near.items()}
    for w, form, _, n, _, form_n in got:
        best = min(near[w], key=lambda v: (-count[v], v), default=None)
        assert (form, form_n) == ((best, count[best]) if best and count[best] >= 10 * n else (None, None))


def test_no_table_of_words_is_broadcast(spark, monkeypatch):
    """Edges dealt to 64 parts, and words pressed in files, look small to Spark: at 0.5 GB 2 GB went through the driver."""
    plans = []

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, name)

    real = S.materialize
    monkeypatch.setattr(S, "materialize", seen)
    count = {"abcdefgh": 200, "abcdefg": 15, "abcdefgx": 3, "zzzzzzzz": 2}
    out = S.variants(spark.createDataFrame(list(count.items()), "word string, n long"))
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert rows(out) == want(count)
    assert sum("SortMergeJoin" in p for p in plans) >= 4
    assert not [p for p in plans if "Broadcast" in p]
