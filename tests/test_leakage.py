"""Leaks and near values against brute force."""

import random

from pyspark.sql import functions as F

from ledgerlens.operators import joins, leakage, solve


def sets_of(text):
    ws = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return tuple(ws), {tuple(ws[i : i + 5]) for i in range(max(len(ws) - 4, 1))} if ws else set()


def brute(rows):
    known = {k: (s, *sets_of(t)) for k, s, t in rows}
    said = {}
    for k, (s, ws, _) in known.items():
        if ws:
            said.setdefault(ws, []).append(k)
    out = {}
    for k, (s, ws, own) in known.items():
        if not ws:
            continue
        near = {}
        for other, ks in said.items():
            its = sets_of(" ".join(other))[1]
            if other != ws and any(known[j][0] != s for j in ks) and len(own & its) >= 0.8 * len(own | its) - 1e-9:
                near[other] = len(own & its) / len(own | its)
        exact = len({known[j][0] for j in said[ws]}) > 1
        if exact or near:
            out[k] = (min(said[ws]), exact, len(near), max(near.values(), default=None))
    return out


def test_leaks(spark):
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(12)] + ["Gia", "É"]
    bases = [[rnd.choice(vocabulary) for _ in range(rnd.choice([2, 4, 5, 30, 60]))] for _ in range(25)]
    rows, k = [], 0
    for b in bases:
        for _ in range(rnd.randint(1, 6)):
            x = list(b)
            for _ in range(rnd.choice([0, 0, 1, 1, 2])):
                x[rnd.randrange(len(x))] = rnd.choice(vocabulary)
            rows.append((k, rnd.choice(["train", "tune", "locked", None]), rnd.choice([" ", "\n", " \t"]).join(x)))
            k += 1
    rows += [(1000, "train", None), (1001, "tune", ""), (1002, "tune", " \n"), (1003, "train", "null"), (1004, None, "NULL")]
    df = spark.createDataFrame(rows, "id int, split string, text string").withColumn("digest", F.lit(1)).withColumn("set", F.lit(2))
    got = {r["id"]: (r["class_id"], r["exact"], r["n_near"], r["nearest"]) for r in leakage.leaks(df, "id", "split", "text").collect()}
    want = brute(rows)
    assert got == want and sum(x[2] > 0 for x in want.values()) > 5 and sum(x[1] for x in want.values()) > 5
    assert leakage.leaks(df.filter("id < 0"), "id", "split", "text").isEmpty()


def test_near_classes(spark):
    rnd = random.Random(7)
    values = [0.0, -0.4, 0.9, 999.0, 1000.5, 1e6, 1e6 + 900, 1e6 + 1100, -1e6, -1e6 - 999, 5e9, 5.004e9, None, float("nan")]
    rows = [(i, rnd.choice(["a", "b", None]), rnd.choice(values)) for i in range(150)]
    got = {r["id"]: tuple(r)[2:] for r in joins.near_classes(spark.createDataFrame(rows, "id int, g string, v double"), ["g"], "id", "v", 0.001).collect()}
    kept = [r for r in rows if r[2] is not None and r[2] == r[2]]
    want = {}
    for i, g, v in kept:
        own = [j for j, h, x in kept if h == g and x == v]
        near = [x for _, h, x in kept if g is not None and h == g and x != v and abs(x - v) <= max(1.0, 0.001 * max(abs(x), abs(v)))]
        want[i] = (min(own), len(own), len(set(near)), len(near))
    assert got == want and any(x[2] for x in want.values())


def near_texts(n_bases, copies, edits, boilerplate, seed):
    """(id, split, text): near copies of random texts, each with the same passage somewhere."""
    rnd, rows = random.Random(seed), []
    for _ in range(n_bases):
        base = [f"v{rnd.randrange(5000)}" for _ in range(60)]
        for _ in range(copies):
            x = list(base)
            for _ in range(rnd.randrange(edits + 1)):
                x[rnd.randrange(len(x))] = f"v{rnd.randrange(5000)}"
            at = rnd.randrange(len(x))
            rows.append((len(rows), rnd.choice("abc"), " ".join(x[:at] + boilerplate + x[at:])))
    return rows


def test_leaks_of_frequent_passages_and_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(leakage, "_OFTEN", 3)
    monkeypatch.setattr(leakage, "_BLOCK", 4)
    # texts of one passage and little else have frequent shingles only
    rows = near_texts(6, 12, 2, [f"b{i}" for i in range(40)], 3)
    rows += [(1000 + i, "abc"[i % 3], " ".join([f"b{j}" for j in range(i % 4, 40)] + [f"x{i % 5}"])) for i in range(40)]
    got = {r["id"]: (r["class_id"], r["exact"], r["n_near"], r["nearest"]) for r in leakage.leaks(spark.createDataFrame(rows, "id int, split string, text string"), "id", "split", "text").collect()}
    want = brute(rows)
    assert got == want and sum(x[2] > 8 for x in want.values()) > 20


def test_leaks_send_few_shingles(spark):
    rows = near_texts(600, 1, 0, [], 4)
    rows += [(len(rows), "d", rows[0][2] + " end")]
    store = spark.sparkContext._jsc.sc().statusStore()
    sent = lambda: sum(x.totalShuffleWrite() for x in (store.executorList(False).apply(i) for i in range(store.executorList(False).size())))
    before = sent()
    found = leakage.leaks(spark.createDataFrame(rows, "id int, split string, text string"), "id", "split", "text").count()
    # fewer bytes than 12 for each shingle of each text
    assert found == 2 and sent() - before < 12 * sum(len(sets_of(t)[1]) for _, _, t in rows)


def test_supports(spark, monkeypatch):
    monkeypatch.setattr(solve, "_LIST", 4)
    rnd = random.Random(8)
    values = [0.0, -0.0, -0.4, 0.6, 1.6, 999.0, 1000.0, 5e9, 5e9 + 5, 5e9 + 11, -5e9, -5e9 - 4, 1e12, 1e12 + 900, None, float("nan"), float("inf")]
    rows = [(i if i % 10 else i // 20, rnd.choice(["a", "b", None]), rnd.choice(values)) for i in range(160)] + [(None, "a", 0.0)]
    out = solve.supports(spark.createDataFrame(rows, "id int, g string, v double"), ["g"], "id", "v")
    fine = [r for r in rows if r[0] is not None and r[1] and r[2] is not None and abs(r[2]) < float("inf")]
    want = {(g, i, j) for i, g, x in fine for j, h, y in fine if g == h and i < j and abs(x - y) <= max(1.0, 1e-9 * max(abs(x), abs(y)))}
    got = [tuple(r) for r in out.collect()]
    assert sorted(got) == sorted(want) and len(want) > 250 and out.columns == ["g", "id", "other"]


def test_supports_send_rows_not_pairs(spark):
    cells = spark.range(1200).select(F.lit("a").alias("g"), "id", (F.col("id") % 2 * 100.0).alias("v"))
    store = spark.sparkContext._jsc.sc().statusStore()
    sent = lambda: sum(x.totalShuffleWrite() for x in (store.executorList(False).apply(i) for i in range(store.executorList(False).size())))
    before = sent()
    # under one byte a pair
    assert len(solve.supports(cells, ["g"], "id", "v").collect()) == 600 * 599 and sent() - before < 600 * 599
