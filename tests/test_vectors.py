"""The kept vector index against a full scan; new rows only; a writer that died."""

import os

import numpy as np
import pytest

from ledgerlens.operators import ranking, vectors

SCHEMA = "vec_id long, embedding array<double>"


def made(seed, n, dims=12, groups=9):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(groups, dims)) * 2
    x = centre[rng.integers(0, groups, n)] + rng.normal(size=(n, dims))
    return x.round(3).tolist()


def full(spark, queries, rows, k):
    q, v = spark.createDataFrame(queries, SCHEMA), spark.createDataFrame(rows, SCHEMA)
    return sorted(tuple(r) for r in ranking.cosine_top_k(q, v, k).collect())


@pytest.mark.parametrize("k", [1, 7, 500])
def test_search_is_exact(spark, tmp_path, k):
    rows = list(enumerate(made(1, 400)))
    rows += [(1000 + i, v) for i, v in rows[:30]]  # ties
    rows += [(2000, None), (2001, [0.0] * 12), (None, rows[0][1])]
    index = vectors.VectorIndex(spark, f"{tmp_path}/index")
    assert index.extend(spark.createDataFrame(rows, SCHEMA), 12) == 430
    queries = [(i, v) for i, v in rows[::9] if v is not None and i is not None] + [(77777, None)]
    got = index.search(spark.createDataFrame(queries, SCHEMA), k, block_bytes=8 * 12 * 20)
    assert sorted(tuple(r) for r in got.collect()) == full(spark, queries, [r for r in rows if r[0] is not None], k)
    assert 0 < index.read_pairs <= index.all_pairs and (k > 1 or index.read_pairs < 0.6 * index.all_pairs)


def test_second_build_adds_new_rows_only(spark, tmp_path):
    folder, rows = f"{tmp_path}/index", list(enumerate(made(2, 300)))
    first = vectors.VectorIndex(spark, folder)
    assert first.extend(spark.createDataFrame(rows[:200], SCHEMA)) == 200
    os.makedirs(f"{folder}/lists/batch=1/list=0")  # a writer died before it published batch 1
    open(f"{folder}/lists/batch=1/list=0/part-x.parquet", "w").close()
    before = {p: os.path.getmtime(p) for d, _, names in os.walk(f"{folder}/lists/batch=0") for p in (f"{d}/{n}" for n in names)}
    again = vectors.VectorIndex(spark, folder)
    assert again.rows().count() == 200
    assert again.extend(spark.createDataFrame(rows, SCHEMA)) == 100
    assert again.extend(spark.createDataFrame(rows, SCHEMA)) == 0
    assert all(os.path.getmtime(p) == t for p, t in before.items())
    assert [sum(x[0] for x in b["lists"].values()) for b in again.batches()] == [200, 100]
    got = vectors.VectorIndex(spark, folder).search(spark.createDataFrame(rows[::20], SCHEMA), 5)
    assert sorted(tuple(r) for r in got.collect()) == full(spark, rows[::20], rows, 5)


def test_empty(spark, tmp_path):
    index = vectors.VectorIndex(spark, f"{tmp_path}/index")
    none = spark.createDataFrame([], SCHEMA)
    assert index.extend(none) == 0 and index.search(spark.createDataFrame([(1, [1.0])], SCHEMA), 3).count() == 0
    index.extend(spark.createDataFrame([(1, [1.0, 0.0])], SCHEMA))
    assert index.search(none, 3).count() == 0


def test_only_wanted_lists_are_read(spark, tmp_path):
    index = vectors.VectorIndex(spark, f"{tmp_path}/index")
    index.extend(spark.createDataFrame(list(enumerate(made(3, 200))), SCHEMA), 6)
    files = index.rows([0, 3]).inputFiles()
    assert files and all("/list=0/" in f or "/list=3/" in f for f in files)


def test_memory_of_a_search_does_not_grow_with_its_queries():
    """A block of 16,384 queries took some 770 MB of each worker; tiles of scores take a tenth of that."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from ledgerlens.operators import ranking

    rng = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    q, v = unit(rng.normal(size=(16384, 8))), unit(rng.normal(size=(1500, 8)))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(1500)), pa.array(v.tolist())], names=["vec_id", "embedding"])
    tracemalloc.start()
    (out,) = ranking._nearest([batch], np.arange(16384), q, 2, 6)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 << 20
    got = {}
    for a, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist()):
        got.setdefault(a, set()).add(b)
    for i in (0, 1023, 1024, 16383):
        s = np.round(q[i] @ v.T, 6)
        assert got[i] == set(np.lexsort((np.arange(1500), -s))[:2].tolist())
