"""Ranking operators: every order ends in a position, so ties go to the first in input order."""

from __future__ import annotations

from collections import Counter
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens import config


def top_k(df: DataFrame, by: list[str], order: list[Column], k) -> DataFrame:
    """First k rows of each group; k may be a column (a budget of the group)."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.filter(F.col("rank") <= k)


#: Rows that a task sorts at a time.
_SORTED_ROWS = 500_000


def quota_top_k(df: DataFrame, query: str, group: str, score: str, pos: str, depth: int) -> DataFrame:
    """Each group of a query first gets max(1, depth / groups) places, the rest is filled by score."""
    best = [F.desc(score), F.asc(pos)]
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // _SORTED_ROWS))
    dealt = df.repartition(n, query)  # one exchange and two sorts; what a task sorts does not grow with the table
    ranked = dealt.withColumn("in_group", F.row_number().over(Window.partitionBy(query, group).orderBy(*best)))
    # each group has one first row; null groups are not counted, as by a distinct count
    first = (F.col("in_group") == 1) & F.col(group).isNotNull()
    ranked = ranked.withColumn("groups", F.count_if(first).over(Window.partitionBy(query)))
    ranked = ranked.withColumn("fill", (F.col("in_group") > F.greatest(F.lit(1), F.floor(F.try_divide(F.lit(depth), F.col("groups"))))).cast("int"))
    return top_k(ranked, [query], [F.asc("fill"), *best], depth).drop("groups", "in_group")


def runner_up_gap(df: DataFrame, by: str, score: str, pos: str) -> DataFrame:
    """Best row of each group and its lead over the second."""
    w = Window.partitionBy(by).orderBy(F.desc(score), pos)
    return df.withColumn("second", F.lead(score).over(w)).withColumn("rank", F.row_number().over(w)).filter("rank = 1").withColumn("gap", F.col(score) - F.col("second"))


def bm25_top_k(docs: DataFrame, queries: DataFrame, k: int, decimals: int = 4, k1: float = config.BM25_K1, b: float = config.BM25_B, block_terms: int = 1 << 20) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best documents of each query, ties to the smaller id.

    docs: doc_id, terms; queries: query_id, terms. A repeated query term counts again; documents that share no
    term are not listed. Queries go out in blocks of at most ``block_terms`` (query, term) places; a task scores
    each document once for a block and keeps k rows for each query, so what is shuffled is
    tasks x queries x k thin rows, and the counts of the asked terms. Null terms count as none.
    """
    spark = docs.sparkSession
    asked = [(r[0], Counter(r[1] or ())) for r in queries.select(F.col("query_id").cast("long"), "terms").toLocalIterator()]
    slim = docs.select(F.col("doc_id").cast("long"), F.coalesce("terms", F.array().cast("array<string>")).alias("terms"))
    found = spark.createDataFrame([], _SCORED)
    for block in _query_blocks(asked, block_terms):
        words = sorted({w for _, ws in block for w in ws})
        shared = spark.sparkContext.broadcast(pa.array(words, pa.string()))  # bounded by the block
        counts = np.zeros(len(words) + 2)
        for r in slim.select("terms").mapInArrow(_document_counts(shared), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
            counts[r["term"]] = r["n"]
        counts, (n_docs, all_terms) = counts[:-2], counts[-2:]
        place = {w: i for i, w in enumerate(words)}
        weight = np.zeros((len(words), len(block)))
        for j, (_, ws) in enumerate(block):
            for w, times in ws.items():
                weight[place[w], j] = times
        weight *= np.log((n_docs - counts + 0.5) / (counts + 0.5) + 1)[:, None]
        index = spark.sparkContext.broadcast((pa.array(words, pa.string()), np.array([i for i, _ in block]), weight))
        found = found.unionAll(slim.mapInArrow(_bm25_search(index, k, decimals, k1, b, all_terms / max(n_docs, 1)), _SCORED))
    return top_k(found, ["query_id"], [F.desc("score"), F.asc("doc_id")], k)


_SCORED = "query_id long, doc_id long, score double"
#: Documents that are scored at a time.
_CHUNK = 256


def _query_blocks(asked: list[tuple[int, Counter]], places: int):
    """Lists of queries whose number times number of terms stays within ``places``."""
    block, words = [], set()
    for q in asked:
        if block and (len(block) + 1) * len(words | q[1].keys()) > places:
            yield block
            block, words = [], set()
        block.append(q)
        words |= q[1].keys()
    if words:
        yield block


def _term_counts(terms: pa.Array, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, word, count) of the asked words in a list array."""
    size = np.diff(terms.offsets.to_numpy())
    which = pc.index_in(terms.flatten(), value_set=words)
    owner, hit = np.repeat(np.arange(len(terms)), size), which.is_valid().to_numpy(zero_copy_only=False)
    key, n = np.unique(owner[hit] * len(words) + which.drop_null().to_numpy(), return_counts=True)
    return key // len(words), key % len(words), n


def _document_counts(shared):
    def run(batches):
        """Documents with each word; after them the number of documents and of all their terms."""
        n = np.zeros(len(shared.value) + 2, np.int64)
        for b in batches:
            n += np.bincount(_term_counts(b.column(0), shared.value)[1], minlength=len(n))
            n[-2:] += b.num_rows, len(b.column(0).flatten())
        there = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(n[there])], names=["term", "n"])

    return run


def _bm25_search(index, k: int, decimals: int, k1: float, b: float, avg_len: float):
    def run(batches):
        words, ids, weight = index.value
        best_s, best_d = np.full((len(ids), 0), -np.inf), np.zeros((len(ids), 0), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, _CHUNK):
                part = batch.slice(at, _CHUNK)
                size = np.diff(part.column(1).offsets.to_numpy())
                doc, word, tf = _term_counts(part.column(1), words)
                grown = np.zeros((part.num_rows, len(words)))
                grown[doc, word] = tf * (k1 + 1) / (tf + k1 * (1 - b + b * size[doc] / (avg_len or 1)))
                s = (grown @ weight).T
                s = np.where(s > 0, np.round(s, decimals), -np.inf)
                best_s = np.concatenate((best_s, s), axis=1)
                best_d = np.concatenate((best_d, np.broadcast_to(part.column(0).to_numpy(), s.shape)), axis=1)
                order = np.lexsort((best_d, -best_s), axis=1)[:, :k]
                best_s, best_d = np.take_along_axis(best_s, order, 1), np.take_along_axis(best_d, order, 1)
        kept = np.isfinite(best_s)
        cols = (np.broadcast_to(ids[:, None], best_s.shape)[kept], best_d[kept], best_s[kept])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["query_id", "doc_id", "score"])

    return run


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def _blocks(rows, size: int):
    """Lists of at most ``size`` rows of an iterator."""
    rows = iter(rows)
    while block := list(islice(rows, size)):
        yield block


#: Queries and vectors whose scores a task holds at a time.
_TILE = 1024


def _nearest(batches, ids: np.ndarray, q: np.ndarray, k: int, decimals: int):
    """query_id, vec_id, score of the k nearest vectors of each query; scores of 1,024 queries and 1,024 vectors at a time, so memory has a bound."""
    best_s, best_v = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)
    for b in batches:
        for at in range(0, b.num_rows, _TILE):
            part = b.slice(at, _TILE)
            v = np.array(part.column(1).to_pylist(), dtype=np.float64)
            norm = np.linalg.norm(v, axis=1, keepdims=True)
            with np.errstate(invalid="ignore", divide="ignore"):
                unit = (v / norm).T
            for first in range(0, len(ids), _TILE):
                own = slice(first, first + _TILE)
                with np.errstate(invalid="ignore", divide="ignore"):
                    s = np.round(q[own] @ unit, decimals)
                s[:, ~(norm[:, 0] > 0)] = -np.inf
                all_s = np.concatenate((best_s[own], s), axis=1)
                all_v = np.concatenate((best_v[own], np.broadcast_to(part.column(0).to_numpy(), s.shape)), axis=1)
                order = np.lexsort((all_v, -all_s), axis=1)[:, :k]
                best_s[own], best_v[own] = np.take_along_axis(all_s, order, 1), np.take_along_axis(all_v, order, 1)
    kept = np.isfinite(best_s)
    cols = (np.broadcast_to(ids[:, None], best_s.shape)[kept], best_v[kept], best_s[kept] + 0.0)
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["query_id", "vec_id", "score"])


def cosine_top_k(queries: DataFrame, vectors: DataFrame, k: int, decimals: int = 6, block_bytes: int = 8 << 20) -> DataFrame:
    """(query_id, vec_id, score, rank): the k nearest vectors of each query by cosine, ties to the smaller id.

    queries and vectors: vec_id, embedding. Queries are sent out in blocks of at most ``block_bytes``; a
    task keeps k rows for each query of a block, so what is shuffled is tasks x queries x k thin rows.
    Null and zero vectors have no neighbours.
    """
    schema = "query_id long, vec_id long, score double"
    sc = vectors.sparkSession.sparkContext
    slim = vectors.filter("embedding is not null").select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))

    def search(shared):
        return lambda batches: _nearest(batches, *shared.value, k, decimals)

    found = None
    asked = queries.filter("embedding is not null").select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    size = len((asked.first() or (0, [0.0]))[1])
    for block in _blocks(asked.toLocalIterator(), max(1, block_bytes // (8 * max(size, 1)))):
        q = np.array([r[1] for r in block])
        norm = np.linalg.norm(q, axis=1, keepdims=True)
        keep = norm[:, 0] > 0
        part = slim.mapInArrow(search(sc.broadcast((np.array([r[0] for r in block])[keep], q[keep] / norm[keep]))), schema)
        found = part if found is None else found.unionByName(part)
    found = vectors.sparkSession.createDataFrame([], schema) if found is None else found
    return top_k(found, ["query_id"], [F.desc("score"), F.asc("vec_id")], k)


def best_column(df: DataFrame, by: list[str], keys: list[Column]) -> DataFrame:
    return top_k(df, by, keys, 1).drop("rank")
