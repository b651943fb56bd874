"""A kept index of vectors: inverted lists over coarse centroids, extended by new rows, searched exactly.

The folder holds ``centroids`` (fitted once, on at most ``SAMPLE`` rows by id hash), and for each batch of rows
``lists/batch=<n>/list=<c>`` with their unit vectors and angle to the centroid. A batch counts once its manifest
``manifest/<n>.json`` (lists with rows, least and greatest angle) is there, which is written last and by a rename.

Angles obey the triangle inequality: a vector at angle a of centroid c is at least \\|angle(q, c) - a\\| from a query q.
A search reads the nearest lists first, takes each query's k-th best score, and then only lists that can hold a
better one. The result is that of a full scan; recall is 1 by construction.

Null and zero vectors are not indexed; an id is indexed once, the first time that it comes (of several rows of
one id in a batch, one); queries without a direction have no neighbours.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators.ranking import _blocks, top_k
from ledgerlens.sources.shared import Files

SAMPLE, ROUNDS = 20_000, 12
#: Bytes of query vectors that are sent to all tasks at a time.
BLOCK_BYTES = 4 << 20
_ROWS = "vec_id long, unit array<double>, list int, angle double"
#: Scores are rounded to six places; nothing is ruled out closer than this.
_SLACK = 2e-6


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        return x / norm, norm[:, 0] > 0


def fit_centroids(sample: np.ndarray, n_lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means from rows spread over the sample; an empty list takes the row that fits worst."""
    centre = sample[np.linspace(0, len(sample) - 1, n_lists).astype(int)]
    for _ in range(rounds):
        near = sample @ centre.T
        own = near.argmax(axis=1)
        total = np.zeros_like(centre)
        np.add.at(total, own, sample)
        empty = np.flatnonzero(np.bincount(own, minlength=n_lists) == 0)
        total[empty] = sample[np.argsort(near.max(axis=1))[: len(empty)]]
        centre, ok = _unit(total)
        centre[~ok] = sample[0]
    return centre


def _slim(vectors: DataFrame) -> DataFrame:
    return vectors.filter("embedding is not null and vec_id is not null").select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))


class VectorIndex:
    """``open`` reads an index of a folder; ``extend`` adds rows that it does not have (and makes it where there is none)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.files = spark, folder.rstrip("/"), Files(spark, folder)
        self.centroids = np.array(json.loads(self.files.read("centroids.json"))) if self.files.exists("centroids.json") else None

    def batches(self) -> list[dict]:
        return [json.loads(self.files.read(f"manifest/{n}")) for n in self.files.names("manifest")]

    def rows(self, lists: list[int] | None = None) -> DataFrame:
        """Indexed rows of all published batches, or of some lists of them (other folders are not read)."""
        paths = [f"{self.folder}/lists/batch={b['batch']}/list={k}" for b in self.batches() for k in map(int, b["lists"]) if lists is None or k in lists]
        if not paths:
            return self.spark.createDataFrame([], _ROWS)
        return self.spark.read.option("basePath", f"{self.folder}/lists").schema(_ROWS + ", batch int").parquet(*paths).drop("batch")

    def extend(self, vectors: DataFrame, n_lists: int | None = None) -> int:
        """Index the rows whose id is new; gives their number. Centroids are fitted by the first batch."""
        new = _slim(vectors).join(self.rows().select("vec_id"), "vec_id", "left_anti").dropDuplicates(["vec_id"])
        if self.centroids is None:
            drawn = new.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toPandas()["embedding"]
            sample, ok = _unit(np.array(drawn.tolist(), dtype=np.float64)) if len(drawn) else (np.zeros((0, 1)), np.zeros(0, bool))
            sample = sample[ok]
            if not len(sample):
                return 0
            self.files.write("centroids.json", json.dumps(fit_centroids(sample, min(len(sample), n_lists or math.isqrt(len(sample)))).tolist()))
            self.centroids = np.array(json.loads(self.files.read("centroids.json")))  # of the one that came first
        shared = self.spark.sparkContext.broadcast(self.centroids)

        def assign(parts):
            for b in parts:
                for at in range(0, b.num_rows, 1024):
                    part = b.slice(at, 1024)
                    unit, ok = _unit(np.array(part.column(1).to_pylist(), dtype=np.float64).reshape(part.num_rows, -1))
                    unit = unit[ok]
                    near = unit @ shared.value.T
                    own = near.argmax(axis=1)
                    angle = np.arccos(np.clip(near[np.arange(len(own)), own], -1, 1))
                    yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(ok)), pa.array(unit.tolist(), pa.list_(pa.float64())), pa.array(own, pa.int32()), pa.array(angle)], names=["vec_id", "unit", "list", "angle"])

        batch = 1 + max((b["batch"] for b in self.batches()), default=-1)
        self.files.remove(f"lists/batch={batch}")  # what a writer that died has left
        # one list may hold a third of all rows: rows are dealt by list and a part of it
        rows = new.mapInArrow(assign, _ROWS).withColumn("deal", F.pmod(F.xxhash64("vec_id"), F.lit(16))).repartition("list", "deal").drop("deal")
        rows.write.partitionBy("list").parquet(f"{self.folder}/lists/batch={batch}")
        written = self.spark.read.schema(_ROWS).parquet(f"{self.folder}/lists/batch={batch}") if self.files.names(f"lists/batch={batch}") else None
        lists = {str(r["list"]): [r["n"], r["least"], r["most"]] for r in written.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("least"), F.max("angle").alias("most")).collect()} if written is not None else {}
        n = sum(x[0] for x in lists.values())
        if n and not self.files.write(f"manifest/{batch:08d}.json", json.dumps({"batch": batch, "lists": lists})):
            raise RuntimeError(f"batch {batch} was published by another writer")
        return n

    def search(self, queries: DataFrame, k: int, decimals: int = 6, block_bytes: int = BLOCK_BYTES) -> DataFrame:
        """(query_id, vec_id, score, rank): the k nearest indexed vectors of each query (vec_id, embedding), ties to the smaller id."""
        found = self.spark.createDataFrame([], "query_id long, vec_id long, score double")
        #: (list, query) pairs read, of all pairs: for reports
        self.read_pairs = self.all_pairs = 0
        spans: dict[int, list[float]] = {}
        for b in self.batches():
            for key, (n, least, most) in b["lists"].items():
                x = spans.setdefault(int(key), [0, math.inf, 0.0])
                spans[int(key)] = [x[0] + n, min(x[1], least), max(x[2], most)]
        if spans:
            width = self.centroids.shape[1]
            for block in _blocks(_slim(queries).toLocalIterator(), max(1, block_bytes // (8 * width))):
                q, ok = _unit(np.array([r[1] for r in block], dtype=np.float64))
                found = found.unionByName(self._block(np.array([r[0] for r in block])[ok], q[ok], spans, k, decimals))
        return top_k(found, ["query_id"], [F.desc("score"), F.asc("vec_id")], k)

    def _block(self, ids: np.ndarray, q: np.ndarray, spans: dict[int, list[float]], k: int, decimals: int) -> DataFrame:
        lists = np.array(sorted(spans))
        n, least, most = np.array([spans[c] for c in lists.tolist()]).T
        angle = np.arccos(np.clip(q @ self.centroids[lists].T, -1, 1))
        # the best score that a list can hold, and the nearest lists that hold k rows together
        gap = np.maximum(0, np.maximum(angle - most, least - angle))
        order = np.argsort(angle, axis=1, kind="stable")
        enough = np.cumsum(n[order], axis=1) - n[order] < k
        first = np.zeros(angle.shape, bool)
        np.put_along_axis(first, order, enough, axis=1)
        probed = self._scan(ids, q, lists, first, k, decimals, None)
        # k-th best so far: one small row for each query of the block
        kth = {r["query_id"]: r["s"] for r in top_k(probed, ["query_id"], [F.desc("score"), F.asc("vec_id")], k).groupBy("query_id").agg(F.min("score").alias("s"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == k).collect()}
        bound = np.array([kth.get(int(i), -2.0) for i in ids])
        second = ~first & (np.cos(gap) >= bound[:, None] - _SLACK)
        self.read_pairs += int(first.sum() + second.sum())
        self.all_pairs += first.size
        return probed.unionByName(self._scan(ids, q, lists, second, k, decimals, bound))

    def _scan(self, ids, q, lists, wanted, k: int, decimals: int, bound) -> DataFrame:
        """The k best of each query in the lists that it wants; rows whose angle rules them out are not scored."""
        schema = "query_id long, vec_id long, score double"
        some = np.flatnonzero(wanted.any(axis=0))
        if not len(some):
            return self.spark.createDataFrame([], schema)
        centre = self.centroids[lists]
        asks = {int(lists[c]): np.flatnonzero(wanted[:, c]) for c in some}
        shared = self.spark.sparkContext.broadcast((ids, q, asks, {int(c): centre[i] for i, c in enumerate(lists)}, bound))

        def run(parts):
            ids, q, asks, centre, bound = shared.value
            best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for b in parts:
                for at in range(0, b.num_rows, 1024):
                    part = b.slice(at, 1024)
                    list_of, angle = part.column(2).to_numpy(), part.column(3).to_numpy()
                    unit, vec = np.array(part.column(1).to_pylist()), part.column(0).to_numpy()
                    for c in np.unique(list_of).tolist():
                        rows, mine = np.flatnonzero(list_of == c), asks.get(c, ())
                        if not len(mine):
                            continue
                        s = np.round(q[mine] @ unit[rows].T, decimals)
                        if bound is not None:
                            away = np.abs(np.arccos(np.clip(q[mine] @ centre[c], -1, 1))[:, None] - angle[rows])
                            s[np.cos(away) < bound[mine][:, None] - _SLACK] = -np.inf
                        for j, i in enumerate(mine.tolist()):
                            old = best.get(i, (np.zeros(0), np.zeros(0, np.int64)))
                            there = np.isfinite(s[j])
                            score, name = np.r_[old[0], s[j][there]], np.r_[old[1], vec[rows][there]]
                            top = np.lexsort((name, -score))[:k]
                            best[i] = (score[top], name[top])
            for i, (score, name) in best.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(name), ids[i])), pa.array(name), pa.array(score + 0.0)], names=["query_id", "vec_id", "score"])

        return self.rows(list(asks)).select("vec_id", "unit", "list", "angle").mapInArrow(run, schema)
