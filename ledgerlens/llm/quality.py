"""Quality classifier by co-training two views of a document.

The content view sees words and word shapes; the metadata view sees language, source, length and the
layout figures of the page (lines, symbols, distinct and most frequent words), each as a bucket. Both
are naive Bayes models over hashed features, so a model is a fixed-size table of counts and training is
an aggregation: in each round every document that is not labelled is scored by both views, and what one
view is sure about is counted, as a pseudo-label, into the other. At the end both views are calibrated
together by logistic regression on labelled rows that are in none of the counts, and score all documents.
The features of the rounds are written once.

Bound: at most ``MAX_LABELS`` labelled rows are used, those with the least hash of their id; a third of
them calibrates. Counts, pseudo-labels and scores cover all documents.

Defined results: null text counts as empty, null language, source and length are values of their own; a
label that is null is ignored, of repeated labels the mean decides; without labels of both kinds every
document scores 0.5 and stays; repeated rows and null ids are scored like any other; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, small
from .substring_dedup import word_hashes

DIMS = 1 << 16
MAX_LABELS = 20_000
ROUNDS = 2
#: A pseudo-label needs this probability and counts this much.
SURE, WEIGHT = 0.97, 0.5
#: Below this score a document is rejected; low, so that clean documents stay.
KEEP_AT = 0.3
VIEWS = ("content", "metadata")

#: ASCII letters and every byte of other letters.
_LETTERS = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])
#: Shape of a byte: letters are one, digits are one, the rest stands for itself.
_SHAPE = bytes(97 if _LETTERS[b] else 57 if 48 <= b <= 57 else b for b in range(256))


class Features:
    """Distinct features of the two views for some texts: per view the texts' numbers and feature numbers."""

    def __init__(self, texts: list[bytes], langs: list, sources: list, chars: list):
        self.n = len(texts)
        data = b"\n".join(texts).lower()
        ends = np.cumsum([len(t) + 1 for t in texts])
        starts = np.concatenate(([0], ends[:-1]))
        raw = np.frombuffer(data, np.uint8)
        owner, words, counts = self._distinct(data, starts)
        shape = np.frombuffer(data.translate(_SHAPE), np.uint8)
        kept = np.concatenate(([True], (shape[1:] != shape[:-1]) | (shape[1:] != 97) & (shape[1:] != 57))) if len(shape) else np.zeros(0, bool)
        before = np.concatenate(([0], np.cumsum(kept)))
        shape_owner, shapes, _ = self._distinct(shape[kept].tobytes(), before[starts])
        words_in = np.bincount(owner, counts, self.n).astype(np.int64)
        distinct = np.bincount(owner, minlength=self.n)
        top = np.zeros(self.n, np.int64)
        np.maximum.at(top, owner, counts)
        per = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags)))[np.append(starts, len(raw))])
        lines, others, sizes = per(raw == 10), per(~_LETTERS[raw]), np.array([len(t) for t in texts])
        empty = np.flatnonzero(words_in == 0)
        pairs = np.unique(np.concatenate((owner * DIMS + (words % (DIMS - 1)).astype(np.int64), shape_owner * DIMS + (shapes % (DIMS - 1)).astype(np.int64), empty * DIMS + DIMS - 1)))
        layout = []
        for i, (lang, source, n_chars, n) in enumerate(zip(langs, sources, chars, words_in.tolist())):
            values = (
                ("lang", lang),
                ("source", source),
                ("chars", None if n_chars is None else int(n_chars).bit_length()),
                ("line", int(math.log2(1 + sizes[i] / (1 + lines[i])) * 2)),
                ("others", int(20 * others[i] / (1 + sizes[i]))),
                ("distinct", int(10 * distinct[i] / n) if n else -1, n.bit_length()),
                ("top", int(20 * top[i] / n) if n else -1, n.bit_length()),
            )
            layout.append([i * DIMS + zlib.crc32(repr(x).encode()) % DIMS for x in values])
        self.pairs = pairs, np.unique(np.array(layout, np.int64).ravel())

    @staticmethod
    def _distinct(data: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text number, digest, count) of the distinct words of each text."""
        at, h = word_hashes(data)
        owner = np.searchsorted(starts, at, "right") - 1
        with np.errstate(over="ignore"):
            key = h[:, 0] ^ (owner.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        _, first, counts = np.unique(key, return_index=True, return_counts=True)
        return owner[first], h[first, 0], counts

    @classmethod
    def read(cls, columns: list[list[bytes]]) -> "Features":
        """Features as ``written`` gave them: for each view a list with one packed uint16 array a text."""
        f = cls.__new__(cls)
        f.n = len(columns[0])
        f.pairs = tuple(np.repeat(np.arange(f.n) * DIMS, [len(x) // 2 for x in c]) + np.frombuffer(b"".join(c), "<u2") for c in columns)
        return f

    def written(self) -> list[list[bytes]]:
        out = []
        for pairs in self.pairs:
            cuts = np.searchsorted(pairs, np.arange(self.n + 1) * DIMS)
            packed = (pairs % DIMS).astype("<u2")
            out.append([packed[a:e].tobytes() for a, e in zip(cuts, cuts[1:])])
        return out

    def add_to(self, counts: np.ndarray, view: int, classes: np.ndarray, weight: float = 1.0) -> None:
        """Count the features of one view by the class of their text; texts of class -1 do not count."""
        y = classes[self.pairs[view] // DIMS]
        for c in (0, 1):
            counts[view, c] += weight * np.bincount(self.pairs[view][y == c] % DIMS, minlength=DIMS)


def _together(texts: list, limit: int = 1 << 20):
    """Slices of consecutive texts of about ``limit`` bytes."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size > limit:
            yield slice(first, i + 1)
            first, size = i + 1, 0
    if first < len(texts):
        yield slice(first, len(texts))


def _parts(batch):
    """(slice, Features) of a batch whose first columns are text, lang, source, n_chars."""
    texts = [t or b"" for t in batch.column(0).cast(pa.binary()).to_pylist()]
    rest = [batch.column(i).to_pylist() for i in (1, 2, 3)]
    for part in _together(texts):
        yield part, Features(texts[part], *(x[part] for x in rest))


class Model:
    """Counts [view, class, feature] and documents [view, class]; logits and the joint calibration."""

    def __init__(self):
        self.counts = np.zeros((2, 2, DIMS))
        self.docs = np.zeros((2, 2))
        self.fit = np.zeros((3, 3))  # rows: content alone, metadata alone, both; bias and a weight per view

    def ready(self) -> bool:
        return bool((self.docs > 0).all())

    def prepare(self) -> "Model":
        p = (self.counts + 0.5) / (self.docs[:, :, None] + 1)
        self.odds = (np.log(p[:, 1]) - np.log(p[:, 0])).astype(np.float32)
        return self

    def raw(self, features: Features) -> np.ndarray:
        """Per text the summed log odds of each view, over the root of their number."""
        out = []
        for view, pairs in enumerate(features.pairs):
            text = pairs // DIMS
            out.append(np.bincount(text, self.odds[view][pairs % DIMS], features.n) / np.sqrt(np.bincount(text, minlength=features.n)))
        return np.stack(out, axis=1)

    def probabilities(self, raw: np.ndarray) -> np.ndarray:
        """Per text the calibrated probability by content, by metadata and by both."""
        z = np.concatenate((np.ones((len(raw), 1)), raw), axis=1) @ self.fit.T
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Weights of a logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def labelled(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = MAX_LABELS) -> DataFrame:
    """docs with ``y`` (0 or 1) and ``fold`` for at most ``bound`` labelled ids."""
    y = labels.select(F.col("doc_id").alias("labelled_id"), F.col(label).alias("q")).filter("q is not null and labelled_id is not null")
    y = y.groupBy("labelled_id").agg((F.avg("q") >= 0.5).cast("int").alias("y"))
    y = y.orderBy(F.xxhash64("labelled_id"), "labelled_id").limit(bound).withColumn("fold", F.pmod(F.xxhash64("labelled_id", F.lit(7)), F.lit(3)))
    return docs.join(F.broadcast(y), docs["doc_id"] == y["labelled_id"])  # at most ``bound`` rows


_COUNTED = "view int, y int, feature int, n double"


def _emit(counts: np.ndarray, docs: np.ndarray):
    """Partial counts of a task; feature -1 has the number of documents."""
    view, y, feature = np.nonzero(counts)
    n = counts[view, y, feature]
    dv, dy = np.nonzero(docs)
    cols = (np.concatenate((view, dv)), np.concatenate((y, dy)), np.concatenate((feature, np.full(len(dv), -1))), np.concatenate((n, docs[dv, dy])))
    types = (pa.int32(), pa.int32(), pa.int32(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["view", "y", "feature", "n"])


def _add(model: Model, counted: DataFrame) -> None:
    """Merge partial counts: at most 4 x DIMS rows come to the driver."""
    for r in counted.groupBy("view", "y", "feature").agg(F.sum("n").alias("n")).toLocalIterator():
        if r["feature"] < 0:
            model.docs[r["view"], r["y"]] += r["n"]
        else:
            model.counts[r["view"], r["y"], r["feature"]] += r["n"]


def _calibrate(model: Model, held: DataFrame) -> None:
    """Joint and single calibrations on the labelled rows that were kept out."""
    shared = held.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in small(batches):
            for part, f in _parts(b):
                raw = shared.value.raw(f)
                y = b.column(4).to_numpy(zero_copy_only=False)[part].astype(float)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (raw[:, 0], raw[:, 1], y)], names=["a", "b", "y"])

    got = held.select("text", "lang", "source", "n_chars", "y").mapInArrow(run, "a double, b double, y double").collect()
    if not got or len({r["y"] for r in got}) < 2:
        model.fit = np.array([[0, 1, 0], [0, 0, 1], [0, 1, 1]], dtype=float)
        return
    a, b, y = np.array([tuple(r) for r in got]).T
    one = np.ones_like(a)
    wa, wb = logistic(np.stack((one, a), 1), y), logistic(np.stack((one, b), 1), y)
    model.fit = np.array([[wa[0], wa[1], 0], [wb[0], 0, wb[1]], logistic(np.stack((one, a, b), 1), y)])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rounds: int = ROUNDS, bound: int = MAX_LABELS) -> Model:
    """Co-trained and calibrated model. docs: doc_id, text, lang, source, n_chars."""
    model = Model()
    some = labelled(docs, labels, label, bound)

    def count(batches):
        counts, n = np.zeros((2, 2, DIMS)), np.zeros((2, 2))
        for b in small(batches):
            for part, f in _parts(b):
                y = b.column(4).to_numpy(zero_copy_only=False)[part].astype(int)
                for view in (0, 1):
                    f.add_to(counts, view, y)
                    n[view] += np.bincount(y, minlength=2)
        yield _emit(counts, n)

    _add(model, some.filter("fold > 0").select("text", "lang", "source", "n_chars", "y").mapInArrow(count, _COUNTED))
    if not model.ready():
        return model.prepare()
    held = some.filter("fold = 0")
    _calibrate(model.prepare(), held)
    labelled_counts, labelled_docs = model.counts.copy(), model.docs.copy()

    def features(batches):
        for b in small(batches):
            for _, f in _parts(b):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in f.written()], names=list(VIEWS))

    # at most ``bound`` ids; a document with a null id has no label
    others = docs.join(F.broadcast(some.select("labelled_id").distinct()), docs["doc_id"] == F.col("labelled_id"), "left_anti")
    featured = materialize(others.select("text", "lang", "source", "n_chars").mapInArrow(features, "content binary, metadata binary"), "features")
    for _ in range(rounds):
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def exchange(batches):
            m, counts, n = shared.value, np.zeros((2, 2, DIMS)), np.zeros((2, 2))
            for b in small(batches, 1024):
                f = Features.read([c.to_pylist() for c in b.columns])
                p = m.probabilities(m.raw(f))
                for view in (0, 1):  # what one view is sure about teaches the other
                    y = np.where(np.maximum(p[:, view], 1 - p[:, view]) >= SURE, p[:, view] > 0.5, -1).astype(int)
                    f.add_to(counts, 1 - view, y, WEIGHT)
                    n[1 - view] += WEIGHT * np.bincount(y[y >= 0], minlength=2)
            yield _emit(counts, n)

        # pseudo-labels are given anew in each round; together they weigh as much as the labelled rows
        pseudo = Model()
        _add(pseudo, featured.mapInArrow(exchange, _COUNTED))
        model = Model()
        scale = np.minimum(1, labelled_docs / np.maximum(pseudo.docs, 1))
        model.counts, model.docs = labelled_counts + pseudo.counts * scale[:, :, None], labelled_docs + pseudo.docs * scale
        _calibrate(model.prepare(), held)
    discard(featured)  # the model is what is left of them
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of docs with p_content, p_metadata, quality_score and keep."""
    shared, ready = docs.sparkSession.sparkContext.broadcast(model), model.ready()
    needed = ["text", "lang", "source", "n_chars"]
    names = [c for c in docs.columns if c not in needed]
    schema = docs.select(*needed, *names).schema
    for c in ("p_content", "p_metadata", "quality_score"):
        schema = schema.add(c, "double")
    schema = schema.add("keep", "boolean")

    def run(batches):
        for b in small(batches):
            if ready:
                p = np.concatenate([shared.value.probabilities(shared.value.raw(f)) for _, f in _parts(b)] or [np.zeros((0, 3))])
            else:
                p = np.full((b.num_rows, 3), 0.5)
            cols = [*(pa.array(p[:, i]) for i in range(3)), pa.array(p[:, 2] >= KEEP_AT)]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, "p_content", "p_metadata", "quality_score", "keep"])

    return docs.select(*needed, *names).mapInArrow(run, schema)


def op2_quality(spark, sf_dir: str) -> DataFrame:
    """Quality of every document by the co-trained views."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", "p_content", "p_metadata", "quality_score", "keep")
