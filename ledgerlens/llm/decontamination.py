"""Benchmark decontamination by the q-gram lemma.

Benchmark items are cut into passages of at most ``PASSAGE`` bytes (overlapping by half; a shorter item
is one passage). A passage of m bytes that occurs with at most k edits shares at least m - q + 1 - k q of
its q-grams with the text, on diagonals (text place minus passage place) that lie within k of each other.
So shared q-grams are counted in overlapping diagonal bands 2(k+1) wide, bands that reach the bound are
kept, and a banded alignment verifies them. Texts are compared as UTF-8 bytes with A-Z lowered.

The benchmark is the stated query set: it goes to all rows in blocks of ``BLOCK_BYTES``, so that what
tasks hold is bounded at any benchmark size.

An item too short for a q-gram (under ``Q`` bytes) counts only where it stands by itself: no letter, digit or
byte of another script touches it, so "yes" is not found in "yesterday".

Defined results: null or empty texts and items match nothing; repeated rows and null ids are separate
documents, repeated items count as one, as do the texts of one item_id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RID, keyed, small

PASSAGE = 80
#: Edits allowed, as a share of the passage's bytes.
EDITS = 0.1
Q = 8
BLOCK_BYTES = 4 << 20
_BITS = 22
_GAP = b"\xff"  # in no UTF-8 text
_BEFORE, _AFTER = rb"(?<![0-9a-z\x80-\xff])", rb"(?![0-9a-z\x80-\xff])"
_STEP = 1 << 20


class Passages:
    """Passages of a block of items, and the index of their q-grams."""

    def __init__(self, items: list[tuple[object, str]], passage: int = PASSAGE, edits: float = EDITS):
        self.items, self.parts, self.owner = list(dict.fromkeys(i for i, _ in items)), [], []
        number = {i: n for n, i in enumerate(self.items)}
        for item, text in items:
            n = number[item]
            data = text.encode().lower()
            last = max(0, len(data) - passage)
            for at in sorted({*range(0, last + 1, passage // 2), last}):
                if part := data[at : at + passage]:
                    self.parts.append(part)
                    self.owner.append(n)
        self.budget = [int(len(p) * edits) for p in self.parts]
        # very short passages: so few edits that the bound stays positive, none where a q-gram does not fit
        for i, p in enumerate(self.parts):
            self.budget[i] = max(0, min(self.budget[i], (len(p) - Q) // Q)) if len(p) >= Q else 0
        self.least = np.array([max(1, len(p) - Q + 1 - k * Q) for p, k in zip(self.parts, self.budget)])
        self.tiny = [i for i, p in enumerate(self.parts) if len(p) < Q]
        grams, part, off = [], [], []
        for i, p in enumerate(self.parts):
            if len(p) >= Q:
                g = grams_of(p)
                grams.append(g)
                part.append(np.full(len(g), i))
                off.append(np.arange(len(g)))
        grams = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(grams, kind="stable")
        self.gram, first = np.unique(grams[order], return_index=True)
        self.first = np.append(first, len(order))
        self.part = (np.concatenate(part) if part else np.zeros(0, int))[order]
        self.off = (np.concatenate(off) if off else np.zeros(0, int))[order]
        self.width = np.array([2 * (k + 1) for k in self.budget])
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[_slot(self.gram)] = True


def grams_of(data: bytes) -> np.ndarray:
    return np.ndarray((max(0, len(data) - Q + 1),), "<u8", data, strides=(1,)).copy()


def _slot(g: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)).astype(np.int64)


def bands(data: bytes, index: Passages) -> list[tuple[int, int]]:
    """(passage, first diagonal) of the bands that reach the passage's bound."""
    parts, diagonals = [], []
    for at in range(0, len(data), _STEP):
        g = grams_of(data[at : at + _STEP + Q - 1])
        pos = np.flatnonzero(index.seen[_slot(g)])
        g = g[pos]
        i = np.minimum(np.searchsorted(index.gram, g), max(0, len(index.gram) - 1))
        true = index.gram[i] == g if len(index.gram) else np.zeros(0, bool)
        i, pos = i[true], pos[true] + at
        n = index.first[i + 1] - index.first[i]
        post = np.repeat(index.first[i] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(n) else np.zeros(0, int)
        parts.append(index.part[post])
        diagonals.append(np.repeat(pos, n) - index.off[post])
    part, diagonal = np.concatenate(parts), np.concatenate(diagonals)
    if not len(part):
        return []
    step = index.width[part] // 2
    band = diagonal // step
    span = np.int64(len(data) + 2 * PASSAGE + 4)
    keys = np.concatenate((part * span + band + PASSAGE, part * span + band - 1 + PASSAGE))  # it lies in two bands
    keys, count = np.unique(keys, return_counts=True)
    part = keys // span
    full = count >= index.least[part]
    part = part[full]
    return list(zip(part.tolist(), ((keys[full] % span - PASSAGE) * (index.width[part] // 2)).tolist()))


def align(part: bytes, text: bytes, low: int, high: int, k: int) -> tuple[int, int, int] | None:
    """Best (edits, start, end) of the passage in the text within k edits and diagonals low..high, or None.

    Free start and end in the text; cells off the band (k wider on both sides) count as unreachable.
    """
    far, lo, hi = k + 1, low - k, high + k
    row = [(0, j) if 0 <= j <= len(text) else (far, j) for j in range(lo, hi + 1)]
    for i, c in enumerate(part, 1):
        new, left, best = [], (far, 0), far
        for d in range(len(row)):
            j = i + lo + d
            if j < 0 or j > len(text):
                left = (far, 0)
            else:
                a, s = row[d]  # match or substitution, from place j - 1
                if j == 0:
                    cell = (far, 0)
                else:
                    cell = (a + (text[j - 1] != c), s)
                if d + 1 < len(row) and row[d + 1][0] + 1 < cell[0]:
                    cell = (row[d + 1][0] + 1, row[d + 1][1])
                if left[0] + 1 < cell[0]:
                    cell = (left[0] + 1, left[1])
                left = cell if cell[0] <= k else (far, cell[1])
                best = min(best, left[0])
            new.append(left)
        if best > k:
            return None
        row = new
    found = min(((e, s, len(part) + lo + d) for d, (e, s) in enumerate(row) if e <= k), default=None)
    return found


def distances(tasks: list[tuple[bytes, bytes, int, int]], k: int) -> np.ndarray:
    """Least edits of each (passage, text, low, high), as ``align`` finds them, for passages of one length.

    All bands advance together, a passage byte at a time. Places outside a text hold a value that no byte
    equals; to pass over one costs an edit, as leaving out the passage byte does, so they change nothing.
    """
    m, width = len(tasks[0][0]), tasks[0][3] - tasks[0][2] + 2 * k + 1
    out = np.empty(len(tasks), np.int64)
    ramp = np.arange(width, dtype=np.int16)
    for at in range(0, len(tasks), 8192):
        some = tasks[at : at + 8192]
        around = np.full((len(some), width + m), 256, np.int16)
        for row, (_, text, low, _) in zip(around, some):
            a, e = max(0, low - k), min(len(text), low - k + width + m)
            if a < e:
                row[a - low + k : e - low + k] = np.frombuffer(text, np.uint8, e - a, a)
        part = np.frombuffer(b"".join(t[0] for t in some), np.uint8).reshape(-1, m)
        cells = np.zeros((len(some), width), np.int16)
        for i in range(m):
            new = cells + (around[:, i : i + width] != part[:, i : i + 1])
            np.minimum(new[:, :-1], cells[:, 1:] + 1, out=new[:, :-1])
            cells = np.minimum.accumulate(new - ramp, axis=1) + ramp
        out[at : at + 8192] = cells.min(axis=1)
    return out


def matches(texts: list[bytes], index: Passages) -> list[tuple[int, int, int, int, int]]:
    """(text number, passage, edits, start byte, end byte), best per text and passage. Texts are lowered."""
    starts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    open_: dict[tuple[int, int], list] = {}
    for part, low in bands(_GAP.join(texts), index) if texts else ():
        p, k = index.parts[part], index.budget[part]
        high = low + int(index.width[part])
        a = int(np.searchsorted(starts, max(low - k, 0), "right")) - 1
        while a < len(texts) and starts[a] <= high + len(p) + k:
            base = int(starts[a])
            if (a, part) not in best:
                at = texts[a].find(p, max(0, low - k - base), max(0, high + len(p) + k - base))
                if at >= 0:
                    best[a, part] = (0, at, at + len(p))
                elif k:
                    open_.setdefault((len(p), k), []).append((a, part, low - base, high - base))
            a += 1
    for (_, k), tasks in open_.items():
        tasks = [t for t in tasks if best.get(t[:2], (1,))[0]]
        near = distances([(index.parts[part], texts[a], low, high) for a, part, low, high in tasks], k) <= k if tasks else ()
        for (a, part, low, high), ok in zip(tasks, near):
            if ok and (hit := align(index.parts[part], texts[a], low, high, k)) and hit < best.get((a, part), (k + 1,)):
                best[a, part] = hit
    for part in index.tiny:
        alone = re.compile(_BEFORE + re.escape(index.parts[part]) + _AFTER)
        for a, text in enumerate(texts):
            if hit := alone.search(text):
                best[a, part] = (0, *hit.span())
    return [(a, part, *hit) for (a, part), hit in sorted(best.items())]


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(RID, doc_id, item_id, passages, edits, start, end): one row for each document and item it holds
    passages of; edits of the best one, start and end (code points) from the first to the last passage."""
    spark = docs.sparkSession
    rows = keyed(docs, id_col, text_col).select(RID, F.col("doc_id").cast("long"), "text")
    names = [RID, "doc_id", "item_id", "passages", "edits", "start", "end"]
    schema = f"{RID} long, doc_id long, item_id long, passages long, edits long, start long, end long"

    def search(index):
        def run(batches):
            for b in small(batches):
                raw = [t or b"" for t in b.column(2).cast(pa.binary()).to_pylist()]
                found: dict[tuple[int, int], list] = {}
                for a, part, edits, start, end in matches([t.lower() for t in raw], index.value):
                    found.setdefault((a, index.value.owner[part]), []).append((edits, start, end))
                rid, doc, out = b.column(0).to_pylist(), b.column(1).to_pylist(), []
                for (a, item), hits in sorted(found.items()):
                    start, end = (len(raw[a][:n].decode(errors="ignore")) for n in (min(h[1] for h in hits), max(h[2] for h in hits)))
                    out.append((rid[a], doc[a], index.value.items[item], len(hits), min(h[0] for h in hits), start, end))
                cols = list(zip(*out)) if out else [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

        return run

    def blocks():
        block, size = [], 0
        items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text).alias("t")).filter("length(t) > 0").distinct()
        for r in items.orderBy("i", "t").toLocalIterator():
            block.append((r["i"], r["t"]))
            size += len(r["t"])
            if size >= BLOCK_BYTES:
                yield block
                block, size = [], 0
        if block:
            yield block

    parts = [rows.mapInArrow(search(spark.sparkContext.broadcast(Passages(block))), schema) for block in blocks()]
    if len(parts) < 2:
        return parts[0] if parts else spark.createDataFrame([], schema)
    # texts of one item may stand in several blocks
    return reduce(DataFrame.unionAll, parts).groupBy(RID, "doc_id", "item_id").agg(F.sum("passages").alias("passages"), F.min("edits").alias("edits"), F.min("start").alias("start"), F.max("end").alias("end"))


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    """Documents that hold passages of the benchmark, with the items."""
    out = contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.drop(RID)
