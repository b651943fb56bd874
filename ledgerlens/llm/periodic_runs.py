"""Periodic runs of words by partition refinement.

The word positions of a document are parted into classes of equal factors, one word longer at each level.
What a level splits off in small parts splits the classes of the positions before it at the next one; the
largest part of each class never does (the smaller half), so a position moves O(log n) times. Members of a
class are linked in order of position. Neighbours whose distance is the length of their factor are a square
without a smaller period; squares of one period at consecutive places are one run.

Documents are independent: they are read where they lie, without a shuffle, and some of them are refined
together as one sequence whose documents never share a class (all steps are array operations).

Defined results: a null text counts as empty (no words, no runs); repeated rows and null ids are documents
of their own; other columns are ignored; an empty table gives no rows. A text may have 2^31 words.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A run has at least so many words and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Documents are refined together until they have so many words.
GROUP_WORDS = 1 << 20
#: Words of a text: what stands between blanks, tabs, line ends and feeds.
WORD = r"[^\x20\x09-\x0D]+"
RUNS = "array<struct<start:long,length:long,period:long>>"


class _Links:
    """Neighbour pairs by their distance, to be looked at once the level reaches it: by 64 distances, then by one."""

    def __init__(self, most: np.ndarray):
        self.most, self.far, self.near, self.block = most, defaultdict(list), defaultdict(list), 0

    def add(self, left: np.ndarray, gap: np.ndarray, level: int) -> None:
        use = (gap >= level) & (gap <= self.most[left])
        left, gap = left[use], gap[use]
        if not len(left):
            return
        key = gap >> 6
        o = np.argsort(key, kind="stable")
        left, gap, key = left[o], gap[o], key[o]
        cut = np.flatnonzero(key[1:] != key[:-1]) + 1
        for k, a, b in zip(key[np.r_[0, cut]].tolist(), np.r_[0, cut].tolist(), np.r_[cut, len(key)].tolist()):
            (self._sort if k <= self.block else self.far[k].append)((left[a:b], gap[a:b]))

    def _sort(self, pairs: tuple[np.ndarray, np.ndarray]) -> None:
        left, gap = pairs
        o = np.argsort(gap, kind="stable")
        left, gap = left[o], gap[o]
        cut = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        for a, b in zip(np.r_[0, cut].tolist(), np.r_[cut, len(gap)].tolist()):
            self.near[int(gap[a])].append(left[a:b])

    def at(self, level: int) -> np.ndarray | None:
        while self.block < level >> 6:
            self.block += 1
            for pairs in self.far.pop(self.block, ()):
                self._sort(pairs)
        found = self.near.pop(level, None)
        return None if found is None else np.unique(np.concatenate(found))


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (size[0] of them), then those of the next."""
    total = int(size.sum())
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(total)


def find_runs(documents: list[np.ndarray], least: int = LEAST_WORDS, times: int = LEAST_PERIODS) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of all runs of each document, by start, then period.

    A document is its words as numbers from 0, without gaps. ``times`` is 2 or more.
    """
    counts = np.array([len(d) for d in documents], np.int64)
    found: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    total = int(counts.sum()) + len(documents)  # each document ends with a word of its own
    offset = np.cumsum(counts + 1) - counts - 1
    if not counts.sum():
        return found
    kinds = np.array([int(d.max()) + 1 if len(d) else 0 for d in documents], np.int64)
    cls = np.empty(total, np.int64)
    base = 0
    for d, at, k in zip(documents, offset.tolist(), kinds.tolist()):
        cls[at : at + len(d)] = d
        cls[at : at + len(d)] += base
        cls[at + len(d)] = base + k
        base += k + 1
    last = np.zeros(total, bool)
    last[offset + counts] = True
    most = np.repeat(np.minimum(counts // times, counts), counts + 1)  # longest period that can matter
    slots = np.argsort(cls, kind="stable")  # members of a class stand together
    place = np.empty(total, np.int64)
    place[slots] = np.arange(total)
    size = np.zeros(total + 1, np.int64)
    size[:base] = np.bincount(cls, minlength=base)
    first = np.zeros(total + 1, np.int64)
    first[:base] = np.cumsum(size[:base]) - size[:base]
    nxt, prv = np.full(total, -1, np.int64), np.full(total, -1, np.int64)
    same = cls[slots[1:]] == cls[slots[:-1]]
    a, b = slots[:-1][same], slots[1:][same]
    nxt[a], prv[b] = b, a
    links = _Links(most)
    links.add(a, b - a, 1)
    moved = np.zeros(total, bool)
    level, longest, n_classes, small = 1, int(most.max()), base, np.arange(total)
    document = np.repeat(np.arange(len(documents)), counts + 1)
    while level <= longest:
        squares = links.at(level)
        if squares is not None and len(squares := squares[nxt[squares] == squares + level]):
            cut = np.flatnonzero(squares[1:] != squares[:-1] + 1) + 1
            start, end = squares[np.r_[0, cut]], squares[np.r_[cut - 1, len(squares) - 1]] + 2 * level
            long = end - start >= max(least, times * level)
            for s, e in zip(start[long].tolist(), end[long].tolist()):
                d = int(document[s])
                found[d].append((s - int(offset[d]), e - s, level))
        level += 1
        before = small[(small > 0) & (most[small] >= level)] - 1
        before = before[~last[before]]
        before = before[size[cls[before]] > 1]
        small = before[:0]
        if not len(before):
            if not links.near and not links.far:
                break
            continue
        # parts of classes by what follows them; positions are in order within a part
        c = cls[before]
        key = c * np.int64(n_classes) + cls[before + 1]
        o = np.argsort(key, kind="stable")
        p, c, key = before[o], c[o], key[o]
        part = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        n_part = np.diff(np.r_[part, len(p)])
        c_part = c[part]
        head = np.flatnonzero(np.r_[True, c_part[1:] != c_part[:-1]])  # first part of each class
        of = np.repeat(np.arange(len(head)), np.diff(np.r_[head, len(part)]))
        rest = size[c_part[head]] - np.add.reduceat(n_part, head)
        top = np.maximum.reduceat(n_part, head)
        at_top = np.flatnonzero(n_part == top[of])
        largest = np.full(len(head), -1)
        largest[of[at_top[::-1]]] = at_top[::-1]
        goes = np.ones(len(part), bool)
        goes[largest[rest == 0]] = False  # a class without a rest keeps its largest part
        if not goes.any():
            continue
        stay = np.where(rest == 0, top, rest)
        quiet = goes.copy()  # parts that split others at the next level
        bigger = (rest > 0) & (top > rest)
        quiet[largest[bigger]] = False
        go = np.repeat(goes, n_part)
        p, c = p[go], c[go]
        n_go, of_go = n_part[goes], of[goes]
        new = n_classes + np.arange(len(n_go))
        moved[p] = True
        # links over what leaves
        by_place = np.argsort(c * np.int64(total) + p)
        q = p[by_place]
        left, right = prv[q], nxt[q]
        opens, closes = (left < 0) | ~moved[left], (right < 0) | ~moved[right]
        a, b = left[opens], right[closes]
        nxt[a[a >= 0]], prv[b[b >= 0]] = b[a >= 0], a[b >= 0]
        both = (a >= 0) & (b >= 0)
        over, over_gap = a[both], b[both] - a[both]
        # what leaves goes to the end of its class's slots, in the order of parts
        cc = c_part[head][np.unique(of_go)]
        n_c = np.bincount(of_go, weights=n_go, minlength=len(head)).astype(np.int64)
        n_c = n_c[n_c > 0]
        begin = first[cc] + size[cc] - n_c
        tail = _ranges(begin, n_c)
        in_tail = slots[tail]
        staying = in_tail[~moved[in_tail]]
        at = place[q]
        holes = at[at < np.repeat(begin, n_c)]
        slots[holes], place[staying] = staying, holes
        slots[tail], place[p] = p, tail
        moved[p] = False
        size[cc] -= n_c
        size[new] = n_go
        at_part = np.cumsum(n_go) - n_go
        first[new] = tail[at_part]
        cls[p] = np.repeat(new, n_go)
        within = np.ones(len(p), bool)
        within[at_part] = False
        nxt[p], prv[p] = -1, -1
        a, b = p[:-1][within[1:]], p[1:][within[1:]]
        nxt[a], prv[b] = b, a
        links.add(np.r_[over, a], np.r_[over_gap, b - a], level)
        n_classes += len(n_go)
        small = p[np.repeat(quiet[goes], n_go)]
        if bigger.any():  # the rest is the smaller half
            small = np.r_[small, slots[_ranges(first[c_part[head[bigger]]], stay[bigger])]]
        small.sort()
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in found]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words without those that a run repeats after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [w for w, k in zip(words, keep.tolist()) if k]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS, times: int = LEAST_PERIODS) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, runs (in words, by start, then period), collapsed (kept words with one blank between)."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    names = ["doc_id", "n_words", "runs", "collapsed"]
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def settle(ids, texts):
        numbers = []
        for words in texts:
            number = {w: i for i, w in enumerate(dict.fromkeys(words))}
            numbers.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
        runs = find_runs(numbers, least, times)
        shown = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs]
        kept = pa.array([b" ".join(collapsed(w, r)) for w, r in zip(texts, runs)], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.array([len(w) for w in texts], pa.int64()), pa.array(shown, run_type), kept], names=names)

    def run(batches):
        ids, texts, n = [], [], 0
        for b in batches:
            for i in range(b.num_rows):
                ids.append(b.column(0).slice(i, 1))
                texts.append((b.column(1)[i].as_py() or "").encode().split())  # bytes are split at the blanks of WORD
                n += len(texts[-1])
                if n >= GROUP_WORDS:
                    yield settle(ids, texts)
                    ids, texts, n = [], [], 0
        if ids:
            yield settle(ids, texts)

    return slim.mapInArrow(run, StructType([*slim.select("doc_id").schema, *StructType.fromDDL(f"n_words long, runs {RUNS}, collapsed string")]))


def longest_exponent(runs: Column) -> Column:
    """The run with the greatest length / period, compared as fractions; the first of equal ones; null if there is none."""
    return F.reduce(runs, F.get(runs, F.lit(0)), lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))


def stretched(docs: DataFrame) -> DataFrame:
    """documents in which one in ten, by the checksum of its id, repeats a stretch of its words to its end.

    With h = crc32(id) and g = floor(h / 10), where 10 divides h: from word a = g % n on, word i becomes word
    a + (i - a) % p, p = 1 + floor((n - a) / (3 + g % 8)). Documents without an id or words stay as they are.
    """
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    rows = docs.select("doc_id", "text", g.alias("g"), F.when(h % 10 == 0, words).alias("w")).withColumn("n", F.size("w"))
    a = F.col("g") % F.col("n")
    rows = rows.withColumn("a", F.when(F.col("n") > 0, a).cast("int"))
    p = 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))
    rows = rows.withColumn("p", p.cast("int"))
    left = F.col("n") - F.col("a")
    again = F.slice(F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil(left / F.col("p")).cast("int"))), F.lit(1), left)
    text = F.concat_ws(" ", F.slice("w", F.lit(1), F.col("a")), again)
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), text).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of all documents, one in ten of which is stretched: the run of greatest exponent and digests of all."""
    found = periodic_runs(stretched(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    shown = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.concat(F.array_join(shown, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    best = found.select("*", longest_exponent(F.col("runs")).alias("best"))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
        "n_words",
    )
