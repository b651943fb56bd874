"""Byte-level repeat removal by prefix-free parsing of the corpus.

A rolling hash of 8 bytes triggers phrase ends: every window of ``TRIGGER`` positions has its least hash
as trigger, so phrases are cut by content alone, are never longer than ``TRIGGER``, and a 400-byte string
has the same first trigger wherever it stands. A position of the corpus is thus a phrase suffix (its
distance to the trigger) followed by the parse from there on, and corpus order is the order of these two:

1. dictionary: a phrase with its 400-byte outlook is one entry, known by 128 bits of digest. An entry that
   occurs twice is repeated in every position. An entry shares its core, what every string with its trigger
   holds after it, with others or starts nothing that is repeated. Of the entries that share a core but
   differ, one representative each goes on, with its bytes.
2. parse order: the suffixes of the corpus at these triggers are sorted by their bytes, over all
   partitions (ranges of the core, so that equal cores stay together). Neighbours' common prefixes cut
   the order into runs with one core, and give each suffix its class at every depth.
3. dictionary order: the phrases of a run are sorted backwards from the trigger, which orders their
   suffixes of every length; neighbours' common ends give the classes by length.
4. corpus order: at each distance to the trigger, positions are ordered by the class of their phrase suffix
   and the class of the parse suffix at the depth left to 400 bytes; neighbours that agree in both are
   repeated. A run with more than ``HOT_RUN`` suffixes is not gathered: its positions travel one by one under
   their parse class and are sorted by phrase suffix.

Defined results: null or empty text has no bytes; texts under 400 bytes keep everything; repeated rows are
separate documents; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RID, keyed, materialize, packed, small, unpacked, window_argmin

LENGTH = 400
#: Positions in a window that has at least one trigger.
TRIGGER = 192
#: Suffixes of a run of the parse order that are combined in memory.
HOT_RUN = 4096
_GRAM = 8
#: Positions that are parsed at a time: bounds the memory for very long texts.
_BLOCK = 1 << 20


def triggers(data: bytes, starts: int, trigger: int) -> np.ndarray:
    """For each of the first ``starts`` positions the place of the least 8-byte hash within ``trigger`` positions."""
    grams = np.ndarray((starts + trigger - 1,), "<u8", data, strides=(1,))
    with np.errstate(over="ignore"):
        h = grams * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    return window_argmin(h, trigger)


def phrases(text: bytes, length: int = LENGTH, trigger: int = TRIGGER):
    """(first start, last start, trigger place) of the runs of starts that share a trigger."""
    last = len(text) - length
    for base in range(0, last + 1, _BLOCK):
        n = min(_BLOCK, last + 1 - base)
        at = triggers(text[base : base + n + trigger + _GRAM], n, trigger)
        cut = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        ends = np.concatenate((cut[1:], [n])) - 1
        yield from zip((cut + base).tolist(), (ends + base).tolist(), (at[cut] + base).tolist())


def _arrays(out: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    cols = list(zip(*out)) if out else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)


def _sorted_classes(batches):
    """Rows sorted by (known, core, entry): tell apart what is repeated (0) and what is to be compared (1).

    Works on runs with a row or two of look-behind, so a hot core or entry is never gathered.
    """

    def told_rows(rid, place, core, kind):
        return pa.RecordBatch.from_arrays([pa.array(rid), pa.array(place), pa.array(core), pa.array(np.full(len(rid), kind), pa.int32())], names=names)

    names = [RID, "place", "core", "open"]
    held, before = None, False
    for b in itertools.chain(batches, [None]):
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns] if b is not None else [np.zeros(0, np.int64)] * 5
        known = cols.pop().astype(bool)
        if known.any():
            yield told_rows(cols[2][known], cols[3][known], cols[0][known], 0)
            cols = [c[~known] for c in cols]
        cols.append(np.zeros(len(cols[0]), bool))  # told already
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols)]
        core, entry, rid, place, told = cols
        if not len(core):
            continue
        start = np.flatnonzero(np.concatenate(([True], (core[1:] != core[:-1]) | (entry[1:] != entry[:-1]))))
        size = np.diff(np.append(start, len(core)))
        same = core[start][1:] == core[start][:-1]
        prior, later = np.concatenate(([before], same)), np.concatenate((same, [False]))
        complete = len(start) - (b is not None)
        whole = np.flatnonzero(np.repeat(size > 1, size) & ~told)
        open_ = start[:complete][(prior | later)[:complete]]
        for rows, kind in ((whole, 0), (open_, 1)):
            if len(rows):
                yield told_rows(rid[rows], place[rows], core[rows], kind)
        if b is not None:
            last = [start[-1]] if size[-1] == 1 else [start[-1], len(core) - 1]
            held = [c[last] for c in cols]
            held[4][:] = size[-1] > 1
            before = bool(prior[-1])


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n - 1  # the first ``low`` bytes agree, not so the first ``high`` + 1
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


def _classes(shared: list[int], depths: np.ndarray) -> np.ndarray:
    """For members of an order (rows) and depths (columns) the first member whose prefix of that depth is the same.

    ``shared[i]`` is the common prefix of members i and i + 1.
    """
    out = np.zeros((len(shared) + 1, len(depths)), np.int64)
    for i, n in enumerate(shared):
        out[i + 1] = np.where(n >= depths, out[i], i + 1)
    return out


def combine(run: list[tuple], shared: list[int], length: int) -> list[tuple[int, int, int]]:
    """(rid, lo, end): positions of a run of the parse order that occur twice, as ranges of the bytes they cover.

    A member is (suffix from the trigger, phrase backwards from it, rid, trigger's place, least distance);
    ``shared`` has the common prefixes of neighbours in the order of the suffixes.
    """
    order = sorted(range(len(run)), key=lambda i: run[i][1])
    ends = [common(run[i][1], run[j][1]) for i, j in zip(order, order[1:])]
    if len(run) == 2:
        low, high = max(run[0][4], run[1][4], length - shared[0]), ends[0]
        return [(rid, at - high, at - low + length) for _, _, rid, at, _ in run] if low <= high else []
    least, most = np.array([m[4] for m in run]), np.array([len(m[1]) for m in run])
    away = np.arange(least.min(), most.max() + 1)
    parse, phrase = _classes(shared, length - away), np.empty((len(run), len(away)), np.int64)
    phrase[order] = _classes(ends, away)
    key = parse * len(run) + phrase
    outside = (away < least[:, None]) | (away > most[:, None])
    key[outside] = -1 - np.broadcast_to(np.arange(len(run))[:, None], key.shape)[outside]  # equal to none
    rank = np.argsort(key, axis=0, kind="stable")
    ordered = np.take_along_axis(key, rank, 0)
    same = np.zeros((len(run) + 1, len(away)), bool)
    same[1:-1] = ordered[1:] == ordered[:-1]
    twice = np.zeros(key.shape, np.int8)
    np.put_along_axis(twice, rank, (same[1:] | same[:-1]).astype(np.int8), 0)
    out = []
    for i in np.flatnonzero(twice.any(axis=1)):
        edge = np.flatnonzero(np.diff(np.concatenate(([0], twice[i], [0]))))
        _, _, rid, at, _ = run[i]
        out += [(rid, at - int(away[e - 1]), at - int(away[b]) + length) for b, e in zip(edge[::2], edge[1::2])]
    return out


class ParseOrder:
    """Walks sorted suffixes: gathers the runs with a common core and combines each, or lists a hot run's positions.

    ``spans`` gets (rid, lo, end), ``singles`` (parse class, phrase suffix, rid, position).
    """

    def __init__(self, length: int, core: int, first_class: int):
        self.length, self.core, self.next_class = length, core, first_class
        self.spans: list[tuple] = []
        self.singles: list[tuple] = []
        self.run: list[tuple] = []
        self.shared: list[int] = []
        self.steps: list[tuple[int, int]] | None = None  # of a hot run: (depth, class of the last member up to it)

    def add(self, member: tuple) -> None:
        if self.run:
            n = common(self.run[-1][0], member[0])
            if n < self.core:
                self.close()
            else:
                self.shared.append(n)
        self.run.append(member)
        if len(self.run) > (HOT_RUN if self.steps is None else 64):
            self._list(last=False)

    def close(self) -> None:
        if self.steps is not None:
            self._list(last=True)
        elif len(self.run) > 1:
            self.spans += combine(self.run, self.shared, self.length)
        self.run, self.shared, self.steps = [], [], None

    def _list(self, last: bool) -> None:
        """Positions of the members read so far but the newest, whose next neighbour is not known yet."""
        members, before = self.run, self.shared
        if self.steps is None:  # the first member of the run
            self.steps, self.reached = [(self.length, self._new())], 0
        for i, (suffix, back, rid, at, least) in enumerate(members):
            if i + 1 == len(members) and not last:
                break
            after = before[i] if i < len(before) else 0
            low = max(least, self.length - max(self.reached, after))
            for away in range(low, len(back) + 1):
                self.singles.append((next(c for d, c in self.steps if d >= self.length - away), back[:away], rid, at - away))
            if i + 1 < len(members):
                self._step(after)
        self.run, self.shared = ([], []) if last else (members[-1:], [])

    def _new(self) -> int:
        self.next_class += 1
        return self.next_class

    def _step(self, shared: int) -> None:
        """Classes of the next member, which has ``shared`` bytes in common with the last one."""
        kept = next(c for d, c in self.steps if d >= shared)
        self.steps = [(d, c) for d, c in self.steps if d < shared] + [(shared, kept)]
        if shared < self.length:
            self.steps.append((self.length, self._new()))
        self.reached = shared


def repeated_spans(rows: DataFrame, length: int = LENGTH, trigger: int = TRIGGER) -> DataFrame:
    """(RID, marks): per document the sorted (lo, end) ranges that repeated strings cover. Rows: RID, text."""
    rest = length - trigger + 1  # what every string with a trigger holds from the trigger on

    def parse(batches):
        names, types, digest = ["core", "entry", RID, "place", "known"], [*[pa.int64()] * 4, pa.bool_()], xxhash.xxh3_64_intdigest
        met: dict[tuple[int, int], int] = {}
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        for b in small(batches):
            out = []
            for rid, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                for lo, hi, at in phrases(t or b"", length, trigger):
                    # seeded with the trigger's place in it: equal entries agree in every suffix
                    entry, core = signed(digest(t[lo : hi + length], at - lo)), signed(digest(t[at : at + rest]))
                    # two witnesses of an entry leave a task under its core; more are known to be repeated
                    # and go anywhere, so that a hot entry does not pile up in one place
                    n = met[core, entry] = met.get((core, entry), 0) + 1
                    out.append((core if n < 3 else core ^ rid * 0x9E3779B97F4A7C1 & (1 << 63) - 1, entry, rid, lo << 20 | (hi - lo) << 10 | (at - lo), n > 2))
                if len(out) > 50_000:
                    yield _arrays(out, types, names)
                    out = []
                if len(met) > 500_000:
                    met.clear()
            yield _arrays(out, types, names)

    parsed = rows.select(RID, "text").mapInArrow(parse, f"core long, entry long, {RID} long, place long, known boolean")
    in_order = parsed.repartition("core").sortWithinPartitions("known", "core", "entry", RID, "place")
    classes = materialize(in_order.mapInArrow(_sorted_classes, f"{RID} long, place long, core long, open int"), "classes")
    lo, hi = F.expr("shiftright(place, 20)"), F.expr("shiftright(place, 20) + (shiftright(place, 10) & 1023)")
    whole = classes.filter("open = 0").select(RID, lo.cast("int").alias("lo"), (hi + length).cast("int").alias("end"))
    item = F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"), F.expr("cast(place & 1023 as int)").alias("back"))
    wanted = classes.filter("open = 1").groupBy(RID).agg(F.collect_list(item).alias("open"))  # bounded by the document

    def outlooks(batches):
        names, types = ["suffix", "back", RID, "at", "least"], [pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.int32()]
        for b in small(batches):
            out = []
            for rid, t, items in zip(b.column(0).to_pylist(), unpacked(b.column(1)), b.column(2).to_pylist()):
                for x in items:
                    at = x["lo"] + x["back"]
                    out.append((t[at : x["hi"] + length], t[x["lo"] : at][::-1], rid, at, at - x["hi"]))
                if len(out) > 20_000:
                    yield _arrays(out, types, names)
                    out = []
            yield _arrays(out, types, names)

    def order(batches):
        """Rows in parse order: the repeated ranges, and the single positions of hot runs."""
        names = [RID, "lo", "end", "class", "phrase"]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
        walk = ParseOrder(length, rest, TaskContext.get().partitionId() << 40)

        def told():
            out = [(*s, None, None) for s in walk.spans] + [(rid, at, at + length, c, back) for c, back, rid, at in walk.singles]
            walk.spans, walk.singles = [], []
            return _arrays(out, types, names)

        for b in batches:
            for member in zip(*(c.to_pylist() for c in b.columns)):
                walk.add(member)
                if len(walk.singles) > 50_000:
                    yield told()
            yield told()
        walk.close()
        yield told()

    def agree(batches):
        """Rows sorted by (class, phrase): positions whose neighbour agrees in both."""
        held, told = None, False
        for b in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                same = held is not None and held[3:] == row[3:]
                if same:
                    out += [row[:3]] if told else [held[:3], row[:3]]
                held, told = row, same
            yield _arrays(out, [pa.int64(), pa.int32(), pa.int32()], [RID, "lo", "end"])

    z = packed(rows, RID)
    entries = materialize(z.join(wanted, RID).select(RID, "z", "open").mapInArrow(outlooks, f"suffix binary, back binary, {RID} long, at int, least int"), "entries")
    parse_order = entries.repartitionByRange(F.substring("suffix", 1, rest)).sortWithinPartitions("suffix", "back", RID, "at")
    told = materialize(parse_order.mapInArrow(order, f"{RID} long, lo int, end int, class long, phrase binary"), "order")
    singles = told.filter("class is not null").repartition("class", "phrase").sortWithinPartitions("class", "phrase")
    spans = whole.unionAll(told.filter("class is null").select(RID, "lo", "end")).unionAll(singles.mapInArrow(agree, f"{RID} long, lo int, end int"))
    # a document's ranges are bounded by its own length
    return spans.groupBy(RID).agg(F.array_sort(F.collect_list(F.struct("lo", "end"))).alias("marks"))


def merge_spans(marks) -> list[tuple[int, int]]:
    """Disjoint maximal runs of sorted (lo, end) ranges; ranges that touch are one run."""
    runs: list[list[int]] = []
    for m in marks or ():
        if runs and m["lo"] <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], m["end"])
        else:
            runs.append([m["lo"], m["end"]])
    return [(a, b) for a, b in runs]


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row for each document: RID, doc_id, n_bytes, n_removed, n_spans, removed, kept (binary), kept_sha256."""
    rows = keyed(docs, id_col, text_col)
    z = packed(rows.withColumn("doc_id", F.col("doc_id").cast("long")), RID, "doc_id")
    marked = z.join(repeated_spans(rows, length), RID, "left").select(RID, "doc_id", "z", "marks")
    schema = f"{RID} long, doc_id long, n_bytes long, n_removed long, n_spans long, removed array<array<int>>, kept binary, kept_sha256 string"

    def run(batches):
        names = [RID, "doc_id", "n_bytes", "n_removed", "n_spans", "removed", "kept", "kept_sha256"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int32())), pa.binary(), pa.string()]
        for b in small(batches):
            out = []
            for rid, doc, t, marks in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), unpacked(b.column(2)), b.column(3).to_pylist()):
                runs, kept, at = merge_spans(marks), [], 0
                for lo, end in runs:
                    kept.append(t[at:lo])
                    at = end
                kept = b"".join([*kept, t[at:]])
                out.append((rid, doc, len(t), len(t) - len(kept), len(runs), [list(r) for r in runs], kept, hashlib.sha256(kept).hexdigest()))
            yield _arrays(out, types, names)

    return marked.mapInArrow(run, schema)


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Bytes of all documents that 400-byte strings with another occurrence cover are removed."""
    return drop_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
