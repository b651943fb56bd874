"""Substring dedup over word windows with a count-min prefilter.

Pass 1: every window of 20 words is represented by one of its 8-word grams, the one with the least
digest: equal windows have equal representatives, and a representative stands for several windows in a
row. The count-min sketch is dealt into shards by ranges of the digest, so its width follows the corpus
(some five cells for each representative, at any size) while a task holds one shard of ``SHARD_CELLS`` cells
a row. Every partition of the corpus counts its representatives in sketches of its own, as sorted cell
lists; these are merged shard by shard, and each shard then tells which of the representatives sent to it
are estimated repeated. What a partition has met twice itself it need not ask for. A cell never counts
less than a representative in it, so no repeated window is missed.

Pass 2: windows whose representative is estimated repeated are grouped exactly, by 128-bit digests. Runs
of them are first cut at content-defined places into chunks: all but the earliest of equal chunks consist
of repeats, so only the earliest goes on to the exact count of single windows. A task sends on only chunks
of which it has met no earlier one, so a hot chunk travels a few times from each task.

Defined results: null or empty text has no words; ids order documents, nulls first and repeated rows in
text order; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RID, keyed, materialize, n_parts, packed, small, unpacked, window_argmin

WINDOW = 20
#: Words in a representative.
GRAM = 8
DEPTH = 2
#: Cells a row of the sketch: at least, and in one shard.
MIN_CELLS, SHARD_CELLS = 1 << 16, 1 << 21
#: Representatives that a partition sketches and asks for at a time.
BLOCK = 500_000
#: Bytes of text for one cell: a representative stands for some forty.
CELL_BYTES = 8
#: A chunk of repeated windows ends, on average, every so many windows.
CHUNK = 16
#: Cells in one piece of the merged bitmap.
_PIECE = 1 << 16
_MULT = (np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xC2B2AE3D27D4EB4F | 1))
_INV = tuple(np.uint64(pow(int(m), -1, 1 << 64)) for m in _MULT)


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(salt)) * np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(29))


def _rolling(h: np.ndarray, width: int, k: int) -> np.ndarray:
    """Polynomial digests (mod 2^64) of all runs of ``width`` word hashes."""
    n = len(h)
    power, inverse = _power(n)[k]
    with np.errstate(over="ignore"):
        prefix = np.concatenate(([np.uint64(0)], np.cumsum(h * power[:n])))
        return (prefix[width:] - prefix[:-width]) * inverse[: n - width + 1]


#: Longer words are hashed one by one.
_LONG = 64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.array([[xxhash.xxh3_64_intdigest(bytes([b]), seed) for b in range(256)] for seed in (11, 12)], dtype=np.uint64)
_powers: list[tuple[np.ndarray, np.ndarray]] = []


def _power(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers 0..n-1 of the multipliers and of their inverses, remembered."""
    if not _powers or len(_powers[0][0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        with np.errstate(over="ignore"):
            _powers[:] = [tuple(np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, x)))) for x in pair) for pair in zip(_MULT, _INV)]
    return _powers


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words of a UTF-8 text, and their 128-bit digests as an n x 2 array, without a loop over words."""
    raw = np.frombuffer(data, np.uint8)
    word = ~_SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    out = np.empty((len(starts), 2), np.uint64)
    size = ends - starts
    short = starts + np.minimum(size, _LONG)
    step = 1 << 20
    with np.errstate(over="ignore"):
        for at in range(0, len(raw), step):
            i, j = np.searchsorted(starts, (at, at + step))
            if i == j:
                continue
            base = int(starts[i])
            part = raw[base : int(short[i:j].max())]
            a, e = starts[i:j] - base, short[i:j] - base
            for k, (power, inverse) in enumerate(_power(len(part) + 1)):
                prefix = np.zeros(len(part) + 1, np.uint64)
                np.cumsum(_BYTE[k][part] * power[: len(part)], out=prefix[1:])
                out[i:j, k] = _mix((prefix[e] - prefix[a]) * inverse[a] + (e - a).astype(np.uint64), 7 + k)
    for i in np.flatnonzero(size > _LONG):
        x = xxhash.xxh3_128_intdigest(data[starts[i] : ends[i]])
        out[i] = x >> 64, x & 0xFFFFFFFFFFFFFFFF
    return starts, out


class Windows:
    """The windows of some texts in a row: 128-bit digests, and for each the digest of its representative.

    ``start[i]`` is the place of text i's first word among all words, ``count[i]`` its number of windows;
    arrays are by the place of a window's first word, and places that start no window mean nothing.
    """

    def __init__(self, texts: list[bytes], width: int = WINDOW):
        at, self.hashed = word_hashes(b"\n".join(texts))
        self.start = np.searchsorted(at, np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts]))))
        sizes = np.diff(self.start)
        self.count = np.maximum(0, sizes - width + 1)
        self.n, self.width = max(0, int(self.start[-1]) - width + 1), width
        if self.n:
            gram = min(GRAM, width)
            self.grams = _mix(_rolling(self.hashed[:, 0], gram, 0), 1)
            # in blocks, so that a place fits the low bits beside the digest
            step, out = 1 << 22, []
            for at in range(0, self.n, step):
                part = self.grams[at : min(self.n, at + step) + width - gram]
                out.append(window_argmin(part, width - gram + 1) + at)
            self.chosen = np.concatenate(out)
            edge = np.zeros(self.n + 1, np.int32)
            np.add.at(edge, self.start[:-1][self.count > 0], 1)
            np.add.at(edge, (self.start[:-1] + self.count)[self.count > 0], -1)
            self.real = np.cumsum(edge)[:-1] > 0

    def representatives(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Digest, text number and place in the text of each representative."""
        at = np.unique(self.chosen[self.real])
        owner = np.searchsorted(self.start, at, "right") - 1
        return self.grams[at], owner, at - self.start[owner]

    def digests(self) -> np.ndarray:
        return np.stack([_mix(_rolling(self.hashed[:, k], self.width, k), 3 + k) for k in (0, 1)], axis=1)


def _together(texts, limit: int = 1 << 20):
    """(number of the first, texts) of consecutive texts with about ``limit`` bytes at a time; null is empty."""
    held, first, size = [], 0, 0
    for i, t in enumerate(texts):
        held.append(t or b"")
        size += len(held[-1])
        if size > limit:
            yield first, held
            held, first, size = [], i + 1, 0
    if held:
        yield first, held


def _cells(digest: np.ndarray, row: int, cells: int) -> np.ndarray:
    return (_mix(digest, 0x1234 + row) & np.uint64(cells - 1)).astype(np.int64)


def _cut(of: np.ndarray):
    """(start, end) of the runs of equal values."""
    cut = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
    return zip(cut.tolist(), np.append(cut[1:], len(of)).tolist())


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _table(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((),) * len(types), types)], names=names)


def sketch_size(n_bytes: int) -> tuple[int, int]:
    """Shards, and cells of one shard in each row of the sketch."""
    wanted, cells = max(MIN_CELLS, n_bytes // CELL_BYTES), MIN_CELLS
    while cells < min(wanted, SHARD_CELLS):
        cells *= 2
    return n_parts(wanted, cells), cells


_ASKED = "shard long, kind int, row int, piece int, block long, docs binary, a binary, b binary"
_TOLD = "block long, docs binary, b binary"


def estimated_repeated(rows: DataFrame, shards: int, cells: int, width: int = WINDOW) -> DataFrame:
    """(RID, places): uint32 places of representatives that the merged sketch counts twice or more. Rows: RID, text.

    A partition asks in blocks of some ``BLOCK`` representatives. The answers of all shards for a block meet again
    and leave as one row for each document.
    """
    names = _names(_ASKED)
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]

    def about(rids, owner, place):
        """Document keys, and each representative's number among them beside its place."""
        docs, which = np.unique(owner, return_inverse=True)
        return np.array([rids[i] for i in docs], "<i8").tobytes(), np.concatenate((which.astype("<u4"), place.astype("<u4"))).tobytes()

    def flush(rids, held):
        """Kind 0: a block's own sketch. Kind 1: representatives to be told. Kind 2: those met twice in the block."""
        digest, owner, place = (np.concatenate(x) for x in zip(*held))
        one, inverse, count = np.unique(digest, return_inverse=True, return_counts=True)
        shard = ((one >> np.uint64(20)) % np.uint64(shards)).astype(np.int64)
        out, block = [], rids[0]
        for row in range(DEPTH):
            key = shard * cells + _cells(one, row, cells)
            order = np.argsort(key)
            key, n = key[order], count[order]
            edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            twice = np.add.reduceat(n, edge) > 1
            key = key[edge]
            for a, e in _cut(key // _PIECE):
                at = key[a] % cells
                out.append((int(key[a] // cells), 0, row, int(at // _PIECE), None, None, (key[a:e] % _PIECE).astype("<u2").tobytes(), np.packbits(twice[a:e]).tobytes()))
        yield _table(out, names, types)
        known = count[inverse] > 1
        if known.any():
            docs, which = about(rids, owner[known], place[known])
            yield _table([(block, 2, 0, 0, block, docs, None, which)], names, types)
        ask = np.flatnonzero(~known)
        ask = ask[np.argsort(shard[inverse[ask]], kind="stable")]
        out, to = [], shard[inverse[ask]]
        for a, e in _cut(to) if len(to) else ():
            docs, which = about(rids, owner[ask[a:e]], place[ask[a:e]])
            out.append((int(to[a]), 1, 0, 0, block, docs, digest[ask[a:e]].tobytes(), which))
        yield _table(out, names, types)

    def ask(batches):
        rids, held, size = [], [], 0
        for b in small(batches):
            ids = b.column(0).to_pylist()
            for first, texts in _together(b.column(1).cast(pa.binary()).to_pylist()):
                w = Windows(texts, width)
                if w.n and w.real.any():
                    digest, owner, place = w.representatives()
                    held.append((digest, owner + len(rids), place))
                    rids += ids[first : first + len(texts)]
                    size += len(digest)
                if size > BLOCK:
                    yield from flush(rids, held)
                    rids, held, size = [], [], 0
        if held:
            yield from flush(rids, held)

    def tell(batches):
        """Rows sorted by (shard, kind): merge the sketches of a shard, then answer; one shard is held."""
        shard, count = None, None
        for b in small(batches, 32):
            out = []
            for to, kind, row, piece, block, docs, a, c in zip(*(x.to_pylist() for x in b.columns)):
                if kind == 2:
                    out.append((block, docs, c))
                    continue
                if to != shard:
                    shard, count = to, np.zeros((DEPTH, cells), np.uint8)
                if kind == 0:
                    at = np.frombuffer(a, "<u2").astype(np.int64) + piece * _PIECE
                    count[row, at] = np.minimum(count[row, at] + 1 + np.unpackbits(np.frombuffer(c, np.uint8), count=len(at)), 2)
                    continue
                digest = np.frombuffer(a, "<u8")
                full = np.all([count[r, _cells(digest, r, cells)] > 1 for r in range(DEPTH)], axis=0)
                if full.any():
                    keys, (which, place) = np.frombuffer(docs, "<i8"), np.frombuffer(c, "<u4").reshape(2, -1)
                    out.append((block, *about(keys.tolist(), which[full], place[full])))
            yield _table(out, _names(_TOLD), [pa.int64(), pa.binary(), pa.binary()])

    def gather(batches):
        """Rows sorted by block: one row for each document; one block is held."""
        block, held = None, []

        def done():
            keys, which, place = (np.concatenate(x) for x in zip(*held))
            rid = keys[which]
            order = np.argsort(rid, kind="stable")
            rid, place = rid[order], place[order].astype("<u4")
            return _table([(int(rid[a]), place[a:e].tobytes()) for a, e in _cut(rid)], [RID, "places"], [pa.int64(), pa.binary()])

        for b in small(batches, 32):
            for of, docs, c in zip(*(x.to_pylist() for x in b.columns)):
                if held and of != block:
                    yield done()
                    held = []
                block, before = of, sum(len(k) for k, *_ in held)
                which, place = np.frombuffer(c, "<u4").reshape(2, -1)
                held.append((np.frombuffer(docs, "<i8"), which.astype(np.int64) + before, place))
        if held:
            yield done()

    asked = rows.select(RID, "text").mapInArrow(ask, _ASKED).repartition("shard").sortWithinPartitions("shard", "kind")
    told = asked.mapInArrow(tell, _TOLD).repartition("block").sortWithinPartitions("block")
    return materialize(told.mapInArrow(gather, f"{RID} long, places binary"), "places")


def _flags(w: Windows, places: list[bytes]) -> np.ndarray:
    """Which windows have one of their text's ``places`` (packed uint32) as representative."""
    flag = np.zeros(len(w.hashed) + 1, bool)
    for base, p in zip(w.start.tolist(), places):
        flag[np.frombuffer(p, "<u4") + base] = True
    return w.real & flag[w.chosen]


def _chunks(digests: np.ndarray, flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the chunks of flagged windows; cuts depend on content only.

    Between two texts are places that start no window (``width`` is over 1), so no chunk joins texts.
    """
    edge = np.diff(np.concatenate(([False], flag, [False])).astype(np.int8))
    first, ends = edge[:-1] == 1, np.flatnonzero(edge[1:] == -1) + 1
    cut = np.concatenate(([False], digests[:-1, 1] % np.uint64(CHUNK) == 0)) & flag & ~first
    return np.flatnonzero(first | cut), np.sort(np.concatenate((ends, np.flatnonzero(cut))))


def repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """RID, doc_id, z (compressed text) and ``marks``: sorted (start, n) runs of windows that start earlier elsewhere."""
    rows = keyed(docs, id_col, text_col)
    n_bytes = rows.select(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    places = estimated_repeated(rows, *sketch_size(n_bytes), width)

    def cut(batches):
        """Chunks of the windows estimated repeated; without a digest where this task has met an earlier equal one."""
        met: dict[bytes, tuple[int, int]] = {}
        for b in small(batches):
            out, rids, told = [], b.column(0).to_pylist(), b.column(2).to_pylist()
            for first, texts in _together(unpacked(b.column(1))):
                w = Windows(texts, width)
                if not w.n or not (flag := _flags(w, told[first : first + len(texts)])).any():
                    continue
                d = w.digests()
                starts, ends = _chunks(d, flag)
                owner = np.searchsorted(w.start, starts, "right") - 1
                for i, a, e, base in zip((owner + first).tolist(), starts.tolist(), ends.tolist(), w.start[owner].tolist()):
                    digest, here = xxhash.xxh3_128_digest(d[a:e]), (rids[i], a - base)
                    earlier = met.get(digest, here) < here
                    if not earlier:
                        met[digest] = here
                    out.append((None if earlier else digest, *here, e - a))
            if len(met) > 500_000:
                met.clear()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else ((),) * 4, (pa.binary(), pa.int64(), pa.int32(), pa.int32()))], names=["digest", RID, "start", "n"])

    z = packed(rows, RID)
    chunks = materialize(z.join(places, RID).select(RID, "z", "places").mapInArrow(cut, f"digest binary, {RID} long, start int, n int"), "chunks")
    open_ = chunks.filter("digest is not null")
    first = open_.groupBy("digest").agg(F.min(F.struct(RID, "start", "n")).alias("f"))
    heads = materialize(first.select("digest", f"f.{RID}", "f.start", "f.n"), "heads")
    later = open_.join(heads.select("digest", F.col(RID).alias("hr"), F.col("start").alias("hs")), "digest").filter(f"{RID} <> hr or start <> hs").select(RID, "start", "n")
    later = later.unionAll(chunks.filter("digest is null").select(RID, "start", "n"))

    def pack(c):
        return F.array_sort(F.collect_list(c))

    wanted = heads.groupBy(RID).agg(pack(F.struct("start", "n")).alias("heads"))

    def expand(batches):
        for b in small(batches):
            rids, heads_ = b.column(0).to_pylist(), b.column(2).to_pylist()
            for first, texts in _together(unpacked(b.column(1))):
                w = Windows(texts, width)
                d = w.digests()
                mine = [(rids[first + i], int(w.start[i]), h["start"], h["n"]) for i in range(len(texts)) for h in heads_[first + i]]
                rid, base, start, n = (np.array(x, np.int64) for x in zip(*mine))
                inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                start = np.repeat(start, n) + inner
                h, l = d[np.repeat(base, n) + start].view(np.int64).T
                rid = np.repeat(rid, n)
                order = np.lexsort((start, rid, l, h))
                h, l, rid, start = h[order], l[order], rid[order], start[order]
                # an equal window earlier in this slice: known to be a repeat, travels under its document's key
                known = np.concatenate(([False], (h[1:] == h[:-1]) & (l[1:] == l[:-1])))
                yield pa.RecordBatch.from_arrays([pa.array(np.where(known, rid, h)), pa.array(l), pa.array(rid), pa.array(start, pa.int32()), pa.array(known)], names=["h", "l", RID, "start", "known"])

    def later_ones(batches):
        """Rows sorted by (known, h, l, RID, start): the known ones, and all but the first of each digest."""
        before = None
        for b in batches:
            h, l, rid, start, known = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            if not len(h):
                continue
            same = np.concatenate(([before == (h[0], l[0])], (h[1:] == h[:-1]) & (l[1:] == l[:-1]))) | known
            before = None if known[-1] else (h[-1], l[-1])
            yield pa.RecordBatch.from_arrays([pa.array(rid[same]), pa.array(start[same]), pa.array(np.ones(same.sum()), pa.int32())], names=[RID, "start", "n"])

    # equal chunks have one head each, and slices send on the first of equal windows
    singles = z.join(wanted, RID).select(RID, "z", "heads").mapInArrow(expand, f"h long, l long, {RID} long, start int, known boolean")
    repeats = singles.repartition("h").sortWithinPartitions("known", "h", "l", RID, "start").mapInArrow(later_ones, f"{RID} long, start int, n int")
    # a document has at most as many entries as words, so its list is bounded by the document
    marked = later.unionAll(repeats).groupBy(RID).agg(pack(F.struct("start", "n")).alias("marks"))
    z = packed(rows.withColumn("doc_id", F.col("doc_id").cast("long")), RID, "doc_id")
    return z.join(marked, RID, "left").select(RID, "doc_id", "z", "marks")


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """One row for each document: RID, doc_id, kept_text (binary), n_words, n_removed, kept_sha256."""
    marked = repeated_words(docs, id_col, text_col, width)

    def run(batches):
        for b in small(batches):
            out = []
            for t, marks in zip(unpacked(b.column(2)), b.column(3).to_pylist()):
                words = t.split()
                gone = np.zeros(len(words) + 1, np.int32)
                if marks:
                    for m in marks:
                        gone[m["start"]] += 1
                        gone[m["start"] + m["n"] + width - 1] -= 1
                gone = np.cumsum(gone)[:-1] > 0
                kept = b" ".join(w for w, g in zip(words, gone.tolist()) if not g)
                out.append((kept, len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*out)) if out else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string())],
                names=[RID, "doc_id", "kept_text", "n_words", "n_removed", "kept_sha256"],
            )

    schema = f"{RID} long, doc_id long, kept_text binary, n_words long, n_removed long, kept_sha256 string"
    return marked.mapInArrow(run, schema)


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Word windows of all documents that start earlier elsewhere are removed."""
    return drop_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_words", "n_removed", "kept_sha256")
