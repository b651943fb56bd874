"""Sequence packing by non-negative least squares over piece lengths.

Documents are tokenized once; whole windows are sequences of their own, and the remainders (under one
window) are packed from their length histogram alone, which has at most ``window - 1`` entries at any
corpus size: shallow combinations of two or three lengths that fill a window are enumerated, their repeat
counts solved by non-negative least squares against the histogram and rounded down, and what is left
over is packed greedily, next fit with cuts, so that only the very last sequence is padded. The plan is
a table of ranges "the i-th to j-th remainder of length l go to sequence s + k at offset o"; remainders
get their number within a length from counts of hash buckets and ranks inside the buckets.

Defined results: null text counts as empty and has the closing id only; repeated rows and null ids are
separate documents; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import RID, keyed, materialize, n_parts, small

WINDOW = 1024
END = 0
#: Combinations of three take two of their lengths from so many of the most frequent.
FREQUENT = 48
_BUCKET_ROWS = 2048
_encoders: dict = {}


def encoder(json_path: str):
    """text -> ids as the tokenizer file gives them, special tokens not added.

    The byte-level vocabulary also comes as ranks beside the file; their encoder gives the same ids several
    times faster. A text that spells out a special token goes to the tokenizer itself.
    """
    if json_path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(json_path)
        special = [t.content for t in slow.get_added_tokens_decoder().values()]
        by_file = lambda text: slow.encode(text, add_special_tokens=False).ids
        ranks_path = json_path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks_path):
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            _encoders[json_path] = lambda text: by_file(text) if any(s in text for s in special) else fast.encode_ordinary(text)
        else:
            _encoders[json_path] = by_file
    return _encoders[json_path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def tokenize(rows: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """RID, doc_id, n (tokens with the closing id), full (checksums of whole windows), rest (ids after them, uint32)."""

    def run(batches):
        encode = encoder(path)
        for b in small(batches):
            out = []
            for t in b.column(2).to_pylist():
                ids = np.array([*encode(t or ""), END], dtype="<u4")
                whole = len(ids) // window * window
                out.append((len(ids), [crc(ids[i : i + window]) for i in range(0, whole, window)], len(ids) - whole, ids[whole:].tobytes()))
            cols = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.list_(pa.int64())), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.binary())],
                names=[RID, "doc_id", "n", "full", "rest_n", "rest"],
            )

    return rows.select(RID, F.col("doc_id").cast("long"), "text").mapInArrow(run, f"{RID} long, doc_id long, n long, full array<long>, rest_n int, rest binary")


def combinations(hist: np.ndarray, window: int = WINDOW) -> list[tuple[int, ...]]:
    """Sorted combinations of two or three lengths present in the histogram that add up to a window."""
    have = np.flatnonzero(hist)
    found = {(int(a), int(window - a)) for a in have if a <= window - a and hist[window - a]}
    often = sorted(map(int, have[np.argsort(-hist[have], kind="stable")][:FREQUENT]))
    for a in often:
        for b in often:
            c = window - a - b
            if a <= b and 0 < c and hist[c]:
                found.add(tuple(sorted((a, b, c))))
    return sorted(found)


def nnls(combos: list[tuple[int, ...]], hist: np.ndarray, sweeps: int = 40) -> np.ndarray:
    """Repeat counts x >= 0 that minimise the squared misfit to the histogram, by coordinate descent."""
    x, rest = np.zeros(len(combos)), hist.astype(float).copy()
    for _ in range(sweeps):
        moved = 0.0
        for i, c in enumerate(combos):
            sizes: dict[int, int] = {}
            for length in c:
                sizes[length] = sizes.get(length, 0) + 1
            step = sum(k * rest[n] for n, k in sizes.items()) / sum(k * k for k in sizes.values())
            new = max(0.0, x[i] + step)
            if new != x[i]:
                for n, k in sizes.items():
                    rest[n] -= k * (new - x[i])
                moved = max(moved, abs(new - x[i]))
                x[i] = new
        if moved < 0.25:
            break
    return x


def plan(hist: np.ndarray, window: int = WINDOW) -> dict:
    """hist[l]: remainders of length l. Ranges per length, then the greedy stream of the others."""
    combos = combinations(hist, window)
    x, used, ranges, seq = nnls(combos, hist), np.zeros(window, np.int64), [], 0
    for i in np.argsort(-x, kind="stable") if len(combos) else ():
        sizes = {n: combos[i].count(n) for n in combos[i]}
        times = min([int(x[i]), *(int(hist[n] - used[n]) // k for n, k in sizes.items())])
        if times > 0:
            at = 0
            for n in combos[i]:
                ranges.append((n, int(used[n]), int(used[n]) + times, seq, at))
                used[n] += times
                at += n
            seq += times
    base, streams = 0, np.zeros(window, np.int64)
    for n in range(window - 1, 0, -1):
        streams[n] = base
        base += int(hist[n] - used[n]) * n
    ranges.sort()
    return {"ranges": np.array(ranges, dtype=np.int64).reshape(-1, 5), "used": used, "streams": streams, "stream_seq": seq, "full_seq": seq + -(-base // window)}


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, window: int = WINDOW) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path = path or default_tokenizer()
    tokens = materialize(tokenize(keyed(docs, id_col, text_col), path, window), "tokens")
    hist, n = np.zeros(window, np.int64), 0
    for r in tokens.groupBy("rest_n").count().collect():  # one row for each length under a window
        hist[r["rest_n"]], n = r["count"], n + r["count"]
    hist[0] = 0
    p = plan(hist, window)
    buckets = n_parts(n, _BUCKET_ROWS)
    rows = tokens.withColumn("bucket", F.pmod(F.xxhash64(RID), F.lit(buckets)))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("bucket", "rest_n").agg(F.count(F.lit(1)).alias("c"), F.sum(F.size("full")).alias("f"))
    lengths = counts.select("bucket", "rest_n", F.coalesce(F.sum("c").over(before(Window.partitionBy("rest_n").orderBy("bucket"))), F.lit(0)).alias("c0"))
    # whole windows: bucket totals, a few bytes for each bucket, summed in blocks of buckets
    block = F.floor(F.col("bucket") / 4096)
    totals = counts.groupBy("bucket").agg(F.sum("f").alias("f")).withColumn("block", block)
    blocks = totals.groupBy("block").agg(F.sum("f").alias("bf")).select("block", F.coalesce(F.sum("bf").over(before(Window.orderBy("block"))), F.lit(0)).alias("b0"))
    totals = totals.join(blocks, "block").select("bucket", (F.col("b0") + F.coalesce(F.sum("f").over(before(Window.partitionBy("block").orderBy("bucket"))), F.lit(0))).alias("f0"))
    # places are found on keys and lengths alone; the ids travel once, to their place
    slim = rows.select(RID, "bucket", "rest_n", F.size("full").alias("f"))
    ranked = slim.withColumn("rank", F.row_number().over(Window.partitionBy("bucket", "rest_n").orderBy(RID)) - 1)
    ranked = ranked.withColumn("fulls", F.coalesce(F.sum("f").over(before(Window.partitionBy("bucket").orderBy(RID))), F.lit(0)))
    places = ranked.join(totals, "bucket").join(lengths, ["bucket", "rest_n"]).select(RID, (F.col("c0") + F.col("rank")).alias("nth"), (F.col("f0") + F.col("fulls")).alias("nth_full"))
    placed = tokens.join(places, RID).select("doc_id", "n", "full", "rest_n", "rest", "nth", "nth_full")

    def emit(batches):
        r = p["ranges"]
        first = {int(m): (int(np.searchsorted(r[:, 0], m)), int(np.searchsorted(r[:, 0], m, "right"))) for m in np.unique(r[:, 0])}
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        for b in small(batches):
            out = []
            for doc, n, full, rest_n, rest, nth, nth_full in zip(*(c.to_pylist() for c in b.columns)):
                out += [(doc, i * window, window, c, n, p["full_seq"] + nth_full + i, 0) for i, c in enumerate(full)]
                if not rest_n:
                    continue
                base, ids = len(full) * window, np.frombuffer(rest, "<u4")
                if nth < p["used"][rest_n]:
                    a, e = first[rest_n]
                    q = r[a + int(np.searchsorted(r[a:e, 1], nth, "right")) - 1]
                    out.append((doc, base, rest_n, crc(ids), n, int(q[3] + nth - q[1]), int(q[4])))
                    continue
                at = int(p["streams"][rest_n] + (nth - p["used"][rest_n]) * rest_n)
                done = 0
                while done < rest_n:
                    o = (at + done) % window
                    size = min(rest_n - done, window - o)
                    out.append((doc, base + done, size, crc(ids[done : done + size]), n, p["stream_seq"] + (at + done) // window, o))
                    done += size
            cols = list(zip(*out)) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

    return placed.mapInArrow(emit, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op9_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
