"""Exact dedup against a minimal perfect hash over historical distinct digests.

An index shard is one row: the levels of a bit-array cascade (each key takes the first level where it
falls alone, its slot is the rank of its bit) and, per slot, the full 32-byte digest, the winner's
locator and the number of rows. A lookup compares the whole digest with the slot's, so a digest that
was never indexed is recognised; such nonmembers keep the plain group-by they come from.

Defined results: null text counts as empty; a null id loses against any other; repeated rows are
separate documents of which exactly one stays; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RID, keyed, materialize, n_parts, small

#: Digests in a shard, on average: bounds what one task holds.
SHARD_KEYS = 8192
GAMMA = 2.0
DIGEST_SCHEMA = f"{RID} long, doc_id long, digest binary"
SHARD_SCHEMA = "shard long, n long, bits array<binary>, rest binary, digests binary, winners array<long>, winner_ids array<long>, sizes array<long>"
LOOKED_UP = "digest binary, winner long, winner_id long, group_size long, known boolean"


def text_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(RID, doc_id, digest): SHA-256 of the text with A-Z lowered, UTF-8."""
    rows = keyed(docs, id_col, text_col)

    def run(batches):
        for b in small(batches):
            texts = b.column(2).cast(pa.binary()).to_pylist()
            out = [hashlib.sha256((t or b"").lower()).digest() for t in texts]  # bytes.lower() is ASCII only
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], names=[RID, "doc_id", "digest"])

    return materialize(rows.select(RID, F.col("doc_id").cast("long"), "text").mapInArrow(run, DIGEST_SCHEMA), "digests")


def _words(digests: np.ndarray) -> np.ndarray:
    """n x 4 little-endian words of n digests given as n x 32 bytes."""
    return np.ascontiguousarray(digests).view("<u8").reshape(-1, 4)


def _spot(words: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (words[:, level % 4] ^ (np.uint64(level + 1) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
    return ((x >> np.uint64(16)) % np.uint64(size)).astype(np.int64)


def build_mph(digests: np.ndarray, max_levels: int = 48) -> tuple[list[bytes], np.ndarray]:
    """Levels of the cascade for distinct digests, and the digests that no level placed."""
    left, levels = digests, []
    while len(left) and len(levels) < max_levels:
        size = max(8, int(len(left) * GAMMA) + 7 & ~7)
        at = _spot(_words(left), len(levels), size)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(np.packbits(alone).tobytes())
        left = left[~alone[at]]
    return levels, left


def mph_slots(levels: list[bytes], rest: bytes, digests: np.ndarray) -> np.ndarray:
    """Slot of each digest; members get distinct slots from 0, others any slot or -1."""
    out, open_, base = np.full(len(digests), -1, np.int64), np.arange(len(digests)), 0
    for level, packed in enumerate(levels):
        bits = np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)
        rank = np.cumsum(bits) - bits
        at = _spot(_words(digests[open_]), level, len(bits))
        hit = bits[at]
        out[open_[hit]] = base + rank[at[hit]]
        open_, base = open_[~hit], base + int(bits.sum())
    if rest and len(open_):
        place = {rest[i : i + 32]: base + i // 32 for i in range(0, len(rest), 32)}
        out[open_] = [place.get(digests[i].tobytes(), -1) for i in open_]
    return out


def _matrix(col) -> np.ndarray:
    return np.frombuffer(b"".join(col), np.uint8).reshape(-1, 32)


def _shard(n: int):
    return F.pmod(F.xxhash64("digest"), F.lit(n)).alias("shard")


def _winners(digests: DataFrame) -> DataFrame:
    """One row for each distinct digest; partial aggregates keep a hot digest small."""
    best = F.max(F.struct(F.col("doc_id"), F.col(RID)))
    return digests.groupBy("digest").agg(best.alias("w"), F.count(F.lit(1)).alias("size")).select("digest", F.col(f"w.{RID}").alias("winner"), F.col("w.doc_id").alias("winner_id"), "size")


def build_index(digests: DataFrame, n_shards: int) -> DataFrame:
    """The perfect-hash index over the distinct digests of ``digests``, one row a shard."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        d = _matrix(pdf["digest"])
        levels, rest = build_mph(d)
        slots = mph_slots(levels, rest.tobytes(), d)
        order = np.argsort(slots)
        row = [int(pdf["shard"].iloc[0]), len(d), levels, rest.tobytes(), d[order].tobytes(), *(pdf[c].to_numpy()[order].tolist() for c in ("winner", "winner_id", "size"))]
        return pd.DataFrame([row], columns=["shard", "n", "bits", "rest", "digests", "winners", "winner_ids", "sizes"])

    rows = _winners(digests).withColumn("winner_id", F.coalesce("winner_id", F.lit(-(2**63)))).withColumn("shard", _shard(n_shards))
    return materialize(rows.groupBy("shard").applyInPandas(build, SHARD_SCHEMA), "mph")


def look_up(batch: DataFrame, index: DataFrame, n_shards: int) -> DataFrame:
    """Winner and size for every digest of the batch or the index; ``known``: it was in the index."""

    def probe(new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        cols = ["digest", "winner", "winner_id", "group_size", "known"]
        if old.empty:
            out = new[["digest", "winner", "winner_id", "size"]].assign(known=False)
            return out.set_axis(cols, axis=1)
        r = old.iloc[0]
        slots = _matrix([r["digests"]])
        winner, ids, sizes = (np.array(r[c], dtype=np.int64) for c in ("winners", "winner_ids", "sizes"))
        fresh = []
        if len(new):
            d = _matrix(new["digest"])
            at = mph_slots(list(r["bits"]), r["rest"], d)
            member = (at >= 0) & (slots[np.maximum(at, 0)] == d).all(axis=1)  # byte check
            nw, ni, ns = (new[c].to_numpy(np.int64) for c in ("winner", "winner_id", "size"))
            hit = at[member]
            later = (ni[member] > ids[hit]) | ((ni[member] == ids[hit]) & (nw[member] > winner[hit]))
            winner[hit], ids[hit] = np.where(later, nw[member], winner[hit]), np.where(later, ni[member], ids[hit])
            sizes[hit] += ns[member]
            fresh = [pd.DataFrame({"digest": new["digest"][~member], "winner": nw[~member], "winner_id": ni[~member], "group_size": ns[~member], "known": False})]
        mine = pd.DataFrame({"digest": [s.tobytes() for s in slots], "winner": winner, "winner_id": ids, "group_size": sizes, "known": True})
        return pd.concat([mine, *fresh], ignore_index=True)[cols]

    rows = _winners(batch).withColumn("winner_id", F.coalesce("winner_id", F.lit(-(2**63)))).withColumn("shard", _shard(n_shards))
    return rows.groupBy("shard").cogroup(index.groupBy("shard")).applyInPandas(probe, LOOKED_UP)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", history=None) -> DataFrame:
    """One row for each document: RID, doc_id, keep_id, group_size, kept, text_sha256, in_history.

    ``history(digests)`` picks the digest rows that the index is built from; the rest is the new batch.
    By default that is the lower half of the id range, as an older crawl would be. ``working`` of the
    result are the tables that it reads; who has written it can discard them.
    """
    digests = text_digests(docs, id_col, text_col)
    lo, hi, n = digests.agg(F.min(RID), F.max(RID), F.count(F.lit(1))).first()
    middle = 0 if n == 0 else (lo + hi) // 2
    old = history(digests) if history else F.col(RID) <= middle
    n_shards = n_parts(n, SHARD_KEYS)
    index = build_index(digests.filter(old), n_shards)
    groups = look_up(digests.filter(~old), index, n_shards)
    groups = groups.withColumn("winner_id", F.expr(f"nullif(winner_id, {-(2**63) + 1} - 1L)"))
    # both sides are a few dozen bytes a row; adaptive execution splits the side of a hot digest
    out = digests.join(groups, "digest", "left").select(
        RID,
        "doc_id",
        F.col("winner_id").alias("keep_id"),
        "group_size",
        (F.col(RID) == F.col("winner")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        F.col("known").alias("in_history"),
    )
    out.working = (digests, index)
    return out


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Exact groups of all documents; the row with the largest doc_id stays."""
    out = exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP10_SQL = f"""
with t as (select doc_id, sha256({_LOWER}) as text_sha256 from documents)
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
       doc_id = max(doc_id) over w as kept, text_sha256
from t window w as (partition by text_sha256)
"""
