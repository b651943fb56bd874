"""SimHash near-dedup by multi-index hashing.

A 64-bit fingerprint has two 32-bit segments; if two fingerprints differ in at most 3 bits, one of the
segments differs in at most 1. So each distinct fingerprint is stored under its two segment values and
looked up in the Hamming ball of radius 1 around each (only the half that clears a set bit: the other
member of a pair sets it). Members of a table entry are compared on all 64 bits inside the task, and
only a spanning forest of the true links leaves it, never all pairs. Where more than ``SPLIT_AT``
fingerprints share a segment value, its entry and those a bit below are split before the shuffle: the
other segment differs in at most 3 bits, so one of its four bytes is equal, and each row goes on under its
four bytes. What one task then holds shares 40 bits. Inside the task large entries are split once more by
16-bit pieces of the remaining bits, so that none costs its square.

Defined results: null or empty text has fingerprint zero, which links like any other; repeated rows and
null ids are separate documents; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RID, discard, keyed, materialize, small
from .components import components

SEED = 42
MAX_BITS = 3
#: Fingerprints of a segment value, and members of an entry in a task, from which on entries are split.
SPLIT_AT = 2048
_BLOCK = 1 << 16


def fingerprint(text: bytes | None, words_in: int = 3) -> int:
    """Unsigned 64-bit SimHash of the word shingles of a UTF-8 text; A-Z are lowered."""
    words = (text or b"").lower().split()  # bytes.split() splits at ASCII white space
    if not words:
        return 0
    n = max(1, len(words) - words_in + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    stops = (ends - 1)[min(words_in, len(words)) - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, _BLOCK):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + _BLOCK], stops[at : at + _BLOCK])], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_in: int = 3) -> DataFrame:
    """(RID, doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches):
        for b in small(batches):
            texts = b.column(2).cast(pa.binary()).to_pylist()
            fp = np.array([fingerprint(t, words_in) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], names=[RID, "doc_id", "fp"])

    rows = keyed(docs, id_col, text_col).select(RID, F.col("doc_id").cast("long"), "text")
    return materialize(rows.mapInArrow(run, f"{RID} long, doc_id long, fp long"), "fingerprints")


def _near(home: np.ndarray, all_: np.ndarray, bits: int) -> np.ndarray:
    """Labels of all_ (home first) after joining what lies within ``bits`` of a home member."""
    label = np.arange(len(all_))
    for i, h in enumerate(home):
        near = np.flatnonzero(np.bitwise_count(all_[i + 1 :] ^ h) <= bits) + i + 1
        if len(near):
            got = np.unique(np.append(label[near], label[i]))
            if len(got) > 1:
                label[np.isin(label, got[1:])] = got[0]
    return label


def forest(home: np.ndarray, probe: np.ndarray, bits: int = MAX_BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges that join everything within ``bits`` of a member of ``home`` (uint64 arrays)."""
    all_ = np.concatenate((home, probe))
    if len(home) <= SPLIT_AT:
        label = _near(home, all_, bits)
        moved = np.flatnonzero(label != np.arange(len(all_)))
        return [(all_[moved], all_[label[moved]])] if len(moved) else []
    # the shared segment is equal (or one bit off): the other 32 bits hold at most ``bits`` differences,
    # so one of their 16-bit halves holds at most one
    known, out = np.arange(len(all_)) < len(home), []
    common = home[0] ^ home[-1]
    low_varies = bool(common & np.uint64(0xFFFFFFFF))
    for shift in (0, 16) if low_varies else (32, 48):
        piece = (all_ >> np.uint64(shift)) & np.uint64(0xFFFF)
        key, who, owns = [piece], [np.arange(len(all_))], [known]
        for bit in range(16):
            has = np.flatnonzero(piece >> np.uint64(bit) & np.uint64(1))
            key.append(piece[has] ^ np.uint64(1 << bit))
            who.append(has)
            owns.append(np.zeros(len(has), bool))
        key, who, owns = np.concatenate(key), np.concatenate(who), np.concatenate(owns)
        # probes of the outer table may be the stored side here: a pair needs one outer home only
        order = np.argsort(key, kind="stable")
        key, who = key[order], who[order]
        cuts = np.flatnonzero(np.diff(key)) + 1
        for a, b in zip(np.concatenate(([0], cuts)), np.concatenate((cuts, [len(key)]))):
            got = np.unique(who[a:b])
            mine = got[known[got]]
            if len(mine) and len(got) > 1:
                sub = np.concatenate((mine, got[~known[got]]))
                label = _near(all_[mine], all_[sub], bits)
                moved = np.flatnonzero(label != np.arange(len(sub)))
                if len(moved):
                    out.append((all_[sub][moved], all_[sub][label[moved]]))
    return out


def _links(batches):
    """Partition sorted by key: gather the members of each table entry and emit its forest."""
    held: list[np.ndarray] = []
    names = ["u", "v"]

    def solve(key, fp, probe):
        cuts = np.flatnonzero(np.diff(key)) + 1
        starts, stops = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(key)]))
        homes = np.add.reduceat(~probe, starts)
        out = []
        for a, b in zip(starts[(homes > 0) & (stops - starts > 1)], stops[(homes > 0) & (stops - starts > 1)]):
            p = probe[a:b]
            out += forest(fp[a:b][~p], fp[a:b][p])
        if out:
            u, v = (np.concatenate(x).view(np.int64) for x in zip(*out))
            for i in range(0, len(u), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(u[i : i + 100_000]), pa.array(v[i : i + 100_000])], names=names)

    for b in batches:
        cols = [b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64), b.column(2).to_numpy(zero_copy_only=False)]
        if not len(cols[0]):
            continue
        held.append(cols)
        if cols[0][-1] == held[0][0][-1]:
            continue  # still one entry
        cols = [np.concatenate(x) for x in zip(*held)]
        last = int(np.searchsorted(cols[0], cols[0][-1]))
        yield from solve(*(c[:last] for c in cols))
        held = [[c[last:] for c in cols]]
    if held:
        yield from solve(*(np.concatenate(x) for x in zip(*held)))


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """(u, v): edges that connect the distinct fingerprints as links of at most 3 bits do."""
    tables, homes = [], []
    for seg, value in enumerate(("(fp & 4294967295L)", "shiftrightunsigned(fp, 32)")):
        tag = f"{seg << 32}L"
        homes.append(f"{value} + {tag}")
        tables.append(f"array(named_struct('key', {value} + {tag}, 'probe', false))")
        tables.append(f"transform(filter(sequence(0, 31), i -> getbit({value}, i) = 1), i -> named_struct('key', {value} - shiftleft(1L, i) + {tag}, 'probe', true))")
    rows = fps.selectExpr("fp", f"explode(concat({', '.join(tables)})) as t").selectExpr("t.key as key", "fp", "t.probe as probe")
    crowded = fps.selectExpr(f"explode(array({', '.join(homes)})) as key").groupBy("key").count().filter(F.col("count") > SPLIT_AT)
    below = "transform(filter(sequence(0, 31), i -> getbit(key, i) = 1), i -> key - shiftleft(1L, i))"
    wide = crowded.selectExpr(f"explode(concat(array(key), {below})) as key").distinct().withColumn("wide", F.lit(True))
    other = "if(key >= 4294967296L, fp & 4294967295L, shiftrightunsigned(fp, 32))"
    parts = f"transform(sequence(0, 3), i -> xxhash64(key, i, shiftrightunsigned({other}, 8 * i) & 255L))"
    dealt = rows.join(wide, "key", "left").selectExpr(f"explode(if(wide, {parts}, array(key))) as key", "fp", "probe")
    return dealt.repartition(F.col("key")).sortWithinPartitions("key").mapInArrow(_links, "u long, v long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_in: int = 3) -> DataFrame:
    """One row for each document: RID, doc_id, fp, component_rid, component_id (the least id of its component)."""
    rows = fingerprints(docs, id_col, text_col, words_in)
    distinct = materialize(rows.groupBy("fp").agg(F.min(RID).alias("first"), F.min("doc_id").alias("first_id")), "distinct")
    links = components(fingerprint_links(distinct.select("fp")))
    roots = distinct.join(links.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = roots.groupBy("root").agg(F.min("first").alias("component_rid"), F.min("first_id").alias("component_id"))
    member = materialize(roots.select("fp", "root").join(least, "root").select("fp", "component_rid", "component_id"), "members")
    # a fingerprint that many documents share is a few bytes a row; adaptive execution splits it
    out = rows.join(member, "fp")
    out.working = (rows, distinct, *links.working, member)
    return out


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(RID, entry): documents whose component has several members, and its least RID."""
    found = simhash_components(docs, id_col, text_col)
    slim = found.select(RID, F.col("component_rid").alias("entry"))
    several = slim.filter(F.col(RID) != F.col("entry"))
    out = materialize(several.unionAll(several.select(F.col("entry").alias(RID), "entry").distinct()), "groups")
    discard(*found.working)
    return out


def op3_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    out = simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
