"""Leaks between splits: texts that are equal, or nearly so, in more than one of them.

Texts are equal when their words are (A-Z in lower case, words between blanks) and near when the Jaccard similarity of
their sets of five-word shingles is 0.8 or more (a shorter text is one shingle). Copies are one class, so links are between
different texts, and no pair of copies is written. A text without words leaks nothing.

Shingles are made in Arrow batches. A near pair shares one of the first n - ceil(0.8 n) + 1 shingles of each side in any one
order of shingles, so only these travel. The order is by digest, with the frequent shingles that ``frequent`` lists put last:
the list decides what meets in vain, never what is found.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ledgerlens.sources.shared import shared_folder

WIDTH, SIMILARITY = 5, 0.8
#: Texts that a worker splits into words at a time.
_TEXTS = 256
#: Shingles of which a worker counts repeats at a time; repeats that make one frequent; frequent ones at most (8 MB).
_COUNTED, _OFTEN, _LISTED = 1 << 21, 64, 1 << 20
#: Classes and shingles of a block; a task compares two blocks at a time.
_BLOCK, _BLOCK_SHINGLES = 512, 1 << 19
#: Bits of the table that tells which texts have a partner.
_BITS = 26
_FACTORS = np.random.default_rng(42).integers(0, 1 << 64, WIDTH, dtype=np.uint64) | np.uint64(1)


def shingles(batches, column: int):
    """(batch, places, digests, sets): for slices of a batch, the rows that have words, 128 bits of their words, their distinct shingles in order."""
    for whole in batches:
        for at in range(0, whole.num_rows, _TEXTS):
            b = whole.slice(at, _TEXTS)
            said = [(t or b"").lower().split() for t in b.column(column).cast(pa.binary()).to_pylist()]
            places = [i for i, ws in enumerate(said) if ws]
            flat = [w for i in places for w in said[i]]
            # zeros stand after each text's end when it is shorter than a shingle
            h = np.concatenate((pd.util.hash_array(np.array(flat, dtype=object), categorize=False), np.zeros(WIDTH, np.uint64)))
            runs = sum(h[k : k + len(flat)] * _FACTORS[k] for k in range(WIDTH)) if flat else h
            sets, start = [], 0
            for i in places:
                n = len(said[i])
                sets.append(np.unique(runs[start : start + n - WIDTH + 1]) if n >= WIDTH else (h[start : start + n] * _FACTORS[:n]).sum(keepdims=True))
                start += n
            yield b, places, [hashlib.md5(b" ".join(said[i])).hexdigest() for i in places], sets


def frequent(texts: DataFrame, text: str) -> Broadcast:
    """(digests in order, their ranks by number): shingles that many texts have, at most ``_LISTED``.

    Workers count over some 2 M shingles at a time and tell what they see twice, so numbers are low estimates.
    """

    def run(batches):
        def told(held):
            s, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(s[n > 1].view(np.int64)), pa.array(n[n > 1])], names=["s", "n"])

        held, size = [], 0
        for *_, sets in shingles(batches, 0):
            held += sets
            size += sum(map(len, sets))
            if size >= _COUNTED:
                yield told(held)
                held, size = [], 0
        if held:
            yield told(held)

    seen = texts.select(text).mapInArrow(run, "s long, n long").groupBy("s").agg(F.sum("n").alias("n"))
    listed = seen.filter(F.col("n") >= _OFTEN).orderBy(F.desc("n"), "s").limit(_LISTED).toArrow()
    s, n = listed["s"].to_numpy().view(np.uint64), listed["n"].to_numpy()
    by, rank = np.argsort(s), np.empty(len(s), np.int64)
    rank[np.lexsort((s, n))] = np.arange(1, len(s) + 1)
    return texts.sparkSession.sparkContext.broadcast((s[by], rank[by]))


def _first(own: np.ndarray, often: np.ndarray, rank: np.ndarray, similarity: float) -> np.ndarray:
    """As many shingles of a set, frequent ones last, as two near sets cannot both miss."""
    at = np.minimum(np.searchsorted(often, own), max(len(often) - 1, 0))
    place = np.where(often[at] == own, rank[at], 0) if len(often) else np.zeros(len(own), np.int64)
    return own[np.argsort(place, kind="stable")][: len(own) - math.ceil(similarity * len(own) - 1e-9) + 1]


def profiles(texts: DataFrame, similarity: float) -> DataFrame:
    """key, split, digest, n, first: each text (columns key, split, text) that has words, its number of shingles and the first of them."""
    often = frequent(texts, "text")

    def run(batches):
        s, rank = often.value
        for b, places, digests, sets in shingles(batches, 2):
            rows = b.take(pa.array(places, pa.int64()))
            first = pa.array([_first(x, s, rank, similarity).view(np.int64) for x in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(digests, pa.string()), pa.array(map(len, sets), pa.int32()), first], names=["key", "split", "digest", "n", "first"])

    slim = texts.select("key", "split", "text")
    schema = T.StructType([slim.schema["key"], slim.schema["split"], T.StructField("digest", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("first", T.ArrayType(T.LongType()))])
    return slim.mapInArrow(run, schema)


def _alike(n: Column, m: Column, both: Column, similarity: float) -> Column:
    return both >= (n + m - both) * similarity - 1e-9


def candidates(classes: DataFrame, similarity: float, keep) -> DataFrame:
    """(rid, other), rid < other: classes (rid, n, first, splits) that may be near and are not all of one split."""
    rows = classes.select("rid", "n", F.size("first").alias("p"), F.explode("first").alias("s"))
    # shingles that one class has meet nothing
    rows = keep(rows.withColumn("__often", F.count(F.lit(1)).over(Window.partitionBy("s"))).filter("__often > 1").drop("__often"), "shared")
    there = rows.select(F.col("rid").alias("other"), F.col("n").alias("m"), F.col("p").alias("q"), "s")
    sized = F.least("n", "m") >= F.greatest("n", "m") * similarity - 1e-9
    met = rows.join(there.hint("merge"), "s").filter((F.col("rid") < F.col("other")) & sized).groupBy("rid", "other", "n", "m", "p", "q").agg(F.count(F.lit(1)).alias("k"))
    # what is shared and not counted stands behind the first ones of the side whose first ones end earlier in the order
    met = met.filter(_alike(F.col("n"), F.col("m"), F.least(F.col("k") + F.greatest(F.col("n") - F.col("p"), F.col("m") - F.col("q")), "n", "m"), similarity)).select("rid", "other")
    a = classes.select("rid", F.col("splits").alias("__a"))
    b = classes.select(F.col("rid").alias("other"), F.col("splits").alias("__b"))
    apart = F.size(F.array_union("__a", "__b")) > 1
    return keep(met.join(a, "rid").join(b, "other").filter(apart).select("rid", "other"), "met")


def _blocks(met: DataFrame, classes: DataFrame) -> DataFrame:
    """(rid, block): classes that meet, those with the same least partner together, dealt to blocks of bounded size."""
    both = met.unionByName(met.select(F.col("other").alias("rid"), F.col("rid").alias("other")))
    of = both.groupBy("rid").agg(F.least("rid", F.min("other")).alias("label")).join(classes.select("rid", "n"), "rid")
    dealt = of.groupBy("label").agg(F.greatest(F.ceil(F.count(F.lit(1)) / _BLOCK), F.ceil(F.sum("n") / _BLOCK_SHINGLES)).alias("parts"))
    return of.join(dealt, "label").select("rid", F.xxhash64("label", F.pmod(F.xxhash64("rid"), "parts")).alias("block"))


def _sets_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(digest, set): the shingles, as bytes, of all texts with a digest of ``wanted`` and of few others.

    A table of bits, of fixed size (8 MB), keeps the others out; the join is by the whole digest.
    """
    bit = F.shiftright(F.conv(F.substring("digest", 1, 7), 16, 10).cast("long"), 28 - _BITS)
    byte = F.bit_or(F.call_function("shiftleft", F.lit(1), F.pmod("bit", F.lit(8)).cast("int")))
    marked = wanted.select(bit.alias("bit")).groupBy(F.shiftright("bit", 3).alias("at")).agg(byte.alias("bits")).toArrow()
    table = np.zeros(1 << (_BITS - 3), np.uint8)
    table[marked["at"].to_numpy()] = marked["bits"].to_numpy()
    shared = texts.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        for _, _, digests, sets in shingles(batches, 0):
            at = np.array([int(d[:7], 16) >> (28 - _BITS) for d in digests], np.int64)
            some = np.flatnonzero(shared.value[at >> 3] >> (at & 7) & 1)
            yield pa.RecordBatch.from_arrays([pa.array([digests[i] for i in some], pa.string()), pa.array([sets[i].tobytes() for i in some], pa.binary())], names=["digest", "set"])

    return texts.select("text").mapInArrow(run, "digest string, set binary").groupBy("digest").agg(F.first("set").alias("set"))


def _compare(similarity: float):
    """Rows (lo, hi, rid, partners, set) sorted by lo and hi: (rid, other, similarity) of partners that are near."""

    def solve(rids, partners, sets):
        at = {r: i for i, r in enumerate(rids)}
        sizes = np.array([len(s) for s in sets])
        values, number = np.unique(np.concatenate(sets), return_inverse=True)
        own, mark = np.split(number, np.cumsum(sizes)[:-1]), np.zeros(len(values), bool)
        out = []
        for i, others in enumerate(partners):
            if not others:
                continue
            rest = np.array([at[r] for r in others])
            mark[own[i]] = True
            both = np.add.reduceat(mark[np.concatenate([own[j] for j in rest])], np.concatenate(([0], np.cumsum(sizes[rest])[:-1])), dtype=np.int64)
            mark[own[i]] = False
            total = sizes[rest] + sizes[i] - both
            near = both >= total * similarity - 1e-9
            out += [(rids[i], r, x) for r, x in zip(np.array(others)[near].tolist(), (both[near] / total[near]).tolist())]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64()))], names=["rid", "other", "similarity"])

    def run(batches):
        group, rids, partners, sets = None, [], [], []
        for whole in batches:
            for at in range(0, whole.num_rows, _TEXTS):
                for lo, hi, rid, others, own in zip(*(c.to_pylist() for c in whole.slice(at, _TEXTS).columns)):
                    if (lo, hi) != group:
                        if rids:
                            yield from solve(rids, partners, sets)
                        group, rids, partners, sets = (lo, hi), [], [], []
                    rids.append(rid)
                    partners.append(others)
                    sets.append(np.frombuffer(own, np.uint64))
        if rids:
            yield from solve(rids, partners, sets)

    return run


def near_classes(texts: DataFrame, classes: DataFrame, similarity: float = SIMILARITY, keep=lambda df, name: df) -> DataFrame:
    """(rid, other, similarity), rid < other: classes (rid, digest, n, first, splits) that are near and not all of one split; none is lost.

    ``texts`` has the column text. ``keep(df, name)`` may write what is read more than once. Classes that meet are compared whole, two blocks
    of them at a time, so that each set is sent once for a block and not once for a pair.
    """
    met = candidates(classes, similarity, keep)
    blocks = keep(_blocks(met, classes), "blocks")
    a, b = blocks.withColumnRenamed("block", "x"), blocks.select(F.col("rid").alias("other"), F.col("block").alias("y"))
    pairs = met.join(a, "rid").join(b, "other").select(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi"), "rid", "other")
    asked = pairs.groupBy("lo", "hi", "rid").agg(F.collect_list("other").alias("partners"))
    need = asked.unionByName(pairs.select("lo", "hi", F.col("other").alias("rid"), F.array().cast("array<long>").alias("partners")).distinct())
    need = need.groupBy("lo", "hi", "rid").agg(F.flatten(F.collect_list("partners")).alias("partners"))
    wanted = classes.select("rid", "digest")
    sets = _sets_of(texts, blocks.join(wanted, "rid"))
    rows = need.join(wanted, "rid").join(sets.hint("merge"), "digest").select("lo", "hi", "rid", "partners", "set").repartition("lo", "hi").sortWithinPartitions("lo", "hi")
    return rows.mapInArrow(_compare(similarity), "rid long, other long, similarity double")


def leaks(texts: DataFrame, key: str, split: str, text: str, similarity: float = SIMILARITY) -> DataFrame:
    """key, split, class_id, exact, n_near, nearest: one row for each text that another split has too, or nearly.

    ``class_id`` is the smallest key of the equal texts, ``exact`` says that another split has one of them, ``n_near`` how
    many different texts of other splits are near, ``nearest`` the highest similarity (null if none). Rows without a
    split are one split of their own. Classes, sets and links are written to the shared folder, as each is read more than once.
    """
    folder = shared_folder(texts.sparkSession, "leaks")

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return df.sparkSession.read.parquet(f"{folder}/{name}")

    rows = texts.select(F.col(key).alias("key"), F.col(split).alias("split"), F.col(text).cast("string").alias("text"))
    member = kept(profiles(rows, similarity), "members").withColumn("__split", F.coalesce(F.concat(F.lit("="), F.col("split").cast("string")), F.lit("null")))
    slim = member.groupBy("digest").agg(F.min("key").alias("class_id"), F.collect_set("__split").alias("splits"), F.first("n").alias("n"), F.first("first").alias("first"))
    slim = kept(slim.withColumn("rid", F.monotonically_increasing_id()), "classes")
    links = kept(near_classes(rows, slim, similarity, kept), "links")
    both = links.unionByName(links.select(F.col("other").alias("rid"), F.col("rid").alias("other"), "similarity"))
    # by class and split, so copies are not joined with copies
    asked = slim.select("rid", "digest", "class_id", F.size("splits").alias("n_splits"), F.explode("splits").alias("__split"))
    near = asked.join(both, "rid").join(slim.select(F.col("rid").alias("other"), F.col("splits").alias("__others")), "other")
    near = near.filter(F.exists("__others", lambda x: x != F.col("__split"))).groupBy("rid", "__split").agg(F.count(F.lit(1)).alias("n_near"), F.max("similarity").alias("nearest"))
    found = asked.join(near, ["rid", "__split"], "left").filter((F.col("n_splits") > 1) | F.col("n_near").isNotNull())
    found = found.select("digest", "__split", "class_id", (F.col("n_splits") > 1).alias("exact"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "nearest")
    out = member.select("key", "split", "digest", "__split").join(found, ["digest", "__split"])
    return out.select(F.col("key").alias(key), F.col("split").alias(split), "class_id", "exact", "n_near", "nearest")
