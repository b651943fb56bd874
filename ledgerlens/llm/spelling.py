"""Spelling variants: words one edit apart, by merging the light subtrees of a trie.

The trie of all words is a table of edges (node, character, words below). At each branching node the edge
with most words below is heavy, the others are light; a path from the root has at most log2(words) light
edges. A word is merged once for each light edge on its path, never for a heavy one (small into large), and
with its error spent at that node: its character skipped, the heavy character put before it, its character
replaced by the heavy one, or replaced by any (which puts the light subtrees of a node together). What
coincides with the end of another word, or of another merged one, is a pair one edit apart. Each pair has
one node where its paths part, and is found there, once.

Merged words of the last kind that coincide differ from one another in the same place: each gets the number
and the best of the others from their group, which has at most one member for each character, and no pairs
are written out.

Defined results: a null text has no words; a null id counts as an empty string; repeated rows count again;
other columns are ignored; an empty table gives no rows. Words may have any length: the edges of a path carry a
digest of the path so far (128 bits; the path itself up to seven characters), not the word. Words and edges
are joined by exchanges at any size: pressed in files, or before their lists are dealt out, they look small
enough to broadcast, and would go through the driver whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, small, unsent

#: Words are maximal runs of these.
LETTERS = r"[A-Za-zÀ-ÿ]"
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: A near word that is so many times more frequent is the form of a word.
RATIO = 10
#: In the query, of one run in so many (by checksum) a character is lost.
DAMAGED = 31
#: Ends the path of a word; not a letter.
END = "$"
#: Nodes of fewer characters have many words below: their edges are dealt to so many parts.
SHORT, SALTS = 3, 64
_BASE, _PRIME = 1_000_003, (1 << 127) - 1


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damaged: int | None = None, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word and n, its occurrences in all texts, of the words that are long and frequent enough.

    A-Z alone are lower-cased. ``damaged``: where it divides h = crc32("<id>:<word>"), the word loses its character h % length.
    """
    run_of = re.compile(f"{LETTERS}{{{least_length},}}")

    def run(batches):
        for b in batches:
            found: Counter = Counter()
            for part in small([b]):
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    words = run_of.findall((text or "").encode().lower().decode())  # bytes lower-case A-Z alone
                    if not damaged:
                        found.update(words)
                        continue
                    for w, n in Counter(words).items():
                        h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
                        if h % damaged == 0:
                            at = h % len(w)
                            w = w[:at] + w[at + 1 :]
                        if len(w) >= least_length:
                            found[w] += n
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["word", "n"])

    slim = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _paths(words: DataFrame) -> DataFrame:
    """An edge of the trie for each character of each word and for its end: wid, k (characters before), node, c."""
    names = ["wid", "k", "node", "c"]

    def run(batches):
        for b in batches:
            wid, k, node, c = [], [], [], []
            for part in small([b], 1024):
                for i, w in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    digest = 0
                    for j, x in enumerate(w + END):
                        node.append(w[:j].encode() if j <= 7 else digest.to_bytes(16, "little"))
                        digest = (digest * _BASE + ord(x)) % _PRIME
                        c.append(x)
                    wid += [i] * (len(w) + 1)
                    k += range(len(w) + 1)
                    if len(k) > 1 << 16:
                        yield pa.RecordBatch.from_arrays([pa.array(wid, pa.int64()), pa.array(k, pa.int32()), pa.array(node, pa.binary()), pa.array(c, pa.string())], names=names)
                        wid, k, node, c = [], [], [], []
            if k:
                yield pa.RecordBatch.from_arrays([pa.array(wid, pa.int64()), pa.array(k, pa.int32()), pa.array(node, pa.binary()), pa.array(c, pa.string())], names=names)

    return words.select("wid", "word").mapInArrow(run, "wid long, k int, node binary, c string")


def _light(words: DataFrame) -> DataFrame:
    """word, n and for each light edge on its path: k (characters before it) and heavy (character of the heavy edge beside it)."""
    edges = _paths(words)
    nodes = edges.groupBy("node", "c").agg(F.count(F.lit(1)).alias("below"), F.min("k").alias("k"))
    # edges of a node: at most one for each character
    kids = nodes.groupBy("node").agg(F.min("k").alias("k"), F.min(F.struct((-F.col("below")).alias("m"), "c")).alias("top"), F.collect_list("c").alias("cs")).filter(F.size("cs") > 1)
    light = kids.select("node", "k", F.col("top.c").alias("heavy"), F.explode("cs").alias("c")).filter("c <> heavy")
    light = light.select("node", "c", "heavy", F.explode(F.when(F.col("k") < SHORT, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    salted = edges.withColumn("salt", F.when(F.col("k") < SHORT, F.pmod(F.xxhash64("wid"), F.lit(SALTS)).cast("int")).otherwise(0))
    met = salted.join(unsent(light), ["node", "c", "salt"]).select("wid", F.struct("k", "heavy").alias("edge"))
    # at most log2(words) edges for each word
    return met.groupBy("wid").agg(F.collect_list("edge").alias("edges")).join(unsent(words), "wid").select("word", "n", F.explode("edges").alias("e")).select("word", "n", "e.k", "e.heavy")


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near and best (m = -n and word of the most frequent near word, the smallest of ties), for words that have near ones.

    ``words`` (word, n): words are not null and differ from one another.
    """
    numbered = materialize(words.select("word", "n", F.monotonically_increasing_id().alias("wid")), "words")
    light = materialize(_light(numbered), "light")
    rows = light.select("word", "n", "heavy", F.expr("left(word, k)").alias("before"), F.expr(f"substr(concat(word, '{END}'), k + 1, 1)").alias("c"), F.expr("substr(word, k + 2)").alias("rest"))
    ends, heavy_ends = F.col("c") == END, F.col("heavy") == END
    own = F.when(ends, "").otherwise(F.col("c"))
    skipped = F.when(~ends & ~F.col("rest").startswith(F.col("c")), F.concat("before", "rest"))
    put = F.when(~heavy_ends, F.concat("before", "heavy", own, "rest"))
    replaced = F.when(~ends & ~heavy_ends, F.concat("before", "heavy", "rest"))
    sought = rows.select(F.col("word").alias("other"), F.col("n").alias("other_n"), F.explode(F.array_compact(F.array(skipped, put, replaced))).alias("word"))
    best = lambda word, n: F.struct((-F.col(n)).alias("m"), F.col(word).alias("word"))
    met = sought.join(unsent(numbered.select("word", "n")), "word")
    sides = met.select(F.explode(F.array(F.struct("word", best("other", "other_n").alias("best")), F.struct(F.col("other").alias("word"), best("word", "n").alias("best")))).alias("x"))
    pairs = sides.select("x.word", F.lit(1).cast("long").alias("n_near"), "x.best")
    groups = rows.filter(~ends).groupBy("before", "rest").agg(F.array_sort(F.collect_list(best("word", "n"))).alias("g")).filter(F.size("g") > 1)
    members = groups.select("g", F.explode("g").alias("x"))
    first, second = F.get("g", F.lit(0)), F.get("g", F.lit(1))
    among = members.select("x.word", (F.size("g") - 1).cast("long").alias("n_near"), F.when(first["word"] == F.col("x.word"), second).otherwise(first).alias("best"))
    found = materialize(pairs.unionByName(among).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best")), "near")
    discard(light, numbered)
    return found


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of ``words`` (word, n)."""
    words = materialize(words.select("word", "n"), "counts")
    near = near_words(words)
    formed = F.col("best.m") * -1 >= ratio * F.col("n")
    rows = words.join(unsent(near), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("best.word")).alias("form"), F.when(formed, -F.col("best.m")).alias("form_n"))
    rows = materialize(rows, "forms")
    # counts grow at least by the ratio from form to form, so a few doublings reach every root
    links = materialize(rows.filter("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = materialize(links.join(unsent(further), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = longer.filter("moved").limit(1).count()
        discard(links)
        links = longer
        if not moved:
            break
    return rows.join(unsent(links.select("word", "root")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark, sf_dir: str) -> DataFrame:
    """Variants among the words of all documents, one run in 31 of which has lost a character."""
    return variants(word_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), damaged=DAMAGED))
