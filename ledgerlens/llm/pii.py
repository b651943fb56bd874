"""Personal data by bootstrapped contextual extraction.

Entities of the four fixed kinds are seeds. The two words left of an entity are its lexical pattern;
patterns and identifier-like tokens (instances) form a bipartite graph over the whole corpus. Spark
scores it in rounds: a pattern is worth the mean score of its instances (one pseudo-count against it); an
instance that is no seed is worth the chance that not all of its patterns fail. Patterns worth ``MIN_SCORE`` that stand before at least
``MIN_SEEDS`` different seeds are good; an instance behind a good pattern that is itself worth ``MIN_SCORE``
is a seed from the next round on, so what was discovered induces further patterns. Tokens behind the good
patterns of the last round are identifiers of kind ``context``.

Patterns are the last two runs of letters before a token, at any distance in the text. Instances are runs
of letters, digits and ``_.@+-`` with a digit and 5 to 64 characters: that is what counts as an identifier.

Defined results: null text counts as empty; repeated rows and null ids are separate documents; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RID, keyed, materialize, small

KINDS = ("email", "ip", "card", "phone")
EXTRA = "context"
ROUNDS = 3
MIN_SCORE = 0.5
MIN_SEEDS = 3

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# the lookbehind spares the starts inside a run of digits, none of which can match; + never gives back
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9](?:[A-Za-z0-9_.@+-]*[A-Za-z0-9])?")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\W\d_]+")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from their @: linear even on long runs of letters."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) by kind, then start."""
    out = [(0, a, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGIT.findall(m[0])) <= 15:
                out.append((3, m.start(), m.end()))
    return out


class _Words:
    """The two words before a place, in lower case; places are asked in rising order, so a text is read once."""

    def __init__(self, text: str):
        self.text, self.coming, self.last = text, _WORD.finditer(text), []
        self.next = next(self.coming, None)

    def before(self, at: int) -> str | None:
        """None at the start of a text."""
        while self.next and self.next.end() <= at:
            self.last = [*self.last[-1:], self.next[0]]
            self.next = next(self.coming, None)
        words = self.last
        if self.next and self.next.start() < at:  # the place is inside a word: its first part counts
            words = [*words[-1:], self.text[self.next.start() : at]]
        return " ".join(words).lower() if words else None


def instances(text: str, base: list[tuple[int, int, int]]) -> list[tuple[str, str, int, int, bool]]:
    """(pattern, instance, start, end, seed): the seeds and the identifier-like tokens outside them."""
    out, taken = [], sorted((a, b) for _, a, b in base)
    words = _Words(text)
    for a, b in taken:
        if p := words.before(a):
            out.append((p, text[a:b].lower(), a, b, True))
    i, words = 0, _Words(text)
    for m in _TOKEN.finditer(text):
        if not 5 <= len(m[0]) <= 64 or not _DIGIT.search(m[0]):
            continue
        while i < len(taken) and taken[i][1] <= m.start():
            i += 1
        if i < len(taken) and taken[i][0] < m.end() or i and taken[i - 1][1] > m.start():
            continue
        if p := words.before(m.start()):
            out.append((p, m[0].lower(), m.start(), m.end(), False))
    return out


def _hash(s: str) -> int:
    x = xxhash.xxh3_64_intdigest(s)
    return x - (1 << 64) if x >> 63 else x


_SCAN = f"{RID} long, doc_id long, base array<array<int>>, seen array<struct<pattern:long,inst:long,start:int,end:int,seed:boolean>>"


def scan(rows: DataFrame) -> DataFrame:
    """One pass over the texts: fixed entities, and every instance with its pattern."""
    seen = pa.list_(pa.struct([("pattern", pa.int64()), ("inst", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("seed", pa.bool_())]))

    def run(batches):
        for b in small(batches):
            base, found = [], []
            for t in b.column(2).to_pylist():
                spans = base_spans(t or "")
                base.append([list(s) for s in spans])
                found.append([{"pattern": _hash(p), "inst": _hash(x), "start": a, "end": e, "seed": s} for p, x, a, e, s in instances(t or "", spans)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(base, pa.list_(pa.list_(pa.int32()))), pa.array(found, seen)], names=[RID, "doc_id", "base", "seen"])

    return rows.select(RID, F.col("doc_id").cast("long"), "text").mapInArrow(run, _SCAN)


def score_patterns(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, score, seeds) from distinct edges (pattern, inst, seed) after some rounds over the graph.

    ``seeds`` counts the fixed entities and the instances promoted in earlier rounds.
    """
    state = edges.select("pattern", "inst", "seed", F.col("seed").cast("double").alias("s"))
    for i in range(rounds):
        patterns = state.groupBy("pattern").agg((F.sum("s") / (F.count(F.lit(1)) + 1)).alias("score"), F.count_if("seed").alias("seeds"))
        if i == rounds - 1:
            return patterns
        good = (F.col("score") >= MIN_SCORE) & (F.col("seeds") >= MIN_SEEDS)
        judged = state.select("pattern", "inst", "seed").join(patterns.select("pattern", "score", good.alias("good")), "pattern")
        inst = judged.groupBy("inst").agg((1 - F.exp(F.sum(F.log(1 - F.col("score"))))).alias("worth"), F.max("good").alias("good"))
        grown = F.col("seed") | (F.col("good") & (F.col("worth") >= MIN_SCORE))
        state = materialize(state.join(inst, "inst").select("pattern", "inst", grown.alias("seed"), F.when(grown, 1.0).otherwise(F.col("worth")).alias("s")), "scores")


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """RID, doc_id, base (kind, start, end) and context (start, end) spans of every document."""
    scanned = materialize(scan(keyed(docs, id_col, text_col)), "pii")
    seen = scanned.select(RID, F.explode("seen").alias("x")).select(RID, "x.*")
    edges = materialize(seen.groupBy("pattern", "inst").agg(F.max("seed").alias("seed")), "edges")
    good = score_patterns(edges).filter((F.col("score") >= MIN_SCORE) & (F.col("seeds") >= MIN_SEEDS)).select("pattern")
    more = seen.filter("not seed").join(good, "pattern", "left_semi").groupBy(RID).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("context"))
    return scanned.select(RID, "doc_id", "base").join(more, RID, "left")


def op7_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    found = extract(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    names = F.array(*map(F.lit, KINDS))

    def of_kind(i: int):
        return lambda s: s[0] == i

    base = F.array_join(F.transform("base", lambda s: F.concat_ws(":", F.get(names, s[0]), s[1].cast("string"), s[2].cast("string"))), ",")
    context = F.array_join(F.transform("context", lambda s: F.concat_ws(":", F.lit(EXTRA), s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        "doc_id",
        *(F.size(F.filter("base", of_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)),
        F.sha2(base, 256).alias("base_sha256"),
        F.concat_ws(",", F.nullif(base, F.lit("")), F.nullif(context, F.lit(""))).alias("spans"),
        F.coalesce(F.size("context"), F.lit(0)).cast("long").alias("n_context"),
    )
