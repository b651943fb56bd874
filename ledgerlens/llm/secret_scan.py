"""Secret scans over a trigram inverted index, in DataFrame functions only.

From each rule's expression a Boolean trigram query is derived. The index holds postings
(trigram, document key) for the trigrams that some rule asks for; postings are intersected per document
as bit sets, which gives the candidate rules of each document, and candidates are verified by the
expression itself. A rule without mandatory trigrams is matched on every text.

Defined results: null text counts as empty; repeated rows and null ids give a row each; an empty table
gives no rows; other columns are ignored. A document key is a 64-bit hash: a collision could only add a
candidate, which verification removes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import match_spans
from .trigrams import trigram_query, vocabulary

#: Kind, expression, and for ``assign`` the group whose length must reach the bound.
RULES = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", (2, 8)),
    ("access", r"AKIA[A-Z0-9]{12,}", None),
    ("hex", r"[0-9a-f]{32,}", None),
    ("private", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", None),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", None),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", None),
    ("google", r"AIza[0-9A-Za-z_-]{35}", None),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", None),
)
BASE = ("assign", "access", "hex")
_BITS = 62


def _fold(text: Column) -> Column:
    """Lower case; it may join other letters with ASCII ones, which only adds candidates."""
    return F.lower(text)


def postings(docs: DataFrame, vocab: list[str]) -> DataFrame:
    """The inverted index for the given trigrams: (gram: place in vocab, key); key and text come in."""
    terms = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(t).alias("t")) for i, t in enumerate(vocab)))
    # the folded text is bound once, as the only element of an array
    held = F.transform(F.array(_fold(F.col("text"))), lambda low: F.filter(terms, lambda t: F.contains(low, t["t"])))
    return docs.select("key", F.explode(F.element_at(held, 1)).alias("p")).select(F.col("p.i").alias("gram"), "key")


def candidates(index: DataFrame, queries: dict[int, object], vocab: list[str]) -> DataFrame:
    """(key, rules): rules whose Boolean query the document's postings satisfy."""
    words = range(-(-len(vocab) // _BITS))
    bit = F.expr(f"shiftleft(1L, gram % {_BITS})")
    sets = index.groupBy("key").agg(*(F.bit_or(F.when(F.floor(F.col("gram") / _BITS) == w, bit).otherwise(F.lit(0).cast("long"))).alias(f"m{w}") for w in words))
    place = {t: i for i, t in enumerate(vocab)}

    def test(q) -> Column:
        if isinstance(q, str):
            return F.expr(f"getbit(m{place[q] // _BITS}, {place[q] % _BITS}) = 1")
        parts = [test(p) for p in q[1]]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if q[0] == "and" else out | p
        return out

    rules = F.array_compact(F.array(*(F.when(test(q), F.lit(i)) for i, q in queries.items())))
    return sets.select("key", rules.alias("rules")).filter(F.size("rules") > 0)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """doc_id, text and ``found``: one array of (start, end) per rule, in the order of the rules."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    slim = slim.withColumn("key", F.xxhash64("doc_id", "text"))
    queries = {i: q for i, (_, pattern, _) in enumerate(rules) if (q := trigram_query(pattern)) is not True}
    if queries:
        vocab = sorted(set().union(*map(vocabulary, queries.values())))
        slim = slim.join(candidates(postings(slim, vocab), queries, vocab), "key", "left")
    else:
        slim = slim.withColumn("rules", F.array().cast("array<int>"))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def one(i: int, pattern: str, least) -> Column:
        ok = (lambda m: F.length(F.regexp_extract(m, pattern, least[0])) >= least[1]) if least else None
        spans = match_spans(F.col("text"), pattern, ok)
        return F.when(F.array_contains("rules", i), spans).otherwise(none) if i in queries else spans

    return slim.select("doc_id", "text", *(one(i, pattern, least).alias(kind) for i, (kind, pattern, least) in enumerate(rules)))


def listed(kinds: list[str]) -> Column:
    """kind:start:end of the spans in the columns of that name, by start and then in the order of kinds."""

    def tag(i: int):
        return lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("i"), s["end"].alias("end"))

    tagged = [F.transform(kind, tag(i)) for i, kind in enumerate(kinds)]
    names = F.array(*map(F.lit, kinds))
    ordered = F.array_sort(F.concat(*tagged))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.get(names, s["i"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text")
    return found.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(listed(list(BASE)), 256).alias("base_sha256"),
        listed([r[0] for r in RULES]).alias("spans"),
    )


def _either_case(pattern: str) -> str:
    """(?i) spelled out for ASCII letters only, outside classes and escapes."""
    out, i, body, inside = "", 0, pattern.removeprefix("(?i)"), False
    while i < len(body):
        c = body[i]
        if c == "\\":
            n = 4 if body[i + 1] == "x" else 2
            out, i = out + body[i : i + n], i + n
            continue
        inside = c == "[" or inside and c != "]"
        out += f"[{c.upper()}{c}]" if c.isalpha() and not inside else c
        i += 1
    return out


def _sql() -> str:
    parts = []
    for i, (kind, pattern, least) in enumerate(RULES):
        p = (_either_case(pattern) if pattern.startswith("(?i)") else pattern).replace("'", "''")
        ok = f"length(regexp_extract(m, '{p}', {least[0]})) >= {least[1]}" if least else "true"
        parts.append(
            f"""select doc_id, {i} as k, '{kind}' as kind, b - length(m) as s, b as e from (
            select doc_id, m, sum(length(gap) + length(m)) over (partition by doc_id order by i) as b from (
            select doc_id, unnest(regexp_extract_all(t, '{p}')) as m, unnest(string_split_regex(t, '{p}')) as gap,
                   unnest(range(length(regexp_extract_all(t, '{p}')) + 1)) as i from d where regexp_matches(t, '{p}')))
            where m is not null and {ok}"""
        )
    item = "kind || ':' || s || ':' || e"
    base = f"k < {len(BASE)}"
    counts = ", ".join(f"count(*) filter (k = {i}) as n_{kind}" for i, kind in enumerate(BASE))
    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
found as ({" union all ".join(parts)}),
per as (select doc_id, {counts}, string_agg({item}, ',' order by s, k) filter ({base}) as base,
        string_agg({item}, ',' order by s, k) as spans from found group by doc_id)
select d.doc_id, {", ".join(f"coalesce(n_{k}, 0) as n_{k}" for k in BASE)},
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join per using (doc_id)
"""


OP1_SQL = _sql()
