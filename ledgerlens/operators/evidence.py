"""Candidate cuts, cell finders, resolvers, row predicates and traces around the choice of evidence cells."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.fuzzy import ratio
from ledgerlens.functions.text import let, norm, tokens
from ledgerlens.operators.ranking import top_k

#: Candidates of an entity that are scored further: this many times the depth asked for, and at least so many.
CUT_FACTOR, CUT_LEAST = 3, 60
#: A shortlist grows to one place for each fact, but not beyond this.
MOST_FACTS = 24
#: Share of the query's tokens and of the matching characters in a cell finder's score.
OVERLAP, MATCHING = 0.65, 0.35
#: Amounts asked for in millions or more are not below a million.
SANE_FROM = 1e6
#: Rule answers from this confidence on are not asked again, and those below the other count as weak.
RULE_SURE, RULE_WEAK = 90.0, 78.0


def pre_cut(df: DataFrame, by: list[str], score: str, pos: str, depth: int) -> DataFrame:
    """The first max(3 depth, 60) candidates of each group by falling score, ties in their order."""
    return top_k(df, by, [F.desc(score), F.asc(pos)], max(CUT_FACTOR * depth, CUT_LEAST)).drop("rank")


def fact_quota(df: DataFrame, query: str, fact: str, score: str, pos: str, top_n: int) -> DataFrame:
    """A shortlist of n = max(top_n, min(facts, 24)) rows a query: each fact first gets max(1, n / facts), then by score.

    Adds ``place``, the order of the list: by fact, then by score.
    """
    best = [F.desc(score), F.asc(pos)]
    facts = df.groupBy(query).agg(F.count_distinct(fact).alias("facts"))
    n = F.greatest(F.lit(top_n), F.least(F.col("facts"), F.lit(MOST_FACTS)))
    ranked = df.join(facts, query).withColumn("in_fact", F.row_number().over(Window.partitionBy(query, fact).orderBy(*best)))
    reserved = F.col("in_fact") <= F.greatest(F.lit(1), F.floor(n / F.col("facts")))
    # reserved rows of the first facts come first, so that a list that is too short drops the last facts
    order = [F.desc(reserved), F.when(reserved, F.col(fact)).asc_nulls_last(), *best]
    kept = ranked.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(*order))).filter(F.col("rank") <= n)
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(query).orderBy(fact, *best))).drop("facts", "in_fact", "rank")


def magnitude_sane(df: DataFrame, by: str, amount: Column, scale: Column) -> DataFrame:
    """Without amounts under a million where the question asks in millions or more, unless a group would be empty."""
    small = (scale >= SANE_FROM) & F.coalesce(F.abs(amount) < SANE_FROM, F.lit(True))
    w = Window.partitionBy(by)
    kept = df.withColumn("__small", small).withColumn("__all", F.bool_and("__small").over(w))
    return kept.filter("not __small or __all").drop("__small", "__all")


def find_cells(cells: DataFrame, queries: DataFrame, within: list[str], k: int) -> DataFrame:
    """(query, label, score, rank): the k labels of a query's scope (``within``) that score highest.

    score = 0.65 x share of the query's tokens in the label + 0.35 x matching share of the characters. cells:
    within, label; queries: query, within. The matching share is scored once for each distinct pair.
    """
    pairs = queries.select("query", *within).distinct().join(cells.select(*within, "label").distinct(), within).select("query", "label").distinct()
    asked = F.array_distinct(tokens(F.col("query")))
    overlap = F.size(F.array_intersect(asked, tokens(F.col("label")))) / F.greatest(F.size(asked), F.lit(1))
    scored = pairs.withColumn("score", F.round(OVERLAP * overlap + MATCHING * ratio(norm(F.col("query")), norm(F.col("label"))) / 100, 4))
    return top_k(scored, ["query"], [F.desc("score"), F.asc("label")], k)


def exactly_one(df: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``df`` for each wanted key with ``status``: ok, missing or duplicate; other columns only where ok."""
    rest = [c for c in df.columns if c not in keys]
    one = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.any_value(F.struct(*rest)).alias("row"))
    found = wanted.select(*keys).distinct().join(one, keys, "left")
    status = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "duplicate").otherwise("ok")
    return found.select(*keys, status.alias("status"), *(F.when(F.col("n") == 1, F.col("row")[c]).alias(c) for c in rest))


def header_score(header: Column, year: Column, col: Column) -> Column:
    """How well a column's header fits a year: 40 for the year, 30 for this period, -30 for the one before, less to the right."""
    return let(norm(header), lambda plain: _header_score(plain, year, col))


def _header_score(plain: Column, year: Column, col: Column) -> Column:
    named = F.regexp_like(plain, F.concat(F.lit(r"\b"), year.cast("string"), F.lit(r"\b")))
    now, before = plain.rlike("nam nay|cuoi nam"), plain.rlike("nam truoc|dau nam")
    points = F.when(named, 40.0).otherwise(0.0) + F.when(now, 30.0).otherwise(0.0) - F.when(before, 30.0).otherwise(0.0)
    return F.when(~plain.rlike("ma so|thuyet minh"), points - 0.01 * col)


def best_by_row(cells: DataFrame, by: list[str], row: list[str], row_score: str, year: str) -> DataFrame:
    """The best row of each group by label, and in each row the column whose header fits the year best.

    cells: by, row, col_name, col, and the row's label score. Rows of codes and notes have no column.
    """
    fitted = cells.withColumn("header_score", header_score(F.col("col_name"), F.col(year), F.col("col")))
    # null scores come last; a filter before the window would compute each score twice
    columns = top_k(fitted, [*by, *row], [F.desc("header_score"), F.asc("col")], 1).filter("header_score is not null").drop("rank")
    total = columns.withColumn("score", F.round(F.col(row_score) + F.col("header_score"), 4))
    return top_k(total, by, [F.desc("score"), *map(F.asc, row)], 1).drop("rank", "header_score")


#: Wordings by which a cell stands for a metric without support. All words of ``metric`` are asked for;
#: then every clause must hold, each by one of its alternatives (place, words that stand there together). ``rest``: words
#: of the metric but these must be in the label, one at least.
ALIASES = (
    {
        "kind": "foreign_currency_usd",
        "output": "number",
        "metric": ("ngoai", "te", "usd"),
        "clauses": ((("label", "usd"),), (("label", "do la my"), ("context", "ngoai te"))),
    },
    {
        "kind": "ownership_percentage",
        "output": "percent",
        "metric": ("so", "huu"),
        "clauses": ((("header", "ty le"),), (("header", "loi ich"), ("header", "quyen bieu quyet"))),
        "rest": ("so", "huu", "ty", "le", "cua"),
    },
)


def direct_alias(metric: Column, label: Column, header: Column, context: Column, output_type: Column) -> Column:
    """Kind of the first rule of ``ALIASES`` that lets a cell stand for a metric; null if none.

    Words of a label stand in any order, those of a header or context as a phrase.
    """
    asked, there = tokens(metric), tokens(label)
    phrases = {"header": norm(header), "context": norm(context)}

    def all_in(words: Column, needed: tuple[str, ...]) -> Column:
        return F.size(F.array_except(F.array(*map(F.lit, needed)), words)) == 0

    def holds(clause) -> Column:
        return reduce(or_, (all_in(there, tuple(words.split())) if place == "label" else phrases[place].contains(words) for place, words in clause))

    def rule(r: dict) -> Column:
        found = reduce(and_, map(holds, r["clauses"]), (output_type == r["output"]) & all_in(asked, r["metric"]))
        if "rest" in r:
            rest = F.array_except(asked, F.array(*map(F.lit, r["rest"])))
            found &= (F.size(rest) > 0) & (F.size(F.array_except(rest, there)) == 0)
        return F.when(found, r["kind"])

    return F.coalesce(*map(rule, ALIASES))


def placeholder(source: Column, status: Column, answer: Column, written: Column) -> Column:
    """True for the failed answer that is a constant zero: no source, status failed, value 0, and 0 or nothing written."""
    text = F.trim(F.coalesce(written, F.lit("")))
    zero = (text == "") | text.rlike(r"^\(*\s*(0+(\.0*)?|\.0+)([eE][-+]?[0-9]+)?\s*\)*$")
    word = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return (word(source) == "none") & (word(status) == "failed") & (F.coalesce(answer, F.lit(0.0)) == 0) & zero


def still_wanted(target: str, has_rule: Column, confidence: Column, rule_first: bool = False) -> Column:
    """Which questions go to a model: all, those without a rule answer (empty), or also those with a weak one (weak)."""
    sure = F.coalesce(confidence, F.lit(0.0))
    choice = {"all": F.lit(True), "empty": ~has_rule, "weak": ~has_rule | (sure < RULE_WEAK)}[target]
    return choice & (sure < RULE_SURE) if rule_first else choice


def requested_scale(seed: str, *cols: str) -> Column:
    """1, a million or a billion, by the hash of the columns."""
    key = F.sha2(F.concat_ws("|", F.lit("scale"), F.lit(seed), *(F.col(c).cast("string") for c in cols)), 256)
    return F.element_at(F.array(F.lit(1.0), F.lit(1e6), F.lit(1e9)), (F.conv(F.substring(key, 1, 8), 16, 10).cast("long") % 3 + 1).cast("int"))


def bounded_text(text: Column, limit: int) -> Column:
    """Struct preview, chars, cut, sha256: control characters become U+FFFD, at most ``limit`` characters stay."""
    raw = F.coalesce(text, F.lit(""))
    clean = F.regexp_replace(raw, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "�")
    return F.struct(F.substring(clean, 1, limit).alias("preview"), F.length(clean).alias("chars"), (F.length(clean) > limit).alias("cut"), F.sha2(raw, 256).alias("sha256"))


def shortlist_audit(lists: DataFrame, count: str, chars: str, seconds: str, flags: list[str]) -> DataFrame:
    """One row over all shortlists: how many are empty or hold a flag, extremes of prompt size and time."""
    sums = [F.count_if(F.coalesce(F.col(f), F.lit(False))).alias(f) for f in flags]
    spread = [g(F.col(c)).alias(f"{c}_{n}") for c in (chars, seconds) for n, g in (("min", F.min), ("median", F.median), ("max", F.max))]
    return lists.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(count) > 0).alias("nonempty"), F.count_if(F.col(count) == 0).alias("empty"), *sums, *spread, F.round(F.sum(seconds), 3).alias(f"{seconds}_total"))


def dropped_cells(grid_cells: DataFrame, tidy: DataFrame, keys: list[str]) -> DataFrame:
    """tidy and the numeric grid cells that it lacks, without code, in the order of the keys' values."""
    more = grid_cells.join(tidy.select(*keys), keys, "left_anti").withColumn("code", F.lit(""))
    return tidy.withColumn("recovered", F.lit(False)).unionByName(more.withColumn("recovered", F.lit(True)), allowMissingColumns=True)


def ratio_mistakes(items: DataFrame, answer: Column, gold: Column, output_type: Column) -> DataFrame:
    """One row: right answers to 0.01 after rounding, and percentages that were given as ratios (100 times too small)."""
    right = F.abs(F.round(answer, 2) - F.round(gold, 2)) <= 0.01
    as_ratio = output_type.isin("percent", "percentage_point") & ~right & (F.abs(F.round(answer * 100, 2) - F.round(gold, 2)) <= 0.01)
    return items.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(right, F.lit(False))).alias("right"), F.count_if(F.coalesce(as_ratio, F.lit(False))).alias("ratio_mistakes"))
