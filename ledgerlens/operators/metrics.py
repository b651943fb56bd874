"""Evaluation operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def f2(predicted: Column, gold: Column) -> Column:
    """5pr / (4p + r) of two sets; 0 without hits."""
    hits = F.size(F.array_intersect(predicted, gold))
    p, r = hits / F.greatest(F.size(predicted), F.lit(1)), hits / F.greatest(F.size(gold), F.lit(1))
    return F.when(hits > 0, 5 * p * r / (4 * p + r)).otherwise(0.0)


def vote(df: DataFrame, by: str, answer: str, pos: str) -> DataFrame:
    """Most frequent answer (two decimals); ties go to the one seen first."""
    counted = df.groupBy(by, F.round(answer, 2).alias("answer")).agg(F.count(F.lit(1)).alias("votes"), F.min(pos).alias("first"))
    return counted.groupBy(by).agg(F.max_by("answer", F.struct(F.col("votes"), (-F.col("first")).alias("f"))).alias("answer"), F.max("votes").alias("votes"))


def consensus(df: DataFrame, by: str, key: Column) -> DataFrame:
    """Groups whose rows all fall into one cluster."""
    return df.groupBy(by).agg(F.count_distinct(key).alias("clusters"), F.count(F.lit(1)).alias("support"), F.min(key).alias("value")).filter("clusters = 1").drop("clusters")


def arbitrate(rule: Column, rule_confidence: Column, model: Column, same: Column, trust: float = 78.0) -> Column:
    """Which answer wins: the only one, both if they agree, the rule if it is trusted, else the model."""
    return F.when(rule.isNull() & model.isNull(), "none").when(model.isNull(), "rule").when(rule.isNull(), "model").when(same, "agree").when(rule_confidence >= trust, "rule").otherwise("model")


def guard(value: Column, kind: Column) -> Column:
    """ok or the reason why an answer of this output type is not plausible."""
    limit = F.when(kind == "percent", 1e6).when(kind == "percentage_point", 1e4).when(kind == "ratio", 1e6)
    return F.when(value.isNull() | F.isnan(value), "missing").when(kind.isin("year", "count") & (value != F.floor(value)), "not_integer").when(F.abs(value) > limit, "out_of_range").when((kind == "percent") & (value > 0) & (value <= 1), "looks_like_ratio").otherwise("ok")


def post_stratified(items: DataFrame, population: DataFrame, stratum: str, flags: list[str]) -> DataFrame:
    """One row: rates of the flags weighted by the population (stratum, population) of the strata that occur.

    represented is the share of the population in those strata, missing the number of strata without items.
    """
    rates = items.groupBy(stratum).agg(*(F.avg(F.coalesce(F.col(f), F.lit(False)).cast("int")).alias(f) for f in flags), F.count(F.lit(1)).alias("__n"))
    both = population.join(rates, stratum, "left")
    there = F.sum(F.when(F.col("__n").isNotNull(), F.col("population")))
    weighted = [F.round(F.try_divide(F.sum(F.col(f) * F.col("population")), there), 6).alias(f) for f in flags]
    return both.agg(*weighted, F.round(F.try_divide(there, F.sum("population")), 6).alias("represented"), F.count_if(F.col("__n").isNull()).alias("missing"))


def acceptance(items: DataFrame, accepted: Column, cell_right: Column, answer_right: Column) -> DataFrame:
    """One row: n, coverage, accuracy of cells and answers over all rows, precision of what was accepted."""
    share = lambda x: F.avg(F.coalesce(x, F.lit(False)).cast("int"))
    precision = F.try_divide(F.count_if(accepted & answer_right).cast("double"), F.count_if(accepted).cast("double"))
    return items.agg(F.count(F.lit(1)).alias("n"), F.round(share(accepted), 6).alias("coverage"), F.round(share(accepted & cell_right), 6).alias("cell_accuracy"), F.round(share(accepted & answer_right), 6).alias("answer_accuracy"), F.round(F.coalesce(precision, F.lit(0.0)), 6).alias("precision"))


def describe_answers(items: DataFrame, by: str, answer: str) -> DataFrame:
    """Counts, extremes, mean, exact median, and numbers of negative and zero answers of each kind."""
    a = F.col(answer)
    return items.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.min(a).alias("low"), F.max(a).alias("high"), F.round(F.avg(a), 4).alias("mean"), F.median(a).alias("middle"), F.count_if(a < 0).alias("negative"), F.count_if(a == 0).alias("zero"))


def mask_audit(output: DataFrame, universe: DataFrame, mask: DataFrame, key: str, attempted: Column) -> DataFrame:
    """(key, problem): ids that are missing, unknown, repeated, or attempted outside the mask; empty if all is well."""
    n = output.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max(F.coalesce(attempted, F.lit(False))).alias("tried"))
    known = universe.select(key).distinct().withColumn("known", F.lit(True))
    allowed = mask.select(key).distinct().withColumn("allowed", F.lit(True))
    both = known.join(n, key, "full_outer").join(allowed, key, "left")
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("known").isNull(), "unknown").when(F.col("n") > 1, "repeated").when(F.col("tried") & F.col("allowed").isNull(), "outside_mask")
    return both.select(key, problem.alias("problem")).filter("problem is not null")


def weakest_link(facts: DataFrame, by: str, score: str, year_sure: str, cell: list[str]) -> DataFrame:
    """(by, confidence): the least score of a group's facts, +8 if all years are sure, else -10, within 0 to 99.

    Facts that share a cell hold it to 35; a fact without a score makes it 0.
    """
    key = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cell))
    g = facts.groupBy(by).agg(F.min(score).alias("s"), F.bool_and(F.coalesce(F.col(year_sure), F.lit(False))).alias("sure"), (F.count(F.lit(1)) > F.count_distinct(key)).alias("shared"), F.count_if(F.col(score).isNull()).alias("lost"))
    c = F.least(F.lit(99.0), F.col("s") + F.when(F.col("sure"), 8.0).otherwise(-10.0))
    c = F.when(F.col("shared"), F.least(c, F.lit(35.0))).otherwise(c)
    return g.select(by, F.when(F.col("lost") > 0, 0.0).otherwise(F.greatest(c, F.lit(0.0))).alias("confidence"))
