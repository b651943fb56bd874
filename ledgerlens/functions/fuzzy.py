"""Fuzzy scores that SQL cannot express: Arrow batches, after a native block on shared tokens."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ledgerlens.functions.text import coverage, norm, tokens


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching share of two strings, 0 to 100."""
    return pd.Series([100 * SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)], dtype=float)


def _sorted(text: Column, distinct: bool) -> Column:
    words = tokens(text)
    return F.array_join(F.array_sort(F.array_distinct(words) if distinct else words), " ")


def sorted_words(text: Column) -> Column:
    """The distinct words of a text, sorted, with a blank between."""
    return _sorted(text, True)


def token_set_ratio(a: Column, b: Column) -> Column:
    return ratio(_sorted(a, True), _sorted(b, True))


def label_score(label: Column, metric: Column) -> Column:
    """60 x coverage of the metric's tokens + 0.4 x ratio of the sorted tokens."""
    return 60 * coverage(label, metric) + 0.4 * ratio(_sorted(label, False), _sorted(metric, False))


def similar_labels(labels: DataFrame, metrics: DataFrame, threshold: float = 62.0) -> DataFrame:
    """label x metric pairs that reach the threshold.

    The ratio adds at most 40, so of a metric's n tokens a pair shares m = ceil(n (threshold - 40) / 60) or more,
    and any n - m + 1 of them meet every such label: the rarest ones are joined, so a token that most
    labels have joins nothing unless it is needed. Only pairs whose coverage suffices are scored in Python.
    """
    least = max((threshold - 40) / 60, 1e-9)
    c = F.col
    a = labels.select("label", F.array_distinct(tokens(c("label"))).alias("have")).distinct()
    each = a.select("label", "have", F.explode("have").alias("token"))
    common = each.groupBy("token").agg(F.count(F.lit(1)).alias("labels"))
    b = metrics.select("metric", F.array_distinct(tokens(c("metric"))).alias("want")).distinct()
    asked = b.select("metric", "want", F.explode("want").alias("token")).join(common, "token")  # tokens of no label join nothing
    rare = F.row_number().over(Window.partitionBy("metric").orderBy("labels", "token"))
    missing = F.size("want") - F.count(F.lit(1)).over(Window.partitionBy("metric"))  # of the rarest, these are gone already
    needed = F.size("want") - F.ceil(least * F.size("want") - 1e-9) + 1 - missing
    asked = asked.withColumn("rare", rare).withColumn("needed", needed).filter("rare <= needed").select("metric", "want", "token")
    pairs = each.join(asked, "token").select("label", "metric", "have", "want").distinct()
    shared = F.size(F.array_intersect("have", "want")) / F.size("want")
    # the ratio is at most 2 min / (a + b) of the lengths: exact, and cheaper than the ratio
    m, n = (F.length(_sorted(c(x), False)) for x in ("label", "metric"))
    pairs = pairs.filter((shared >= least - 1e-9) & (60 * shared + 80 * F.least(m, n) / F.greatest(m + n, F.lit(1)) >= threshold))
    return pairs.withColumn("score", label_score(c("label"), c("metric"))).filter(c("score") >= threshold).select("label", "metric", "score")


def partial_ratio(a: Column, b: Column) -> Column:
    """Matching share of two normalised strings; the whole strings, in spite of the name."""
    return ratio(norm(a), norm(b))


#: Which scorer the numbers come from: kept with results that are compared later.
SCORER = {"name": "difflib.SequenceMatcher", "autojunk": True, "version": 1}
