"""Rule answers from facts and cells, and independent support of a cell by others of nearly the same value."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.numbers import cagr_percent, growth_percent
from ledgerlens.operators.joins import scale
from ledgerlens.sources.shared import shared_folder

_RELATIVE = 1e-9
#: Keys of one value that are paired together.
_LIST = 1024
SOLVED = ("lookup", "sum", "average", "difference", "growth_pct", "cagr", "ratio", "ranking")


def rule_answers(facts: DataFrame, cells: DataFrame) -> DataFrame:
    """(qid, op, answer, status): facts (qid, op, entity, year, metric, role) answered from cells (entity, year, metric, value).

    A fact needs exactly one cell. Facts of a question are rows, so every operation is an aggregate; the
    newest year is the end of a growth, the oldest its base.
    """
    found = facts.join(cells, ["entity", "year", "metric"], "left")
    end, base = F.max_by("value", "year"), F.min_by("value", "year")
    part = lambda role: F.max(F.when(F.col("role") == role, F.col("value")))
    g = found.groupBy("qid", "op").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("value").alias("known"),
        F.count_distinct("entity", "year", "metric", "role").alias("facts"),
        F.sum("value").alias("total"),
        F.max("value").alias("top"),
        end.alias("end"),
        base.alias("base"),
        (F.max("year") - F.min("year")).alias("span"),
        part("numerator").alias("over"),
        part("denominator").alias("under"),
    )
    c = F.col
    value = (
        F.when(c("op").isin("lookup"), F.when(c("facts") == 1, c("total")))
        .when(c("op") == "sum", c("total"))
        .when(c("op") == "average", c("total") / c("known"))
        .when(c("op") == "ranking", c("top"))
        .when(c("op") == "difference", c("end") - c("base"))
        .when(c("op") == "growth_pct", growth_percent(c("base"), c("end")))
        .when(c("op") == "cagr", cagr_percent(c("base"), c("end"), c("span")))
        .when(c("op") == "ratio", F.when(c("under") != 0, c("over") / c("under") * 100))
    )
    complete = (c("known") == c("facts")) & (c("rows") == c("facts"))
    status = F.when(~c("op").isin(*SOLVED), "unsupported").when(~complete, "incomplete").when(value.isNull(), "execution_failed").otherwise("ok")
    out = g.withColumn("status", status).withColumn("answer", F.when(c("status") == "ok", F.round(value, 2) + 0.0))
    return out.select("qid", "op", "answer", "status")


def supports(cells: DataFrame, by: list[str], key: str, value: str) -> DataFrame:
    """(key, other), key < other: pairs of cells of the same group whose values differ by at most max(1, 1e-9 x the larger size).

    Keys of equal values are lists of ``_LIST`` at most. Lists are placed in buckets such that the larger value of a pair is in the bucket
    of the smaller one or the next, so each pair of lists meets once; its keys are paired where they meet, and no pair travels to be
    made distinct. Only keys that have several values, and so may meet more than once, take that way. The lists are written to the
    shared folder, as they are read more than once. Null, NaN and infinite values have no partners.
    """
    v = F.col(value).cast("double")
    rows = cells.select(*by, F.col(key).alias("__k"), v.alias("__v")).filter(F.col("__k").isNotNull() & (F.abs("__v") < F.lit(float("inf"))))
    seen = rows.groupBy(*by, "__k").agg(F.min("__v").alias("__v"), F.max("__v").alias("__w"))
    one = seen.filter("__v = __w").drop("__w")
    several = rows.join(seen.filter("__v < __w").select(*by, "__k"), [*by, "__k"], "left_semi")
    place = Window.partitionBy(*by, "__v").orderBy("__k")
    dealt = one.withColumn("__c", F.floor((F.row_number().over(place) - 1) / _LIST))
    lists = dealt.groupBy(*by, "__v", "__c").agg(F.array_sort(F.collect_list("__k")).alias("__ks"))
    lists = lists.unionByName(several.select(*by, "__v", F.lit(-1).cast("long").alias("__c"), F.array("__k").alias("__ks")))
    folder = shared_folder(cells.sparkSession, "supports")
    lists.withColumn("__at", F.floor(scale(F.col("__v"), _RELATIVE))).write.parquet(folder)
    placed = cells.sparkSession.read.parquet(folder)
    there = placed.select(*by, F.col("__v").alias("__u"), F.col("__c").alias("__d"), F.col("__ks").alias("__os"), "__at")
    beside = placed.withColumn("__at", F.explode(F.array("__at", F.col("__at") + 1)))
    near = F.abs(F.col("__v") - F.col("__u")) <= F.greatest(F.lit(1.0), _RELATIVE * F.greatest(F.abs("__v"), F.abs("__u")))
    same = (F.col("__v") == F.col("__u")) & (F.col("__c") == F.col("__d"))
    upward = (F.col("__v") < F.col("__u")) | ((F.col("__v") == F.col("__u")) & (F.col("__c") <= F.col("__d")))
    met = beside.join(there.hint("merge"), [*by, "__at"]).filter(upward & near)
    # a list meets itself by the keys that follow
    found = lambda df, rest: df.select(*by, F.posexplode("__ks").alias("__i", "__k"), "__os", same.alias("__same")).select(*by, "__k", F.explode(rest).alias("__o"))
    pair = [*by, F.least("__k", "__o").alias(key), F.greatest("__k", "__o").alias("other")]
    once = found(met.filter("__c >= 0 and __d >= 0"), F.when(F.col("__same"), F.slice("__os", F.col("__i") + 2, F.size("__os"))).otherwise(F.col("__os")))
    more = found(met.filter("__c < 0 or __d < 0"), F.col("__os")).filter(F.col("__k") != F.col("__o"))
    return once.select(*pair).unionByName(more.select(*pair).distinct())
