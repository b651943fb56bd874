"""Join shapes: tiers with fallback, bands, as-of, overlays, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tiered(df: DataFrame, by: list[str], tier: Column) -> DataFrame:
    """Rows of the lowest tier that each group has."""
    t = df.withColumn("tier", tier).filter("tier is not null")
    return t.withColumn("least", F.min("tier").over(Window.partitionBy(*by))).filter("tier = least").drop("least")


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """Last right value at or before each left place: one sort of both sides, no join."""
    l_ = left.withColumn("__side", F.lit(1)).withColumn(value, F.lit(None).cast(dict(right.dtypes)[value]))
    r_ = right.select(*by, at, value).withColumn("__side", F.lit(0))
    w = Window.partitionBy(*by).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = l_.unionByName(r_, allowMissingColumns=True)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(w)).filter("__side = 1").drop("__side")


def overlay(primary: DataFrame, fallback: DataFrame, key: str, columns: list[str], replace: Column) -> DataFrame:
    """Columns of the fallback where ``replace`` holds and it has the key; all rows of the primary stay."""
    f = fallback.select(key, *(F.col(c).alias(f"__{c}") for c in columns), F.lit(True).alias("__has"))
    joined = primary.join(f, key, "left").withColumn("__use", F.coalesce(replace & F.col("__has"), F.lit(False)))
    for c in columns:
        joined = joined.withColumn(c, F.when(F.col("__use"), F.col(f"__{c}")).otherwise(F.col(c)))
    return joined.drop(*(f"__{c}" for c in columns), "__has", "__use")


def universe_gate(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: keys that only one side has, and keys of both."""
    a, b = left.select(key).distinct().withColumn("l", F.lit(1)), right.select(key).distinct().withColumn("r", F.lit(1))
    both = a.join(b, key, "full_outer")
    return both.agg(F.count_if(F.col("r").isNull()).alias("only_left"), F.count_if(F.col("l").isNull()).alias("only_right"), F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("in_both"))


def close_values(a: Column, b: Column, relative: float = 1e-9) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(1.0), relative * F.abs(b))


def scale(value: Column, relative: float) -> Column:
    """A scale on which values that differ by at most max(1, relative x the larger size) are less than 1 apart."""
    size, flat = F.abs(value), 1.0 / relative
    # slope 1/2 where the bound is 1, and 1 / (2 relative x) beyond: over a pair the scale moves under 0.6
    return F.signum(value) * F.when(size <= flat, size / 2).otherwise(flat / 2 + F.log(F.greatest(size, F.lit(flat)) / flat) / (2 * relative))


def near_pairs(df: DataFrame, by: list[str], key: str, value: str, relative: float) -> DataFrame:
    """(key, other), key < other: pairs of a group whose values differ by at most max(1, relative x |value of other|).

    relative is below 0.1. Values are placed on a scale on which such a pair is less than 1 apart: linear
    up to 1 / relative, logarithmic beyond. Each value meets its own bucket of the scale and the two beside
    it, so no pair is lost and none is compared outside its buckets. Null values have no partners.
    """
    place = scale(F.col(value), relative)
    rows = df.select(*by, key, value, F.floor(place).alias("__at")).filter(F.col(value).isNotNull())
    asked = rows.withColumn("__at", F.explode(F.array(*(F.col("__at") + i for i in (-1, 0, 1)))))
    there = rows.select(*by, F.col(key).alias("other"), F.col(value).alias("__v"), "__at")
    hits = asked.join(there, [*by, "__at"]).filter((F.col(key) < F.col("other")) & close_values(F.col(value), F.col("__v"), relative))
    return hits.select(key, "other")


def near_values(df: DataFrame, by: list[str], value: str, relative: float) -> DataFrame:
    """by, value, other, value < other: different values of a group that differ by at most max(1, relative x the larger size).

    Equal values are one, so however many rows have a value, it takes part once; relative is below 0.1.
    """
    one = df.filter(F.col(value).isNotNull() & ~F.isnan(value)).select(*by, F.col(value).alias("__a")).distinct().withColumn("__at", F.floor(scale(F.col("__a"), relative)))
    # a larger value is in the same bucket or the next
    asked = one.withColumn("__at", F.explode(F.array(F.col("__at"), F.col("__at") + 1)))
    hits = asked.join(one.withColumnRenamed("__a", "other"), [*by, "__at"]).filter(F.col("__a") < F.col("other"))
    near = F.col("other") - F.col("__a") <= F.greatest(F.lit(1.0), relative * F.greatest(F.abs("__a"), F.abs("other")))
    return hits.filter(near).select(*by, F.col("__a").alias(value), "other")


def near_classes(df: DataFrame, by: list[str], key: str, value: str, relative: float) -> DataFrame:
    """by, key, class_id, class_size, n_near, rows_near: each row with its class of equal values and what is near it in its group.

    ``class_id`` is the smallest key of the class, ``n_near`` counts the other classes that ``near_values`` links to it and
    ``rows_near`` their rows. The links are those of values, so copies are never expanded into pairs. Rows without a value
    (null or NaN) are left out; rows with a null in ``by`` have no partners.
    """
    kept = df.filter(F.col(value).isNotNull() & ~F.isnan(value)).select(*by, key, F.col(value).alias("__v"))
    of = kept.groupBy(*by, "__v").agg(F.min(key).alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    links = near_values(kept, by, "__v", relative)
    both = links.unionByName(links.select(*by, F.col("other").alias("__v"), F.col("__v").alias("other")))
    sized = of.select(*by, F.col("__v").alias("other"), F.col("class_size").alias("__n"))
    near = both.join(sized, [*by, "other"]).groupBy(*by, "__v").agg(F.count(F.lit(1)).alias("n_near"), F.sum("__n").alias("rows_near"))
    a, n, k = of.alias("a"), near.alias("n"), kept.alias("k")
    same = lambda x, y: [F.col(f"{x}.{c}").eqNullSafe(F.col(f"{y}.{c}")) for c in (*by, "__v")]
    counted = a.join(n, same("a", "n"), "left").select("a.*", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.coalesce("rows_near", F.lit(0)).alias("rows_near")).alias("c")
    return k.join(counted, same("k", "c")).select(*(f"k.{c}" for c in by), f"k.{key}", "class_id", "class_size", "n_near", "rows_near")


def upsert(previous: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` replace those of the same key."""
    return previous.join(new.select(key).distinct(), key, "left_anti").unionByName(new)
