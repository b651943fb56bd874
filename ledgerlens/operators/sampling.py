"""Deterministic sampling: hash order, hash splits, largest-remainder quotas with a reserve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_key(seed: str, *cols: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(seed), *(F.col(c).cast("string") for c in cols)), 256)


def hash_percent(seed: str, *cols: str) -> Column:
    """0..99 from the first eight hex digits."""
    return F.conv(F.substring(hash_key(seed, *cols), 1, 8), 16, 10).cast("long") % 100


def quota_sample(df: DataFrame, stratum: str, key: str, quota, seed: str) -> DataFrame:
    w = Window.partitionBy(stratum).orderBy(hash_key(seed, stratum, key), key)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= quota)


def allocate(counts: DataFrame, stratum: str, size: str, total: int) -> DataFrame:
    """Quotas that add up to ``total`` and stay within the strata. One row a stratum.

    Each stratum that is not empty gets one where ``total`` reaches for all; the rest goes by largest remainder
    over the capacity left: floors of the shares, then one each by fraction, then by name. Shares are whole
    numbers and remainders of divisions, so ties are exact. Fails if ``total`` exceeds the population.
    """
    if total < 0:
        raise ValueError(f"cannot allocate {total} rows")
    everyone, c = Window.partitionBy(), F.col
    n = F.coalesce(F.greatest(c(size), F.lit(0)), F.lit(0)).cast("long")
    df = counts.withColumn("n_", n).withColumn("all_", F.sum("n_").over(everyone)).withColumn("kinds_", F.count_if(c("n_") > 0).over(everyone))
    df = df.withColumn("base_", ((c("n_") > 0) & (c("kinds_") <= total)).cast("long")).withColumn("cap_", c("n_") - c("base_"))
    df = df.withColumn("rest_", F.lit(total).cast("long") - F.sum("base_").over(everyone)).withColumn("caps_", F.greatest(F.sum("cap_").over(everyone), F.lit(1)))
    df = df.withColumn("part_", c("rest_") * c("cap_") % c("caps_")).withColumn("floor_", F.expr("(rest_ * cap_) div caps_"))
    # fewer are left than strata with a fraction, and each of those has room for one more
    left = c("rest_") - F.sum("floor_").over(everyone)
    rank = F.row_number().over(Window.orderBy(F.desc("part_"), stratum))
    quota = c("base_") + c("floor_") + (rank <= left).cast("long")
    too_many = F.raise_error(F.concat(F.lit(f"cannot allocate {total} rows from population "), c("all_").cast("string"))).cast("long")
    return df.withColumn("quota", F.when(c("all_") < total, too_many).otherwise(quota)).select(*counts.columns, "quota")
