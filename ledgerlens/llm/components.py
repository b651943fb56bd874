"""Connected components by alternating large-star and small-star rounds (published MapReduce scheme).

Each round is two aggregations and joins on (node, neighbour) pairs; the table is written to the shared
folder after each round, so lineage stays short. Only counts come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _least(pairs: DataFrame) -> DataFrame:
    """Smallest neighbour of each u, u itself included."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge; edges has long columns u and v. root: the least node."""
    e = materialize(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(max_rounds):
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        small = large.join(_least(large), "u")
        out = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(small.select("u", F.col("m").alias("v")))
        new = materialize(out.filter("u <> v").distinct(), "edges")
        a = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        b = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(e)  # the new table is read without it
        e = new
        if tuple(a) == tuple(b):
            break
    else:
        raise RuntimeError("components did not settle")
    out = e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    out.working = (e,)
    return out
