"""A store bucketed and sorted by one key: lookups read one bucket, joins of two such tables move no rows.

The key is the key columns as one string, for Spark prunes buckets by one column only. Each bucket is one file
sorted by the key, so row groups prune within it; a merge join still sorts each bucket, as Spark does not trust the
order of files. ``store.json`` beside the files has what a session needs to open the table again
(a catalog need not outlive the session).

Null key columns are empty in the key, so a row with one is found by an empty string there.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.sources.shared import Files

KEY = "store_key"
_BETWEEN = "\x1f"


def key_of(*columns: str) -> Column:
    """The key columns as one string; their ends are told apart by a character that is taken out of them."""
    return F.concat_ws(_BETWEEN, *(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(_BETWEEN), F.lit("")) for c in columns))


class BucketedStore:
    """``write`` makes a store, ``BucketedStore(spark, folder)`` opens one."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        about = json.loads(Files(spark, folder).read("store.json"))
        self.keys, self.buckets = about["keys"], about["buckets"]
        self.name = f"store_{uuid.uuid4().hex}"
        spark.sql(f"create table {self.name} ({about['schema']}) using parquet clustered by ({KEY}) sorted by ({KEY}) into {self.buckets} buckets location '{self.folder}/rows'")

    @classmethod
    def write(cls, df: DataFrame, folder: str, keys: list[str], buckets: int) -> "BucketedStore":
        """Refuses a folder that has a store."""
        spark, files = df.sparkSession, Files(df.sparkSession, folder)
        rows = df.withColumn(KEY, key_of(*keys))
        temporary = f"store_{uuid.uuid4().hex}"
        # dealt as it will be bucketed: one task, so one file, for each bucket
        rows.repartition(buckets, KEY).write.mode("errorifexists").option("path", f"{files.folder}/rows").bucketBy(buckets, KEY).sortBy(KEY).format("parquet").saveAsTable(temporary)
        spark.sql(f"drop table {temporary}")  # the rows stay: the table is external
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        if not files.write("store.json", json.dumps({"keys": keys, "buckets": buckets, "schema": schema})):
            raise ValueError(f"{folder} has a store")
        return cls(spark, folder)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def lookup(self, *values) -> DataFrame:
        """Rows of one key: one bucket is read, and of it what its row groups cannot rule out."""
        key = _BETWEEN.join("" if v is None else str(v).replace(_BETWEEN, "") for v in values)
        return self.table().filter(F.col(KEY) == key).drop(KEY)

    def join(self, other: DataFrame, how: str = "inner") -> DataFrame:
        """Rows of ``other`` (with the key columns, or of a store of as many buckets) with those of the store of the same key.

        A merge join of the buckets as they are: only ``other`` is dealt, where it is not bucketed like the store.
        """
        mine = self.table().drop(*(c for c in self.keys if c in other.columns))
        other = other if KEY in other.columns else other.withColumn(KEY, key_of(*self.keys)).repartition(self.buckets, KEY)
        return other.join(mine.hint("merge"), KEY, how).drop(KEY)

    def close(self) -> None:
        """Forget the table; the folder stays."""
        self.spark.sql(f"drop table if exists {self.name}")
