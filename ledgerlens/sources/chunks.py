"""Long runs in chunks: each appears whole, under the signature of the run, and is not made twice.

A chunk is written to a staging folder and published by one rename, so a reader sees all of it or nothing, and a
run that was stopped goes on with the chunks that are missing. The folder belongs to one signature (the digest
of the run's parameters): a run with others is refused. What a stopped run has left in staging is never read.
Renames are atomic on HDFS and local folders; on an object store a commit service has to make them so.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.sources.shared import Files


class OtherRun(ValueError):
    """The folder has chunks of a run with other parameters."""


def canonical(value) -> str:
    """One text for equal JSON values, whatever the order of keys; no NaN."""
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"), allow_nan=False)


def signature(parameters: dict) -> str:
    return hashlib.sha256(canonical(parameters).encode()).hexdigest()


def hashed_chunks(df: DataFrame, key: str, n: int) -> dict[str, Callable[[], DataFrame]]:
    """The rows of ``df`` in n chunks by a hash of the key (null keys in one of them); each reads ``df`` again."""
    at = F.pmod(F.xxhash64(key), F.lit(n))
    return {f"chunk-{i:05d}": lambda i=i: df.filter(at == i) for i in range(n)}


class ChunkedRun:
    """``run`` makes and publishes what is missing, ``read`` gives all that is published."""

    def __init__(self, spark: SparkSession, folder: str, parameters: dict):
        self.spark, self.files, self.signature = spark, Files(spark, folder), signature(parameters)
        self.files.write("signature.json", canonical({"signature": self.signature, "parameters": parameters}))  # the first run's stays
        if json.loads(self.files.read("signature.json"))["signature"] != self.signature:
            raise OtherRun(f"{folder} has chunks of other parameters")

    def published(self) -> list[str]:
        return self.files.names("chunks")

    def run(self, chunks: dict[str, Callable[[], DataFrame]]) -> list[str]:
        """Names of the chunks that this call published."""
        done, made = set(self.published()), []
        for name, make in chunks.items():
            if name in done:
                continue
            staged = f"_staging/{name}-{uuid.uuid4().hex}"
            make().write.parquet(f"{self.files.folder}/{staged}")
            if self.files.rename(staged, f"chunks/{name}"):
                made.append(name)
            else:  # another run of the same signature was first
                self.files.remove(staged)
        return made

    def read(self) -> DataFrame:
        """All published chunks, with their name; fails where none is there."""
        return self.spark.read.parquet(*(f"{self.files.folder}/chunks/{n}" for n in self.published()))


def seal(df: DataFrame, columns: list[str], by: list[str] = (), fan: int = 4096) -> DataFrame:
    """by, seal, rows: one digest for the rows of each split, whatever their order and that of columns and JSON keys.

    ``columns`` that hold JSON text are read and written with sorted keys; others are cast. A digest of each row, of the
    sorted digests of each of ``fan`` parts (by the digest itself), and of the parts: no group grows with more than its part.
    """
    text = F.concat_ws("\x1e", *(F.concat(F.lit(f"{c}\x1f"), F.coalesce(_canonical_column(F.col(c).cast("string")), F.lit("\x00"))) for c in sorted(columns)))
    rows = df.select(*by, F.sha2(text, 256).alias("d")).withColumn("part", F.pmod(F.conv(F.substring("d", 1, 8), 16, 10).cast("long"), F.lit(fan)))
    parts = rows.groupBy(*by, "part").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ""), 256).alias("p"), F.count(F.lit(1)).alias("n"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "p"))), lambda x: x["p"]), "")
    return parts.groupBy(*by).agg(F.sha2(joined, 256).alias("seal"), F.sum("n").alias("rows"))


def _canonical_column(text: Column) -> Column:
    """JSON objects and lists with sorted keys; other texts as they are."""
    return F.when(text.rlike(r"^\s*[\[{]"), F.coalesce(F.to_json(F.try_parse_json(text)), text)).otherwise(text)
