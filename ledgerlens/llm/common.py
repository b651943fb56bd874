"""Shared plumbing of the corpus operators: shared folder, written tables, row keys, spans."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Internal row key. It is the document id where that is unique, else a number in the same order.
RID = "__rid"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, local mode gets a fresh one; a cluster fails."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerlens-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.folder = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``materialize`` that no frame still to be read, nor its recovery, can ask for."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(batches, rows: int = 256):
    """Slices of Arrow batches: what is made of whole texts at a time must fit a Python worker."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(RID, id, text) with a unique RID that orders rows as their ids do.

    Ids that are null, repeated or not integers are numbered once, in (id, text) order, nulls first,
    and written to the shared folder, so that later reads see the same numbers.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if dict(docs.dtypes)[id_col] in ("bigint", "int", "smallint", "tinyint"):
        n, distinct = slim.agg(F.count(F.lit(1)), F.countDistinct("doc_id")).first()
        if n == distinct:
            return slim.select(F.col("doc_id").cast("long").alias(RID), F.col("doc_id").cast("long"), "text")
    # the draw lets equal rows, such as null ids with null texts, fall in several ranges
    numbered = slim.orderBy("doc_id", "text", F.rand(0)).select(F.monotonically_increasing_id().alias(RID), "doc_id", "text")
    return materialize(numbered, "keyed")


def unsent(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that Spark must not broadcast, though it may seem small.

    Spark takes the size of files and of what comes before an explode for that of the rows.
    """
    return df.hint("merge")


def n_parts(rows: int, per: int, least: int = 1) -> int:
    """How many partitions or shards hold ``rows`` at ``per`` rows each."""
    return max(least, -(-rows // per))


def packed(rows: DataFrame, *others: str) -> DataFrame:
    """rows with ``text`` as a compressed UTF-8 binary ``z`` (null stays null): what text joins shuffle."""
    names = [*others, "z"]

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=3)
        for b in small(batches):
            z = [t if t is None else squeeze.compress(t) for t in b.column(len(others)).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(others)], pa.array(z, pa.binary())], names=names)

    slim = rows.select(*others, "text")
    return slim.mapInArrow(run, slim.select(*others).schema.add("z", "binary"))


def unpacked(column) -> list[bytes]:
    """Texts of an Arrow column that ``packed`` made, null as empty."""
    expand = zstandard.ZstdDecompressor()
    return [b"" if z is None else expand.decompress(z) for z in column.to_pylist()]


def window_argmin(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of each ``width`` consecutive values (uint64), by their high 40 bits, leftmost on ties.

    Fewer than 2^24 values at a time.
    """
    n = len(h)
    low = np.uint64((1 << 24) - 1)
    padded = np.full(-(-n // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = (h & ~low) | np.arange(n, dtype=np.uint64)
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - width + 1], ahead[width - 1 : n])
    return (least & low).astype(np.int64)


def match_spans(text: Column, pattern: str, ok=None) -> Column:
    """Native ``array<struct<start,end>>`` of leftmost non-overlapping matches, in code points.

    ``ok(match)`` drops matches without retrying inside them. Offsets are prefix sums over the pieces
    between matches; they are summed in chunks of 256 so that the work stays linear in the text.
    """
    keep = ok or (lambda m: F.lit(True))
    chunk = 256
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.zip_with(
        F.transform(pieces, F.length),
        F.transform(found, lambda m: F.struct(F.length(m).alias("n"), keep(m).alias("ok"))),
        lambda gap, m: F.struct(gap.alias("gap"), F.coalesce(m["n"], F.lit(0)).alias("n"), F.coalesce(m["ok"], F.lit(False)).alias("ok")),
    )
    none = F.array().cast("array<struct<start:int,end:int>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        span = F.struct(start.alias("start"), (start + x["n"]).alias("end"))
        return F.struct((start + x["n"]).alias("at"), F.when(x["ok"], F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    def chunked(xs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(1), F.greatest(F.size(xs), F.lit(1)), F.lit(chunk)), lambda i: F.slice(xs, i, chunk))
        local = F.transform(blocks, lambda b: F.aggregate(b, F.struct(F.lit(0).alias("at"), none.alias("out")), step))
        moved = F.aggregate(
            local,
            F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,end:int>>>").alias("out")),
            lambda acc, b: F.struct(
                (acc["at"] + b["at"]).alias("at"),
                F.when(
                    F.size(b["out"]) > 0,
                    F.concat(acc["out"], F.array(F.transform(b["out"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), (s["end"] + acc["at"]).alias("end"))))),
                ).otherwise(acc["out"]).alias("out"),
            ),
            lambda acc: F.flatten(acc["out"]),
        )
        return moved

    # most texts have no match: one cheap test skips the arrays
    return F.when(text.rlike(pattern), chunked(parts)).otherwise(none)
