"""Incremental ingestion: new files in micro-batches, each id once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def ingest(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, key: str = "report_id") -> None:
    """Append what is new in ``source`` (JSON lines) to the Parquet folder ``sink``; resumes at its checkpoint."""

    def add(batch: DataFrame, _: int) -> None:
        fresh = batch.dropDuplicates([key])
        known = spark._jvm.org.apache.hadoop.fs.Path(sink)
        if known.getFileSystem(spark._jsc.hadoopConfiguration()).exists(known):
            fresh = fresh.join(spark.read.parquet(sink).select(key), key, "left_anti")
        fresh.write.mode("append").parquet(sink)

    stream = spark.readStream.schema(schema).json(source).writeStream.foreachBatch(add)
    stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
