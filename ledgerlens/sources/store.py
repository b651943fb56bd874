"""Sources and sinks of the report store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators.joins import upsert


def scan_reports(spark: SparkSession, root: str, entities: list[str] | None = None) -> DataFrame:
    """Whole text files <entity>/<year>/<report>/*_extracted.txt with their path metadata."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*_extracted.txt").withColumn("path", F.input_file_name())
    parts = F.split("path", "/")
    name = F.lower(F.element_at(parts, -1))
    kind = F.when(name.rlike("(?:^|_)separate(?:_|$)"), "separate").when(name.rlike("(?:^|_)consolidated(?:_|$)"), "consolidated").when(name.rlike("(?:^|_)aggregated(?:_|$)"), "aggregated").otherwise("other")
    out = files.select(F.element_at(parts, -2).alias("report_id"), F.upper(F.element_at(parts, -4)).alias("ticker"), F.element_at(parts, -3).try_cast("int").alias("year"), kind.alias("doc_type"), "path", F.col("value").alias("text"))
    return out.filter(F.col("ticker").isin([e.upper() for e in entities])) if entities else out


def write_store(df: DataFrame, path: str, by: str = "ticker") -> None:
    """Parquet, one folder for each entity, so that filters on it prune; refuses to overwrite."""
    df.repartition(by).write.mode("errorifexists").partitionBy(by).parquet(path)


def read_store(spark: SparkSession, path: str, entities: list[str] | None = None, reports: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    if entities:
        df = df.filter(F.col("ticker").isin(entities))
    return df.filter(F.col("report_id").isin(reports)) if reports else df


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


TIDY_SCHEMA = "row int, label string, code string, col int, col_name string, value double, unit_scale double"


def read_companies(spark: SparkSession, path: str) -> DataFrame:
    """(ticker, name): the first two columns of a CSV file with a header, by place."""
    df = spark.read.csv(path, header=True)
    return df.select(F.upper(F.trim(df.columns[0])).alias("ticker"), F.trim(df.columns[1]).alias("name"))


def read_tidy(spark: SparkSession, path: str) -> DataFrame:
    """A tidy table as written by the package: an empty label is null, codes stay text without ".0"."""
    df = spark.read.schema(TIDY_SCHEMA).csv(path, header=True)
    return df.withColumn("code", F.regexp_replace("code", r"\.0$", ""))


def unique_by(df: DataFrame, key: str) -> DataFrame:
    """Rows with a status: ok, missing or duplicate key."""
    n = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    status = F.when(F.col(key).isNull(), "missing").when(F.col("n") > 1, "duplicate").otherwise("ok")
    return n.select(key, "n", status.alias("status"))


__all__ = ["scan_reports", "write_store", "read_store", "read_jsonl", "read_companies", "read_tidy", "unique_by", "upsert"]
