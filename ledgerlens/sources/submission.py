"""Answers with their evidence: checked entries, and the package of one JSON file and the evidence tables.

Entries are one row a question and few; the package refuses more than ``MAX_ENTRIES`` of them and takes
table rows from an iterator, so the driver holds one table at a time.
"""

from __future__ import annotations

import csv
import hashlib
import io
import json
import zipfile
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens import config
from ledgerlens.operators.serialize import TIDY

MAX_ENTRIES = 100_000


def entries(questions: DataFrame, ranked: DataFrame, answers: DataFrame, evidence: DataFrame, positions: DataFrame, k: int = config.SUBMISSION_K) -> DataFrame:
    """One row a question: answer, relevant_docs, relevant_tables, evidence, pandas_query and status.

    questions: id, question. ranked: id, rank, report_id, table_pos. answers: id, answer, pandas_query.
    evidence: id, variable, report_id, table_pos. positions: report_id, table_pos, line_no. The first k
    tables count as relevant, evidence tables are appended where they are not among them. status names the
    first failed check: duplicate_id, missing_answer, not_finite, duplicate_variable, unknown_table, else ok.
    """
    c = F.col
    first = ranked.filter(c("rank") <= k).select("id", F.lit(0).alias("kind"), c("rank").alias("at"), F.lit(None).cast("string").alias("variable"), "report_id", "table_pos")
    used = evidence.select("id", F.lit(1).alias("kind"), F.row_number().over(Window.partitionBy("id").orderBy("variable")).alias("at"), "variable", "report_id", "table_pos")
    tables = first.unionByName(used).join(positions.select("report_id", "table_pos", "line_no"), ["report_id", "table_pos"], "left")
    tables = tables.withColumn("ref", F.concat_ws("|", "report_id", c("line_no").cast("string")))
    item = F.struct("kind", "at", "variable", "report_id", "table_pos", "line_no", "ref")
    lists = tables.groupBy("id").agg(F.array_sort(F.collect_list(item)).alias("t"))  # at most k and the variables of a question
    variables = F.filter("t", lambda x: x["kind"] == 1)
    path = lambda x: F.concat(F.lit("data/"), x["report_id"], F.lit("_table_"), x["line_no"].cast("string"), F.lit(".csv"))
    one = answers.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.first("answer").alias("answer"), F.first("pandas_query").alias("pandas_query"))
    df = questions.select("id", "question").join(one, "id", "left").join(lists, "id", "left").withColumn("t", F.coalesce("t", F.array().cast(lists.schema["t"].dataType)))
    status = (
        F.when(c("n") > 1, "duplicate_id")
        .when(c("answer").isNull(), "missing_answer")
        .when(F.isnan("answer") | (F.abs("answer") == float("inf")), "not_finite")
        .when(F.size(F.array_distinct(variables["variable"])) < F.size(variables), "duplicate_variable")
        .when(F.exists("t", lambda x: x["line_no"].isNull()), "unknown_table")
        .otherwise("ok")
    )
    shown = F.transform(variables, lambda x: F.struct(x["variable"].alias("variable"), path(x).alias("csv_path"), x["report_id"].alias("report_id"), x["table_pos"].alias("table_pos")))
    return df.select("id", "question", F.round("answer", 2).alias("answer"), F.array_distinct(c("t")["report_id"]).alias("relevant_docs"), F.array_distinct(c("t")["ref"]).alias("relevant_tables"), shown.alias("evidence"), F.coalesce("pandas_query", F.lit("0.0")).alias("pandas_query"), status.alias("status"))


def package(checked: DataFrame, tidied: DataFrame, path: str, name: str = "results.json") -> dict[str, str]:
    """Write a new ZIP file of the entries and their tables; file names with their SHA-256 come back.

    Nothing is written if an entry is not ok. tidied: report_id, table_pos and the tidy columns.
    """
    bad = checked.filter("status <> 'ok'").select("id", "status").take(10)
    if bad:
        raise ValueError(f"entries fail: {[tuple(r) for r in bad]}")
    rows = checked.drop("status").orderBy("id").take(MAX_ENTRIES + 1)
    if len(rows) > MAX_ENTRIES:
        raise ValueError(f"over {MAX_ENTRIES} entries")
    out = [r.asDict(True) | {"evidence": [{"variable": e["variable"], "csv_path": e["csv_path"]} for e in r["evidence"]]} for r in rows]
    wanted = checked.select(F.explode("evidence").alias("e")).select("e.report_id", "e.table_pos", "e.csv_path").distinct()
    cells = tidied.join(wanted, ["report_id", "table_pos"]).select("csv_path", *TIDY).orderBy("csv_path", "row", "col")
    manifest = {}
    with zipfile.ZipFile(path, "x", zipfile.ZIP_DEFLATED) as z:

        def add(file: str, text: str) -> None:
            z.writestr(file, text)
            manifest[file] = hashlib.sha256(text.encode()).hexdigest()

        add(name, json.dumps(out, ensure_ascii=False, indent=1))
        for file, lines in groupby(cells.toLocalIterator(), lambda r: r["csv_path"]):
            buffer = io.StringIO()
            writer = csv.writer(buffer, lineterminator="\n")
            writer.writerow(TIDY)
            writer.writerows([r[c] for c in TIDY] for r in lines)
            add(file, buffer.getvalue())
    missing = {e["csv_path"] for r in out for e in r["evidence"]} - set(manifest)
    if missing:
        raise ValueError(f"no rows for {sorted(missing)[:10]}")
    return manifest


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """(path, bytes, sha256) of the files under a folder, relative to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split("://")[-1]
    return files.select(F.element_at(F.split("path", base + "/", 2), -1).alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Files that are missing, added or changed: path, status."""
    both = expected.select("path", F.col("sha256").alias("want")).join(found.select("path", F.col("sha256").alias("got")), "path", "full_outer")
    return both.select("path", F.when(F.col("got").isNull(), "missing").when(F.col("want").isNull(), "added").when(F.col("got") != F.col("want"), "changed").alias("status")).filter("status is not null")
