"""Tables as tidy rows, as text for retrieval, and as distinct labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.numbers import parse_number
from ledgerlens.functions.text import tokens

TIDY = ("row", "label", "code", "col", "col_name", "value", "unit_scale")


def tidy(cells: DataFrame) -> DataFrame:
    """Cells with the keys of their table and the seven tidy columns; a missing scale counts as 1."""
    keys = [c for c in ("report_id", "table_pos", "doc_key") if c in cells.columns]
    scale = F.coalesce("unit_scale", F.lit(1.0)) if "unit_scale" in cells.columns else F.lit(1.0)
    code = F.col("row_code") if "row_code" in cells.columns else F.col("code")
    return cells.withColumn("code", code).withColumn("unit_scale", scale).select(*keys, *TIDY)


def with_dropped_cells(tidied: DataFrame, grids: DataFrame, keys: list[str]) -> DataFrame:
    """Tidy rows and, with an empty code, the numeric grid cells (keys, grid) that the unpivot took for codes."""
    rows = grids.select(*keys, F.get("grid", F.lit(0)).alias("header"), F.posexplode("grid").alias("row", "texts"))
    flat = rows.select(*keys, "row", F.get("texts", F.lit(0)).alias("label"), "header", F.posexplode("texts").alias("col", "text"))
    value = parse_number(F.col("text"))
    more = flat.select(*keys, "row", "label", F.lit("").alias("code"), "col", F.coalesce(F.get("header", F.col("col")), F.lit("")).alias("col_name"), value.alias("value"), F.lit(1.0).alias("unit_scale")).filter("value is not null")
    return tidied.unionByName(more.join(tidied.select(*keys, "row", "col"), [*keys, "row", "col"], "left_anti"))


def table_terms(tables: DataFrame, cells: DataFrame, keys: list[str], context_chars: int = 250, headers: int = 12, labels: int = 60) -> DataFrame:
    """(keys, terms): tokens of the end of the context, the first headers and the first distinct row labels of a table.

    The limits are part of the retrieval document's definition; labels are cut before they are gathered,
    so no table gathers more than ``labels`` of them.
    """
    first = cells.filter("label <> ''").groupBy(*keys, "label").agg(F.min("row").alias("row"))
    named = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("row", "label"))).alias("found"))  # a grid has at most 600 rows
    named = named.select(*keys, F.slice("found", 1, labels)["label"].alias("labels"))
    words = F.concat(F.array(F.substring(F.coalesce("context", F.lit("")), -context_chars, context_chars)), F.slice(F.coalesce(F.get("grid", F.lit(0)), F.array().cast("array<string>")), 1, headers), F.coalesce("labels", F.array().cast("array<string>")))
    return tables.join(named, keys, "left").select(*keys, tokens(F.array_join(words, " ")).alias("terms"))


def label_vocabulary(grids: DataFrame) -> DataFrame:
    """Distinct labels: the first of a row's three leading cells that is text of over three characters, cut at 160."""
    rows = grids.select(F.explode("grid").alias("texts"))
    texts = F.filter(F.slice("texts", 1, 3), lambda x: (F.length(F.trim(x)) > 3) & ~F.trim(x).rlike("^[0-9]+$"))
    return rows.select(F.substring(F.trim(F.get(texts, F.lit(0))), 1, 160).alias("label")).filter("label is not null").distinct()


def numbered_variables(ranked: DataFrame) -> DataFrame:
    """Names df1, df2, ... by retrieval rank: the same table keeps its name when more are taken."""
    return ranked.withColumn("variable", F.concat(F.lit("df"), F.col("rank").cast("string")))
