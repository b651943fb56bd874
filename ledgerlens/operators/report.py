"""Reports to tables in one step: a table function over the text, units that carry on, and a quarantine for what fails.

``register`` gives the function to SQL: ``select r.report_id, t.* from reports r, lateral parse_report(r.text) t``.
A row of it is a table or, with ``problem``, what could not be read: ``empty_report`` (no text), ``no_table``,
``unclosed_table`` (another begins or the text ends before it is closed), ``empty_table`` (no cell). Other tables
of the report are read all the same. ``truncated`` tells that a grid had more rows or columns than the limits.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerlens.functions.numbers import detect_unit
from ledgerlens.functions.text import norm
from ledgerlens.operators.extract import grid_of, sticky_unit
from ledgerlens.operators.ranking import top_k

_MARK = re.compile(r"<(/?)table\b[^>]*>|PAGE\s+(\d+)", re.I)
_TAG = re.compile(r"<[^>]+>")
#: Characters before a table that its context is taken from, and characters of context kept.
_LOOK_BACK, _CONTEXT = 1500, 400
PARSED = "table_pos int, page int, line_no int, context string, grid array<array<string>>, truncated boolean, problem string"


def parse(text: str | None):
    """Rows of ``PARSED``, in the order of the text."""
    if not (text or "").strip():
        yield None, None, None, None, None, False, "empty_report"
        return
    page, line, counted, last, pos, opened = 1, 1, 0, 0, 0, None

    def row(start: int, end: int | None):
        context = " ".join(_TAG.sub(" ", text[max(last, start - _LOOK_BACK) : start]).split())[-_CONTEXT:]
        grid, cut = grid_of(text[start:end]) if end else (None, False)
        return pos, page, line, context, grid or None, cut, "unclosed_table" if end is None else None if grid else "empty_table"

    for m in _MARK.finditer(text):
        if m[2]:
            page = int(m[2]) if opened is None else page
        elif m[1]:
            if opened is not None:
                yield row(opened, m.end())
                pos, last, opened = pos + 1, m.end(), None
        else:
            if opened is not None:
                yield row(opened, None)
                pos += 1
            line += text.count("\n", counted, m.start())
            opened = counted = m.start()
    if opened is not None:
        yield row(opened, None)
        pos += 1
    if not pos:
        yield None, None, None, None, None, False, "no_table"


@F.udtf(returnType=PARSED)
class ParseReport:
    def eval(self, text: str):
        yield from parse(text)


def register(spark: SparkSession, name: str = "parse_report") -> None:
    spark.udtf.register(name, ParseReport)


def parsed_reports(reports: DataFrame, per_ticker: int | None = None) -> DataFrame:
    """Tables of reports (report_id, ticker, text) and, with ``problem``, what could not be read, each report parsed once;
    tables with unit_scale and unit_source: of the context, else of the first row, else carried on.

    ``per_ticker``: so many reports of each ticker, in the order of their ids.
    """
    rows = reports.select("report_id", "ticker", "text")
    rows = rows if per_ticker is None else top_k(rows, ["ticker"], [F.asc("report_id")], per_ticker).drop("rank")
    # dealt by number, which adaptive execution does not gather: parsing is all of the work, and its input is small
    rows = rows.repartition(int(reports.sparkSession.conf.get("spark.sql.shuffle.partitions")), "report_id")
    schema = StructType([*rows.select("report_id", "ticker").schema, *StructType.fromDDL(PARSED)])
    found = rows.mapInArrow(_parsed, schema)
    good = F.col("problem").isNull()
    unit = F.coalesce(detect_unit(norm(F.col("context"))), detect_unit(norm(F.array_join(F.get("grid", F.lit(0)), " "))))
    marked = sticky_unit(found.withColumn("unit_scale", F.when(good, unit)), "report_id", "table_pos")
    return marked.withColumns({c: F.when(good, F.col(c)) for c in ("unit_scale", "unit_source")})


def _parsed(batches):
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            own, out = [], []
            for i, text in enumerate(part.column(2).to_pylist()):
                for row in parse(text):
                    own.append(i)
                    out.append(row)
            cols = zip(*out) if out else [()] * len(_KINDS)
            yield pa.RecordBatch.from_arrays([*(part.column(i).take(pa.array(own, pa.int32())) for i in (0, 1)), *map(pa.array, cols, _KINDS)], names=["report_id", "ticker", *_NAMES])


_NAMES = ["table_pos", "page", "line_no", "context", "grid", "truncated", "problem"]
_KINDS = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.list_(pa.string())), pa.bool_(), pa.string()]


def parse_reports(reports: DataFrame, per_ticker: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(tables, quarantine) of ``parsed_reports``; a caller who reads both has the reports parsed twice."""
    register(reports.sparkSession)
    found = parsed_reports(reports, per_ticker)
    return found.filter("problem is null").drop("problem"), found.filter("problem is not null").select("report_id", "ticker", "table_pos", "problem")
