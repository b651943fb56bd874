"""Tables inside documents: scan, grid, cells, sticky units."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.numbers import parse_number, year_like

_TABLE = re.compile(r"<table\b.*?</table\s*>", re.I | re.S)
_PAGE = re.compile(r"PAGE\s+(\d+)", re.I)
_TAG = re.compile(r"<[^>]+>")
TABLE_SCHEMA = "doc_key string, table_pos int, page int, line_no int, html string, context string, grid array<array<string>>, truncated boolean"


def find_tables(docs: DataFrame) -> DataFrame:
    """(doc_key, text) -> one row for each HTML table: position, page, line, markup, the text before it, its grid and whether that was cut."""
    names = ["doc_key", "table_pos", "page", "line_no", "html", "context", "grid", "truncated"]
    types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.list_(pa.string())), pa.bool_()]

    def run(batches):
        for b in batches:
            out = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                last, page, line, seen = 0, 1, 1, 0
                for pos, m in enumerate(_TABLE.finditer(text or "")):
                    for mark in _PAGE.finditer(text, seen, m.start()):
                        page = int(mark[1])
                    line += text.count("\n", seen, m.start())
                    seen = m.start()
                    context = _TAG.sub(" ", text[max(last, m.start() - 1500) : m.start()])
                    out.append((key, pos, page, line, m[0], " ".join(context.split())[-400:], *grid_of(m[0])))
                    last = m.end()
            cols = list(zip(*out)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, types)], names=names)

    return docs.select(F.col("doc_key").cast("string"), "text").mapInArrow(run, TABLE_SCHEMA)


class _Grid(HTMLParser):
    """Rows of (text, rowspan, colspan)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.cell = [], None

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th"):
            if not self.rows:
                self.rows.append([])
            a = dict(attrs)
            span = lambda name: min(50, max(1, int(a.get(name) or 1))) if str(a.get(name) or 1).isdigit() else 1
            self.cell = [[], span("rowspan"), span("colspan")]
            self.rows[-1].append(self.cell)

    def handle_endtag(self, tag):
        if tag in ("td", "th"):
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell[0].append(data)


MAX_ROWS, MAX_COLS = 600, 40


def parse_grid(html: str, max_rows: int = MAX_ROWS, max_cols: int = MAX_COLS) -> list[list[str]]:
    return grid_of(html, max_rows, max_cols)[0]


def grid_of(html: str, max_rows: int = MAX_ROWS, max_cols: int = MAX_COLS) -> tuple[list[list[str]], bool]:
    """Rectangular grid, in which spans repeat their text; whether rows or columns beyond the limits were cut."""
    p = _Grid()
    p.feed(html or "")
    taken: dict[tuple[int, int], str] = {}
    cut = len(p.rows) > max_rows
    for r, row in enumerate(p.rows[:max_rows]):
        c = 0
        for parts, down, across in row:
            while (r, c) in taken:
                c += 1
            text = " ".join("".join(parts).split())
            for i in range(r, min(r + down, max_rows)):
                for j in range(c, min(c + across, max_cols)):
                    taken.setdefault((i, j), text)
            c += across
            cut |= c > max_cols
    rows, cols = (1 + max((k[i] for k in taken), default=-1) for i in (0, 1))
    return [[taken.get((i, j), "") for j in range(cols)] for i in range(rows)], cut


def cells(tables: DataFrame) -> DataFrame:
    """Unpivot grids: one row for each numeric cell with its row label, row code and column header."""
    keys = [c for c in tables.columns if c not in ("grid", "html")]
    rows = tables.select(*keys, F.get("grid", F.lit(0)).alias("header"), F.posexplode("grid").alias("row", "texts"))
    values = F.transform("texts", parse_number)
    label = F.substring(F.array_join(F.filter(F.slice("texts", 1, 6), lambda t: (t != "") & parse_number(t).isNull()), " "), 1, 160)
    code_at = F.array_position(F.transform(F.slice("texts", 1, 4), lambda t: t.rlike("^[0-9]{2,3}[a-z]?$") & ~F.coalesce(year_like(parse_number(t)), F.lit(False))), True)
    rows = rows.withColumn("label", label).withColumn("code_at", code_at).withColumn("row_code", F.when(F.col("code_at") > 0, F.get("texts", F.col("code_at").cast("int") - 1)).otherwise(""))
    out = rows.select(*keys, "row", "label", "row_code", "code_at", "header", F.posexplode(values).alias("col", "value"))
    name = F.when(F.col("row") > 0, F.substring(F.coalesce(F.get("header", F.col("col")), F.lit("")), 1, 80)).otherwise("")
    return out.filter(F.col("value").isNotNull() & (F.col("col") + 1 != F.col("code_at"))).withColumn("col_name", name).drop("header", "code_at")


def sticky_unit(tables: DataFrame, key: str, pos: str, scale: str = "unit_scale") -> DataFrame:
    """Last explicit scale of the report so far; source explicit, sticky or none."""
    w = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    carried = F.last(scale, ignorenulls=True).over(w)
    source = F.when(F.col(scale).isNotNull(), "explicit").when(carried.isNotNull(), "sticky").otherwise("none")
    return tables.withColumn("unit_source", source).withColumn(scale, carried)
