"""Flat programs: one operation over numbered candidate cells, answered for all questions in one plan.

Selections are rows and so are their operands; a question's operands meet the candidates by an equi-join
and come back as one short array (its length is that of the selection), so checks and answers are Columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.numbers import percent_from_cell

#: Operations with their least and largest number of operands.
ARITY = {
    "lookup": (1, 1),
    "sum": (1, None),
    "average": (1, None),
    "difference": (2, 2),
    "growth_pct": (2, 2),
    "ratio": (2, 2),
    "margin": (2, 2),
    "ratio_times": (2, 2),
    "ranking_max": (2, None),
    "ranking_min": (2, None),
    "argmax": (2, None),
    "argmin": (2, None),
    "count": (1, None),
    "percentage_point": (2, 2),
}
#: Largest magnitude of an answer by its output type.
HARD_LIMITS = {"percent": 1e6, "percentage_point": 1e4, "ratio": 1e6}


def parse_selection(reply: Column) -> Column:
    """Struct op, operands of the first JSON object in a text (prose and fences are skipped) that has both; else null."""
    objects = F.regexp_extract_all(reply, F.lit(r"\{[^{}]*\}"), F.lit(0))

    def read(x: Column) -> Column:
        numbers = F.coalesce(*(F.get_json_object(x, f"$.{n}") for n in ("operands", "idx", "rows")))
        found = F.regexp_extract_all(numbers, F.lit(r"-?[0-9]+"), F.lit(0))
        return F.struct(F.lower(F.trim(F.get_json_object(x, "$.op"))).alias("op"), F.transform(found, lambda n: n.try_cast("int")).alias("operands"))

    return F.get(F.filter(F.transform(objects, read), lambda s: (s["op"] != "") & (F.size(s["operands"]) > 0)), F.lit(0))


def incompatible(op: Column, kind: Column) -> Column:
    """The operation cannot give an answer of this output type."""
    ranked = op.isin("argmax", "argmin", "ranking_max", "ranking_min")
    return (
        ((kind == "year") & ~ranked)
        | ((kind == "count") != (op == "count"))
        | (op.isin("argmax", "argmin") & (kind != "year"))
        | ((op == "ratio_times") & (kind != "ratio"))
        | ((op == "percentage_point") & (kind != "percentage_point"))
    )


def answers(selections: DataFrame, candidates: DataFrame) -> DataFrame:
    """(qid, answer, status) of selections (qid, op, operands, output_type, question_scale).

    candidates: qid, idx (from 1), cell, value, unit_scale, label, year. Growth and differences take the
    later value first. A failed check gives a null answer and its reason: unknown_op, wrong_arity,
    duplicate_operands, operand_out_of_range, duplicate_cells, incompatible_output, ambiguous_years,
    division_by_zero, out_of_range.
    """
    c = F.col
    asked = selections.select("qid", "op", "output_type", "question_scale", "operands")
    rows = asked.select("qid", F.posexplode("operands").alias("pos", "idx")).join(candidates.select("qid", "idx", "cell", "value", "unit_scale", "label", "year"), ["qid", "idx"], "left")
    fact = F.struct("pos", (c("value") * c("unit_scale")).alias("v"), "value", "cell", "label", "year")
    picked = rows.groupBy("qid").agg(F.array_sort(F.collect_list(fact)).alias("p"))
    df = asked.join(picked, "qid", "left")
    v, years, cells = c("p")["v"], c("p")["year"], c("p")["cell"]  # arrays of one field
    n, at = F.size("operands"), lambda i: F.get("p", F.lit(i))
    low = F.coalesce(*(F.when(c("op") == o, F.lit(a)) for o, (a, _) in ARITY.items()))
    high = F.coalesce(*(F.when(c("op") == o, F.lit(b)) for o, (_, b) in ARITY.items() if b), F.lit(1 << 30))
    by_year = c("op").isin("argmax", "argmin") | ((c("output_type") == "year") & c("op").isin("ranking_max", "ranking_min"))
    largest = c("op").isin("argmax", "ranking_max")
    year_bad = by_year & (F.exists(years, lambda y: y.isNull()) | (F.size(F.array_distinct(years)) < n))
    zero = (c("op").isin("ratio", "margin", "ratio_times") | (c("op") == "growth_pct")) & (at(1)["v"] == 0)
    a, b = at(0)["v"], at(1)["v"]
    total = F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    extreme = F.when(largest, F.array_max(v)).otherwise(F.array_min(v))
    scale = c("question_scale")
    value = (
        F.when(by_year, F.get(years, (F.array_position(v, extreme) - 1).cast("int")).cast("double"))
        .when((c("op") == "lookup") & (c("output_type") == "percent"), percent_from_cell(at(0)["value"], at(0)["label"]))
        .when(c("op") == "lookup", a / scale)
        .when(c("op") == "difference", F.when(c("output_type").isin("percent", "percentage_point"), a - b).otherwise((a - b) / scale))
        .when(c("op") == "percentage_point", at(0)["value"] - at(1)["value"])
        .when(c("op") == "growth_pct", F.try_divide(a - b, F.abs(b)) * 100)
        .when((c("op") == "ratio_times") | (c("op").isin("ratio", "margin") & (c("output_type") == "ratio")), F.try_divide(a, b))
        .when(c("op").isin("ratio", "margin"), F.try_divide(a, b) * 100)
        .when(c("op") == "count", n.cast("double"))
        .when(c("op") == "sum", total / scale)
        .when(c("op") == "average", total / n / scale)
        .otherwise(extreme / scale)
    )
    limit = F.coalesce(*(F.when(c("output_type") == k, F.lit(x)) for k, x in HARD_LIMITS.items()), F.lit(float("inf")))
    status = (
        F.when(low.isNull(), "unknown_op")
        .when((n < low) | (n > high), "wrong_arity")
        .when(F.size(F.array_distinct("operands")) < n, "duplicate_operands")
        .when(F.exists(cells, lambda x: x.isNull()), "operand_out_of_range")
        .when(F.size(F.array_distinct(cells)) < n, "duplicate_cells")
        .when(incompatible(c("op"), c("output_type")), "incompatible_output")
        .when(year_bad, "ambiguous_years")
        .when(zero, "division_by_zero")
    )
    checked = df.withColumn("status", status).withColumn("answer", F.when(c("status").isNull(), F.round(value, 2) + 0.0))
    over = c("answer").isNotNull() & (F.abs("answer") > limit)
    status = F.coalesce(c("status"), F.when(over, "out_of_range"), F.when(c("answer").isNull(), "execution_failed"), F.lit("ok"))
    return checked.select("qid", F.when(~over, c("answer")).alias("answer"), status.alias("status"))
