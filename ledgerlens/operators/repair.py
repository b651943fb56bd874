"""Repair of answers: facts resolved again from all cells of their reports, and the answers they give.

A proposal replaces an answer only if every check holds; all others keep their row and get a reason.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.fuzzy import label_score
from ledgerlens.functions.numbers import growth_percent
from ledgerlens.functions.text import coverage, norm

DIRECT, WEAK, CONTEXT = 70.0, 55.0, 78.0
REPAIRED = ("difference", "ratio", "growth_pct", "average")


def candidates(facts: DataFrame, cells: DataFrame) -> DataFrame:
    """Cells that may be a fact: facts x cells of the same ticker, doc_type and year, scored by label.

    facts: qid, fact, ticker, year, doc_type, metric, question_scale. cells: ticker, doc_type, year (that
    of the column), report_id, table_pos, row, col, label, context, value, unit_scale, confidence (of the
    column's role). A label passes at 70 points, or at 55 if label and context together reach 78. Python
    scores only labels that cover a quarter of the metric, which 55 points need.
    """
    c = F.col
    good = cells.filter((c("confidence") >= 3) & (F.length(norm(c("label"))) >= 5))
    near = facts.join(good, ["ticker", "doc_type", "year"]).filter(coverage(c("label"), c("metric")) >= (WEAK - 40) / 60)
    scored = near.withColumn("direct", label_score(c("label"), c("metric")))
    with_context = F.when(c("direct") < DIRECT, label_score(F.concat_ws(" ", "context", "label"), c("metric"))).otherwise(0.0)
    scored = scored.filter(c("direct") >= WEAK).withColumn("around", with_context).filter((c("direct") >= DIRECT) | (c("around") >= CONTEXT))
    return scored.withColumn("score", F.greatest("direct", "around")).withColumn("amount", c("value") * c("unit_scale")).drop("direct", "around")


def resolve(facts: DataFrame, cells: DataFrame) -> DataFrame:
    """One row a fact: amount, the best cell, support (cells that agree) and status.

    All candidates of a fact must round to one answer; else the status is competing_answer_clusters,
    without candidates missing_metric_cell. Of agreeing cells the order is score, confidence, address.
    """
    c = F.col
    found = candidates(facts, cells).withColumn("answer_key", F.round(c("amount") / c("question_scale"), 2))
    address = ["report_id", "table_pos", "row", "col"]
    # the address decides ties: the first in its order
    w = Window.partitionBy("qid", "fact").orderBy(F.desc("score"), F.desc("confidence"), *address)
    top = found.withColumn("at", F.row_number().over(w))
    g = top.groupBy("qid", "fact").agg(F.count_distinct("answer_key").alias("clusters"), F.count(F.lit(1)).alias("support"), F.min_by(F.struct("amount", "score", *address), "at").alias("cell"))
    status = F.when(c("clusters").isNull(), "missing_metric_cell").when(c("clusters") > 1, "competing_answer_clusters").otherwise("accepted")
    out = facts.select("qid", "fact").join(g, ["qid", "fact"], "left").withColumn("status", status)
    kept = F.when(c("status") == "accepted", c("cell"))
    return out.select("qid", "fact", "status", F.coalesce("support", F.lit(0)).alias("support"), kept["amount"].alias("amount"), kept["score"].alias("score"), *(kept[a].alias(a) for a in address))


def proposals(answers: DataFrame, resolved: DataFrame) -> DataFrame:
    """(qid, answer, repaired, status) of answers (qid, op, answer, question_scale) from resolved facts 0, 1, ...

    Facts stand in the order of the operation: minuend, numerator and later value first. Statuses:
    accepted, unsupported_operation, unresolved_operand, wrong_operand_count, duplicate_repaired_cell,
    invalid_repaired_value, implausible_percent, repair_does_not_change_answer.
    """
    c = F.col
    cell = F.concat_ws("|", "report_id", "table_pos", "row", "col")
    at = lambda i: F.max(F.when(c("fact") == i, c("amount")))
    g = resolved.groupBy("qid").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(c("status") == "accepted").alias("known"),
        F.count_distinct(F.when(c("status") == "accepted", cell)).alias("cells"),
        at(0).alias("a"),
        at(1).alias("b"),
        F.avg("amount").alias("mean"),
    )
    df = answers.select("qid", "op", "answer", "question_scale").join(g, "qid", "left")
    value = (
        F.when(c("op") == "difference", (c("a") - c("b")) / c("question_scale"))
        .when(c("op") == "ratio", F.try_divide("a", "b") * 100)
        .when(c("op") == "growth_pct", growth_percent(c("b"), c("a")))
        .when(c("op") == "average", c("mean") / c("question_scale"))
    )
    df = df.withColumn("new", F.round(value, 2) + 0.0)
    status = (
        F.when(~c("op").isin(*REPAIRED), "unsupported_operation")
        .when(c("n").isNull() | (c("known") < c("n")), "unresolved_operand")
        .when(F.when(c("op") == "average", (c("n") < 2) | (c("n") > 6)).otherwise(c("n") != 2), "wrong_operand_count")
        .when(c("cells") < c("n"), "duplicate_repaired_cell")
        .when(c("new").isNull() | F.isnan("new") | (F.abs("new") == float("inf")), "invalid_repaired_value")
        .when(c("op").isin("ratio", "growth_pct") & (F.abs("new") > 10000), "implausible_percent")
        .when(F.abs(c("new") - c("answer")) <= 1e-12, "repair_does_not_change_answer")
        .otherwise("accepted")
    )
    df = df.withColumn("status", status)
    accepted = c("status") == "accepted"
    return df.select("qid", F.when(accepted, c("new")).otherwise(c("answer")).alias("answer"), accepted.alias("repaired"), "status")
