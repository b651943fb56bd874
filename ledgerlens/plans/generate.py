"""Questions made backwards: from cells to question, typed program and gold answer in one pass.

Classes: ``lookup`` (a cell), ``growth_pct`` (a cell and that of the year before, which is positive), ``ratio`` (two metrics
of one entity and year), ``difference`` (two entities of one metric and year) and ``ranking`` (three or four). Partners
of the last two are neighbours in the order of a digest of the entity, in cohorts of about a thousand, so no group is
paired with itself and none goes to one task.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.plans import ir

#: Units that answers are asked in.
ASKED_UNITS = (("đồng", 1.0), ("triệu đồng", 1e6), ("tỷ đồng", 1e9))
CLASSES = ("lookup", "growth_pct", "ratio", "difference", "ranking")
COHORT = 1000
_FACT = "array<struct<slot:string,entity:string,period:int,metric:string,value:double>>"


def usable(cells: DataFrame) -> DataFrame:
    """entity, year, metric, value: cells that are alone in their place and at least 1 in size; one that is there twice is dropped with its double."""
    one = cells.groupBy("entity", "year", "metric").agg(F.count(F.lit(1)).alias("n"), F.max("value").cast("double").alias("value"))
    named = F.col("entity").isNotNull() & F.col("year").isNotNull() & F.col("metric").isNotNull()
    finite = ~F.isnan("value") & (F.abs("value") >= 1) & (F.abs("value") < float("inf"))
    return one.filter(named & (F.col("n") == 1) & finite).select(F.col("entity").cast("string").alias("entity"), F.col("year").cast("int").alias("year"), "metric", "value")


def _part(text: Column, n: Column | int) -> Column:
    """Number below n from the digest of a text."""
    return F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("long") % n


def _facts(cells: list[tuple]) -> Column:
    """Array of facts from (entity, year, metric, value)."""
    return F.array(*(F.struct(F.lit(f"F{i}").alias("slot"), e.alias("entity"), y.alias("period"), m.alias("metric"), v.alias("value")) for i, (e, y, m, v) in enumerate(cells, 1))).cast(_FACT)


def _declared(cells: list[tuple]) -> Column:
    """The facts as a program declares them."""
    return F.to_json(F.struct(*(F.struct(F.lit("money").alias("type"), e.alias("entity"), y.alias("period")).alias(f"F{i}") for i, (e, y, _, _) in enumerate(cells, 1))))


def _key(cells: list[tuple]) -> Column:
    return F.concat_ws("|", *(x for e, y, m, _ in cells for x in (e, y.cast("string"), m)))


def _op(name: str, n: int) -> str:
    return json.dumps({"op": name, "args": [{"fact": f"F{i}"} for i in range(1, n + 1)]})


def _top(n: int) -> str:
    named = [{"fact": f"F{i}"} for i in range(1, n + 1)]
    return json.dumps({"op": "argmax_project", "scores": named, "results": named})


#: Roots of the programs of all classes, how many facts they have, what they give.
_ROOTS = (
    (_op("lookup", 1), 1, "money"), (_op("growth_percent", 2), 2, "percent"), (_op("divide", 2), 2, "percent"),
    (_op("subtract", 2), 2, "money"), (_top(3), 3, "money"), (_top(4), 4, "money"),
)


def _told(cells: DataFrame, forms: list[tuple]) -> DataFrame:
    """klass, key, facts, declared, raw, text and root of the questions that the forms make of cells, in one pass."""
    cells = cells.withColumn("__form", F.explode(F.array(*(F.when(x[1], i) for i, x in enumerate(forms))))).filter(F.col("__form").isNotNull())
    pick = lambda made: F.coalesce(*(F.when(F.col("__form") == i, made(x)) for i, x in enumerate(forms)))
    columns = {"klass": lambda x: F.lit(x[0]), "key": lambda x: _key(x[2]), "facts": lambda x: _facts(x[2]), "declared": lambda x: _declared(x[2]), "raw": lambda x: x[3], "text": lambda x: x[4], "root": lambda x: F.lit(x[5])}
    return cells.select(*(pick(made).alias(n) for n, made in columns.items()))


def generate(cells: DataFrame, ratios: list[tuple[str, str]], seed: int = 17, classes: tuple = CLASSES) -> DataFrame:
    """qid, klass, question, program, facts, gold, output, unit_scale and root of all questions that cells (entity, year, metric, value) give.

    ``ratios``: metrics over and under the line. ``qid`` is a digest of seed, class and cells, so it does not depend on the order
    of rows; ``gold`` is in the unit asked, rounded to two places. Null entities, years, metrics and values give nothing.
    """
    c = F.col
    good = usable(cells)
    own = (c("entity"), c("year"), c("metric"), c("value"))
    # (class, where a cell gives a question of it, cells of the question, value, text, root of the program)
    alone = [("lookup", F.lit(True), [own], c("value"), F.concat("metric", F.lit(" của "), "entity", F.lit(" năm "), c("year").cast("string"), F.lit(" là bao nhiêu ")), _op("lookup", 1))]
    was = (c("entity"), c("__was.year"), c("metric"), c("__was.value"))
    grown = (c("value") - was[3]) / F.abs(was[3]) * 100
    text = F.concat("metric", F.lit(" của "), "entity", F.lit(" năm "), c("year").cast("string"), F.lit(" tăng trưởng bao nhiêu phần trăm so với năm "), was[1].cast("string"), F.lit("?"))
    alone.append(("growth_pct", (was[1] == c("year") - 1) & (was[3] > 0), [was, own], grown, text, _op("growth_percent", 2)))
    for i, (over, under) in enumerate(ratios):
        base = (c("entity"), c("year"), F.lit(under), c(f"__under{i}"))
        text = F.concat(F.lit("Tỷ lệ "), "metric", F.lit(f" trên {under} của "), "entity", F.lit(" năm "), c("year").cast("string"), F.lit(" là bao nhiêu phần trăm?"))
        alone.append(("ratio", (c("metric") == over) & base[3].isNotNull(), [own, base], c("value") / base[3] * 100, text, _op("divide", 2)))
    next_ = [(c(f"__next{i}.entity"), c("year"), c("metric"), c(f"__next{i}.value")) for i in (1, 2, 3)]
    text = F.concat(F.lit("Năm "), c("year").cast("string"), F.lit(", "), "metric", F.lit(" của "), "entity", F.lit(" so với "), next_[0][0], F.lit(" chênh lệch bao nhiêu "))
    beside = [("difference", (c("__at") % 2 == 0) & next_[0][0].isNotNull(), [own, next_[0]], c("value") - next_[0][3], text, _op("subtract", 2))]
    for n, whole in ((3, next_[2][0].isNull()), (4, next_[2][0].isNotNull())):
        of = [own, *next_[: n - 1]]
        text = F.concat(F.lit("Trong "), F.concat_ws(", ", *(x[0] for x in of)), F.lit(", "), "metric", F.lit(" cao nhất năm "), c("year").cast("string"), F.lit(" là bao nhiêu "))
        beside.append(("ranking", (c("__at") % 4 == 0) & next_[1][0].isNotNull() & whole, of, F.greatest(*(x[3] for x in of)), text, _top(n)))
    alone, beside = ([x for x in xs if x[0] in classes] for xs in (alone, beside))
    parts = []
    if alone:
        # the year before and the metric under the line stand in rows of the same entity, so cells dealt by entity are not sent again
        met = good.withColumn("__was", F.lag(F.struct("year", "value")).over(Window.partitionBy("entity", "metric").orderBy("year")))
        for i, (_, under) in enumerate(ratios):
            met = met.withColumn(f"__under{i}", F.max(F.when(c("metric") == under, c("value"))).over(Window.partitionBy("entity", "year")))
        parts.append(_told(met, alone))
    if beside:
        # only groups of more than one cohort are sent to all, at most one row for a thousand cells
        sizes = good.groupBy("metric", "year").agg(F.ceil(F.count(F.lit(1)) / COHORT).alias("__cohorts")).filter("__cohorts > 1")
        w = Window.partitionBy("metric", "year", "__cohort").orderBy("__d", "entity")
        dealt = good.join(F.broadcast(sizes), ["metric", "year"], "left").withColumn("__d", F.md5(c("entity"))).withColumn("__cohort", _part(c("entity"), F.coalesce("__cohorts", F.lit(1))))
        placed = dealt.select(*own, (F.row_number().over(w) - 1).alias("__at"), *(F.lead(F.struct("entity", "value"), i).over(w).alias(f"__next{i}") for i in (1, 2, 3)))
        parts.append(_told(placed, beside))
    out = reduce(DataFrame.unionByName, parts)
    share = c("klass").isin("growth_pct", "ratio")
    out = out.withColumn("qid", F.md5(F.concat_ws("|", F.lit(str(seed)), "klass", "key")))
    unit = F.get(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(s).alias("scale")) for n, s in ASKED_UNITS)), _part(c("qid"), len(ASKED_UNITS)).cast("int"))
    out = out.withColumn("unit", unit).withColumn("unit_scale", F.when(share, 1.0).otherwise(c("unit.scale")))
    output = F.when(share, "percent").otherwise("money")
    program = F.concat(F.lit('{"facts": '), "declared", F.lit(', "root": '), "root", F.lit(', "output": "'), output, F.lit('"}'))
    question = F.when(share, c("text")).otherwise(F.concat("text", "unit.name", F.lit("?")))
    return out.select("qid", "klass", question.alias("question"), program.alias("program"), "facts", (F.round(c("raw") / c("unit_scale"), 2) + 0.0).alias("gold"), output.alias("output"), "unit_scale", "root")


def answered(generated: DataFrame, keep: list[str]) -> DataFrame:
    """keep, answer and status: each question answered by its program over its own facts.

    Programs of one root differ only in the places that they declare, which are those of their facts, so each root is compiled
    once and no row is parsed, joined or sent anywhere. ``rows.attempts`` gives the same from the texts, for programs of any kind.
    """
    answer = F.lit(None).cast("double")
    for root, n, output in _ROOTS:
        program = {"facts": {f"F{i}": {"type": "money"} for i in range(1, n + 1)}, "root": json.loads(root), "output": output}
        answer = F.when(F.col("root") == root, ir.Compiler(program).compile(F.col("unit_scale")).column).otherwise(answer)
    valued = generated.select(F.struct(*keep).alias("__kept"), "root", "unit_scale", *(F.get("facts", F.lit(i - 1))["value"].alias(f"F{i}") for i in (1, 2, 3, 4)))
    return valued.select("__kept", answer.alias("answer")).select("__kept.*", "answer", F.when(F.col("answer").isNull(), "execution_failed").otherwise("ok").alias("status"))


def balanced(generated: DataFrame, per_class: int) -> DataFrame:
    """The first ``per_class`` questions of each class in the order of their digests, so many for each whatever the data."""
    w = Window.partitionBy("klass").orderBy("qid")
    return generated.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= per_class).drop("__n")


def cells_of(generated: DataFrame) -> DataFrame:
    """Facts of the questions as ``rows.attempts`` takes them."""
    return generated.select("qid", F.explode("facts").alias("f")).select("qid", "f.slot", "f.value", "f.entity", "f.period", "f.metric")
