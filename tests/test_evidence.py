"""Candidate cuts, cell finders, lineage and grounding on small cases with nulls, ties and empty tables."""

import math
import random
from collections import Counter
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import fuzzy
from ledgerlens.operators import evidence, lineage, ranking
from ledgerlens.plans import ir

WORDS = "alpha beta gamma delta net total cost of goods part small ring".split()


def phrases(rng, n, longest):
    return sorted({" ".join(rng.choices(WORDS, k=rng.randint(1, longest))) for _ in range(n)})


@pytest.mark.parametrize("threshold", [62.0, 70.0, 85.0])
def test_similar_labels_by_brute_force(spark, threshold):
    rng = random.Random(3)
    labels, metrics = phrases(rng, 120, 6), phrases(rng, 30, 5)

    def score(a, b):
        x, y = a.split(), b.split()
        return 60 * len(set(x) & set(y)) / len(set(y)) + 40 * SequenceMatcher(None, " ".join(sorted(x)), " ".join(sorted(y))).ratio()

    got = fuzzy.similar_labels(spark.createDataFrame([(x,) for x in labels], "label string"), spark.createDataFrame([(x,) for x in metrics], "metric string"), threshold)
    want = {(a, b): round(score(a, b), 6) for a in labels for b in metrics if score(a, b) >= threshold}
    assert {(r[0], r[1]): round(r[2], 6) for r in got.collect()} == want


def test_bm25_by_brute_force_in_blocks(spark):
    rng = random.Random(5)
    docs = [(i, rng.choices(WORDS, k=rng.randint(0, 30)) if i % 9 else None) for i in range(60)]
    asked = [(i, rng.choices(WORDS, k=4)) for i in range(5)] + [(9, []), (10, ["nowhere"])]
    d, q = spark.createDataFrame(docs, "doc_id long, terms array<string>"), spark.createDataFrame(asked, "query_id long, terms array<string>")
    size = [len(t or ()) for _, t in docs]
    df = Counter(w for _, t in docs for w in set(t or ()))

    def score(terms, of):
        tf = Counter(terms or ())
        return sum(math.log((60 - df[w] + 0.5) / (df[w] + 0.5) + 1) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(terms or ()) * 60 / sum(size))) for w in of)

    want = set()
    for i, of in asked:
        scored = sorted((-round(score(t, of), 4), j) for j, t in docs if score(t, of) > 0)[:7]
        want |= {(i, j, -s) for s, j in scored}
    for places in (1 << 20, 6):
        assert {tuple(r)[:3] for r in ranking.bm25_top_k(d, q, 7, block_terms=places).collect()} == want
    assert ranking.bm25_top_k(d.limit(0), q, 3).count() == 0 and ranking.bm25_top_k(d, q.limit(0), 3).count() == 0


def test_find_cells_by_brute_force(spark):
    rng = random.Random(6)
    labels = phrases(rng, 40, 5)
    cells = spark.createDataFrame([(x, i % 2) for i, x in enumerate(labels)] + [(None, 0), (labels[0], 0)], "label string, scope int")
    asked = ["net cost of goods", "alpha ring"]
    got = evidence.find_cells(cells, spark.createDataFrame([(q, 0) for q in asked], "query string, scope int"), ["scope"], 4).collect()
    for q in asked:
        scored = sorted((-round(0.65 * len(set(q.split()) & set(x.split())) / len(set(q.split())) + 0.35 * SequenceMatcher(None, q, x).ratio(), 4), x) for x in labels[::2])
        assert [(r["label"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query"] == q] == [(x, -s) for s, x in scored[:4]]


def test_exactly_one_with_nulls(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (3, None)], "k int, v string")
    got = {r["k"]: (r["status"], r["v"]) for r in evidence.exactly_one(df, spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 4)], "k int"), ["k"]).collect()}
    assert got == {1: ("ok", "a"), 2: ("duplicate", None), 3: ("ok", None), 4: ("missing", None)}


def test_magnitude_keeps_a_group_that_would_be_empty(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 2e6), (2, 5.0), (2, None)], "q int, v double")
    got = [tuple(r) for r in evidence.magnitude_sane(df, "q", F.col("v"), F.lit(1e9)).collect()]
    assert sorted(got, key=str) == [(1, 2e6), (2, 5.0), (2, None)]


def test_tables_that_an_answer_depends_on():
    assert lineage.tables_of("df1.x + df2.y") == (["df1", "df2"], ["df1", "df2"])
    assert lineage.tables_of("x = df1\nanswer = 0") == ([], ["df1"])
    assert lineage.tables_of("a = df3.x\nb = a + a\nc = df4\nanswer = b * 2") == (["df3"], ["df3", "df4"])
    assert lineage.tables_of("a = b\nb = a\nanswer = a") == ([], [])


@pytest.mark.parametrize(
    "code, used",
    [
        ("x = df1\nanswer = x\nx = 0", ["df1"]),  # what a name is set to later does not count
        ("answer = df1\nanswer = 0", []),
        ("answer = 0\nfor r in df1:\n    answer += r", ["df1"]),
        ("a = b = df2\nfor i in df1:\n    a = b\n    b = i\nanswer = a", ["df1", "df2"]),
        ("a, b = df1, df2\nanswer = a", ["df1", "df2"]),
        ("x = 0\nif df3:\n    x = df1\nelse:\n    x = df2\nanswer = x", ["df1", "df2"]),
        ("x = {}\nx['k'] = df1\nanswer = x", ["df1"]),
        ("df1 = df2\nanswer = df1", ["df2"]),
        ("try:\n    x = df1\nexcept E:\n    x = 0\nanswer = x", ["df1"]),
        ("while df9:\n    answer = df4", ["df4"]),
    ],
)
def test_flow_of_tables(code, used):
    assert lineage.tables_of(code)[0] == used


def test_checks_of_answers(spark):
    rows = [("df1.x", 2020.5, "year"), ("df1.x", 1900.0, "year"), ("df1.x", -1.0, "count"), ("df1.x", None, "number"), (None, 1.0, "number"), ("df1 +", 1.0, "number"), ("df1.x", 1e5, "ratio")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, code string, answer double, kind string").withColumn("there", F.array(F.lit("df1")))
    got = {r["i"]: (r["errors"], r["warnings"]) for r in lineage.check_answers(df, "code", "there", "answer", F.col("kind")).collect()}
    assert [got[i][0] for i in range(7)] == [["year_not_whole"], ["year_out_of_range"], ["count_not_whole"], ["not_finite"], ["no_table"], ["invalid_syntax"], []]
    assert got[6][1] == ["large_ratio"]


@pytest.mark.parametrize("value, question, kind, ok", [(2.0, "", "number", True), (1.5, "tang 1,5, sau do", "number", True), (1.0e9, "hon 1 tỷ đồng", "money", True), (1.0e9, "hon 1 tỷ đồng", "number", False), (5.0, "muc 5,1", "number", False), (5.0, "muc 15", "number", False), (5.0, "5.", "number", True)])
def test_grounded_literals(value, question, kind, ok):
    assert ir.literal_grounded(value, question, kind) == ok


def test_first_sample_that_answers(spark):
    facts = spark.createDataFrame([(1, 0.0), (2, 4.0)], "q int, a double")
    inverse = {"facts": {"a": {}}, "root": {"op": "divide", "args": [{"lit": 100, "type": "money"}, {"fact": "a"}]}}
    got = {r["q"]: (r["answer"], r["status"], [x["reason"] for x in r["trace"]]) for r in ir.answer_first(facts, ["{", inverse], ["q"]).collect()}
    assert got == {1: (None, "execution_failed", ["schema_error", "execution_failed"]), 2: (25.0, "ok", ["schema_error", "ok"])}
    assert ir.answer_first(facts, [], ["q"]).collect()[0]["status"] == "no_samples"


@pytest.mark.parametrize("value, question, ok", [(1234567, "doanh thu 1234567 dong", True), (1500000, "1.500.000 dong", True), (1500000, "1,500,000", True), (1234567.5, "1.234.567,5", True), (1234568, "1234567", False), (1.5, "1.500", True), (1500, "1.500", True), (15, "1.5", False), (-7, "giam -7", True), (-7, "giam 7", False), (7, "tu -7", True), (0.25, ",25", False)])
def test_grounded_numbers_of_any_length(value, question, ok):
    assert ir.literal_grounded(float(value), question) == ok


def test_texts_are_normalised_once_a_row(spark):
    """Branches and lambdas that name a normalised text computed it again: 25 times and more a row."""
    from pyspark.sql import functions as F

    from ledgerlens.operators import evidence, shortlist

    df = spark.createDataFrame([("Lợi nhuận sau thuế", "Năm 2021", "60", "lợi nhuận sau thuế", 2021)], "label string, header string, code string, metric string, y int")
    c = F.col
    made = {
        "codes": (shortlist.expected_codes(c("metric")), 1, ["60"]),
        "qualifier": (shortlist.qualifier_bonus(c("label"), c("metric")), 2, 0),
        "bonus": (shortlist.code_bonus(c("code"), shortlist.expected_codes(c("metric"))), 1, 12),
        "year": (shortlist.year_reason(c("header"), c("label"), c("y"), c("y")), 2, "explicit_column_year"),
        "reason": (shortlist.metric_grounding(c("label"), c("header"), c("code"), c("metric"), F.lit("ending"), F.lit(50.0)), 8, "exact_vas_code"),
        "score": (evidence.header_score(c("header"), c("y"), F.lit(1)), 1, 39.99),
        "role": (shortlist.period_column(c("header"), c("y"), c("y"), F.lit(True))["role"], 1, "target_value"),
    }
    for name, (column, most, want) in made.items():
        out = df.select(column.alias("x"))
        assert out.first()["x"] == want, name
        assert out._jdf.queryExecution().optimizedPlan().toString().count("translate(") <= most, name
