"""Entities, units, periods and gap filling on small cases."""

import random
import re
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from ledgerlens.functions import numbers
from ledgerlens.operators import assign, entities, metrics, shortlist
from ledgerlens.sources import store

COMPANIES = [("FPT", "CTCP FPT"), ("FTS", "CTCP Chứng khoán FPT"), ("VNM", "Công ty Cổ phần Sữa Việt Nam"), ("GAS", "Tổng Công ty Khí Việt Nam - CTCP"), ("SAM", "CTCP SAM Holdings"), ("MBB", "Ngân hàng TMCP Quân đội")]
ASKED = {
    "Doanh thu của Sữa Việt Nam (VNM) và FPT năm 2020?": (["VNM"], "explicit", 100.0),
    "Lợi nhuận của CTCP Chứng khoán FPT năm 2020": (["FTS"], "explicit_name", 99.0),
    "So sánh FPT với Sữa Việt Nam": (["FPT", "VNM"], "explicit", 100.0),
    "so sánh vnm, gas": (["VNM", "GAS"], "explicit", 100.0),
    "mã cổ phiếu gas lãi bao nhiêu": (["GAS"], "explicit", 100.0),
    "Nhân sâm giá bao nhiêu": (["MBB"], "low_conf_fuzzy", 44.4),  # a small-letter word alone is no symbol; the best of all names
    "Khoản vay của Sữa Việt Nam của công ty mẹ FPT": (["FPT"], "explicit", 100.0),
    "Mbbank lãi bao nhiêu?": (["MBB"], "explicit_name", 99.0),
    "Tổng công ty Khí Việt Nam": (["GAS"], "explicit_name", 99.0),
    "sữa việt nam công ty cổ phần": (["VNM"], "explicit_name", 99.0),
    None: ([], "none", 0.0),
}


def test_tickers(spark):
    q = spark.createDataFrame([(i, a) for i, a in enumerate(ASKED)], "qid int, question string")
    got = {r["qid"]: (r["tickers"], r["source"], round(r["score"], 1)) for r in entities.find_tickers(q, spark.createDataFrame(COMPANIES, "ticker string, name string"), "qid").collect()}
    assert [got[i] for i in range(len(ASKED))] == list(ASKED.values())


def test_fuzzy_name(spark):
    q = spark.createDataFrame([(1, "Quân độii ngân hàng TMCP"), (2, "Ngân quỹ là gì")], "qid int, question string")
    got = {r["qid"]: (r["tickers"], r["source"]) for r in entities.find_tickers(q, spark.createDataFrame(COMPANIES, "ticker string, name string"), "qid").collect()}
    assert got == {1: (["MBB"], "fuzzy"), 2: (["MBB"], "low_conf_fuzzy")}


def test_best_names_are_those_of_scoring_all(spark):
    """Misspelt names of one word and of several, in blocks, against every pair."""
    rnd = random.Random(2)
    names = [(f"T{i:03d}", " ".join("".join(rnd.choices("aeioutnhcgmlsd", k=rnd.randint(3, 9))) for _ in range(rnd.choice([1, 1, 2, 3])))) for i in range(150)]
    names += [("T900", names[0][1]), ("T000", names[5][1])]  # equal names, a ticker with two names
    asked = []
    for i in range(60):
        word = list(rnd.choice(names)[1])
        word[rnd.randrange(len(word))] = rnd.choice("xyz")
        asked.append((i, rnd.choice(["doanh thu ", "", "lai gop cua "]) + "".join(word)))
    asked += [(90, ""), (91, names[0][1]), (92, "z" * 300)]
    q, n = spark.createDataFrame(asked, "q int, plain string"), spark.createDataFrame(names, "ticker string, alias string")

    def one(text):
        cut = lambda t: " ".join(sorted(set(re.findall("[0-9a-z]+", t))))
        return min((-100 * SequenceMatcher(None, cut(a), cut(text)).ratio(), t) for t, a in names)

    want = {i: one(text)[::-1] for i, text in asked}
    for block in (1 << 20, 400):
        got = {r["q"]: (r["ticker"], -r["score"]) for r in entities.best_names(q, n, "q", "plain", block).collect()}
        assert got == want
    assert entities.best_names(q, n.limit(0), "q", "plain").count() == 0


def test_misspelt_one_word_name(spark):
    companies = spark.createDataFrame([("VIC", "Vingroup"), ("HPG", "Hoaphat"), ("MSN", "Masan")], "ticker string, name string")
    got = entities.find_tickers(spark.createDataFrame([(1, "Vingruop")], "qid int, question string"), companies, "qid").collect()
    assert [(r["tickers"], r["source"]) for r in got] == [(["VIC"], "fuzzy")]


def test_units_and_scalars(spark):
    rows = {(1e6, "sticky", "Cuối năm VND"): (1.0, "terminal_vnd", True), (1e6, "sticky", "triệu VND"): (1e6, "sticky", False), (1e6, "explicit", "VND"): (1e6, "explicit", False), (None, None, None): (1.0, "none", False), (float("nan"), "sticky", "x"): (1.0, "sticky", False)}
    df = spark.createDataFrame([(i, *k) for i, k in enumerate(rows)], "i int, a double, b string, c string")
    got = [tuple(r["u"]) for r in df.select("i", numbers.resolve_unit(F.col("a"), F.col("b"), F.col("c")).alias("u")).orderBy("i").collect()]
    assert got == list(rows.values())
    texts = {"1,234.5": 1234.5, " -2 ": -2.0, "nan": None, "Infinity": None, "abc": None, "": None}
    df = spark.createDataFrame([(k,) for k in texts], "t string")
    assert {r["t"]: r["v"] for r in df.select("t", numbers.scalar(F.col("t")).alias("v")).collect()} == texts


def test_period_columns(spark):
    cases = {("31/12/2020", False): ("target_value", 2020, 4), ("01/01/2021", False): ("target_value", 2020, 4), ("Năm 2019", False): ("other_period", 2019, 4), ("2019 và 2020", True): ("ambiguous", None, 0), ("Số cuối năm", False): ("target_value", 2020, 3), ("Năm trước", False): ("other_period", 2019, 3), ("", True): ("target_value", 2020, 1), (None, False): ("unknown", None, 0)}
    df = spark.createDataFrame([(i, *k) for i, k in enumerate(cases)], "i int, h string, f boolean")
    got = [tuple(r["p"]) for r in df.select("i", shortlist.period_column(F.col("h"), F.lit(2020), F.lit(2020), F.col("f")).alias("p")).orderBy("i").collect()]
    assert got == list(cases.values())


def test_fill_and_confidence(spark):
    schema = "q int, slot string, cell int, score double"
    strict = spark.createDataFrame([(1, "F1", 1, 90.0)], schema)
    rescue = spark.createDataFrame([(1, "F1", 2, 80.0), (1, "F2", 1, 99.0), (1, "F2", 3, 50.0), (1, "F2", 4, 60.0), (1, "F3", 4, 70.0)], schema)
    slots = spark.createDataFrame([(1, "F1"), (1, "F2"), (1, "F3")], "q int, slot string")
    got = shortlist.fill_missing(strict, rescue, slots, "q", "slot", ["cell"], "score", 3)
    assert [(r["slot"], r["cell"]) for r in got.orderBy("rank").collect()] == [("F1", 1), ("F3", 4), ("F2", 3)]
    facts = spark.createDataFrame([(1, 80.0, True, 1), (1, 95.0, True, 2), (2, 95.0, True, 1), (2, 95.0, True, 1), (3, None, True, 1), (4, 70.0, None, 1)], "q int, s double, y boolean, cell int")
    assert {r["q"]: r["confidence"] for r in metrics.weakest_link(facts, "q", "s", "y", ["cell"]).collect()} == {1: 88.0, 2: 35.0, 3: 0.0, 4: 60.0}


def test_csv_sources(spark, tmp_path):
    (tmp_path / "c.csv").write_text("Mã,Tên\n fpt , CTCP FPT\n")
    (tmp_path / "t.csv").write_text("row,label,code,col,col_name,value,unit_scale\n1,,60.0,2,2023,5,1\n")
    assert [tuple(r) for r in store.read_companies(spark, str(tmp_path / "c.csv")).collect()] == [("FPT", "CTCP FPT")]
    assert [tuple(r) for r in store.read_tidy(spark, str(tmp_path / "t.csv")).collect()] == [(1, None, "60", 2, "2023", 5.0, 1.0)]


def test_assignment(spark):
    rows = [(1, 0, 0, 5.0), (1, 0, 1, 1.0), (1, 1, 0, 4.0), (1, 1, 1, 3.0), (1, 1, 1, 2.0), (2, 0, 0, 1.0), (2, 0, 1, 1.0), (2, 1, 0, 1.0), (2, 1, 1, 1.0), (3, 0, 0, 1.0), (3, 7, 7, 1.0), (4, 0, 1, 1.0)]
    got = assign.assign(spark.createDataFrame(rows, "qid int, fact int, leaf int, score double")).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 0), (1, 1, 1)]
