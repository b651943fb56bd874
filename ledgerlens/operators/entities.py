"""Companies named in questions: symbols in brackets, names, symbols in the text, and one fuzzy name at last."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerlens.functions.fuzzy import sorted_words
from ledgerlens.functions.text import norm, strip_company_prefixes, strip_diacritics

#: Brand names that legal names do not hold.
BRANDS = (("MBB", "mbbank"), ("MBB", "mb bank"), ("EIB", "eximbank"), ("EIB", "exim bank"), ("SAB", "sabeco"))
FUZZY_MIN = 82.0


def company_aliases(companies: DataFrame) -> DataFrame:
    """(ticker, alias) of companies (ticker, name): the name, without prefixes, without legal suffixes, brands."""
    full = norm(F.col("name"))
    both = F.array(full, strip_company_prefixes(F.col("name")))
    short = F.transform(both, lambda a: F.regexp_replace(a, " (?:ctcp|cong ty co phan)$", ""))
    symbol = F.upper(F.trim("ticker"))
    brand = F.array_compact(F.array(*(F.when(symbol == t, F.lit(b)) for t, b in BRANDS)))
    return companies.select(symbol.alias("ticker"), F.explode(F.concat(both, short, brand)).alias("alias")).filter("alias <> ''").distinct()


def _words(plain: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(plain, "[ /%]+", " ")), " ")


def _apart(hits: Column) -> Column:
    """Hits (at, minus_n, ticker, n) that do not overlap an earlier kept one; the order is place, then length."""
    start = F.struct(F.lit(0).alias("until"), F.filter(hits, lambda x: F.lit(False)).alias("kept"))

    def step(s, x):
        free = x["at"] >= s["until"]
        return F.struct(F.when(free, x["at"] + x["n"]).otherwise(s["until"]).alias("until"), F.when(free, F.concat(s["kept"], F.array(x))).otherwise(s["kept"]).alias("kept"))

    return F.aggregate(F.array_sort(hits), start, step)["kept"]


def _counts(texts: list[str]) -> np.ndarray:
    """How often each of 64 classes of characters occurs: no two strings share more characters than their classes do."""
    out = np.zeros((len(texts), 64), np.int32)
    for i, x in enumerate(texts):
        if x:
            out[i] = np.bincount(np.frombuffer(x.encode("utf-32-le"), "<u4") % 64, minlength=64)
    return out


def best_names(questions: DataFrame, names: DataFrame, key: str, text: str, block_chars: int = 1 << 20) -> DataFrame:
    """(key, ticker, score): for each question the name most alike by the ratio of the sorted distinct words, of all names.

    Names (ticker, alias) are the stated set that goes to all questions, in blocks of ``block_chars``. The ratio is
    2 M / (a + b) of the lengths a and b, and M is at most the number of characters that both have. So names are
    scored from the highest such bound down, until the bound falls below the best score: the result is that of
    scoring all. Ties go to the smaller ticker.
    """
    spark = questions.sparkSession
    asked = questions.select(key, sorted_words(F.col(text)).alias("said"))
    listed = names.filter("ticker is not null").select("ticker", sorted_words(F.col("alias")).alias("name")).distinct().orderBy("ticker", "name")
    schema = StructType([asked.schema[key], *StructType.fromDDL("ticker string, score double")])

    def search(shared):
        def run(batches):
            tickers, shown, sizes, counts = shared.value
            for b in batches:
                out = []
                for said in b.column(1).to_pylist():
                    bound = 200.0 * np.minimum(counts, _counts([said])).sum(axis=1) / np.maximum(sizes + len(said), 1)
                    bound[sizes + len(said) == 0] = 100.0  # two empty strings are equal
                    best = (-1.0, "")
                    for i in np.argsort(-bound, kind="stable").tolist():
                        if bound[i] < best[0] - 1e-9:
                            break
                        score = 100 * SequenceMatcher(None, shown[i], said).ratio()
                        if score > best[0] or score == best[0] and tickers[i] < best[1]:
                            best = (score, tickers[i])
                    out.append(best)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t for _, t in out], pa.string()), pa.array([s for s, _ in out], pa.float64())], names=[key, "ticker", "score"])

        return run

    found, block, size = None, [], 0

    def add():
        nonlocal found, block, size
        shown = [r["name"] for r in block]
        part = asked.mapInArrow(search(spark.sparkContext.broadcast(([r["ticker"] for r in block], shown, np.array([len(x) for x in shown]), _counts(shown)))), schema)
        found, block, size = part if found is None else found.unionByName(part), [], 0

    for r in listed.toLocalIterator():
        block.append(r)
        size += len(r["name"]) + 64
        if size >= block_chars:
            add()
    if block:
        add()
    found = spark.createDataFrame([], schema) if found is None else found
    return found.groupBy(key).agg(F.min(F.struct((-F.col("score")).alias("s"), "ticker")).alias("x")).select(key, "x.ticker", (-F.col("x.s")).alias("score"))


def find_tickers(questions: DataFrame, companies: DataFrame, key: str) -> DataFrame:
    """One row a question (key, question): tickers in the order of their places, source and score.

    Symbols in brackets win (explicit, 100). Else names count, longest first and not overlapping, and
    symbols outside them: in capitals, or in small letters if two differ or the wording says it is one
    (explicit, or explicit_name at 99 without a symbol). After a single "cua cong ty me" only what follows
    counts. Else the best of all names: fuzzy from 82, low_conf_fuzzy below; none, 0 if no name
    has a character of it.
    Questions meet names and symbols by equi-joins on words; the lists gathered are those of one question.
    """
    c = F.col
    asked = questions.select(key, F.coalesce("question", F.lit("")).alias("question")).withColumn("plain", norm(c("question"))).withColumn("words", _words(c("plain")))
    aliases = company_aliases(companies)
    symbols = companies.select(F.upper(F.trim("ticker")).alias("ticker")).distinct()
    tagged = F.regexp_extract_all(strip_diacritics(c("question")), F.lit(r"\(([A-Z][A-Z0-9]{1,4})\)"), F.lit(1))
    mention = lambda at, kind, n: F.struct(at.alias("at"), (-n).alias("minus_n"), "ticker", n.alias("n"), F.lit(kind).alias("kind"))
    marked = asked.select(key, F.posexplode(tagged).alias("at", "ticker")).join(symbols, "ticker").select(key, mention(c("at"), "tag", F.lit(1)).alias("m"))
    words = asked.select(key, "words", F.posexplode("words").alias("at", "word"))
    names = aliases.filter(F.length("alias") >= 5).withColumn("name", _words(c("alias"))).select("ticker", "name", F.get("name", F.lit(0)).alias("word"), F.size("name").alias("n"))
    named = words.join(names, "word").filter(F.slice("words", c("at") + 1, c("n")) == c("name")).select(key, mention(c("at"), "name", c("n")).alias("m"))
    listed = words.join(symbols.withColumn("word", F.lower("ticker")), "word").select(key, mention(c("at"), "ticker", F.lit(1)).alias("m"))
    found = marked.unionByName(named).unionByName(listed).groupBy(key).agg(F.collect_list("m").alias("all"))
    df = asked.join(found, key, "left").withColumn("all", F.coalesce("all", F.array().cast(found.schema["all"].dataType)))
    of = lambda kind: F.filter("all", lambda x: x["kind"] == kind)
    df = df.withColumn("named", _apart(of("name"))).withColumn("ascii", strip_diacritics(c("question")))
    free = F.filter(of("ticker"), lambda x: ~F.exists("named", lambda y: (x["at"] >= y["at"]) & (x["at"] < y["at"] + y["n"])))
    capital = lambda x: F.rlike("ascii", F.concat(F.lit("(?<![0-9A-Za-z])"), x["ticker"], F.lit("(?![0-9A-Za-z])"))) | x["ticker"].rlike("[0-9]")
    df = df.withColumn("large", F.filter(free, capital)).withColumn("small", F.filter(free, lambda x: ~capital(x)))
    low = lambda x: F.lower(x["ticker"])
    said = lambda x: F.rlike("plain", F.concat(F.lit(r"\b(?:ma(?: co phieu)?|co phieu) "), low(x), F.lit(r"\b|\b"), low(x), F.lit(r" (?:nam|trong nam|giai doan|tu nam)\b")))
    several = F.size(F.array_distinct(c("small")["ticker"])) >= 2
    mentions = F.array_sort(F.concat("named", "large", F.filter("small", lambda x: several | said(x))))
    anchor = F.when(F.size(F.split("plain", "cua cong ty me")) == 2, F.size(_words(F.get(F.split("plain", "cua cong ty me"), F.lit(0)))))
    df = df.withColumn("mentions", mentions).withColumn("scoped", F.filter("mentions", lambda x: x["at"] >= F.coalesce(anchor, F.lit(0))))
    df = df.withColumn("tags", F.array_sort(of("tag"))).withColumn("chosen", F.when(F.size("tags") > 0, c("tags")).when(F.size("scoped") > 0, c("scoped")).otherwise(c("mentions")))
    sure = F.exists("chosen", lambda x: x["kind"] != "name")
    df = df.select(key, "plain", F.array_distinct(c("chosen")["ticker"]).alias("tickers"), sure.alias("sure"))
    lost = df.filter(F.size("tickers") == 0).select(key, "plain")
    guess = best_names(lost, aliases.filter(F.length("alias") >= 6).select("ticker", "alias"), key, "plain")
    guess = guess.filter("score > 0").select(key, F.col("score").alias("best"), F.col("ticker").alias("guess"))
    out = df.join(guess, key, "left")
    known = F.size("tickers") > 0
    source = F.when(known & c("sure"), "explicit").when(known, "explicit_name").when(c("best") >= FUZZY_MIN, "fuzzy").when(c("best").isNotNull(), "low_conf_fuzzy").otherwise("none")
    score = F.when(known, F.when(c("sure"), 100.0).otherwise(99.0)).otherwise(F.coalesce("best", F.lit(0.0)))
    return out.select(key, F.when(known, c("tickers")).otherwise(F.array_compact(F.array("guess"))).alias("tickers"), source.alias("source"), score.alias("score"))
