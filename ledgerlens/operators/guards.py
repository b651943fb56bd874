"""Guards of a plan: the companies and the object that a question names must be those that the plan answers for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.text import norm

#: Brands that name a company whatever its legal name.
GUARDED_BRANDS = (("mbbank", "MBB"), ("mb bank", "MBB"), ("eximbank", "EIB"), ("exim bank", "EIB"), ("sabeco", "SAB"), ("masan", "MSN"), ("dai duong", "OGC"), ("vinamilk", "VNM"), ("binh son", "BSR"), ("pvtrans", "PVT"))
#: Wordings of a parent company, of a subtraction, and of an object that a company holds.
PARENTS = r"\b(?:cong ty me|ngan hang me|khoi ngan hang me)\b"
SUBTRACTED = "tru di"
NAMED_OBJECT = r"\btai\s+(.+?)\s+cua\s+(?:ctcp|cong ty|tong cong ty|tap doan|ngan hang)\b"
#: Words of legal forms, which tell no object from another.
FORM_WORDS = ("cong", "ty", "ctcp", "co", "phan", "tnhh", "tap", "doan", "tong", "ngan", "hang", "thuong", "mai")

#: Names that are sent to where the questions are; more of them and the questions are dealt out by words.
NAMES_SENT = 20_000


def mentions(questions: DataFrame, names: DataFrame, key: str, text: str = "question") -> DataFrame:
    """(key, at, until, ticker): the widest mentions of names (ticker, alias) in a question, in words, end exclusive.

    A mention inside a wider one gives way to it ("An Bình" in "chứng khoán An Bình"); mentions that only overlap stay,
    and so do two companies of one name. Names meet questions on their first word, so hits grow with what is said. A
    null or empty text or alias has no mention; a name listed twice counts once.
    """
    split = lambda plain: F.filter(F.split(plain, "[ /%]+"), lambda w: w != "")
    asked = questions.select(key, split(norm(F.col(text))).alias("__words"))
    listed = names.select(F.upper(F.trim("ticker")).alias("ticker"), split(norm(F.col("alias"))).alias("__name")).filter((F.size("__name") > 0) & F.col("ticker").isNotNull()).distinct()
    said = asked.select(key, "__words", F.posexplode("__words").alias("at", "__first"))
    first = listed.withColumn("__first", F.get("__name", F.lit(0)))
    # Spark takes the size of the file for that of the words said, and would send all of them through the driver
    first = F.broadcast(first) if listed.limit(NAMES_SENT + 1).count() <= NAMES_SENT else first.hint("merge")
    hits = said.join(first, "__first").filter(F.slice("__words", F.col("at") + 1, F.size("__name")) == F.col("__name"))
    hits = hits.select(key, "at", (F.col("at") + F.size("__name")).alias("until"), "ticker").distinct()
    # from the left, wider first: a mention is inside another if an earlier one, or a wider one of its start, ends no sooner
    before = Window.partitionBy(key).orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    spans = hits.withColumn("__widest", F.max("until").over(Window.partitionBy(key, "at"))).withColumn("__before", F.max("until").over(before))
    return spans.filter((F.col("until") == F.col("__widest")) & (F.col("__before").isNull() | (F.col("__before") < F.col("until")))).select(key, "at", "until", "ticker")


def named_object(question: Column) -> Column:
    """The words, without those of legal forms, of what is asked about "tại ... của công ty": two to ten, else null."""
    found = F.regexp_extract(norm(question), NAMED_OBJECT, 1)
    words = F.filter(F.split(found, " "), lambda x: (x != "") & ~x.isin(*FORM_WORDS))
    return F.when(F.size(words).between(2, 10), F.array_join(words, " "))


def holds_object(text: Column, anchor: Column) -> Column:
    """Does a text (label, section, context) have the object's words in a row? True without an object."""
    return anchor.isNull() | F.contains(F.concat(F.lit(" "), norm(text), F.lit(" ")), F.concat(F.lit(" "), anchor, F.lit(" ")))


def entity_guard(routed: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """One row a question (key, question, tickers): ok, mentioned, absent, anchor and reasons.

    ``mentioned`` are the companies that the question names for certain: symbols in brackets, brands, and names (ticker,
    alias) by ``mentions`` (an empty table adds none); ``absent`` those of them that the route lacks. Where companies
    share a name, one of them in the route is enough. Reasons: ``entity_absent``, and ``one_entity`` where something is
    subtracted or two parents are named and the route has fewer than two companies. Null tickers are none, null
    texts name nothing.
    """
    c = F.col
    brands = routed.sparkSession.createDataFrame([(t, b) for b, t in GUARDED_BRANDS], "ticker string, alias string")
    found = mentions(routed, names.select("ticker", "alias").unionByName(brands), key)
    spans = found.groupBy(key, "at", "until").agg(F.array_sort(F.collect_set("ticker")).alias("one_of"))
    spans = spans.groupBy(key).agg(F.collect_set("one_of").alias("__spans"))
    tagged = F.regexp_extract_all(F.coalesce("question", F.lit("")), F.lit(r"\(([A-Z][A-Z0-9]{1,4})\)"), F.lit(1))
    df = routed.select(key, "question", F.array_distinct(F.transform(F.filter(F.coalesce("tickers", F.array().cast("array<string>")), lambda x: x.isNotNull() & (F.trim(x) != "")), lambda x: F.upper(F.trim(x)))).alias("__routed"), F.array_distinct(tagged).alias("__tags"))
    df = df.join(spans, key, "left")
    groups = F.concat(F.transform("__tags", lambda x: F.array(x)), F.coalesce("__spans", F.array().cast("array<array<string>>")))
    df = df.withColumn("__groups", groups)
    lost = F.filter("__groups", lambda g: ~F.arrays_overlap(g, c("__routed")))
    plain = norm(c("question"))
    few = (plain.contains(SUBTRACTED) | (F.regexp_count(plain, F.lit(PARENTS)) >= 2)) & (F.size("__routed") < 2)
    reasons = F.array_compact(F.array(F.when(F.size(lost) > 0, "entity_absent"), F.when(few, "one_entity")))
    flat = lambda x: F.array_sort(F.array_distinct(F.flatten(x)))
    return df.select(key, (F.size(reasons) == 0).alias("ok"), flat(c("__groups")).alias("mentioned"), flat(lost).alias("absent"), named_object(c("question")).alias("anchor"), reasons.alias("reasons"))


def guarded_slots(slots: DataFrame, guard: DataFrame, key: str) -> DataFrame:
    """The slots with anchor, grounded and reasons of their question: a plan for other companies, or one that lacks a quantity, is not grounded.

    slots as of ``slots.plan_slots``. A question without a row in the guard is not grounded (``not_guarded``).
    """
    g = guard.select(key, "anchor", F.col("ok").alias("__ok"), F.col("reasons").alias("__reasons"))
    df = slots.join(g, key, "left")
    reasons = F.concat(F.coalesce("__reasons", F.array(F.lit("not_guarded"))), F.when(F.size(F.coalesce("missing", F.array().cast("array<string>"))) > 0, F.array(F.lit("leaf_missing"))).otherwise(F.array().cast("array<string>")))
    return df.withColumn("grounded", F.size(reasons) == 0).withColumn("reasons", reasons).drop("__ok", "__reasons")
