"""Registered queries of what is kept on disk: vector index, bucketed store, chunked runs, seals; of misspelt names, whole reports
and the reports that answer for a year.

Importing this module adds them to the catalog. What they keep goes to a new folder under ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import entities, report, router, vectors
from ledgerlens.plans.catalog import SQL, query, t
from ledgerlens.sources import bucketed, chunks
from ledgerlens.sources.shared import shared_folder


@query(SQL["cosine_topk"])
def vector_index_topk(spark, d):
    """Two builds of the index (the second brings the odd ids), then the ten nearest of every id that 20 divides."""
    e = t(spark, d, "embeddings")
    folder = shared_folder(spark, "vectors")
    vectors.VectorIndex(spark, folder).extend(e.filter("vec_id % 2 = 0"))
    index = vectors.VectorIndex(spark, folder)
    index.extend(e)
    return index.search(e.filter("vec_id % 20 = 0"), 10).withColumn("rank", F.col("rank").cast("long"))


@query("""select o_orderkey, l_linenumber::bigint as l_linenumber, l_extendedprice, l_quantity from orders join lineitem on l_orderkey = o_orderkey and l_linenumber = o_orderkey % 5 + 1""")
def bucketed_join(spark, d):
    """The lines that orders ask for, from a store of all lines: orders are dealt, lines stay."""
    li = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").cast("long"), "l_extendedprice", "l_quantity")
    store = bucketed.BucketedStore.write(li, shared_folder(spark, "store"), ["o_orderkey", "l_linenumber"], int(spark.conf.get("spark.sql.shuffle.partitions")))
    asked = t(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 5 + 1).alias("l_linenumber"))
    return store.join(asked).select("o_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")


@query("""select l_orderkey, count(*) as lines, sum(cast(l_extendedprice as decimal(20, 2)))::double as total from lineitem group by l_orderkey""")
def resumed_chunks(spark, d):
    """Totals of orders in four chunks; the first run ends after two of them, the second makes the others."""
    folder, parameters = shared_folder(spark, "chunks"), {"of": "lineitem", "chunks": 4}

    def totals(rows):
        return lambda: rows().groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.col("l_extendedprice").cast("decimal(20,2)")).cast("double").alias("total"))

    all_of = {n: totals(rows) for n, rows in chunks.hashed_chunks(t(spark, d, "lineitem"), "l_orderkey", 4).items()}
    chunks.ChunkedRun(spark, folder, parameters).run(dict(list(all_of.items())[:2]))
    again = chunks.ChunkedRun(spark, folder, parameters)
    again.run(all_of)
    return again.read()


_SHOWN = " || chr(30) || ".join(f"'{c}' || chr(31) || coalesce({c}::varchar, chr(0))" for c in ("o_custkey", "o_orderkey", "o_orderstatus"))


@query(f"""with r as (select o_orderpriority, sha256({_SHOWN}) as d from orders), p as (select o_orderpriority, ('0x' || d[1:8])::bigint % 4096 as part, sha256(string_agg(d, '' order by d)) as p, count(*) as n from r group by all)
select o_orderpriority, sha256(string_agg(p, '' order by part)) as seal, sum(n)::bigint as rows from p group by 1""")
def sealed_splits(spark, d):
    """A seal of the orders of each priority."""
    return chunks.seal(t(spark, d, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus"], ["o_orderpriority"])


@query("""select p_partkey, upper(p_name) as ticker, 'fuzzy' as source from part""")
def misspelt_names(spark, d):
    """Each part asked for by its name with the last letter wrong, against all names."""
    p = t(spark, d, "part")
    companies = p.select(F.col("p_name").alias("ticker"), F.col("p_name").alias("name")).distinct()
    asked = p.select("p_partkey", F.concat(F.expr("left(p_name, length(p_name) - 1)"), F.lit("q")).alias("question"))
    return entities.find_tickers(asked, companies, "p_partkey").select("p_partkey", F.get("tickers", F.lit(0)).alias("ticker"), "source")


@query("""with o as (select c_custkey, c_custkey % 2 = 0 as even, count(o_orderkey) as n, max(o_orderkey) as last from customer left join orders on o_custkey = c_custkey group by all),
live as (select * from o where c_custkey % 11 <> 0)
select c_custkey::varchar as report_id, 0 as table_pos, n::int + 1 as n_rows, 3 as n_cols, coalesce(last::varchar, 'Price') as shown, case when even then 1e6 end::double as unit_scale, case when even then 'explicit' else 'none' end as unit_source, null as problem from live
union all select c_custkey::varchar, 1, 2, 2, n::varchar, case when c_custkey % 3 = 0 then 1e9 when even then 1e6 end::double, case when c_custkey % 3 = 0 then 'explicit' when even then 'sticky' else 'none' end, null from live
union all select c_custkey::varchar, 2, null, null, null, null, null, case when c_custkey % 2 = 0 then 'empty_table' else 'unclosed_table' end from live where c_custkey % 5 = 0
union all select c_custkey::varchar, null, null, null, null, null, null, 'empty_report' from o where c_custkey % 11 = 0""")
def report_parse(spark, d):
    """A report for each customer: its orders, a table with spans, broken ones; tables with units, and the quarantine."""
    c, o = t(spark, d, "customer"), t(spark, d, "orders")
    lines = c.join(o, c.c_custkey == o.o_custkey, "left").groupBy("c_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("keys"))
    row = lambda k: F.concat(F.lit("<tr><td>Order</td><td>"), k.cast("string"), F.lit("</td></tr>\n"))
    key, n = F.col("c_custkey"), F.size("keys").cast("string")
    first = F.concat(F.when(key % 2 == 0, "<p>Đơn vị tính: triệu đồng</p>").otherwise("<p>Bảng</p>"), F.lit("<table>\n<tr><th>Label</th><th colspan='2'>Price</th></tr>\n"), F.array_join(F.transform("keys", row), ""), F.lit("</TABLE >\nPAGE 2\n"))
    unit = F.when(key % 3 == 0, "ĐVT: tỷ đồng").otherwise("Lines")
    second = F.concat(F.lit("<table class=x><tr><td rowspan=2>"), unit, F.lit("</td><td>Count</td></tr><tr><td>"), n, F.lit("</td></tr></table>"))
    broken = F.when(key % 5 != 0, "").when(key % 2 == 0, "<table></table>").otherwise("<table><tr><td>lost")
    reports = lines.select(key.cast("string").alias("report_id"), (key % 7).cast("string").alias("ticker"), F.when(key % 11 != 0, F.concat(first, second, broken)).alias("text"))
    found = report.parsed_reports(reports)
    shown = F.when(F.col("problem").isNull(), F.get(F.element_at("grid", -1), F.lit(1)))
    sized = lambda grid: F.when(F.col("problem").isNull(), F.size(grid))
    return found.select("report_id", "table_pos", sized("grid").alias("n_rows"), sized(F.get("grid", F.lit(0))).alias("n_cols"), shown.alias("shown"), "unit_scale", "unit_source", "problem")


_KINDS = ("consolidated", "separate", "aggregated", "other")


@query("""with k as (select ['consolidated', 'separate', 'aggregated', 'other'] as kinds),
y as (select min(year(o_orderdate)) as first, max(year(o_orderdate)) - min(year(o_orderdate)) + 1 as n from orders),
a as (select c_custkey, (first + c_custkey % n)::int as year, kinds[c_custkey % 4 + 1] as doc_type from customer, k, y),
r as (select o_orderkey, o_custkey, year(o_orderdate)::int as of, kinds[o_orderkey % 4 + 1] as kind from orders, k),
p as (select a.*, o_orderkey, 10 * (of - year) + case when kind = doc_type then 0 when doc_type = 'consolidated' then case kind when 'separate' then 1 when 'aggregated' then 2 else 3 end
  when doc_type = 'separate' then case kind when 'consolidated' then 1 when 'aggregated' then 2 else 3 end when kind = 'consolidated' then 1 when doc_type = 'aggregated' and kind = 'other' or doc_type = 'other' and kind = 'aggregated' then 2 end as tier
  from a join r on o_custkey = c_custkey and of in (year, year + 1)),
b as (select * from p where tier is not null qualify tier = min(tier) over (partition by c_custkey))
select a.c_custkey, a.year, o_orderkey as report_id, case when tier is null then 'missing' when tier = 0 then 'exact' when tier < 10 then 'other_kind' else 'next_year' end as note from a left join b using (c_custkey)""")
def reports_of_year(spark, d):
    """For each customer a year and kind of report: its orders stand for reports; other kinds, then the next year, stand in."""
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"))
    first, n = o.agg(F.min("year"), F.max("year") - F.min("year") + 1).first()
    kind = lambda key: F.get(F.array(*map(F.lit, _KINDS)), (F.col(key) % 4).cast("int"))
    asked = t(spark, d, "customer").select("c_custkey", F.col("c_custkey").alias("ticker"), (F.lit(first) + F.col("c_custkey") % F.lit(n)).cast("int").alias("year"), kind("c_custkey").alias("doc_type"))
    reports = o.select(F.col("o_orderkey").alias("report_id"), F.col("o_custkey").alias("ticker"), "year", kind("o_orderkey").alias("doc_type"))
    return router.lock_reports(asked, reports, "c_custkey").select("c_custkey", "year", "report_id", "note")
