"""Registered queries of the table question-answering operators, each beside the SQL with the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import fuzzy, metric, numbers, text
from ledgerlens.operators import assign, entities, extract, joins, metrics, ranking, repair, router, sampling, selection, shortlist, slots, solve
from ledgerlens.plans import expressions, ir
from ledgerlens.sources import submission

QUERIES = {}
SQL = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def t(spark, d, name) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def year(col: str):
    return F.year(col).cast("long")


def _revenue(spark, d) -> DataFrame:
    """Long cells: nation, year, revenue, discount, tax (money), quantity."""
    li, o = t(spark, d, "lineitem"), t(spark, d, "orders")
    c, n = t(spark, d, "customer"), t(spark, d, "nation")
    rows = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    money = lambda x: F.round(F.sum(x.cast("decimal(20,6)")), 2).cast("double")
    return rows.groupBy(F.col("n_name").alias("entity"), year("o_orderdate").alias("year")).agg(
        money(F.col("l_extendedprice")).alias("revenue"),
        money(F.col("l_extendedprice") * F.col("l_discount")).alias("discount"),
        money(F.col("l_extendedprice") * F.col("l_tax")).alias("tax"),
        F.sum("l_quantity").alias("quantity"),
    )


_CELLS = """cells as (select n_name as entity, year(o_orderdate) as year,
  cast(round(sum(cast(l_extendedprice as decimal(20,6))), 2) as double) as revenue,
  cast(round(sum(cast(l_extendedprice * l_discount as decimal(20,6))), 2) as double) as discount,
  cast(round(sum(cast(l_extendedprice * l_tax as decimal(20,6))), 2) as double) as tax, sum(l_quantity) as quantity
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
  join nation on c_nationkey = n_nationkey group by all)"""


def _program_facts(spark, d, metric_names: list[str], years: int = 3) -> DataFrame:
    """One row per entity: <metric>_<i> for its first years, as facts of a program."""
    w = Window.partitionBy("entity").orderBy("year")
    cells = _revenue(spark, d).withColumn("i", F.row_number().over(w)).filter(F.col("i") <= years)
    slots = [f"{m}_{i}" for m in metric_names for i in range(1, years + 1)]
    long = cells.select("entity", F.explode(F.array(*(F.struct(F.concat(F.lit(f"{m}_"), F.col("i").cast("string")).alias("slot"), F.col(m).alias("value")) for m in metric_names))).alias("c")).select("entity", "c.*")
    return ir.pivot_facts(long, ["entity"], "slot", "value", slots)


_FIRST = _CELLS + """, ranked as (select *, row_number() over (partition by entity order by year) as i from cells),
  p as (select entity, """ + ", ".join(f"max({m}) filter (i = {i}) as {m}_{i}" for m in ("revenue", "discount", "tax") for i in (1, 2, 3)) + " from ranked group by entity)"


def _facts(*names: str) -> dict:
    return {n: {"type": "money"} for n in names}


def f(name: str) -> dict:
    return {"fact": name}


def op(name: str, *args, **more) -> dict:
    return {"op": name, "args": list(args), **more}


def _status(x: str) -> str:
    return f"select entity, round({x}, 2) + 0.0 as answer, case when ({x}) is null then 'execution_failed' else 'ok' end as status from p"


GROWTH = {"facts": _facts("revenue_1", "revenue_2"), "root": op("growth_percent", f("revenue_1"), f("revenue_2")), "output": "percent"}


def entry(spark, sf_dir):
    """Growth of revenue between the first two years of each nation."""
    return ir.answer(_program_facts(spark, sf_dir, ["revenue"], 2), GROWTH, ["entity"])


def _program(name: str, program: dict, metric_names: list[str], sql: str):
    def run(spark, d):
        return ir.answer(_program_facts(spark, d, metric_names), program, ["entity"])

    QUERIES[name] = run
    SQL[name] = f"with {_FIRST} {_status(sql)}"


_R, _D, _T = ([f(f"{m}_{i}") for i in (1, 2, 3)] for m in ("revenue", "discount", "tax"))
_ratio = [op("divide", d_, r) for d_, r in zip(_D, _R)]
_program("ir_growth", GROWTH, ["revenue"], "case when revenue_1 <> 0 then (revenue_2 - revenue_1) / abs(revenue_1) * 100 end")
_program("ir_cagr", {"facts": _facts("revenue_1", "revenue_3"), "root": op("cagr", _R[0], _R[2], {"lit": 2}), "output": "percent"}, ["revenue"], "(pow(revenue_3 / revenue_1, 1.0 / 2) - 1) * 100")
_program("ir_ratio_percent", {"facts": _facts("discount_1", "revenue_1"), "root": _ratio[0], "output": "percent"}, ["revenue", "discount"], "discount_1 / revenue_1 * 100")
_program("ir_average_median", {"facts": _facts("revenue_1", "revenue_2", "revenue_3"), "bindings": {"m": op("median", *_R)}, "root": op("subtract", op("average", *_R), {"var": "m"}), "output": "money"}, ["revenue"], "(revenue_1 + revenue_2 + revenue_3) / 3 - list_median([revenue_1, revenue_2, revenue_3])".replace("list_median", "list_aggregate").replace("revenue_3])", "revenue_3], 'median')"))
_program("ir_count_improving", {"facts": _facts(*(f"{m}_{i}" for m in ("revenue", "discount") for i in (1, 2, 3))), "root": op("count_true", op("gt", _ratio[1], _ratio[0]), op("gt", _ratio[2], _ratio[1])), "output": "count"}, ["revenue", "discount"], "cast((discount_2 / revenue_2 > discount_1 / revenue_1)::int + (discount_3 / revenue_3 > discount_2 / revenue_2)::int as double)")
_program("ir_argmax_project_when", {"facts": _facts(*(f"{m}_{i}" for m in ("revenue", "discount", "tax") for i in (1, 2, 3))), "root": {"op": "argmax_project", "scores": _ratio, "results": _T, "when": [op("gt", r, x) for r, x in zip(_R, _T)]}, "output": "money"}, ["revenue", "discount", "tax"], "case when discount_1 / revenue_1 >= discount_2 / revenue_2 and discount_1 / revenue_1 >= discount_3 / revenue_3 then tax_1 when discount_2 / revenue_2 >= discount_3 / revenue_3 then tax_2 else tax_3 end")
_program("ir_point_change", {"facts": _facts("revenue_1", "revenue_2", "discount_1", "discount_2"), "root": op("percentage_point", _ratio[1], _ratio[0]), "output": "percentage_point"}, ["revenue", "discount"], "(discount_2 / revenue_2 - discount_1 / revenue_1) * 100")
_program("ir_scenario", {"facts": _facts("revenue_1"), "root": op("increase_percent", _R[0], {"lit": 7.3, "type": "percent"}), "output": "money"}, ["revenue"], "revenue_1 + revenue_1 * 7.3::double / 100")
_program("ir_if_else", {"facts": _facts("revenue_1", "revenue_2"), "root": op("if_else", op("gt", _R[0], _R[1]), op("subtract", _R[0], _R[1]), {"lit": 0}), "output": "money"}, ["revenue"], "case when revenue_1 > revenue_2 then revenue_1 - revenue_2 else 0 end")


@query("with " + _CELLS + """, r as (select *, discount / revenue as ratio from cells),
m as (select entity, median(ratio) as m from r group by entity)
select r.entity, round((avg(revenue) filter (ratio > m)) - (avg(revenue) filter (ratio <= m)), 4) as gap from r join m using (entity) group by r.entity""")
def shape_median_partition(spark, d):
    r = _revenue(spark, d).withColumn("ratio", F.col("discount") / F.col("revenue"))
    m = r.groupBy("entity").agg(F.median("ratio").alias("m"))
    above = F.col("ratio") > F.col("m")
    return r.join(m, "entity").groupBy("entity").agg(F.round(F.avg(F.when(above, F.col("revenue"))) - F.avg(F.when(~above, F.col("revenue"))), 4).alias("gap"))


@query("with " + _CELLS + """, r as (select entity, year, discount / revenue as ratio, lead(tax / revenue) over (partition by entity order by year) as next_tax from cells)
select entity, round(arg_min(next_tax, ratio) filter (next_tax is not null), 6) as next_tax from r group by entity""")
def shape_argmin_next_year(spark, d):
    nxt = F.lead(F.col("tax") / F.col("revenue")).over(Window.partitionBy("entity").orderBy("year"))
    r = _revenue(spark, d).select("entity", "year", (F.col("discount") / F.col("revenue")).alias("ratio"), nxt.alias("next_tax"))
    return r.filter("next_tax is not null").groupBy("entity").agg(F.round(F.min_by("next_tax", F.struct("ratio", "year")), 6).alias("next_tax"))


@query("with " + _CELLS + """, g as (select entity, year, revenue > lag(revenue) over (partition by entity order by year) as up, revenue from cells)
select entity, cast(count(*) filter (up) as bigint) as rising_years, round(sum(revenue) filter (up), 2) as rising_revenue from g group by entity""")
def shape_conditional_sum(spark, d):
    up = F.col("revenue") > F.lag("revenue").over(Window.partitionBy("entity").orderBy("year"))
    return _revenue(spark, d).withColumn("up", up).groupBy("entity").agg(F.count_if("up").alias("rising_years"), F.round(F.sum(F.when(F.col("up"), F.col("revenue"))), 2).alias("rising_revenue"))


@query("with " + _CELLS + """, e as (select entity, bool_and(discount / revenue > 0.04) as always, sum(revenue) as total from cells group by entity)
select round(sum(total) filter (always), 2) as held, cast(count(*) filter (always) as bigint) as n from e""")
def shape_every_year(spark, d):
    e = _revenue(spark, d).groupBy("entity").agg(F.bool_and(F.col("discount") / F.col("revenue") > 0.04).alias("always"), F.sum("revenue").alias("total"))
    return e.agg(F.round(F.sum(F.when(F.col("always"), F.col("total"))), 2).alias("held"), F.count_if("always").alias("n"))


@query("with " + _CELLS + """, m as (select year, median(revenue) as m from cells group by year)
select c.year, round((sum(revenue) filter (revenue < m)) / sum(revenue) * 100, 4) as share from cells c join m using (year) group by c.year""")
def shape_below_median_share(spark, d):
    c = _revenue(spark, d)
    m = c.groupBy("year").agg(F.median("revenue").alias("m"))
    return c.join(m, "year").groupBy("year").agg(F.round(F.sum(F.when(F.col("revenue") < F.col("m"), F.col("revenue"))) / F.sum("revenue") * 100, 4).alias("share"))


@query("with " + _CELLS + """, a as (select entity, year, revenue / ((quantity + lag(quantity) over (partition by entity order by year)) / 2) as turn from cells)
select entity, round(max(turn), 4) as best, arg_max(year, turn) as best_year from a group by entity""")
def shape_average_balance(spark, d):
    w = Window.partitionBy("entity").orderBy("year")
    turn = F.col("revenue") / ((F.col("quantity") + F.lag("quantity").over(w)) / 2)
    a = _revenue(spark, d).select("entity", "year", turn.alias("turn"))
    return a.groupBy("entity").agg(F.round(F.max("turn"), 4).alias("best"), F.max_by("year", F.struct("turn", -F.col("year"))).alias("best_year"))


@query("select o_orderkey, o_custkey, o_totalprice from orders where o_orderstatus = 'F' and o_totalprice > 100000")
def scan_filter_project(spark, d):
    return t(spark, d, "orders").filter("o_orderstatus = 'F' and o_totalprice > 100000").select("o_orderkey", "o_custkey", "o_totalprice")


@query("select cast(n_nationkey as varchar) as doc_key, 0::bigint as table_pos, n_name as label, cast(n_nationkey + 0.5 as double) as value from nation")
def html_grid_roundtrip(spark, d):
    html = F.format_string("<p>PAGE 1</p><table><tr><th>name</th><th>value</th></tr><tr><td>%s</td><td>%d,5</td></tr></table>", "n_name", "n_nationkey")
    docs = t(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("doc_key"), html.alias("text"))
    tables = extract.find_tables(docs).select("doc_key", F.col("table_pos").cast("long"), "grid")
    return extract.cells(tables).select("doc_key", "table_pos", "label", "value")


@query("select page_id, length(regexp_replace(html, '<[^>]+>', '', 'g')) as plain_chars, length(html) - length(replace(html, '<', '')) as marks from pages")
def page_tag_strip(spark, d):
    return t(spark, d, "pages").select("page_id", F.length(F.regexp_replace("html", "<[^>]+>", "")).cast("long").alias("plain_chars"), (F.length("html") - F.length(F.replace("html", F.lit("<")))).cast("long").alias("marks"))


@query("select c_custkey, c_acctbal from customer where c_custkey % 10 <> 0 union all select c_custkey, 0.0 from customer where c_custkey % 10 = 0")
def incremental_upsert(spark, d):
    c = t(spark, d, "customer").select("c_custkey", "c_acctbal")
    return joins.upsert(c, c.filter("c_custkey % 10 = 0").withColumn("c_acctbal", F.lit(0.0)), "c_custkey")


@query("select l_orderkey, cast(l_linenumber as bigint) as line, metric, value from (unpivot (select l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax from lineitem) on l_quantity, l_extendedprice, l_discount, l_tax into name metric value value)")
def cell_unpivot(spark, d):
    return t(spark, d, "lineitem").unpivot(["l_orderkey", F.col("l_linenumber").cast("long").alias("line")], ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "metric", "value")


@query("select p_brand, arg_min(p_retailprice, p_partkey) as price, min(p_partkey) as p_partkey from part where contains(lower(p_name), 'a') group by p_brand")
def contains_first_match(spark, d):
    p = t(spark, d, "part").filter(F.contains(F.lower("p_name"), F.lit("a")))
    return p.groupBy("p_brand").agg(F.min_by("p_retailprice", "p_partkey").alias("price"), F.min("p_partkey").alias("p_partkey"))


@query("select l_orderkey, l_partkey, l_quantity from lineitem qualify count(*) over (partition by l_orderkey, l_partkey) = 1")
def verified_facts(spark, d):
    w = Window.partitionBy("l_orderkey", "l_partkey")
    return t(spark, d, "lineitem").withColumn("n", F.count(F.lit(1)).over(w)).filter("n = 1").select("l_orderkey", "l_partkey", "l_quantity")


@query("select c_custkey, c_name, o_orderkey from customer left join orders on c_custkey = o_custkey")
def left_metadata_join(spark, d):
    c, o = t(spark, d, "customer"), t(spark, d, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left").select("c_custkey", "c_name", "o_orderkey")


@query("""select o_custkey, o_orderkey, tier from (select *, min(tier) over (partition by o_custkey) as least from (
select o_custkey, o_orderkey, cast(case o_orderstatus when 'F' then 1 when 'O' then 2 else 3 end as bigint) as tier from orders)) where tier = least""")
def tiered_fallback_join(spark, d):
    tier = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3).cast("long")
    return joins.tiered(t(spark, d, "orders"), ["o_custkey"], tier).select("o_custkey", "o_orderkey", "tier")


@query("""select a.entity, a.year, b.year as report_year, b.revenue from cells a join cells b on a.entity = b.entity and b.year between a.year and a.year + 1""".join(["with " + _CELLS + " ", ""]))
def band_year_join(spark, d):
    a = _revenue(spark, d)
    b = a.select(F.col("entity").alias("e"), F.col("year").alias("report_year"), "revenue")
    return a.select("entity", "year").join(b, (F.col("entity") == F.col("e")) & F.col("report_year").between(F.col("year"), F.col("year") + 1)).select("entity", "year", "report_year", "revenue")


@query("select r_name, n_name, y as year from region cross join nation cross join (select unnest([2020, 2021])::bigint as y) where r_regionkey = n_regionkey")
def facts_grid(spark, d):
    r, n = t(spark, d, "region"), t(spark, d, "nation")
    return n.join(r, n.n_regionkey == r.r_regionkey).select("r_name", "n_name", F.explode(F.array(F.lit(2020), F.lit(2021)).cast("array<bigint>")).alias("year"))


@query("""with w as (select vec_id, embedding from embeddings where vec_id % 20 = 0),
s as (select w.vec_id as query_id, e.vec_id, round(list_cosine_similarity(w.embedding::double[], e.embedding::double[]), 6) as score from w join embeddings e on true)
select query_id, vec_id, score, cast(row_number() over (partition by query_id order by score desc, vec_id) as bigint) as rank from s qualify rank <= 10""")
def cosine_topk(spark, d):
    e = t(spark, d, "embeddings")
    found = ranking.cosine_top_k(e.filter("vec_id % 20 = 0"), e, 10)  # the stated query set against all rows, in blocks
    return found.withColumn("rank", F.col("rank").cast("long"))


@query(r"""with d as (select doc_id, regexp_extract_all(lower(text), '[a-z]+') as terms from documents),
q as (select item_id as query_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) as term from benchmark),
st as (select count(*) as n, avg(len(terms)) as a from d),
tf as (select doc_id, len(terms) as dl, term, count(*) as tf from (select doc_id, terms, unnest(terms) as term from d) where term in (select term from q) group by all),
df as (select term, count(*) as df from tf group by term),
s as (select query_id, doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))), 4) as score from tf join df using (term) join q using (term), st group by all)
select query_id, doc_id, score from s qualify row_number() over (partition by query_id order by score desc, doc_id) <= 20""")
def bm25_topk(spark, d):
    terms = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0))
    docs = t(spark, d, "documents").select("doc_id", terms("text").alias("terms"))
    asked = t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), terms("text").alias("terms"))
    return ranking.bm25_top_k(docs, asked, 20).drop("rank")


@query("""select event_id, coalesce(m, -1.0) as mark from (select event_id, last_value(case when event_type = 'view' then value end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as m from events)""")
def sticky_last_value(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.last(F.when(F.col("event_type") == "view", F.col("value")), ignorenulls=True).over(w)
    return t(spark, d, "events").select("event_id", F.coalesce(mark, F.lit(-1.0)).alias("mark"))


@query("""with l as (select event_id, user_id, ts from events where event_type <> 'view'), r as (select user_id, ts, max(event_id) as page from events where event_type = 'view' group by all)
select l.event_id, r.page from l asof left join r on l.user_id = r.user_id and l.ts >= r.ts""")
def asof_page_lookup(spark, d):
    e = t(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    r = e.filter("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("event_id").alias("page"))
    return joins.as_of(e.filter("event_type <> 'view'").select("event_id", "user_id", "ts"), r, ["user_id"], "ts", "page").select("event_id", "page")


@query("select c_custkey, exists (select 1 from orders where o_custkey = c_custkey) as has_orders from customer")
def semi_anti_mask(spark, d):
    c, o = t(spark, d, "customer").select("c_custkey"), t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_semi").withColumn("has_orders", F.lit(True)).union(c.join(o, "c_custkey", "left_anti").withColumn("has_orders", F.lit(False)))


@query("select o_orderkey, case when o_orderstatus = 'O' and o_orderkey % 2 = 0 then -1.0 else o_totalprice end as o_totalprice from orders")
def coalesce_merge(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return joins.overlay(o, o.filter("o_orderkey % 2 = 0").withColumn("o_totalprice", F.lit(-1.0)), "o_orderkey", ["o_totalprice"], F.col("o_orderstatus") == "O").drop("o_orderstatus")


@query("""with a as (select distinct c_custkey as k from customer), b as (select distinct o_custkey as k from orders)
select count(*) filter (b.k is null) as only_left, count(*) filter (a.k is null) as only_right, count(*) filter (a.k is not null and b.k is not null) as in_both from a full join b on a.k = b.k""")
def universe_gate(spark, d):
    return joins.universe_gate(t(spark, d, "customer").select(F.col("c_custkey").alias("k")), t(spark, d, "orders").select(F.col("o_custkey").alias("k")), "k")


@query("""select a.o_orderkey, b.o_orderkey as other from orders a join orders b on a.o_custkey = b.o_custkey and a.o_orderkey < b.o_orderkey and abs(a.o_totalprice - b.o_totalprice) <= greatest(1.0, abs(b.o_totalprice) * 0.01)""")
def adjacent_equal_join(spark, d):
    a = t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return joins.near_pairs(a, ["o_custkey"], "o_orderkey", "o_totalprice", 0.01)


@query("select l_returnflag, sum(l_quantity) as total, round(avg(l_quantity), 4) as mean, median(l_quantity) as middle, min(l_quantity) as low, max(l_quantity) as high from lineitem group by l_returnflag")
def sum_avg_median(spark, d):
    q = "l_quantity"
    return t(spark, d, "lineitem").groupBy("l_returnflag").agg(F.sum(q).alias("total"), F.round(F.avg(q), 4).alias("mean"), F.median(q).alias("middle"), F.min(q).alias("low"), F.max(q).alias("high"))


@query("select o_custkey, count(*) filter (o_totalprice > 150000) as big, count(*) as n from orders group by o_custkey")
def count_true(spark, d):
    return t(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_totalprice") > 150000).alias("big"), F.count(F.lit(1)).alias("n"))


@query("select user_id, answer, votes from (select user_id, round(value, 0) as answer, count(*) as votes, min(event_id) as f from events group by all) qualify row_number() over (partition by user_id order by votes desc, f) = 1")
def vote_mode(spark, d):
    e = t(spark, d, "events")
    counted = metrics.vote(e.withColumn("value", F.round("value", 0)), "user_id", "value", "event_id")
    return counted


@query("select o_custkey, min(o_orderpriority) as value, count(*) as support from orders group by o_custkey having count(distinct o_orderpriority) = 1")
def consensus_cluster(spark, d):
    return metrics.consensus(t(spark, d, "orders"), "o_custkey", F.col("o_orderpriority"))


@query("""select l_returnflag, l_linestatus, sum(l_quantity) as total, count(*) as n from lineitem group by grouping sets ((l_returnflag), (l_linestatus), ())""")
def grouping_sets_report(spark, d):
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    return t(spark, d, "lineitem").groupingSets([[flag], [status], []], flag, status).agg(F.sum("l_quantity").alias("total"), F.count(F.lit(1)).alias("n"))


@query("""with g as (select c_mktsegment as s, count(*) as n from customer group by 1),
b as (select s, n, (100 - count(*) over ())::hugeint * (n - 1) as share, (sum(n - 1) over ())::hugeint as caps from g),
q as (select s, n, share // caps as whole, share % caps as part, 100 - count(*) over () - sum(share // caps) over () as rest from b)
select s, n, cast(1 + whole + (row_number() over (order by part desc, s) <= rest)::int as bigint) as quota from q""")
def stratified_allocation(spark, d):
    g = t(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return sampling.allocate(g, "s", "n", 100)


@query("""select c_custkey, cast(('0x' || sha256('seed|' || c_custkey)[1:8])::bigint % 100 as bigint) as bucket from customer""")
def hash_split(spark, d):
    return t(spark, d, "customer").select("c_custkey", sampling.hash_percent("seed", "c_custkey").alias("bucket"))


@query("""select c_custkey, c_mktsegment from customer qualify row_number() over (partition by c_mktsegment order by sha256('s|' || c_mktsegment || '|' || c_custkey), c_custkey) <= 12""")
def quota_sample(spark, d):
    return sampling.quota_sample(t(spark, d, "customer"), "c_mktsegment", "c_custkey", 12, "s").select("c_custkey", "c_mktsegment")


@query("""with a as (select l_orderkey as q, l_suppkey % 3 as g, l_extendedprice as score, l_linenumber as pos from lineitem),
n as (select q, count(distinct g) as groups from a group by q),
r as (select a.*, groups, row_number() over (partition by a.q, g order by score desc, pos) as rn from a join n using (q)),
f as (select *, (rn > greatest(1, 3 // groups))::int as fill from r)
select q, cast(pos as bigint) as pos, score from f qualify row_number() over (partition by q order by fill, score desc, pos) <= 3""")
def quota_topk(spark, d):
    a = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("q"), (F.col("l_suppkey") % 3).alias("g"), F.col("l_extendedprice").alias("score"), F.col("l_linenumber").cast("long").alias("pos"))
    return ranking.quota_top_k(a, "q", "g", "score", "pos", 3).select("q", "pos", "score")


@query("""select o_custkey, o_orderkey, round(o_totalprice - second, 2) as gap from (select *, lead(o_totalprice) over w as second, row_number() over w as r from orders window w as (partition by o_custkey order by o_totalprice desc, o_orderkey)) where r = 1""")
def runner_up_gap(spark, d):
    return ranking.runner_up_gap(t(spark, d, "orders"), "o_custkey", "o_totalprice", "o_orderkey").select("o_custkey", "o_orderkey", F.round("gap", 2).alias("gap"))


@query("""select o_custkey, o_orderkey from orders qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) <= 1 + o_custkey % 3""")
def dynamic_budget_limit(spark, d):
    return ranking.top_k(t(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 1 + F.col("o_custkey") % 3).select("o_custkey", "o_orderkey")


@query("""select l_orderkey, l_linenumber::bigint as line from lineitem qualify row_number() over (partition by l_orderkey order by (l_returnflag = 'N')::int desc, l_discount desc, l_linenumber) = 1""")
def best_column_pick(spark, d):
    keys = [F.desc(F.col("l_returnflag") == "N"), F.desc("l_discount"), F.asc("l_linenumber")]
    return ranking.best_column(t(spark, d, "lineitem"), ["l_orderkey"], keys).select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"))


@query("""with a as (select o_custkey as k from orders where o_orderstatus = 'F'), b as (select o_custkey as k from orders where o_orderstatus = 'O')
select 'both' as kind, k from (select k from a intersect select k from b) union all select 'only_f', k from (select k from a except select k from b) union all select 'any', k from (select k from a union select k from b)""")
def set_ops(spark, d):
    o = t(spark, d, "orders")
    a, b = (o.filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k")) for s in "FO")
    tag = lambda kind, df: df.select(F.lit(kind).alias("kind"), "k")
    return tag("both", a.intersect(b)).union(tag("only_f", a.subtract(b))).union(tag("any", a.union(b).distinct()))


@query(r"""select doc_id, sha256(trim(regexp_replace(regexp_replace(lower(replace(replace(strip_accents(coalesce(text, '')), 'đ', 'd'), 'Đ', 'D')), '[^0-9a-z\s/%]', ' ', 'g'), '\s+', ' ', 'g'))) as norm_sha from documents""")
def text_normalize(spark, d):
    return t(spark, d, "documents").select("doc_id", F.sha2(text.norm(F.col("text")), 256).alias("norm_sha"))


@query("select l_orderkey, l_linenumber::bigint as line, l_extendedprice as value from lineitem")
def vn_number_parse(spark, d):
    li = t(spark, d, "lineitem")
    raw = F.translate(F.format_number("l_extendedprice", 2), ",.", ".,")
    return li.select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), numbers.parse_number(raw).alias("value"))


@query("select o_orderkey, case o_orderkey % 4 when 0 then 1e6 when 1 then 1e9 when 2 then 1e3 else null end::double as scale from orders")
def unit_detect(spark, d):
    words = F.element_at(F.array(*map(F.lit, ("Đơn vị tính: triệu đồng", "ĐVT: tỷ đồng", "Đơn vị: nghìn đồng", "Thuyết minh"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return t(spark, d, "orders").select("o_orderkey", numbers.detect_unit(text.norm(words)).alias("scale"))


@query("select l_orderkey, l_linenumber::bigint as line, round(case when l_linenumber % 2 = 0 or abs(l_discount) > 1.5 then l_discount else l_discount * 100 end, 4) as percent from lineitem")
def percent_from_cell(spark, d):
    label = F.when(F.col("l_linenumber") % 2 == 0, "rate %").otherwise("rate")
    return t(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), F.round(numbers.percent_from_cell(F.col("l_discount"), label), 4).alias("percent"))


@query("select n_nationkey::bigint as k, unnest(range(2015, 2015 + n_nationkey % 5 + 1)) as year from nation")
def year_range_expand(spark, d):
    q = F.format_string("revenue of %s in %d-%d", "n_name", F.lit(2015), (F.lit(2015) + F.col("n_nationkey") % 5).cast("int"))
    return t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.explode(text.extract_years(q)).alias("year")).withColumn("year", F.col("year").cast("long"))


@query("select o_orderkey, case when rule is null and model is null then 'none' when model is null then 'rule' when rule is null then 'model' when abs(rule - model) <= greatest(0.011, 1e-4 * greatest(abs(rule), abs(model))) then 'agree' when conf >= 78 then 'rule' else 'model' end as source from (select o_orderkey, case when o_orderkey % 5 <> 0 then o_totalprice end as rule, case when o_orderkey % 7 <> 0 then o_totalprice + (o_orderkey % 3) * 100 end as model, o_orderkey % 100 as conf from orders)")
def arbitration(spark, d):
    o = t(spark, d, "orders").selectExpr("o_orderkey", "case when o_orderkey % 5 <> 0 then o_totalprice end as rule", "case when o_orderkey % 7 <> 0 then o_totalprice + (o_orderkey % 3) * 100 end as model", "o_orderkey % 100 as conf")
    return o.select("o_orderkey", metrics.arbitrate(F.col("rule"), F.col("conf"), F.col("model"), numbers.agrees(F.col("rule"), F.col("model"))).alias("source"))


@query("select o_orderkey, case when kind = 'count' and v <> floor(v) then 'not_integer' when kind = 'percent' and abs(v) > 1e6 then 'out_of_range' when kind = 'percent' and v > 0 and v <= 1 then 'looks_like_ratio' else 'ok' end as status from (select o_orderkey, case when o_orderkey % 2 = 0 then 'percent' else 'count' end as kind, case when o_orderkey % 4 = 0 then o_totalprice / 1e6 else o_totalprice end as v from orders)")
def answer_guards(spark, d):
    o = t(spark, d, "orders").selectExpr("o_orderkey", "case when o_orderkey % 2 = 0 then 'percent' else 'count' end as kind", "case when o_orderkey % 4 = 0 then o_totalprice / 1e6 else o_totalprice end as v")
    return o.select("o_orderkey", metrics.guard(F.col("v"), F.col("kind")).alias("status"))


@query("""with g as (select lang, list(distinct doc_id order by doc_id) as gold from documents join labels using (doc_id) where quality = 1 group by lang), p as (select lang, list(distinct doc_id order by doc_id) as pred from documents where n_chars > 1000 group by lang),
h as (select lang, len(list_intersect(pred, gold)) as h, len(pred) as p, len(gold) as g from g join p using (lang))
select lang, round(case when h > 0 then 5 * (h / p) * (h / g) / (4 * (h / p) + h / g) else 0 end, 6) as f2 from h""")
def macro_f2(spark, d):
    docs, labels = t(spark, d, "documents").select("doc_id", "lang", "n_chars"), t(spark, d, "labels")
    # per language, hits and sizes are counts: no list of ids is gathered
    gold = labels.filter("quality = 1").select("doc_id").distinct().withColumn("gold", F.lit(1))
    rows = docs.join(gold, "doc_id", "left").withColumn("pred", (F.col("n_chars") > 1000).cast("int"))
    c = rows.groupBy("lang").agg(F.count_if((F.col("gold") == 1) & (F.col("pred") == 1)).alias("h"), F.sum("pred").alias("p"), F.count("gold").alias("g")).filter("p > 0 and g > 0")
    p, r = F.col("h") / F.col("p"), F.col("h") / F.col("g")
    return c.select("lang", F.round(F.when(F.col("h") > 0, 5 * p * r / (4 * p + r)).otherwise(0.0), 6).alias("f2"))


@query("select event_id, json_extract_string(props, '$.k') as k, length(props) as n from events")
def json_extract(spark, d):
    return t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.length("props").cast("long").alias("n"))


@query("""with s as (select o_orderpriority as s, avg((o_orderstatus = 'F')::int) filter (o_orderstatus <> 'P') as rate, count(*) as n, count(*) filter (o_orderstatus <> 'P') as m from orders group by 1)
select round((sum(rate * n) filter (m > 0)) / (sum(n) filter (m > 0)), 6) as weighted, round((sum(n) filter (m > 0)) / sum(n), 6) as represented, count(*) filter (m = 0) as missing from s""")
def post_stratified(spark, d):
    items = t(spark, d, "orders").filter("o_orderstatus <> 'P'").select("o_orderpriority", (F.col("o_orderstatus") == "F").alias("weighted"))
    population = t(spark, d, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("population"))
    return metrics.post_stratified(items, population, "o_orderpriority", ["weighted"])


@query()
def fuzzy_label_match(spark, d):
    labels = t(spark, d, "part").select(F.col("p_name").alias("label")).distinct()
    wanted = t(spark, d, "part").filter("p_partkey % 20 = 0").select(F.col("p_name").alias("metric")).distinct()  # the stated query set
    return fuzzy.similar_labels(labels, wanted, 70.0)


_ASKED = ("Tốc độ tăng trưởng doanh thu của %s năm 2021 là bao nhiêu phần trăm?", "Doanh thu của %s năm 2020 là bao nhiêu tỷ đồng?", "Năm nào %s có lợi nhuận cao nhất trong 2019-2021?", "Trung bình tài sản của %s năm 2020 và 2021 là bao nhiêu triệu đồng?")


def _questions(spark, d):
    words = F.element_at(F.array(*(F.format_string(q, "n_name") for q in _ASKED)), F.col("n_nationkey") % 4 + 1)
    return t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("qid"), "n_name", words.alias("question"))


@query("""select n_nationkey::bigint as qid, case n_nationkey % 4 when 0 then 'growth_pct' when 1 then 'lookup' when 2 then 'ranking' else 'average' end as op,
case n_nationkey % 4 when 0 then 'percent' when 2 then 'year' else 'number' end as output_type,
case n_nationkey % 4 when 1 then 1e9 when 3 then 1e6 else 1.0 end::double as unit_scale,
case n_nationkey % 4 when 0 then '2021' when 1 then '2020' when 2 then '2019,2020,2021' else '2020,2021' end as years from nation""")
def question_route(spark, d):
    r = router.route(_questions(spark, d))
    return r.select("qid", "op", "output_type", "unit_scale", F.array_join(F.col("years").cast("array<string>"), ",").alias("years"))


@query("""select n_nationkey::bigint as qid, n_name as ticker from nation""")
def containment_join(spark, d):
    names = t(spark, d, "nation").select(text.norm(F.col("n_name")).alias("alias"), F.col("n_name").alias("ticker"))
    return router.find_entities(router.route(_questions(spark, d)), names, "qid").select("qid", "ticker")


@query("""with t as (select n_nationkey, unnest(case when n_nationkey % 8 in (0, 1) then [n_name, 'other'] else [n_name] end) as ticker from nation)
select n_nationkey::bigint as qid, ticker, unnest(case n_nationkey % 8 when 0 then [2021] when 4 then [2021, 2020] when 1 then [2020] when 5 then [2020, 2019] when 2 then [2019, 2020, 2021] when 6 then [2019, 2020, 2021] else [2020, 2021] end)::bigint as year, 'value' as role from t""")
def fact_plan(spark, d):
    """Growth of one entity and of two, difference of one (5) and of two (1) in a year, rankings, averages."""
    r = router.route(_questions(spark, d)).withColumn("metric", F.lit("doanh thu"))
    r = r.withColumn("op", F.when(F.col("qid") % 4 == 1, "difference").otherwise(F.col("op")))
    r = r.withColumn("tickers", F.when((F.col("qid") % 8).isin(0, 1), F.array("n_name", F.lit("other"))).otherwise(F.array("n_name")))
    return router.plan_facts(r, "qid").select("qid", "ticker", F.col("year").cast("long").alias("year"), "role")


@query("""select o_custkey, count(*) as n, cast(least(12, 4 + 2 * greatest(count(*) - 1, 0)) as bigint) as budget from orders group by o_custkey""")
def evidence_budget(spark, d):
    o = t(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return o.select("o_custkey", "n", router.evidence_budget(F.col("n")).cast("long").alias("budget"))


@query("""select o_orderkey, case when o_orderkey % 3 = 0 then 'date' when o_orderkey % 3 = 1 then 'note' else 'prior' end as role, (case when o_orderkey % 3 = 0 then (case when year(o_orderdate) = 2023 then 10 else -30 end) else -6 end)::bigint as bonus,
(case when o_orderkey % 3 = 0 then 2023 when o_orderkey % 3 = 2 then year(o_orderdate) - 1 else year(o_orderdate) end)::bigint as grounded from orders""")
def column_role_case(spark, d):
    header = F.element_at(F.array(F.lit("31/12/2023"), F.lit("thuyet minh"), F.lit("so dau nam nam truoc")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    o = t(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"), header.alias("h"))
    return o.select("o_orderkey", shortlist.column_role(F.col("h")).alias("role"), shortlist.year_bonus(F.col("h"), F.col("y")).cast("long").alias("bonus"), shortlist.year_grounding(F.col("h"), F.lit(""), F.col("y")).cast("long").alias("grounded"))


@query("""select o_custkey, o_orderkey from (select *, max(o_shippriority) over (partition by o_custkey) as best from (select o_custkey, o_orderkey, o_orderpriority as o_shippriority from orders)) where o_shippriority = best qualify count(*) over (partition by o_custkey) = 1""")
def unique_best(spark, d):
    return shortlist.unique_best(t(spark, d, "orders"), ["o_custkey"], "o_orderpriority").select("o_custkey", "o_orderkey")


@query("""with f as (select l_orderkey as qid, row_number() over (partition by l_orderkey order by l_linenumber, l_extendedprice, l_partkey) - 1 as i, l_extendedprice as v, count(*) over (partition by l_orderkey) as n from lineitem),
one as (select qid from f group by qid having count(distinct v) = count(*))
select qid, i::bigint as fact, row_number() over (partition by qid order by v desc) - 1 as leaf from f join one using (qid)""")
def optimal_assignment(spark, d):
    # leaf j weighs n - j, so the best assignment gives the leaves in falling order of price
    lines = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("qid"), "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("v"))
    asked = lines.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "v", "l_partkey"))).alias("facts"))
    n = F.size("facts")
    # pairs are made in the row of their order: as rows of their own they would be sorted, their number the square of its lines
    pair = lambda f, i: F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.struct(i.alias("fact"), j.alias("leaf"), (f["v"] * (n - j)).alias("score")))
    return assign.assign_lists(asked.select("qid", F.flatten(F.transform("facts", pair)).alias("pairs")))


@query("""select p_partkey, least(18, 3 * greatest(0, len(list_filter(list_distinct(string_split(lower(p_name), ' ')), lambda x: x <> '' and x <> 'part')) - 1))::bigint as penalty from part""")
def extra_token_penalty(spark, d):
    return t(spark, d, "part").select("p_partkey", shortlist.extra_penalty(F.col("p_name"), F.lit("part")).cast("long").alias("penalty"))


@query("with " + _CELLS + """, r as (select entity, min(year) as y0, max(year) as y1, arg_min(revenue, year) as b, arg_max(revenue, year) as e, sum(revenue) as s, count(*) as n from cells group by entity)
select n_nationkey::bigint as qid, op, round(case op when 'growth_pct' then (e - b) / abs(b) * 100 when 'difference' then e - b when 'average' then s / n else (pow(e / b, 1.0 / (y1 - y0)) - 1) * 100 end, 2) + 0.0 as answer, 'ok' as status
from (select *, case n_nationkey % 4 when 0 then 'growth_pct' when 1 then 'difference' when 2 then 'average' else 'cagr' end as op from nation join r on entity = n_name)""")
def rule_solve(spark, d):
    cells = _revenue(spark, d).select("entity", "year", F.lit("revenue").alias("metric"), F.col("revenue").alias("value"))
    op_ = F.element_at(F.array(*map(F.lit, ("growth_pct", "difference", "average", "cagr"))), F.col("n_nationkey") % 4 + 1)
    asked = t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("qid"), F.col("n_name").alias("entity"), op_.alias("op"))
    facts = asked.join(cells.select("entity", "year", "metric"), "entity").withColumn("role", F.lit("value"))
    return solve.rule_answers(facts, cells)


@query("""select a.o_orderstatus as status, least(a.o_orderkey, b.o_orderkey) as k, greatest(a.o_orderkey, b.o_orderkey) as other from orders a join orders b on a.o_orderstatus = b.o_orderstatus and a.o_orderkey < b.o_orderkey and abs(a.o_totalprice - b.o_totalprice) <= 1.0""")
def silver_supports(spark, d):
    o = t(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("k"), "o_totalprice")
    return solve.supports(o, ["status"], "k", "o_totalprice")


@query("""select n_nationkey::bigint as qid, case n_nationkey % 4 when 0 then 'toc do doanh thu' when 1 then 'doanh thu' when 2 then 'loi nhuan trong 2019 2021' else 'trung binh tai san' end as metric from nation""")
def metric_phrase(spark, d):
    return _questions(spark, d).select("qid", metric.metric_phrase(F.col("question"), text.norm(F.col("n_name"))).alias("metric"))


@query("""with f as (select l_orderkey as qid, row_number() over (partition by l_orderkey order by l_linenumber, l_extendedprice, l_partkey) as i, l_extendedprice as v from lineitem),
p as (select qid, max(v) filter (i = 1) as a, max(v) filter (i = 2) as b from f group by qid)
select qid, case when qid % 5 <> 0 and b is null then null else round(case qid % 5 when 0 then a when 1 then a - b when 2 then a + b when 3 then a / b * 100 else case when a >= b then 2001.0 else 2002.0 end end, 2) + 0.0 end as answer,
case when qid % 5 <> 0 and b is null then 'operand_out_of_range' else 'ok' end as status from p""")
def selection_answers(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_extendedprice", "l_partkey")
    cells = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("qid"), F.row_number().over(w).alias("idx"), F.col("l_extendedprice").alias("value"), F.lit(1.0).alias("unit_scale"), F.lit("price").alias("label"))
    cells = cells.withColumn("cell", F.col("idx").cast("string")).withColumn("year", F.col("idx") + 2000)
    pick = lambda *items: F.element_at(F.array(*map(F.lit, items)), (F.col("qid") % 5 + 1).cast("int"))
    asked = cells.select("qid").distinct().withColumn("op", pick("lookup", "difference", "sum", "ratio", "argmax"))
    asked = asked.withColumn("output_type", pick("number", "number", "number", "percent", "year")).withColumn("question_scale", F.lit(1.0))
    return selection.answers(asked.withColumn("operands", F.when(F.col("op") == "lookup", F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2)))), cells)


@query("with " + _FIRST + """ select entity, round(case when revenue_3 > revenue_1 then (revenue_1 + revenue_2 + revenue_3) / 3 / greatest(revenue_1, revenue_2) else -abs(revenue_1 - revenue_2) / revenue_2 end, 2) + 0.0 as answer,
case when revenue_3 is null then 'execution_failed' else 'ok' end as status from p""")
def expression_program(spark, d):
    facts = _program_facts(spark, d, ["revenue"]).withColumnsRenamed({f"revenue_{i}": f"E{i}" for i in (1, 2, 3)})
    program = expressions.to_program("average(E1, E2, E3) / max(E1, E2) if E3 > E1 else -abs(E1 - E2) / E2", dict.fromkeys(("E1", "E2", "E3"), "money"), "ratio")
    return ir.answer(facts, program, ["entity"])


@query("""select o_orderkey, case o_orderkey % 4 when 0 then '60' when 1 then '421' when 2 then '140,141' else '' end as codes,
(case o_orderkey % 4 when 0 then 12 when 1 then -10 when 2 then 0 else 0 end)::bigint as bonus, (case o_orderkey % 4 when 1 then -25 when 2 then 8 when 3 then -3 else 0 end)::bigint as qualifier from orders""")
def code_dictionary(spark, d):
    one = lambda *items: F.element_at(F.array(*map(F.lit, items)), (F.col("o_orderkey") % 4 + 1).cast("int"))
    o = t(spark, d, "orders").select("o_orderkey", one("Lợi nhuận sau thuế", "lợi nhuận sau thuế chưa phân phối dài hạn", "hàng tồn kho ngắn hạn", "cổ tức hợp nhất").alias("metric"), one("60", "60", "", "12").alias("code"), one("Lãi", "Nợ ngắn hạn", "Hàng tồn kho ngắn hạn", "Cổ tức").alias("label"))
    codes = shortlist.expected_codes(F.col("metric"))
    return o.select("o_orderkey", F.array_join(codes, ",").alias("codes"), shortlist.code_bonus(F.col("code"), codes).cast("long").alias("bonus"), shortlist.qualifier_bonus(F.col("label"), F.col("metric")).cast("long").alias("qualifier"))


@query("""select o_orderkey, case o_orderkey % 5 when 0 then 'exact_vas_code' when 1 then 'vas_code_mismatch' when 2 then 'period_contradiction:expected_ending' when 3 then 'metric_match:direct' else 'metric_mismatch:direct' end as reason,
case o_orderkey % 5 when 0 then (case when year(o_orderdate) = 2023 then 'explicit_column_year' else 'year_mismatch:column' end) when 1 then 'relative_column_year' when 2 then 'year_mismatch:relative' when 3 then 'year_ambiguous:context' else 'report_year_match' end as year_reason from orders""")
def grounding_reasons(spark, d):
    one = lambda *items: F.element_at(F.array(*map(F.lit, items)), (F.col("o_orderkey") % 5 + 1).cast("int"))
    o = t(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"), one("Lợi nhuận sau thuế", "Lợi nhuận sau thuế", "Cổ phiếu quỹ", "Cổ phiếu quỹ", "Phải thu").alias("label"), one("2023", "Năm nay", "Đầu năm", "", "").alias("header"), one("60", "50", "", "", "").alias("code"), one("lợi nhuận sau thuế", "lợi nhuận sau thuế", "cổ phiếu quỹ", "cổ phiếu quỹ", "phải thu khách hàng").alias("metric"), one("", "", "", "2021 2022", "").alias("context"))
    reason = shortlist.metric_grounding(F.col("label"), F.col("header"), F.col("code"), F.col("metric"), F.lit("ending"), F.lit(50.0))
    return o.select("o_orderkey", reason.alias("reason"), shortlist.year_reason(F.col("header"), F.col("context"), F.col("y"), F.col("y")).alias("year_reason"))


@query("""with q as (select n_nationkey::bigint as qid, n_name from nation), c as (
select qid, n_name, unnest(case qid % 3 when 0 then ['tai san ngan han', 'hang ton kho', 'no ngan han'] when 1 then ['loi nhuan gop', 'doanh thu thuan'] else ['doanh thu'] end) as metric,
unnest(case qid % 3 when 0 then ['rank', 'rank', 'denominator'] when 1 then ['numerator', 'denominator'] else ['value'] end) as role,
unnest(case qid % 3 when 0 then [1, 2, 3] when 1 then [1, 2] else [1] end) as i, case qid % 3 when 0 then 3 when 1 then 2 else 1 end as n from q)
select qid, 'F' || ((y - 2020) * n + i)::varchar as slot, n_name as ticker, y::bigint as year, metric, role, case qid % 3 when 2 then 'ending' else 'same_period' end as period_role,
case qid % 3 when 0 then 'quick_ratio' when 1 then 'gross_margin' else 'routed_fact' end as family, case qid % 3 when 2 then 'equity:von chu so huu' else '' end as missing from c cross join (select unnest([2020, 2021]) as y)""")
def slot_plan(spark, d):
    asked = F.element_at(F.array(*(F.format_string(q, "n_name") for q in ("Hệ số thanh toán nhanh của %s năm 2020 và 2021?", "Biên lợi nhuận gộp của %s năm 2020, 2021?", "Doanh thu so với vốn chủ sở hữu của %s cuối năm 2020, 2021?"))), F.col("n_nationkey") % 3 + 1)
    q = t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("qid"), F.array("n_name").alias("tickers"), asked.alias("question"), F.lit("doanh thu").alias("metric"))
    slots_ = slots.plan_slots(router.route(q), "qid")
    return slots_.select("qid", "slot", "ticker", F.col("year").cast("long").alias("year"), "metric", "role", "period_role", "family", F.array_join("missing", ",").alias("missing"))


@query("""select o_orderkey, (o_orderkey % 9 + 0.5) * 1e12 as first, (o_orderkey % 7)::double * 1e6 as second from orders""")
def money_literals(spark, d):
    q = F.format_string("Lãi %d,5 nghìn  tỷ đồng và %d triệu?", F.col("o_orderkey") % 9, F.col("o_orderkey") % 7)
    found = text.money_literals(q)
    return t(spark, d, "orders").select("o_orderkey", F.get(found, F.lit(0)).alias("first"), F.get(found, F.lit(1)).alias("second"))


@query("""select o_orderkey, case o_orderkey % 3 when 0 then 'ratio' when 1 then 'lookup' end as op, case o_orderkey % 3 when 0 then '2,1' when 1 then (o_orderkey % 5)::varchar end as operands from orders""")
def reply_parsing(spark, d):
    reply = F.element_at(F.array(F.lit('So {"x": 1}:\n```json\n{"op": "Ratio", "operands": [2, 1]}\n```'), F.format_string('{"op": "lookup", "idx": %d}', F.col("o_orderkey") % 5), F.lit("no idea {}")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    found = selection.parse_selection(reply)
    return t(spark, d, "orders").select("o_orderkey", found["op"].alias("op"), F.array_join(found["operands"].cast("array<string>"), ",").alias("operands"))


@query("""select count(*) as n, round(avg((o_orderstatus = 'F')::int), 6) as coverage, round(avg((o_orderstatus = 'F' and o_orderkey % 2 = 0)::int), 6) as cell_accuracy, round(avg((o_orderstatus = 'F' and o_orderkey % 3 = 0)::int), 6) as answer_accuracy,
round((count(*) filter (o_orderstatus = 'F' and o_orderkey % 3 = 0)) / (count(*) filter (o_orderstatus = 'F')), 6) as precision from orders""")
def acceptance_report(spark, d):
    return metrics.acceptance(t(spark, d, "orders"), F.col("o_orderstatus") == "F", F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") % 3 == 0)


@query("""select c_mktsegment, count(*) as n, min(c_acctbal) as low, max(c_acctbal) as high, round(avg(c_acctbal), 4) as mean, median(c_acctbal) as middle, count(*) filter (c_acctbal < 0) as negative, count(*) filter (c_acctbal = 0) as zero from customer group by 1""")
def answer_description(spark, d):
    return metrics.describe_answers(t(spark, d, "customer"), "c_mktsegment", "c_acctbal")


@query("""select coalesce(k, ck) as k, case when n is null then 'missing' when n > 1 then 'repeated' else 'outside_mask' end as problem from (select c_custkey as ck from customer) full join (select o_custkey as k, count(*) as n, bool_or(o_orderstatus = 'F') as f from orders group by 1) on k = ck
where n is null or n > 1 or (f and k % 2 = 1)""")
def mask_audit(spark, d):
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    return metrics.mask_audit(t(spark, d, "orders").withColumnRenamed("o_custkey", "k"), c, c.filter("k % 2 = 0"), "k", F.col("o_orderstatus") == "F")


@query("""with o as (select o_custkey as id, o_orderkey, o_totalprice, row_number() over (partition by o_custkey order by o_orderkey) as rank from orders),
l as (select id, string_agg('R' || (o_orderkey % 50) || '|' || o_orderkey, ',' order by rank) filter (rank <= 5) as first, max('R' || (o_orderkey % 50) || '|' || o_orderkey) filter (rank = 7) as used, max(o_totalprice) filter (rank = 1) as answer from o group by id)
select c_custkey as id, round(answer, 2) as answer, coalesce(first, '') || case when used is not null then ',' || used else '' end as tables, case when answer is null then 'missing_answer' else 'ok' end as status from customer left join l on id = c_custkey""")
def submission_entries(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    ranked = t(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.row_number().over(w).alias("rank"), F.concat(F.lit("R"), (F.col("o_orderkey") % 50).cast("string")).alias("report_id"), F.col("o_orderkey").alias("table_pos"), "o_totalprice")
    used = ranked.filter("rank = 7").withColumn("variable", F.lit("df7"))
    answers = ranked.filter("rank = 1").select("id", F.col("o_totalprice").alias("answer"), F.lit("0.0").alias("pandas_query"))
    questions = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("question"))
    positions = ranked.select("report_id", "table_pos", F.col("table_pos").alias("line_no"))
    out = submission.entries(questions, ranked, answers, used, positions)
    return out.select("id", "answer", F.array_join("relevant_tables", ",").alias("tables"), "status")


@query("""with f as (select c_custkey as qid, count(distinct round(o_totalprice / 1000, 2)) as clusters, count(o_orderkey) as support, max(o_totalprice) as amount from customer left join orders on o_custkey = c_custkey group by 1)
select qid, case clusters when 0 then 'missing_metric_cell' when 1 then 'accepted' else 'competing_answer_clusters' end as status, support, case when clusters = 1 then amount end as amount from f""")
def fact_consensus(spark, d):
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("qid"), F.lit(0).alias("fact"), F.col("c_custkey").cast("string").alias("ticker"), F.lit(2020).alias("year"), F.lit("separate").alias("doc_type"), F.lit("doanh thu thuần").alias("metric"), F.lit(1000.0).alias("question_scale"))
    cells = t(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("ticker"), F.lit("separate").alias("doc_type"), F.lit(2020).alias("year"), F.col("o_orderkey").cast("string").alias("report_id"), F.lit(0).alias("table_pos"), F.lit(1).alias("row"), F.lit(1).alias("col"), F.lit("Doanh thu thuần").alias("label"), F.lit("").alias("context"), F.col("o_totalprice").alias("value"), F.lit(1.0).alias("unit_scale"), F.lit(4).alias("confidence"))
    return repair.resolve(c, cells).select("qid", "status", "support", "amount")


@query("""with n as (select n_nationkey::bigint as qid, n_name, 'N' || chr((65 + n_nationkey)::int) as ticker from nation)
select qid, ticker, case when qid % 3 = 1 and length(n_name) >= 5 then 'explicit_name' else 'explicit' end as source from n""")
def find_tickers(spark, d):
    n = t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("qid"), "n_name", F.concat(F.lit("N"), F.chr(F.col("n_nationkey") + 65)).alias("ticker"))
    named = F.when(F.length("n_name") >= 5, F.concat(F.lit("Doanh thu của "), F.col("n_name"))).otherwise(F.concat(F.lit("Doanh thu của "), F.col("ticker")))
    asked = F.when(F.col("qid") % 3 == 0, F.concat("n_name", F.lit(" ("), "ticker", F.lit(") năm 2020"))).when(F.col("qid") % 3 == 1, named).otherwise(F.concat(F.lit("Mã "), F.lower("ticker"), F.lit(" lãi bao nhiêu")))
    out = entities.find_tickers(n.select("qid", asked.alias("question")), n.select("ticker", F.col("n_name").alias("name")), "qid")
    return out.select("qid", F.get("tickers", F.lit(0)).alias("ticker"), "source")


@query("""select o_orderkey, case o_orderkey % 4 when 0 then 'target_value' when 1 then (case when year(o_orderdate) = 2020 then 'target_value' else 'other_period' end) when 2 then 'ambiguous' else 'target_value' end as role,
(case o_orderkey % 4 when 0 then 4 when 1 then 4 when 2 then 0 else 1 end)::bigint as confidence, case when o_orderkey % 3 = 0 then 1.0 else 1e6 end::double as scale from orders""")
def period_and_unit(spark, d):
    one = lambda *items: F.element_at(F.array(*map(F.lit, items)), (F.col("o_orderkey") % 4 + 1).cast("int"))
    o = t(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"), one("", "Năm 2020", "2019 2020", "").alias("h"))
    header = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("31/12/"), F.col("y").cast("string"))).otherwise(F.col("h"))
    p = shortlist.period_column(header, F.col("y"), F.col("y"), F.lit(True))
    context = F.when(F.col("o_orderkey") % 3 == 0, "Số cuối năm VND").otherwise("Đơn vị: triệu VND")
    return o.select("o_orderkey", p["role"].alias("role"), p["confidence"].cast("long").alias("confidence"), numbers.resolve_unit(F.lit(1e6), F.lit("sticky"), context)["scale"].alias("scale"))


@query("""with l as (select o_custkey as q, min(o_totalprice / 10000) as s, bool_and(o_orderstatus = 'F') as sure, count(*) > count(distinct o_orderkey % 4) as shared from orders group by 1)
select q, round(greatest(0.0, least(case when shared then 35.0 else 99.0 end, s + case when sure then 8.0 else -10.0 end)), 6) as confidence from l""")
def weakest_link(spark, d):
    o = t(spark, d, "orders").select(F.col("o_custkey").alias("q"), (F.col("o_totalprice") / 10000).alias("s"), (F.col("o_orderstatus") == "F").alias("sure"), (F.col("o_orderkey") % 4).alias("cell"))
    return metrics.weakest_link(o, "q", "s", "sure", ["cell"]).select("q", F.round("confidence", 6).alias("confidence"))
