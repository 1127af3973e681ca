"""Projections, joins, aggregation, sorting, sets, subqueries."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import utc
from siltstone.operators import asof_join, broadcast_if_small, exact_quantiles, range_join, ranged_asof_join, ranged_overlap_join, salted_join
from siltstone.registry import query


def _revenue():
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def _sum2(column, name):
    return F.round(F.sum(column), 2).alias(name)


def _n(name="n"):
    return F.count(F.lit(1)).alias(name)


@query("select o_orderkey, round(o_totalprice * 1.1, 3) as with_tax, upper(o_orderpriority) as priority from orders where o_totalprice > 300000 and o_orderstatus in ('F', 'O')")
def p06_project_filter(spark, t):
    return t.orders.filter((F.col("o_totalprice") > 300000) & F.col("o_orderstatus").isin("F", "O")).select("o_orderkey", F.round(F.col("o_totalprice") * 1.1, 3).alias("with_tax"), F.upper("o_orderpriority").alias("priority"))


@query("""
with a as (select n_regionkey, nullif(n_regionkey, 2) as k from nation), b as (select r_name, nullif(r_regionkey, 2) as k from region)
select r_name, count(*) as n from a join b on a.k is not distinct from b.k group by all
""")
def p07_null_safe_equality(spark, t):
    a = t.nation.select(F.nullif("n_regionkey", F.lit(2)).alias("ka"))
    b = t.region.select("r_name", F.nullif("r_regionkey", F.lit(2)).alias("kb"))
    return a.join(b, F.col("ka").eqNullSafe(F.col("kb"))).groupBy("r_name").agg(_n())


_SEGMENT_SQL = "select c_mktsegment, count(*) as n, round(sum(o_totalprice), 2) as total from orders join customer on o_custkey = c_custkey group by all"


def _segments(orders, customer):
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(_n(), _sum2("o_totalprice", "total"))


@query("select r_name, count(*) as n from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by all")
def p08_broadcast_join(spark, t):
    small = broadcast_if_small(t.nation.join(broadcast_if_small(t.region), F.col("n_regionkey") == F.col("r_regionkey")))
    return t.supplier.join(small, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("r_name").agg(_n())


@query(_SEGMENT_SQL)
def p09_sort_merge_join(spark, t):
    return _segments(t.orders.hint("merge"), t.customer)


@query(_SEGMENT_SQL)
def p10_shuffled_hash_join(spark, t):
    return _segments(t.orders, t.customer.hint("shuffle_hash"))


@query("select a.n_nationkey as a, b.r_regionkey as b from nation a join region b on a.n_nationkey + b.r_regionkey < 6")
def p11_nested_loop_join(spark, t):
    a, b = t.nation.select(F.col("n_nationkey").alias("a")), t.region.select(F.col("r_regionkey").alias("b"))
    return a.join(b.hint("shuffle_replicate_nl"), F.col("a") + F.col("b") < 6)


@query("select n_name, count(*) as n from orders join nation on o_totalprice >= n_nationkey * 20000 and o_totalprice < n_nationkey * 20000 + 30000 group by all")
def p12_range_join(spark, t):
    bands = t.nation.select("n_name", (F.col("n_nationkey") * 20000.0).alias("lo"), (F.col("n_nationkey") * 20000.0 + 30000).alias("hi"))
    return range_join(t.orders.select("o_totalprice"), bands, "o_totalprice", "lo", "hi", 30000.0).groupBy("n_name").agg(_n())


@query("select o_orderkey, o_totalprice from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity > 49)")
def p13_semi_join(spark, t):
    return t.orders.join(t.lineitem.filter("l_quantity > 49"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("o_orderkey", "o_totalprice")


@query("select o_orderkey, o_orderdate from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)")
def p13_anti_join(spark, t):
    return t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select("o_orderkey", "o_orderdate")


_OUTER = "with a as (select p_partkey % 97 as k, count(*) as parts from part where p_size < 10 group by all), b as (select s_suppkey % 89 as k, count(*) as suppliers from supplier group by all) select coalesce(a.k, b.k) as k, parts, suppliers from a {how} join b on a.k = b.k"


def _outer(t, how):
    a = t.part.filter("p_size < 10").groupBy((F.col("p_partkey") % 97).alias("ka")).agg(_n("parts"))
    b = t.supplier.groupBy((F.col("s_suppkey") % 89).alias("kb")).agg(_n("suppliers"))
    return a.join(b, F.col("ka") == F.col("kb"), how).select(F.coalesce("ka", "kb").alias("k"), "parts", "suppliers")


@query(_OUTER.format(how="left"))
def p14_left_join(spark, t):
    return _outer(t, "left")


@query(_OUTER.format(how="right"))
def p14_right_join(spark, t):
    return _outer(t, "right")


@query(_OUTER.format(how="full"))
def p14_full_join(spark, t):
    return _outer(t, "full")


@query("select a.r_name as a, b.r_name as b from region a cross join region b")
def p14_cross_join(spark, t):
    return t.region.select(F.col("r_name").alias("a")).crossJoin(t.region.select(F.col("r_name").alias("b")))


@query("select l_returnflag, o_orderstatus, count(*) as n from lineitem join orders on l_orderkey = o_orderkey group by all")
def p14_salted_join(spark, t):
    left = t.lineitem.select(F.col("l_orderkey").alias("k"), "l_linenumber", "l_returnflag")
    right = t.orders.select(F.col("o_orderkey").alias("k"), "o_orderstatus")
    return salted_join(left, right, ["k"], 8).groupBy("l_returnflag", "o_orderstatus").agg(_n())


@query("""
with e as (select event_id, event_type, epoch(ts) as lo, epoch(ts) + case when event_id % 50 = 0 then 864000 else value * 60 end as hi from events)
select b.event_id as buy, v.event_id as seen from e b join e v on b.lo < v.hi and v.lo < b.hi where b.event_type = 'purchase' and v.event_type = 'view' and b.hi > b.lo and v.hi > v.lo
""")
def p12_overlap_join(spark, t):
    """Intervals of minutes and of ten days on both sides, whatever overlaps."""
    at = F.unix_micros(utc(F.col("ts"))) / 1e6
    long = F.when(F.col("event_id") % 50 == 0, 864000.0).otherwise(F.col("value") * 60)
    e = t.events.select("event_id", "event_type", at.alias("lo"), (at + long).alias("hi"))
    buys = e.filter("event_type = 'purchase'").select(F.col("event_id").alias("buy"), "lo", "hi")
    views = e.filter("event_type = 'view'").select(F.col("event_id").alias("seen"), F.col("lo").alias("from"), F.col("hi").alias("till"))
    return ranged_overlap_join(buys, views, ("lo", "hi"), ("from", "till"), keep=["buy", "seen"])


@query("""
select p.event_id, v.event_id as view_id, v.value as view_value
from (select * from events where event_type = 'purchase') p asof left join (select * from events where event_type = 'view') v on p.user_id = v.user_id and p.ts >= v.ts
""")
def p15_asof_join(spark, t):
    e = t.events
    views = e.filter("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"), F.col("value").alias("view_value"))
    buys = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return asof_join(buys, views, ["user_id"], "ts", "ts", ["view_id", "view_value"]).select("event_id", "view_id", "view_value")


@query("""
select p.event_id, v.event_id as view_id, v.value as view_value
from (select *, case when user_id % 2 = 0 then 0 else user_id end as k from events where event_type = 'purchase') p
asof left join (select *, case when user_id % 2 = 0 then 0 else user_id end as k from events where event_type = 'view') v on p.k = v.k and p.ts >= v.ts
""")
def p15_asof_hot_key(spark, t):
    """Half of the users are one key: it is spread over ranges of time."""
    e = t.events.withColumn("k", F.when(F.col("user_id") % 2 == 0, 0).otherwise(F.col("user_id")))
    views = e.filter("event_type = 'view'").select("k", "ts", F.col("event_id").alias("view_id"), F.col("value").alias("view_value"))
    buys = e.filter("event_type = 'purchase'").select("event_id", "k", "ts")
    return ranged_asof_join(buys, views, ["k"], "ts", "ts", ["view_id", "view_value"]).select("event_id", "view_id", "view_value")


@query("""
select p.event_id, v.event_id as view_id, v.value as view_value
from (select * from events where event_type = 'purchase') p asof left join (select * from events where event_type = 'view') v on p.ts > v.ts
""")
def p15_asof_without_key(spark, t):
    """The last view of anybody before each purchase: no key at all."""
    views = t.events.filter("event_type = 'view'").select("ts", F.col("event_id").alias("view_id"), F.col("value").alias("view_value"))
    buys = t.events.filter("event_type = 'purchase'").select("event_id", "ts")
    return ranged_asof_join(buys, views, [], "ts", "ts", ["view_id", "view_value"], strict=True).select("event_id", "view_id", "view_value")


@query("select r_name, x.n_name from region, lateral (select n_name from nation where n_regionkey = r_regionkey order by n_name limit 2) x")
def p16_lateral_join(spark, t):
    inner = t.nation.filter(F.col("n_regionkey") == F.col("r_regionkey").outer()).orderBy("n_name").limit(2).select("n_name")
    return t.region.lateralJoin(inner).select("r_name", "n_name")


@query("""
select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice), 2) as sum_base_price,
       round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) as sum_charge,
       round(avg(l_quantity), 4) as avg_qty, round(avg(l_extendedprice), 4) as avg_price, round(avg(l_discount), 6) as avg_disc, count(*) as count_order
from lineitem where l_shipdate <= timestamp '1998-09-02' group by all
""")
def p17_pricing_summary(spark, t):
    rows = t.lineitem.filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        _sum2("l_quantity", "sum_qty"), _sum2("l_extendedprice", "sum_base_price"), _sum2(_revenue(), "sum_disc_price"), _sum2(_revenue() * (1 + F.col("l_tax")), "sum_charge"),
        F.round(F.avg("l_quantity"), 4).alias("avg_qty"), F.round(F.avg("l_extendedprice"), 4).alias("avg_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), _n("count_order"),
    )


@query("select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by all")
def p17_revenue_by_nation(spark, t):
    orders = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    lines = t.lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("c_nationkey").agg(F.sum(_revenue()).alias("revenue"))
    return lines.join(broadcast_if_small(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", F.round("revenue", 2).alias("revenue"))


@query("select event_type, count(distinct user_id) as users, count(distinct props) as kinds, cast(sum(distinct user_id) as bigint) as user_sum from events group by all")
def p18_distinct_aggregates(spark, t):
    return t.events.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count_distinct("props").alias("kinds"), F.sum_distinct("user_id").alias("user_sum"))


@query("select l_returnflag, count(*) filter (where l_quantity > 25) as large, round(coalesce(sum(l_tax) filter (where l_discount = 0), 0), 4) as tax from lineitem group by all")
def p19_filtered_aggregates(spark, t):
    return t.lineitem.groupBy("l_returnflag").agg(F.expr("count(*) filter (where l_quantity > 25)").alias("large"), F.round(F.coalesce(F.expr("sum(l_tax) filter (where l_discount = 0)"), F.lit(0.0)), 4).alias("tax"))


@query("select o_orderstatus, o_orderpriority, cast(grouping(o_orderpriority) as bigint) as g, count(*) as n from orders group by rollup (o_orderstatus, o_orderpriority)")
def p20_rollup(spark, t):
    return t.orders.rollup("o_orderstatus", "o_orderpriority").agg(F.grouping("o_orderpriority").cast("bigint").alias("g"), _n())


@query("select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as q from lineitem group by cube (l_returnflag, l_linestatus)")
def p21_cube(spark, t):
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(_n(), _sum2("l_quantity", "q"))


@query("select p_brand, p_size, count(*) as n from part group by grouping sets ((p_brand), (p_size), ())")
def p21_grouping_sets(spark, t):
    return t.part.groupingSets([["p_brand"], ["p_size"], []], "p_brand", "p_size").agg(_n()).select("p_brand", "p_size", "n")


@query("""
select o_orderpriority, count(*) filter (where o_orderstatus = 'F') as "F", count(*) filter (where o_orderstatus = 'O') as "O", count(*) filter (where o_orderstatus = 'P') as "P" from orders group by all
""")
def p22_pivot(spark, t):
    return t.orders.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).fillna(0)


@query("select s_suppkey, 'nation' as k, cast(s_nationkey as double) as v from supplier union all select s_suppkey, 'balance', s_acctbal from supplier")
def p22_unpivot(spark, t):
    wide = t.supplier.select("s_suppkey", F.col("s_nationkey").cast("double").alias("nation"), F.col("s_acctbal").alias("balance"))
    return wide.unpivot("s_suppkey", ["nation", "balance"], "k", "v")


@query("""
select 'r_name' as key, max(r_name) filter (where r_regionkey = 0) as "0", max(r_name) filter (where r_regionkey = 1) as "1", max(r_name) filter (where r_regionkey = 2) as "2",
       max(r_name) filter (where r_regionkey = 3) as "3", max(r_name) filter (where r_regionkey = 4) as "4" from region
""")
def p22_transpose(spark, t):
    return t.region.transpose("r_regionkey")


@query("select o_orderstatus, round(median(o_totalprice), 4) as med, round(quantile_cont(o_totalprice, 0.9), 4) as p90 from orders group by all")
def p23_exact_quantile(spark, t):
    return t.orders.groupBy("o_orderstatus").agg(F.round(F.median("o_totalprice"), 4).alias("med"), F.round(F.percentile("o_totalprice", 0.9), 4).alias("p90"))


@query("""
select o_orderstatus, round(quantile_cont(o_totalprice, 0.01), 4) as p01, round(median(o_totalprice), 4) as med, round(quantile_cont(o_totalprice, 0.999), 4) as p999 from orders group by all
""")
def p23_quantile_selection(spark, t):
    """Histograms narrow each rank's interval: three keys, and no task holds a key."""
    got = exact_quantiles(t.orders, ["o_orderstatus"], "o_totalprice", {"p01": 0.01, "med": 0.5, "p999": 0.999})
    return got.select("o_orderstatus", *[F.round(c, 4).alias(c) for c in ("p01", "med", "p999")])


@query("select quantile_cont(l_quantity, 0.25) as q1, quantile_cont(l_quantity, 0.5) as q2, quantile_cont(l_quantity, 0.75) as q3 from lineitem")
def p23_quantile_selection_of_all(spark, t):
    return exact_quantiles(t.lineitem, [], "l_quantity", {"q1": 0.25, "q2": 0.5, "q3": 0.75})


@query("select o_orderstatus, true as close from orders group by all")
def p24_approximate_quantile(spark, t):
    """Whether the approximate 90 % point lies between the exact 89 % and 91 % points."""
    q = t.orders.groupBy("o_orderstatus").agg(F.percentile_approx("o_totalprice", 0.9, 10000).alias("a"), F.percentile("o_totalprice", F.array(F.lit(0.89), F.lit(0.91))).alias("e"))
    return q.select("o_orderstatus", ((F.col("a") >= F.col("e")[0]) & (F.col("a") <= F.col("e")[1])).alias("close"))


@query("select event_type, true as close from events group by all")
def p25_approximate_distinct(spark, t):
    """Whether the estimate is within a tenth of the exact number."""
    # distinct pairs first: beside a distinct count in one aggregate, a whole sketch would be held for each pair
    pairs = t.events.select("event_type", "user_id").distinct()
    q = pairs.groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("a"), F.count("user_id").alias("e"))
    return q.select("event_type", (F.abs(F.col("a") - F.col("e")) <= F.col("e") * 0.1).alias("close"))


@query("select true as hll_close, true as theta_close, true as kll_close, true as count_min_close")
def p26_sketches(spark, t):
    """Sketches by group, merged, against exact figures: distinct users, the rank of the median, the count of the most frequent user."""
    per = t.events.groupBy("event_type").agg(F.hll_sketch_agg("user_id").alias("h"), F.theta_sketch_agg("user_id").alias("th"))
    merged = per.agg(F.hll_sketch_estimate(F.hll_union_agg("h")).alias("h"), F.theta_sketch_estimate(F.theta_union_agg("th")).alias("th"))
    # one sketch of fixed size comes to the driver, whose JVM reads it
    whole = t.events.agg(F.count_min_sketch("user_id", F.lit(0.001), F.lit(0.99), F.lit(7)).alias("c"), F.kll_sketch_get_quantile_bigint(F.kll_sketch_agg_bigint("user_id"), F.lit(0.5)).alias("k")).first()
    sketch = spark._jvm.org.apache.spark.util.sketch.CountMinSketch.readFrom(whole["c"])
    top = t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "user_id").first()
    estimate = sketch.estimateCount(top["user_id"])
    exact = t.events.agg(F.count_distinct("user_id").alias("n"), F.count(F.lit(1)).alias("all"), F.count_if(F.col("user_id") < whole["k"]).alias("below"), F.count_if(F.col("user_id") <= whole["k"]).alias("upto"))
    close = lambda c: F.abs(F.col(c) - F.col("n")) <= F.col("n") * 0.1
    kll = (F.col("below") <= F.col("all") * 0.53) & (F.col("upto") >= F.col("all") * 0.47)
    count_min = F.lit(estimate).between(F.lit(top["n"]), F.lit(top["n"]) + F.col("all") * 0.002)
    return merged.crossJoin(exact).select(close("h").alias("hll_close"), close("th").alias("theta_close"), kll.alias("kll_close"), count_min.alias("count_min_close"))


@query("""
with c as (select c_mktsegment, c_nationkey, count(*) as n from customer group by all),
m as (select c_mktsegment, arg_min(c_nationkey, (-n, c_nationkey)) as common from c group by all)
select c_mktsegment, common, names, cast(size as bigint) as size
from m join (select c_mktsegment, string_agg(c_name, ';' order by c_custkey) as names, len(list(c_custkey)) as size from customer group by all) using (c_mktsegment)
""")
def p27_mode_and_lists(spark, t):
    t.customer.createOrReplaceTempView("siltstone_customer")
    return spark.sql("""
        select c_mktsegment, mode(c_nationkey, true) as common, listagg(c_name, ';') within group (order by c_custkey) as names, cast(size(collect_list(c_custkey)) as bigint) as size
        from siltstone_customer group by c_mktsegment""")


@query("select c_mktsegment, arg_max(c_custkey, (c_acctbal, c_custkey)) as richest, string_agg(distinct cast(c_nationkey as varchar), ',' order by cast(c_nationkey as varchar)) as nations, list(c_nationkey order by c_custkey)[1] as first_nation from customer group by all")
def p27_ordered_aggregates(spark, t):
    key = F.col("c_nationkey").cast("string")
    return t.customer.groupBy("c_mktsegment").agg(
        F.max_by("c_custkey", F.struct("c_acctbal", "c_custkey")).alias("richest"), F.array_join(F.array_sort(F.collect_set(key)), ",").alias("nations"), F.min_by("c_nationkey", "c_custkey").alias("first_nation")
    )


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 50 offset 10")
def p31_sort_limit_offset(spark, t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(10).limit(50)


@query("select c_custkey, c_acctbal from customer order by c_acctbal desc, c_custkey limit 20")
def p32_top_k(spark, t):
    return t.customer.select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").limit(20)


_SETS = "select {q} o_custkey as k from orders where o_orderstatus = 'F' {op} select {q} o_custkey as k from orders where o_orderstatus = 'P'"


def _sides(t):
    return tuple(t.orders.filter(f"o_orderstatus = '{s}'").select(F.col("o_custkey").alias("k")) for s in "FP")


@query(_SETS.format(q="", op="union all"))
def p34_union_all(spark, t):
    a, b = _sides(t)
    return a.unionByName(b)


@query(_SETS.format(q="", op="union"))
def p34_union(spark, t):
    a, b = _sides(t)
    return a.unionByName(b).distinct()


@query(_SETS.format(q="", op="intersect"))
def p34_intersect(spark, t):
    a, b = _sides(t)
    return a.intersect(b)


@query(_SETS.format(q="", op="intersect all"))
def p34_intersect_all(spark, t):
    a, b = _sides(t)
    return a.intersectAll(b)


@query(_SETS.format(q="", op="except"))
def p34_except(spark, t):
    a, b = _sides(t)
    return a.subtract(b)


@query(_SETS.format(q="", op="except all"))
def p34_except_all(spark, t):
    a, b = _sides(t)
    return a.exceptAll(b)


@query("select distinct l_returnflag, l_linestatus, l_linenumber from lineitem")
def p35_dedup(spark, t):
    return t.lineitem.select("l_returnflag", "l_linestatus", "l_linenumber").dropDuplicates()


@query()
def p36_sample(spark, t):
    """A tenth of the orders of each status, by a fixed seed; sampling is the feature."""
    return t.orders.sampleBy("o_orderstatus", {"F": 0.1, "O": 0.1, "P": 0.1}, seed=7).select("o_orderkey", "o_orderstatus")


@query("select o_orderstatus, count(*) as n, true as near_a_tenth, true as once_and_theirs from orders group by all")
def p36_sample_by_bounds(spark, t):
    """The sample above: of each status a tenth within five standard deviations, every row once and with its own status."""
    orders = t.orders.select("o_orderkey", "o_orderstatus")
    sample = p36_sample(spark, t).select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s")).groupBy("k", "s").agg(_n("times"))
    met = orders.join(sample, (F.col("o_orderkey") == F.col("k")) & (F.col("o_orderstatus") == F.col("s")), "full_outer")
    groups = met.groupBy(F.coalesce("o_orderstatus", "s").alias("o_orderstatus")).agg(
        F.count("o_orderkey").alias("n"), F.sum(F.coalesce("times", F.lit(0))).alias("drawn"), F.max(F.coalesce("times", F.lit(1))).alias("most"), F.count_if(F.col("o_orderkey").isNull()).alias("strange")
    )
    off = F.abs(F.col("drawn") - F.col("n") * 0.1)
    return groups.select("o_orderstatus", "n", (off <= 5 * F.sqrt(F.col("n") * 0.09)).alias("near_a_tenth"), ((F.col("most") == 1) & (F.col("strange") == 0)).alias("once_and_theirs"))


@query("select o_orderkey, o_orderstatus from orders where substr(md5('7:' || o_orderkey), 1, 8) < '1999999a'")
def p36_hash_sample(spark, t):
    """A tenth by the hash of the key and a seed: the same rows in any run, partitioning or engine, and no shuffle."""
    drawn = F.substring(F.md5(F.concat(F.lit("7:"), F.col("o_orderkey").cast("string"))), 1, 8) < "1999999a"
    return t.orders.filter(drawn).select("o_orderkey", "o_orderstatus")


@query("select true as near_a_tenth, count(*) as rows, count(*) as ids from orders")
def p36_sample_and_split(spark, t):
    """sample() takes about a tenth, randomSplit() deals every row into one part; sampling is the feature."""
    ids = t.orders.select("o_orderkey")
    tenth = ids.sample(0.1, seed=7).agg(F.count(F.lit(1)).alias("s"))
    a, b = ids.randomSplit([0.7, 0.3], seed=7)
    both = a.unionByName(b).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("o_orderkey").alias("ids"))
    return tenth.crossJoin(both).select(F.col("s").between(F.col("rows") * 0.08, F.col("rows") * 0.12).alias("near_a_tenth"), "rows", "ids")


@query("select o_orderkey, o_totalprice from orders where o_totalprice > (select avg(o_totalprice) * 1.8 from orders)")
def p37_scalar_subquery(spark, t):
    mean = t.orders.select(F.avg("o_totalprice") * 1.8).scalar()
    return t.orders.filter(F.col("o_totalprice") > mean).select("o_orderkey", "o_totalprice")


@query("select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 450000)")
def p37_exists_subquery(spark, t):
    inner = t.orders.filter((F.col("o_custkey") == F.col("c_custkey").outer()) & (F.col("o_totalprice") > 450000))
    return t.customer.filter(inner.exists()).select("c_custkey")


@query("select p_partkey from part where p_brand not in (select p_brand from part where p_size > 49)")
def p37_not_in_subquery(spark, t):
    t.part.createOrReplaceTempView("siltstone_part")
    return spark.sql("select p_partkey from siltstone_part where p_brand not in (select p_brand from siltstone_part where p_size > 49)")


@query("with recursive f(n, a, b) as (select 1, cast(0 as bigint), cast(1 as bigint) union all select n + 1, b, a + b from f where n < 40) select cast(n as bigint) as n, a from f")
def p38_recursive_cte(spark, t):
    return spark.sql("with recursive f(n, a, b) as (select 1, cast(0 as bigint), cast(1 as bigint) union all select n + 1, b, a + b from f where n < 40) select cast(n as bigint) as n, a from f")


@query("select n_regionkey, count(*) as n from nation where n_nationkey > 3 group by all having count(*) > 2")
def p39_pipe_syntax(spark, t):
    t.nation.createOrReplaceTempView("siltstone_nation")
    return spark.sql("from siltstone_nation |> where n_nationkey > 3 |> aggregate count(*) as n group by n_regionkey |> where n > 2")
