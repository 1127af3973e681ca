"""Ranking, analytic functions, frames, time windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.functions import utc
from siltstone.operators import global_ranks, range_sums, rows_frame, running_sums
from siltstone.registry import query


def _by_balance():
    return Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")


@query("""
select c_custkey, row_number() over w as rn, rank() over w as rk, dense_rank() over w as dr, ntile(4) over w as nt, round(percent_rank() over w, 6) as pr, round(cume_dist() over w, 6) as cd
from customer window w as (partition by c_nationkey order by c_acctbal desc, c_custkey)
""")
def p28_ranking(spark, t):
    w = _by_balance()
    long = lambda f: f.over(w).cast("bigint")
    return t.customer.select("c_custkey", long(F.row_number()).alias("rn"), long(F.rank()).alias("rk"), long(F.dense_rank()).alias("dr"), long(F.ntile(4)).alias("nt"), F.round(F.percent_rank().over(w), 6).alias("pr"), F.round(F.cume_dist().over(w), 6).alias("cd"))


@query("""
select o_orderkey, row_number() over (order by o_orderdate desc, o_orderkey) as rn, rank() over w as rk, dense_rank() over w as dr, round(percent_rank() over w, 9) as pr, ntile(100) over (order by o_orderdate desc, o_orderkey) as nt
from orders window w as (order by o_orderdate desc)
""")
def p28_global_rank(spark, t):
    """Ranks over all rows, with many peers: no window without a key is planned."""
    ranked = global_ranks(t.orders.select("o_orderkey", "o_orderdate"), ["-o_orderdate"], ["o_orderkey"], 100)
    return ranked.select("o_orderkey", F.col("row_number").alias("rn"), F.col("rank").alias("rk"), F.col("dense_rank").alias("dr"), F.round("percent_rank", 9).alias("pr"), F.col("ntile").alias("nt"))


@query("""
select event_id, lag(value) over w as before, lead(value, 2) over w as after, first_value(event_type) over w as first_type,
       last_value(event_id) over (partition by user_id order by ts, event_id rows between unbounded preceding and unbounded following) as last_id, nth_value(event_id, 3) over w as third
from events window w as (partition by user_id order by ts, event_id)
""")
def p29_analytic(spark, t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return t.events.select("event_id", F.lag("value").over(w).alias("before"), F.lead("value", 2).over(w).alias("after"), F.first_value("event_type").over(w).alias("first_type"), F.last_value("event_id").over(whole).alias("last_id"), F.nth_value("event_id", 3).over(w).alias("third"))


@query("""
select o_orderkey, round(sum(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey rows between 2 preceding and current row), 2) as last3,
       count(*) over (partition by o_orderpriority order by o_custkey range between 10 preceding and 10 following) as near_customers
from orders
""")
def p30_frames(spark, t):
    rows = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(-2, 0)
    near = Window.partitionBy("o_orderpriority").orderBy("o_custkey").rangeBetween(-10, 10)
    return t.orders.select("o_orderkey", F.round(F.sum("o_totalprice").over(rows), 2).alias("last3"), F.count(F.lit(1)).over(near).alias("near_customers"))


@query("""
select o_orderkey, sum(cents) over w as near_sum, max(cents) over w as near_max, sum(cents) over (partition by o_orderpriority order by o_orderdate, o_orderkey rows unbounded preceding) as so_far
from (select *, cast(round(o_totalprice * 100) as bigint) as cents from orders) window w as (partition by o_orderpriority order by o_orderdate, o_orderkey rows between 5 preceding and 3 following)
""")
def p30_frames_of_hot_keys(spark, t):
    """Five keys hold all orders: frames go by blocks of rows with halos, running sums by sums of blocks."""
    orders = t.orders.select("o_orderkey", "o_orderpriority", "o_orderdate", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"))
    by, order = ["o_orderpriority"], ["o_orderdate", "o_orderkey"]
    near = rows_frame(orders, by, order, 5, 3, {"near_sum": F.sum("cents"), "near_max": F.max("cents")}, block=1024)
    far = running_sums(orders, by, order, {"so_far": "cents"}, block=1024)
    return near.join(far.select("o_orderkey", "so_far"), "o_orderkey").select("o_orderkey", "near_sum", "near_max", "so_far")


@query("""
select o_orderkey, count(*) over w as n, sum(cents) over w as total
from (select *, cast(round(o_totalprice * 100) as bigint) as cents from orders) window w as (partition by o_orderpriority order by o_custkey range between 10 preceding and 4 following)
""")
def p30_range_frames_of_hot_keys(spark, t):
    """Frames by value as differences of running sums, which as-of joins find."""
    orders = t.orders.select("o_orderkey", "o_orderpriority", "o_custkey", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"))
    return range_sums(orders, ["o_orderpriority"], "o_custkey", 10, 4, {"total": "cents"}).select("o_orderkey", "n", "total")


@query("select c_nationkey, c_custkey, c_acctbal from customer qualify row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) <= 3")
def p33_top_k_per_group(spark, t):
    return t.customer.withColumn("rn", F.row_number().over(_by_balance())).filter("rn <= 3").select("c_nationkey", "c_custkey", "c_acctbal")


@query("select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 2) as total from events group by all")
def p47_tumbling_window(spark, t):
    return t.events.groupBy(F.window(utc(F.col("ts")), "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("""
select s as start, count(*) as n from (select unnest([date_trunc('hour', ts) - interval 1 hour, date_trunc('hour', ts)]) as s from events) group by all
""")
def p47_sliding_window(spark, t):
    return t.events.groupBy(F.window(utc(F.col("ts")), "2 hours", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("""
with a as (select *, case when ts >= lag(ts) over (partition by user_id order by ts) + interval 2 hour then 1 else 0 end as fresh from events),
b as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as s from a)
select user_id, min(ts) as start, max(ts) + interval 2 hour as stop, count(*) as n from b group by user_id, s
""")
def p48_session_window(spark, t):
    return t.events.groupBy("user_id", F.session_window(utc(F.col("ts")), "2 hours").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("stop"), "n")
