"""Scans, formats, a custom connector, sinks, upsert."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import snapshots, upsert
from siltstone.registry import query
from siltstone.sources import archive, create_table, read_jdbc, read_pushed, round_trip
from siltstone.sources.lines import LinesDataSource
from siltstone.sources.series import SeriesDataSource
from siltstone.storage import cut, scratch_path


@query("select l_orderkey, l_linenumber, l_quantity from lineitem where l_shipdate < timestamp '1995-06-01' and l_quantity >= 40")
def p01_parquet_scan(spark, t):
    return t.lineitem.filter((F.col("l_shipdate") < F.lit("1995-06-01").cast("timestamp_ntz")) & (F.col("l_quantity") >= 40)).select("l_orderkey", "l_linenumber", "l_quantity")


@query("select * from nation")
def p02_csv(spark, t):
    return round_trip(t.nation, "csv", header="true")


@query("select * from region")
def p02_json(spark, t):
    return round_trip(t.region, "json")


@query("select c_custkey, c_name, c_acctbal from customer")
def p02_orc(spark, t):
    return round_trip(t.customer.select("c_custkey", "c_name", "c_acctbal"), "orc")


@query("select n_name as value from nation")
def p02_text(spark, t):
    return round_trip(t.nation.select(F.col("n_name").alias("value")), "text")


@query("select n_nationkey, n_name, n_regionkey from nation")
def p02_jdbc(spark, t):
    """From a database, on any master: four tasks read a range of its keys each."""
    url = archive.publish(t.nation.select("n_nationkey", "n_name", "n_regionkey"), "N")
    return read_jdbc(spark, url, "N", "n_nationkey", 0, 25, 4, **archive.OPTIONS)


@query("select range as id, range * range as square from range(1000)")
def p03_custom_source(spark, t):
    spark.dataSource.register(SeriesDataSource)
    return spark.read.format("series").options(n=1000, parts=4).load()


@query("select o_orderstatus, count(*) as n from orders where o_orderstatus = 'F' group by all")
def p04_partitioned_sink(spark, t):
    back = round_trip(t.orders.select("o_orderkey", "o_orderstatus"), "parquet", partition_by=["o_orderstatus"])
    return back.filter("o_orderstatus = 'F'").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("select o_orderkey, o_orderstatus, o_totalprice from orders where o_orderstatus <> 'F'")
def p03_custom_sink(spark, t):
    """Written and read by a connector of our own."""
    spark.dataSource.register(LinesDataSource)
    path, orders = scratch_path(spark), t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice").filter("o_orderstatus <> 'F'")
    orders.write.format("lines").mode("append").save(path)
    return spark.read.format("lines").schema(orders.schema).load(path)


@query("select o_orderkey, o_orderstatus, o_totalprice from orders where o_orderkey between 1000 and 1999 and o_orderstatus in ('F', 'P')")
def p03_filter_pushdown(spark, t):
    """A read of our connector that skips the files whose keys are out of the range asked for."""
    spark.dataSource.register(LinesDataSource)
    path, orders = scratch_path(spark), t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    orders.repartitionByRange(8, "o_orderkey").write.format("lines").mode("append").save(path)
    return read_pushed(spark, "lines", path, orders.schema, "o_orderkey between 1000 and 1999 and o_orderstatus in ('F', 'P')")


@query("select o_orderstatus, count(*) as n, max(o_orderkey) as top from orders group by all")
def p04_table_writer(spark, t):
    orders = t.orders.select("o_orderkey", "o_orderstatus")
    return create_table(orders, ["o_orderstatus"]).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("top"))


@query("""
select s_suppkey, s_name, case when s_suppkey % 3 = 0 then s_acctbal + 100 else s_acctbal end as s_acctbal from supplier where s_suppkey % 7 <> 0 or s_suppkey % 3 <> 0
union all select s_suppkey + 1000000, s_name, 0.0 from supplier where s_suppkey % 10 = 1
""")
def p05_upsert(spark, t):
    s = t.supplier.select("s_suppkey", "s_name", "s_acctbal")
    changed = s.filter("s_suppkey % 3 = 0").withColumn("s_acctbal", F.col("s_acctbal") + 100).withColumn("gone", F.col("s_suppkey") % 7 == 0)
    added = s.filter("s_suppkey % 10 = 1").select((F.col("s_suppkey") + 1_000_000).alias("s_suppkey"), "s_name", F.lit(0.0).alias("s_acctbal"), F.lit(False).alias("gone"))
    return cut(upsert(s, changed.unionByName(added), ["s_suppkey"], "gone"))


@query("""
select o_orderkey, case when o_orderkey between 100 and 200 then 'X' else o_orderstatus end as o_orderstatus, o_custkey from orders where o_orderkey not between 150 and 160
union all select -o_orderkey - 1, 'N', o_custkey from orders where o_orderkey < 10
""")
def p05_copy_on_write_merge(spark, t):
    """Changes of a narrow range of keys rewrite the files that hold it; the others keep their names."""
    root, orders = scratch_path(spark), t.orders.select("o_orderkey", "o_orderstatus", "o_custkey")
    snapshots.create(orders.repartitionByRange(8, "o_orderkey"), root)
    changed = orders.filter("o_orderkey between 100 and 200").withColumn("o_orderstatus", F.lit("X")).withColumn("gone", F.col("o_orderkey").between(150, 160))
    added = orders.filter("o_orderkey < 10").select((-F.col("o_orderkey") - 1).alias("o_orderkey"), F.lit("N").alias("o_orderstatus"), "o_custkey", F.lit(False).alias("gone"))
    snapshots.merge(changed.unionByName(added), root, ["o_orderkey"], "gone")
    return snapshots.read_version(spark, root, orders.schema)
