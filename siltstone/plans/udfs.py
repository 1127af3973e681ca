"""User-defined functions, aggregates, table functions and partition maps."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeResult, OrderingColumn, PartitioningColumn

from siltstone.operators import moments, two_phase
from siltstone.registry import query


@query("select o_orderkey, round(o_totalprice * 0.19, 4) as by_row, round(o_totalprice * 0.19, 4) as by_pandas, round(o_totalprice * 0.19, 4) as by_arrow from orders")
def p52_scalar_udfs(spark, t):
    by_row = F.udf(lambda x: x * 0.19, "double")

    @F.pandas_udf("double")
    def by_pandas(x: pd.Series) -> pd.Series:
        return x * 0.19

    @F.arrow_udf("double")
    def by_arrow(x: pa.Array) -> pa.Array:
        return pc.multiply(x, 0.19)

    price = F.col("o_totalprice")
    return t.orders.select("o_orderkey", F.round(by_row(price), 4).alias("by_row"), F.round(by_pandas(price), 4).alias("by_pandas"), F.round(by_arrow(price), 4).alias("by_arrow"))


@query("select c_nationkey, round(avg(c_acctbal), 5) as mean from customer group by all")
def p53_grouped_aggregate(spark, t):
    @F.pandas_udf("double")
    def mean(v: pd.Series) -> float:
        return float(v.mean())

    return t.customer.groupBy("c_nationkey").agg(F.round(mean("c_acctbal"), 5).alias("mean"))


@query("select c_custkey, round(c_acctbal - avg(c_acctbal) over (partition by c_nationkey), 5) as off from customer")
def p53_apply_in_pandas(spark, t):
    def centre(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"c_custkey": frame["c_custkey"], "off": (frame["c_acctbal"] - frame["c_acctbal"].mean())})

    return t.customer.groupBy("c_nationkey").applyInPandas(centre, "c_custkey long, off double").select("c_custkey", F.round("off", 5).alias("off"))


@query("select s_nationkey, count(*) as n, max(s_acctbal) as top from supplier group by all")
def p53_apply_in_arrow(spark, t):
    def top(table: pa.Table) -> pa.Table:
        return pa.table({"s_nationkey": table["s_nationkey"][:1], "n": pa.array([table.num_rows]), "top": pa.array([pc.max(table["s_acctbal"]).as_py()])})

    return t.supplier.groupBy("s_nationkey").applyInArrow(top, "s_nationkey int, n long, top double")


@query("select n_nationkey as k, (select count(*) from customer where c_nationkey = n_nationkey) as customers, (select count(*) from supplier where s_nationkey = n_nationkey) as suppliers from nation where n_nationkey in (select c_nationkey from customer union select s_nationkey from supplier)")
def p53_cogroup(spark, t):
    def sizes(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": [key[0]], "customers": [len(a)], "suppliers": [len(b)]})

    a, b = t.customer.select("c_nationkey").groupBy("c_nationkey"), t.supplier.select("s_nationkey").groupBy("s_nationkey")
    return a.cogroup(b).applyInPandas(sizes, "k int, customers long, suppliers long")


@query("""
select l_returnflag, count(*) as n, round(avg(l_quantity), 6) as mean, round(var_samp(l_quantity), 6) as variance, round(covar_samp(l_quantity, l_extendedprice), 2) as covariance, round(corr(l_quantity, l_extendedprice), 8) as correlation
from lineitem group by all
""")
def p53_two_phase_aggregate(spark, t):
    """Three keys hold all rows; each task sends a state per key."""
    partial, merge, columns = moments(["l_returnflag"], "l_quantity", "l_extendedprice")
    states = two_phase(t.lineitem.select("l_returnflag", "l_quantity", "l_extendedprice"), ["l_returnflag"], partial, merge, f"l_returnflag string, {columns}")
    less = F.col("n") - 1
    return states.select(
        "l_returnflag", "n", F.round("mx", 6).alias("mean"), F.round(F.col("cxx") / less, 6).alias("variance"), F.round(F.col("cxy") / less, 2).alias("covariance"), F.round(F.col("cxy") / F.sqrt(F.col("cxx") * F.col("cyy")), 8).alias("correlation")
    )


class FirstAndLast:
    """Table function: per key of a table, in an order, the first and last value of a column and the number of rows.

    The names of key, order and value columns are arguments, so the schema follows from them and from the table.
    """

    def __init__(self, analyzed):
        self.key, self.value = analyzed.key, analyzed.value
        self.n, self.first, self.last, self.of = 0, None, None, None

    @staticmethod
    def analyze(table, key, order, value):
        kinds = {f.name: f.dataType for f in table.dataType.fields}
        schema = T.StructType([T.StructField(key.value, kinds[key.value]), T.StructField(f"first_{value.value}", kinds[value.value]), T.StructField(f"last_{value.value}", kinds[value.value]), T.StructField("n", T.LongType())])
        return Chosen(schema, partitionBy=[PartitioningColumn(key.value)], orderBy=[OrderingColumn(c.strip()) for c in order.value.split(",")], key=key.value, value=value.value)

    def eval(self, row, key, order, value):
        if not self.n:
            self.first = row[self.value]
        self.of, self.last, self.n = row[self.key], row[self.value], self.n + 1

    def terminate(self):
        if self.n:
            yield self.of, self.first, self.last, self.n


@dataclass
class Chosen(AnalyzeResult):
    """What analyze has chosen, for the function itself."""

    key: str = ""
    value: str = ""


@query("""
select user_id, arg_min(event_type, (ts, event_id)) as first_event_type, arg_max(event_type, (ts, event_id)) as last_event_type, count(*) as n from events group by all
""")
def p54_polymorphic_table_function(spark, t):
    """analyze picks the schema, the partitioning and the order of the table argument."""
    spark.udtf.register("siltstone_first_and_last", F.udtf(FirstAndLast))
    t.events.select("user_id", "ts", "event_id", "event_type").createOrReplaceTempView("siltstone_events")
    return spark.sql("select * from siltstone_first_and_last(table(siltstone_events), 'user_id', 'ts, event_id', 'event_type')")


@query("select p_partkey, unnest(range(cast(p_size as bigint) % 4)) as i from part")
def p54_table_function(spark, t):
    @F.udtf(returnType="p_partkey long, i long")
    class Steps:
        def eval(self, key: int, n: int):
            for i in range(n):
                yield key, i

    spark.udtf.register("siltstone_steps", Steps)
    t.part.createOrReplaceTempView("siltstone_parts")
    return spark.sql("select s.p_partkey, s.i from siltstone_parts p, lateral siltstone_steps(p.p_partkey, p.p_size % 4) s")


@query("select n_nationkey, n_nationkey * 10 as tens from nation where n_nationkey < 20")
def p54_arrow_table_function(spark, t):
    """A table function that takes a table and yields Arrow tables."""

    @F.arrow_udtf(returnType="n_nationkey int, tens int")
    class Tens:
        def eval(self, batch: pa.RecordBatch):
            key = batch.column("n_nationkey")
            key = key.filter(pc.less(key, 20))
            yield pa.table({"n_nationkey": key, "tens": pc.multiply(key, pa.scalar(10, pa.int32()))})

    spark.udtf.register("siltstone_tens", Tens)
    t.nation.select("n_nationkey").createOrReplaceTempView("siltstone_nations")
    return spark.sql("select * from siltstone_tens(table(siltstone_nations))")


@query("select l_orderkey, l_linenumber, l_quantity * 2 as twice from lineitem where l_quantity > 45")
def p55_map_in_pandas(spark, t):
    def keep(frames):
        for f in frames:
            f = f[f["l_quantity"] > 45]
            yield f.assign(twice=f["l_quantity"] * 2)[["l_orderkey", "l_linenumber", "twice"]]

    return t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity").mapInPandas(keep, "l_orderkey long, l_linenumber int, twice double")


@query("select event_id, value * value as square from events")
def p55_map_in_arrow(spark, t):
    def square(batches):
        for b in batches:
            v = np.asarray(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(v * v)], names=["event_id", "square"])

    return t.events.select("event_id", "value").mapInArrow(square, "event_id long, square double")
