"""As-of joins, ranks, frames, quantiles and overlaps of hot keys against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone import catalog
from siltstone.operators import exact_quantiles, global_ranks, numbered, overlap_join, range_sums, ranged_asof_join, ranged_overlap_join, rows_frame, running_sums


def skewed(r, n):
    """Rows of one key with most of all, some keys beside, null keys and null times, ties and repeated rows."""
    rows = [(i, r.choice(["hot"] * 8 + ["a", "b", None]), r.choice([None, *range(12), *range(60)]), r.randrange(-9, 50)) for i in range(n)]
    return rows


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("by", [["k"], [], ["k", "j"]])
def test_ranged_asof_join(spark, strict, by):
    r = random.Random(1)
    left = [(i, k, t, i % 3) for i, k, t, _ in skewed(r, 300)]
    right = [(k, u, v, v % 3) for _, k, u, v in skewed(r, 200) if v % 5]
    l, q = spark.createDataFrame(left, "id int, k string, t int, j int"), spark.createDataFrame(right, "k string, u int, v int, j int")
    got = ranged_asof_join(l, q.drop(*[c for c in ("k", "j") if c not in by]), by, "t", "u", ["v"], strict).collect()

    def want(k, t, j):
        ok = [(u, v) for k2, u, v, j2 in right if ("k" not in by or k2 == k) and ("j" not in by or j2 == j) and u is not None and t is not None and (u < t if strict else u <= t)]
        return max(ok)[1] if ok else None

    assert {x.id: x.v for x in got} == {i: want(k, t, j) for i, k, t, j in left}
    assert len(got) == len(left)


def test_ranged_asof_join_of_nothing(spark):
    l, q = spark.createDataFrame([(1, 2)], "id int, t int"), spark.createDataFrame([], "u int, v string")
    assert [tuple(x) for x in ranged_asof_join(l, q, [], "t", "u", ["v"]).collect()] == [(1, 2, None)]
    assert ranged_asof_join(l.limit(0), q, [], "t", "u", ["v"]).count() == 0


def test_a_value_is_carried_over_many_ranges(spark):
    l = spark.range(4000).select(F.col("id"), (F.col("id") + 5).alias("t"))
    q = spark.createDataFrame([(0, "first"), (4002, "late")], "u bigint, v string")
    got = ranged_asof_join(l, q, [], "t", "u", ["v"])
    assert {(x.v, x["count"]) for x in got.groupBy("v").count().collect()} == {("first", 3997), ("late", 3)}


def test_a_hot_key_is_spread_over_ranges(spark):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    l = spark.range(8000).select(F.lit("hot").alias("k"), F.col("id").alias("t"))
    from siltstone.operators.ranges import in_ranges

    sizes = [x["count"] for x in in_ranges(l, ["k", "t"]).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == n and max(sizes) < 2 * 8000 / n
    plan = ranged_asof_join(l, l.select("k", F.col("t").alias("u"), F.col("t").alias("v")), ["k"], "t", "u", ["v"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "NestedLoop" not in plan


def ranked(rows, key, order, ties):
    out = {}
    for k in {key(x) for x in rows}:
        mine = sorted((x for x in rows if key(x) == k), key=lambda x: (order(x), ties(x)))
        values = sorted({order(x) for x in mine})
        for i, x in enumerate(mine):
            out[x[0]] = (i + 1, 1 + sum(order(y) < order(x) for y in mine), 1 + values.index(order(x)))
    return out


@pytest.mark.parametrize("by", [["k"], []])
def test_numbered(spark, by):
    r = random.Random(3)
    rows = [(i, k, None if t is None else t % 7, v) for i, k, t, v in skewed(r, 400)]
    df = spark.createDataFrame(rows, "id int, k string, t int, v int")
    got = {x.id: (x.row_number, x["rank"], x.dense_rank) for x in numbered(df, by, ["t"], ["-id"]).collect()}
    assert got == ranked(rows, lambda x: x[1] if by else 0, lambda x: (x[2] is not None, x[2] or 0), lambda x: -x[0])


def test_global_ranks_agree_with_windows(spark):
    from pyspark.sql import Window

    df = spark.range(997).select("id", (F.col("id") * 7919 % 31).alias("x"))
    w, u = Window.orderBy(F.desc("x")), Window.orderBy(F.desc("x"), "id")
    want = df.select("id", F.row_number().over(u), F.rank().over(w), F.dense_rank().over(w), F.percent_rank().over(w), F.ntile(10).over(u))
    got = global_ranks(df, ["-x"], ["id"], 10).select("id", "row_number", "rank", "dense_rank", "percent_rank", "ntile")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    assert global_ranks(df.limit(0), ["x"]).count() == 0
    few = global_ranks(df.limit(3), ["id"], (), 10).select("ntile").collect()
    assert sorted(x.ntile for x in few) == [1, 2, 3]


@pytest.mark.parametrize("before,after,block", [(2, 1, 8), (0, 5, 6), (7, 0, 8), (3, 3, 1)])
def test_rows_frame_and_running_sums(spark, before, after, block):
    r = random.Random(4)
    rows = skewed(r, 300)
    df = spark.createDataFrame(rows, "id int, k string, t int, v int")
    got = {x.id: (x.s, x.n) for x in rows_frame(df, ["k"], ["t", "id"], before, after, {"s": F.sum("v"), "n": F.count("v")}, block).collect()}
    run = {x.id: x.s for x in running_sums(df, ["k"], ["t", "id"], {"s": "v"}, block).collect()}
    want, sums = {}, {}
    for k in {x[1] for x in rows}:
        mine = sorted((x for x in rows if x[1] == k), key=lambda x: (x[2] is not None, x[2] or 0, x[0]))
        for i, x in enumerate(mine):
            near = mine[max(0, i - before) : i + after + 1]
            want[x[0]] = (sum(y[3] for y in near), len(near))
            sums[x[0]] = sum(y[3] for y in mine[: i + 1])
    assert got == want
    assert run == sums


def test_range_sums(spark):
    rows = skewed(random.Random(5), 300)
    df = spark.createDataFrame(rows, "id int, k string, t int, v int")
    got = {x.id: (x.n, x.s) for x in range_sums(df, ["k"], "t", 4, 2, {"s": "v"}).collect()}

    def want(k, t):
        near = [y[3] for y in rows if y[1] == k and t is not None and y[2] is not None and t - 4 <= y[2] <= t + 2]
        return (len(near), sum(near)) if t is not None else (None, None)

    assert got == {i: want(k, t) for i, k, t, _ in rows}


@pytest.mark.parametrize("bins", [2, 512])
def test_exact_quantiles(spark, bins):
    r = random.Random(6)
    rows = [(k, r.choice([r.gauss(0, 1), r.gauss(0, 1) * 10 ** r.randrange(-30, 30), 1.5, 1.5])) for k in ["hot"] * 900 + ["a"] * 7 + [None] * 20]
    rows += [("hot", None), ("hot", float("nan")), ("none", None), ("one", 3.0), ("same", 2.0), ("same", 2.0)]
    asked = {"low": 0.0, "q": 0.137, "med": 0.5, "high": 1.0}
    got = {x.k: tuple(x)[1:] for x in exact_quantiles(spark.createDataFrame(rows, "k string, x double"), ["k"], "x", asked, bins).collect()}
    for k in {x[0] for x in rows}:
        values = [x for j, x in rows if j == k and x is not None and not math.isnan(x)]
        want = tuple(float(np.quantile(values, q)) for q in asked.values()) if values else (None,) * 4
        assert got[k] == pytest.approx(want, rel=1e-12) if values else got[k] == want
    assert exact_quantiles(spark.createDataFrame([], "x double"), [], "x", {"m": 0.5}).collect()[0].m is None


def test_quantiles_shuffle_bins_and_not_rows(spark):
    df = spark.range(20000).select(F.lit("k").alias("k"), (F.col("id") * 1.0).alias("x"))
    assert exact_quantiles(df, ["k"], "x", {"m": 0.5}).collect()[0].m == 9999.5


def test_overlap_join(spark):
    r = random.Random(7)

    def intervals(n):
        return [(i, r.choice("xy"), a, a + w) for i in range(n) for a in [r.uniform(-50, 50)] for w in [r.choice([0.0, 0.01, 1.0, 2.0, 7.5, 64.0, 1000.0, -1.0])]] + [(n, "x", None, 3.0), (n + 1, "y", 3.0, None)]

    a, b = intervals(60), intervals(50)
    l, q = spark.createDataFrame(a, "i int, k string, lo double, hi double"), spark.createDataFrame(b, "j int, k string, since double, till double")
    meets = lambda x, y: None not in (*x, *y) and x[2] < x[3] and y[2] < y[3] and x[2] < y[3] and y[2] < x[3]
    for finest, levels in ((1.0, 40), (0.1, 4), (100.0, 3)):
        got = [(x.i, x.j) for x in overlap_join(l, q.drop("k"), ("lo", "hi"), ("since", "till"), finest=finest, levels=levels).collect()]
        assert sorted(got) == sorted((x[0], y[0]) for x in a for y in b if meets(x, y))
    got = [(x.i, x.j) for x in overlap_join(l, q, ("lo", "hi"), ("since", "till"), ["k"]).collect()]
    assert sorted(got) == sorted((x[0], y[0]) for x in a for y in b if meets(x, y) and x[1] == y[1])
    joined = overlap_join(l, q.drop("k"), ("lo", "hi"), ("since", "till"))
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert joined.columns == ["i", "k", "lo", "hi", "j", "since", "till"]
    assert overlap_join(l.limit(0), q.drop("k"), ("lo", "hi"), ("since", "till")).count() == 0


def test_overlap_join_meets_only_in_cells_where_one_is_at_home(spark):
    """Short intervals are copied to the wide ones' level on both sides, but don't meet there; hot cells are dealt."""
    short = spark.range(2000).select(F.col("id").alias("i"), (F.col("id") * 10.0).alias("lo"), (F.col("id") * 10.0 + 1).alias("hi"))
    wide = spark.range(2).select((F.col("id") - 2).alias("i"), F.lit(0.0).alias("lo"), F.lit(20000.0).alias("hi"))
    l = short.unionByName(wide)
    q = l.toDF("j", "since", "till")
    for block in (8192, 50):
        joined = overlap_join(l, q, ("lo", "hi"), ("since", "till"), block=block)
        assert joined.count() == 2000 + 2 * 2 * 2000 + 4
        assert joined.filter("i >= 0 and j >= 0 and i <> j").count() == 0
    # candidates: rows of the join before its inequalities
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "_kind" in plan and "_l_piece" in plan


def test_ranged_overlap_join(spark):
    """Ends that are equal, infinite, NaN, null or the wrong way round; blocks of one row, of some and of all."""
    r = random.Random(8)
    nan, inf = float("nan"), float("inf")

    def intervals(n):
        lows = [r.choice([r.uniform(-50, 50), 3.0, 3.0, float(r.randrange(-50, 50))]) for _ in range(n)]
        rows = [(i, r.choice("xyz"), a, a + r.choice([0.0, 0.01, 1.0, 2.0, 7.5, 64.0, 1000.0, -1.0, inf, nan])) for i, a in enumerate(lows)]
        return rows + [(n, "x", None, 3.0), (n + 1, "y", 3.0, None), (n + 2, None, 3.0, 4.0), (n + 3, "x", -inf, -3.0)]

    a, b = intervals(90), intervals(70)
    l, q = spark.createDataFrame(a, "i int, k string, lo double, hi double"), spark.createDataFrame(b, "j int, k string, since double, till double")
    above = lambda x, y: x is not None and y is not None and (x > y or (math.isnan(x) and not math.isnan(y)))
    meets = lambda x, y: above(x[3], x[2]) and above(y[3], y[2]) and above(y[3], x[2]) and above(x[3], y[2])
    for block in (1, 20, 1 << 18):
        joined = ranged_overlap_join(l, q.drop("k"), ("lo", "hi"), ("since", "till"), block=block)
        assert joined.columns == ["i", "k", "lo", "hi", "j", "since", "till"]
        assert sorted((x.i, x.j) for x in joined.collect()) == sorted((x[0], y[0]) for x in a for y in b if meets(x, y))
        joined = ranged_overlap_join(l, q, ("lo", "hi"), ("since", "till"), ["k"], keep=["j", "i"], block=block)
        assert joined.columns == ["j", "i"]
        assert sorted((x.i, x.j) for x in joined.collect()) == sorted((x[0], y[0]) for x in a for y in b if meets(x, y) and x[1] == y[1] is not None)
    assert ranged_overlap_join(l.limit(0), q.drop("k"), ("lo", "hi"), ("since", "till")).count() == 0


def test_ranged_overlap_join_deals_rows_that_start_together(spark):
    l = spark.range(1000).select(F.col("id").alias("i"), F.lit(5.0).alias("lo"), F.lit(6.0).alias("hi"))
    joined = ranged_overlap_join(l, l.toDF("j", "since", "till"), ("lo", "hi"), ("since", "till"), block=100)
    found = joined.groupBy(F.spark_partition_id()).count().collect()
    assert sum(x[1] for x in found) == 1000 * 1000
    assert len(found) >= 10 and max(x[1] for x in found) < 300000


def test_overlaps_of_events_shuffle_about_a_row_an_interval(spark):
    folder = "/root/testdata/sf0.01"
    intervals = spark.read.parquet(f"{folder}/events.parquet").filter("event_type in ('purchase', 'view')").count()
    store = spark.sparkContext._jsc.sc().statusStore()

    def shuffled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    began = shuffled()
    catalog.queries()["p12_overlap_join"](spark, folder).write.format("noop").mode("overwrite").save()
    assert shuffled() - began < 1.5 * intervals


def test_overlap_blocks_of_long_intervals_are_put_together(spark, monkeypatch):
    """Many shuffle partitions don't make each long interval visit as many blocks."""
    from siltstone.operators import ranges

    monkeypatch.setattr(ranges, "FEW_ROWS", 10)
    n = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        for length, least, most in ((1.0, 190, 200), (3000.0, 32, 40)):
            rows = spark.range(8000).select(F.lit(0).cast("bigint").alias("_sl_key"), F.col("id").cast("double").alias("_sl_low"), (F.col("id") + length).alias("_sl_high")).coalesce(2)
            assert least <= len(ranges._block_bounds(rows, 1 << 18)[0]) <= most
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", n)
