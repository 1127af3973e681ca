import datetime
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.functions import cosine_similarity
from siltstone.operators import asof_join, broadcast_if_small, range_join, salted_join, upsert
from siltstone.sources import read_jdbc, write_jdbc


@pytest.mark.parametrize("strict", [False, True])
def test_asof_join(spark, strict):
    r = random.Random(1)
    left = [(i, r.choice("ab"), r.choice([None, 1, 2, 3, 4, 5])) for i in range(40)]
    right = [(r.choice("ab"), r.choice([None, 1, 2, 3, 4, 5]), r.randrange(100)) for _ in range(30)]
    got = asof_join(spark.createDataFrame(left, "id int, k string, t int"), spark.createDataFrame(right, "k string, u int, v int"), ["k"], "t", "u", ["v"], strict).collect()

    def want(k, t):
        ok = [(u, v) for k2, u, v in right if k2 == k and u is not None and t is not None and (u < t if strict else u <= t)]
        return max(ok)[1] if ok else None

    assert {x.id: x.v for x in got} == {i: want(k, t) for i, k, t in left}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(points=st.lists(st.floats(-50, 50), max_size=20), ranges=st.lists(st.tuples(st.floats(-50, 50), st.floats(0, 40)), max_size=12), width=st.sampled_from([0.7, 5.0, 100.0]))
def test_range_join(spark, points, ranges, width):
    p = spark.createDataFrame(list(enumerate(points)), "i int, x double")
    q = spark.createDataFrame([(j, a, a + b) for j, (a, b) in enumerate(ranges)], "j int, lo double, hi double")
    got = {(r.i, r.j) for r in range_join(p, q, "x", "lo", "hi", width).collect()}
    assert got == {(i, j) for i, x in enumerate(points) for j, (a, b) in enumerate(ranges) if a <= x < a + b}


def test_range_join_is_an_equi_join(spark):
    p, q = spark.range(10).select(F.col("id").cast("double").alias("x")), spark.range(3).select(F.col("id").cast("double").alias("lo"), (F.col("id") + 2.0).alias("hi"))
    plan = range_join(p, q, "x", "lo", "hi", 2.0)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n"), (3, "c")], "k int, v string")
    new = spark.createDataFrame([(2, "B", False), (None, "N", False), (3, None, True), (9, "new", None)], "k int, v string, gone boolean")
    got = {(r.k, r.v) for r in upsert(old, new, ["k"], "gone").collect()}
    assert got == {(1, "a"), (2, "B"), (None, "N"), (9, "new")}


def test_salted_join(spark):
    left = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(90)], "k int, i int")
    right = spark.createDataFrame([(1, "x"), (3, "y"), (3, "z")], "k int, s string")
    assert sorted(map(tuple, salted_join(left, right, ["k"], 5).collect())) == sorted(map(tuple, left.join(right, "k").collect()))


def test_broadcast_only_within_its_limit(spark):
    small = spark.range(10)
    assert "broadcast" in broadcast_if_small(small)._jdf.queryExecution().logical().toString().lower()
    assert broadcast_if_small(small, 1) is small


def test_cosine_similarity_of_zero_is_null(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(cosine_similarity(F.col("a"), F.col("b"))).collect()]
    assert got[0] == pytest.approx(0.5**0.5) and got[1] is None and got[2] is None


def test_jdbc_round_trip(spark):
    df = spark.createDataFrame([(i, f"n{i}") for i in range(20)], "k int, s string")
    url, options = "jdbc:derby:memory:siltstone;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    try:
        spark._jvm.java.lang.Class.forName(options["driver"])
    except Exception:
        pytest.skip("no embedded database on the class path")
    write_jdbc(df, url, "T", "overwrite", **options)
    back = read_jdbc(spark, url, "T", "k", 0, 20, 4, **options)
    assert back.rdd.getNumPartitions() == 4
    assert sorted((r[0], r[1]) for r in back.collect()) == sorted(map(tuple, df.collect()))


def test_lines_connector(spark):
    from siltstone.sources.lines import LinesDataSource
    from siltstone.storage import scratch_path

    spark.dataSource.register(LinesDataSource)
    path, kinds = scratch_path(spark), "k bigint, s string, d date, t timestamp_ntz, a array<int>"
    day, at = datetime.date(2024, 2, 29), datetime.datetime(2024, 2, 29, 1, 2, 3, 4)
    one = [(1, "a\nb\u2028c", day, at, [1, None]), (None, None, None, None, None)]
    df = spark.createDataFrame(one, kinds)
    back = lambda: sorted(map(tuple, spark.read.format("lines").schema(kinds).load(path).collect()), key=repr)
    df.write.format("lines").mode("append").save(path)
    assert back() == sorted(one, key=repr)
    df.write.format("lines").mode("append").save(path)
    assert back() == sorted(one * 2, key=repr)
    df.limit(0).write.format("lines").mode("append").save(path)
    assert back() == sorted(one * 2, key=repr)
    df.filter("k = 1").write.format("lines").mode("overwrite").save(path)
    assert back() == one[:1]


def test_lines_stream_batch_replaces_its_first_run(tmp_path):
    from siltstone.sources.lines import LinesReader, LinesStreamWriter
    from pyspark.sql import Row
    from pyspark.sql.types import StructType

    path, writer = str(tmp_path / "t"), LinesStreamWriter(str(tmp_path / "t"))
    lost = writer.write(iter([Row(k=7)]))  # a task whose message never came
    for rows in ([Row(k=1)], [Row(k=1), Row(k=2)]):
        writer.commit([writer.write(iter(rows)), None], 0)
    writer.commit([writer.write(iter([]))], 1)
    reader = LinesReader(path, StructType.fromDDL("k bigint"))
    assert [r for p in reader.partitions() for r in reader.read(p)] == [(1,), (2,)]
    writer.abort([lost, None], 2)
    assert not (tmp_path / "t" / lost.file).exists()
