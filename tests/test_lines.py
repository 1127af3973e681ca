import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, IsNull, LessThan, LessThanOrEqual

from siltstone.sources import read_pushed
from siltstone.sources.lines import LinesDataSource, LinesStreamReader, LinesStreamWriter, SkippingLinesReader, Written
from siltstone.storage import scratch_path
from siltstone.streaming import run_to_table

KIND = T.StructType().add("k", T.IntegerType()).add("s", T.StringType()).add("x", T.DoubleType()).add("at", T.TimestampNTZType()).add("ok", T.BooleanType())


def saved(spark, rows, path=None, mode="append", files=1):
    spark.dataSource.register(LinesDataSource)
    path = path or scratch_path(spark)
    spark.createDataFrame(rows, KIND).repartitionByRange(files, "k").write.format("lines").mode(mode).save(path)
    return path


def row(k, s="a", x=1.0):
    return (k, s, x, datetime.datetime(2020, 1, 1, 0, 0, 0, k or 0), True)


def files(path, *filters):
    reader = SkippingLinesReader(path, KIND)
    assert list(reader.pushFilters(list(filters))) == list(filters)  # Spark applies all of them again
    return [p.value for p in reader.partitions() if p.value]


def test_files_are_skipped_by_their_ends(spark):
    path = saved(spark, [row(k, "abcd"[k // 10], float(k)) for k in range(40)], files=4)
    assert len(files(path)) == 4
    k, s = ("k",), ("s",)
    assert len(files(path, EqualTo(k, 15))) == 1 and len(files(path, EqualTo(k, 99))) == 0
    assert len(files(path, GreaterThan(k, 39))) == 0 and len(files(path, GreaterThanOrEqual(k, 39))) == 1
    assert len(files(path, LessThan(k, 0))) == 0 and len(files(path, LessThanOrEqual(k, 0))) == 1
    assert len(files(path, In(k, (1, 2, 35)))) == 2 and len(files(path, In(k, (None,)))) == 0
    assert len(files(path, EqualTo(s, "b"), LessThan(("x",), 25.0))) == 1
    # what the ends don't tell skips nothing
    assert len(files(path, IsNull(k), EqualTo(("at",), datetime.datetime(1999, 1, 1)), EqualTo(("ok",), False), EqualTo(("s", "inner"), "z"), EqualTo(s, 3), GreaterThan(("x",), float("nan")))) == 4


def test_nulls_and_odd_numbers(spark):
    path = saved(spark, [row(1, None, float("nan")), row(2, None, float("inf")), row(None, None, None)])
    assert len(files(path, EqualTo(("s",), "a"))) == 0  # nulls alone
    assert len(files(path, GreaterThan(("x",), 5.0))) == 1 and len(files(path, LessThan(("k",), 2))) == 1
    assert len(files(saved(spark, []))) == 0


@pytest.mark.parametrize("condition", ["k between 12 and 17", "k in (3, 38) and s <> 'a'", "s >= 'c' or k = 0", "x > 30 and ok", "s is null", "k = 400"])
def test_pushed_reads_are_whole(spark, condition):
    rows = [row(k, None if k % 7 == 0 else "abcd"[k // 10], float(k)) for k in range(40)]
    path = saved(spark, rows, files=4)
    want = spark.createDataFrame(rows, KIND).filter(condition)
    assert sorted(read_pushed(spark, "lines", path, KIND, condition).collect(), key=str) == sorted(want.collect(), key=str)
    assert spark.conf.get("spark.sql.python.filterPushdown.enabled") == "false"


def test_stream_goes_on_from_its_checkpoint(spark):
    path = saved(spark, [row(k) for k in range(10)], files=3)
    stream = spark.readStream.format("lines").schema(KIND).load(path)
    first = run_to_table(stream)
    assert sorted(r.k for r in first.table.collect()) == list(range(10))
    saved(spark, [row(k) for k in range(10, 15)], path)
    saved(spark, [row(k) for k in range(15, 20)], path)
    second = run_to_table(stream, first.checkpoint, first.path)
    assert sorted(r.k for r in second.table.collect()) == list(range(20))
    assert sum(p["numInputRows"] for p in second.progress) == 10
    third = run_to_table(stream, first.checkpoint, first.path)
    assert third.table.count() == 20 and sum(p["numInputRows"] for p in third.progress) == 0


def test_offsets_are_commits_and_partitions_files(spark):
    path = saved(spark, [row(k) for k in range(10)], files=3)
    saved(spark, [row(10)], path)
    reader = LinesStreamReader(path, KIND)
    assert reader.initialOffset() == {"commit": 0} and reader.latestOffset() == {"commit": 2}
    assert [len(reader.partitions({"commit": a}, {"commit": b})) for a, b in ((0, 1), (1, 2), (0, 2), (2, 2))] == [3, 1, 4, 0]
    assert [r[0] for r in reader.read(reader.partitions({"commit": 1}, {"commit": 2})[0])] == [10]
    assert LinesStreamReader(scratch_path(spark), KIND).latestOffset() == {"commit": 0}


def test_a_batch_run_again_keeps_its_number(spark):
    path = saved(spark, [row(0)])
    writer = LinesStreamWriter(path)
    writer.commit([Written("one", 1)], 0)
    writer.commit([Written("two", 1)], 1)
    writer.commit([Written("again", 1)], 0)
    reader = LinesStreamReader(path, KIND)
    assert reader.latestOffset() == {"commit": 3}
    assert [p.value for p in reader.partitions({"commit": 1}, {"commit": 3})] == ["again", "two"]


def test_overwrite_leaves_the_new_rows(spark):
    path = saved(spark, [row(1), row(2)])
    saved(spark, [row(3)], path, "overwrite")
    assert [r.k for r in spark.read.format("lines").schema(KIND).load(path).agg(F.max("k").alias("k")).collect()] == [3]
    assert len(files(path)) == 1
