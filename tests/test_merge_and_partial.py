"""Copy-on-write merges, two-phase aggregates and the polymorphic table function."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import moments, snapshots, two_phase
from siltstone.plans.udfs import FirstAndLast
from siltstone.storage import scratch_path

SCHEMA = "k long, v string"


def content(spark, root, number=None):
    return sorted((r.k is None, r.k, r.v) for r in snapshots.read_version(spark, root, SCHEMA, number).collect())


def test_merge_rewrites_only_touched_files(spark):
    root = scratch_path(spark)
    table = spark.range(400).select(F.col("id").alias("k"), F.lit("old").alias("v"))
    snapshots.create(table.repartitionByRange(4, "k"), root)
    before = snapshots.files(spark, root)
    changes = spark.createDataFrame([(3, "new", False), (5, None, True), (9000, "added", False), (None, "null key", False)], "k long, v string, gone boolean")
    assert snapshots.merge(changes, root, ["k"], "gone") == 1
    after = snapshots.files(spark, root)
    assert len(set(before) - set(after)) == 1 and set(before) - set(after) != set(before)
    want = {i: "old" for i in range(400)} | {3: "new", 9000: "added", None: "null key"}
    want.pop(5)
    assert content(spark, root) == sorted((k is None, k, v) for k, v in want.items())
    # the version before is still there, and a null key finds its row again
    assert len(content(spark, root, 0)) == 400 and content(spark, root, 0)[3] == (False, 3, "old")
    snapshots.merge(spark.createDataFrame([(None, "again")], SCHEMA), root, ["k"])
    assert [x for x in content(spark, root) if x[0]] == [(True, None, "again")]


def test_a_failed_or_late_commit_leaves_the_table_readable(spark, monkeypatch):
    root = scratch_path(spark)
    snapshots.create(spark.createDataFrame([(1, "a")], SCHEMA), root)
    one, two = spark.createDataFrame([(1, "b")], SCHEMA), spark.createDataFrame([(1, "c")], SCHEMA)
    with monkeypatch.context() as m:
        m.setattr(snapshots, "publish", lambda *a: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError):
            snapshots.merge(one, root, ["k"])
    assert content(spark, root) == [(False, 1, "a")]
    assert snapshots.merge(one, root, ["k"], base=0) == 1
    with pytest.raises(snapshots.Conflict):
        snapshots.merge(two, root, ["k"], base=0)
    assert content(spark, root) == [(False, 1, "b")]
    # a writer that died while it published
    monkeypatch.setattr(snapshots, "version", lambda *a: 1)
    fs, at = snapshots._fs(spark, f"{root}/_drafts/{2:012d}.taken")
    fs.create(at, False).close()
    with pytest.raises(snapshots.Conflict):
        snapshots.merge(two, root, ["k"], base=1)
    snapshots.release(spark, root)
    assert snapshots.merge(two, root, ["k"], base=1) == 2


def test_merge_into_nothing(spark):
    root = scratch_path(spark)
    assert snapshots.version(spark, root) == -1
    assert snapshots.merge(spark.createDataFrame([(1, "a")], SCHEMA), root, ["k"]) == 0
    assert content(spark, root) == [(False, 1, "a")]


def test_two_phase_moments(spark):
    r = random.Random(1)
    rows = [(r.choice(["hot"] * 9 + ["a", None]), r.choice([None, *[r.gauss(1e6, 1) for _ in range(9)]]), r.uniform(0, 5)) for _ in range(3000)] + [("one", 1.0, 2.0), ("none", None, 1.0)]
    partial, merge, columns = moments(["k"], "x", "y")
    df = spark.createDataFrame(rows, "k string, x double, y double").repartition(4)
    got = {s.k: s for s in two_phase(df, ["k"], partial, merge, f"k string, {columns}").collect()}
    assert "none" not in got
    for k in ("hot", "a", None, "one"):
        x, y = np.array([(a, b) for j, a, b in rows if j == k and a is not None]).T
        assert got[k].n == len(x)
        assert (got[k].mx, got[k].my) == pytest.approx((x.mean(), y.mean()))
        assert (got[k].cxx, got[k].cxy) == pytest.approx((((x - x.mean()) ** 2).sum(), ((x - x.mean()) * (y - y.mean())).sum()), rel=1e-6, abs=1e-6)


def test_a_task_sends_a_state_per_key(spark):
    partial, merge, columns = moments(["k"], "x", "y")
    df = spark.range(0, 60000, 1, 4).select(F.lit("hot").alias("k"), F.col("id").cast("double").alias("x"), F.lit(1.0).alias("y"))
    seen = spark.sparkContext.accumulator(0)

    def counting(states):
        seen.add(len(states))
        return merge(states)

    # 4 tasks of 2 Arrow batches: 8 partial states, then one a task
    assert two_phase(df, ["k"], partial, counting, f"k string, {columns}").first().n == 60000
    assert seen.value <= 8 + 4


def test_polymorphic_table_function_takes_any_column(spark):
    spark.udtf.register("first_and_last", F.udtf(FirstAndLast))
    spark.createDataFrame([("a", 2, 1.5), ("a", 1, 2.5), (None, 7, None)], "k string, t int, x double").createOrReplaceTempView("first_and_last_of")
    got = spark.sql("select * from first_and_last(table(first_and_last_of), 'k', 't', 'x')")
    assert got.dtypes == [("k", "string"), ("first_x", "double"), ("last_x", "double"), ("n", "bigint")]
    assert sorted(map(tuple, got.collect()), key=str) == [("a", 2.5, 1.5, 2), (None, None, None, 1)]
    assert spark.sql("select * from first_and_last(table(first_and_last_of), 'k', 'x', 't')").columns == ["k", "first_t", "last_t", "n"]
