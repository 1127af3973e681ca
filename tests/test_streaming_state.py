"""Interval joins of streams, timers, initial state and state with a lifetime."""

import datetime

import pytest
from pyspark.sql import functions as F

from siltstone.plans.streams import append_by_batch, closing
from siltstone.streaming import event_stream, in_files, in_order, interval_join, read_state, run_to_table, with_rocksdb
from siltstone.streaming.stateful import CountsByType, InactivitySessions

START = datetime.datetime(2024, 1, 1)


def events(spark, rows):
    """(event_id, user_id, minute)"""
    made = [(i, START + datetime.timedelta(minutes=m), u, "view" if i % 2 else "buy") for i, u, m in rows]
    return spark.createDataFrame(made, "event_id long, ts timestamp_ntz, user_id long, event_type string")


ROWS = [(i, i % 7, i * 13 % 3000) for i in range(300)]


def test_interval_join_equals_the_batch_join_and_lets_its_state_go(spark):
    all_ = events(spark, ROWS)
    a = all_.filter("event_type = 'buy'").select(F.col("event_id").alias("buy"), "ts", "user_id")
    b = all_.filter("event_type = 'view'").select(F.col("event_id").alias("seen"), "ts", "user_id")
    left = event_stream(spark, in_order(a, "ts", 4, closing(a)), 2)
    right = event_stream(spark, in_order(b, "ts", 4, closing(b)), 2).withColumnRenamed("ts", "seen_at")
    run = run_to_table(interval_join(left, right, ["user_id"], "ts", "seen_at", "30 minutes", "5 minutes"))
    got = sorted((r.buy, r.seen or -1) for r in run.table.collect() if r.buy >= 0)
    want = []
    for i, u, m in ROWS:
        if i % 2 == 0:
            want += [(i, j) for j, v, k in ROWS if j % 2 and v == u and m - 30 <= k <= m] or [(i, -1)]
    assert got == sorted(want)
    assert -1 in {s for _, s in got}
    held = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in run.progress]
    assert len(held) >= 4 and max(held) < 300 and held[-1] <= 2


def test_in_order_gives_slices_of_time(spark):
    path = in_order(events(spark, ROWS), "ts", 3)
    run = run_to_table(event_stream(spark, path, 2).withWatermark("ts", "0 seconds").groupBy(F.window("ts", "1 minute")).agg(F.count(F.lit(1)).alias("n")))
    assert sum(o["numRowsDroppedByWatermark"] for p in run.progress for o in p["stateOperators"]) == 0


def sessions(rows, gap):
    out = []
    for u in {u for _, u, _ in rows}:
        last = None
        for m in sorted(m for _, v, m in rows if v == u):
            if last is None or m >= last + gap:
                out.append([u, m, 0])
            out[-1][2] += 1
            last = m
    return sorted(map(tuple, out))


@pytest.mark.parametrize("ordered", [True, False])
def test_sessions_end_by_timers_and_open_ones_stay_in_the_state(spark, ordered):
    df = events(spark, ROWS).select("user_id", "ts")

    def run(closed):
        path = in_order(df, "ts", 4, closing(df) if closed else None) if ordered else in_files(df.unionByName(closing(df)) if closed else df, 1)
        stream = event_stream(spark, path, 2 if ordered else 1).withWatermark("ts", "1 minute")
        rows = stream.select("user_id", "ts", F.unix_micros("ts").alias("at")).groupBy("user_id")
        return run_to_table(rows.transformWithStateInPandas(InactivitySessions(20 * 60 * 1_000_000), "user_id long, start long, n long", "Append", "EventTime"))

    base = int(START.replace(tzinfo=datetime.timezone.utc).timestamp())
    ended = lambda run: sorted((r.user_id, (r.start // 1_000_000 - base) // 60, r.n) for r in run.table.collect())
    assert ended(with_rocksdb(spark, lambda: run(True))) == sessions(ROWS, 20)
    part = with_rocksdb(spark, lambda: run(False))
    open_ = with_rocksdb(spark, lambda: read_state(spark, part.checkpoint, "open").select("key.user_id", "list_element.*").collect() if "list_element" in read_state(spark, part.checkpoint, "open").columns else read_state(spark, part.checkpoint, "open").selectExpr("key.user_id", "inline(list_value)").collect())
    still = [(r.user_id, (r["first"] // 1_000_000 - base) // 60, r.n) for r in open_]
    assert still
    assert sorted(ended(part) + still) == sessions(ROWS, 20)


def counts(spark, rows, ttl, initial=None):
    stream = event_stream(spark, in_files(events(spark, rows), 4))
    return append_by_batch(stream.groupBy("user_id").transformWithStateInPandas(CountsByType(ttl), "user_id long, event_type string, n long", "Update", "ProcessingTime" if ttl else "None", initial))


def test_counts_go_on_from_an_initial_state(spark):
    initial = spark.createDataFrame([(0, "buy", 1000), (0, "other", 5), (99, "buy", 7)], "user_id long, event_type string, n long").groupBy("user_id")
    got = with_rocksdb(spark, lambda: counts(spark, ROWS, None, initial)).groupBy("user_id", "event_type").agg(F.max("n").alias("n"))
    have = {(r.user_id, r.event_type): r.n for r in got.collect()}
    assert have[0, "buy"] == 1000 + sum(u == 0 and i % 2 == 0 for i, u, _ in ROWS)
    assert have[0, "other"] == 5
    assert have[3, "view"] == sum(u == 3 and i % 2 == 1 for i, u, _ in ROWS)
    assert all(u != 99 for u, _ in have)


def test_a_short_lifetime_forgets_between_batches(spark):
    key = "spark.sql.streaming.noDataMicroBatches.enabled"
    spark.conf.set(key, "false")
    try:
        rows = with_rocksdb(spark, lambda: counts(spark, ROWS, 1))
    finally:
        spark.conf.unset(key)
    per_user = rows.groupBy("user_id", "event_type").agg(F.sum("n").alias("n"), F.max("n").alias("most")).collect()
    whole = {(u, k): sum(v == u and (i % 2 == 1) == (k == "view") for i, v, _ in ROWS) for u in range(7) for k in ("view", "buy")}
    # nothing is carried on, so the batches' counts add up to the whole
    assert {(r.user_id, r.event_type): r.n for r in per_user} == whole
    assert all(r.most < whole[r.user_id, r.event_type] for r in per_user)


class Store:
    """A map state in memory that counts its requests, and a handle that keeps timers."""

    def __init__(self):
        self.held, self.timers, self.requests = {}, [], 0

    def getMapState(self, *_):
        return self

    def registerTimer(self, at):
        self.timers.append(at)

    def getValue(self, key):
        self.requests += 1
        return self.held.get(key)

    def updateValue(self, key, value):
        self.requests += 1
        self.held[key] = value

    def removeKey(self, key):
        del self.held[key]

    def iterator(self):
        return iter(self.held.items())


def test_buckets_ask_twice_a_user_and_set_one_timer():
    import pandas as pd

    from siltstone.streaming.stateful import CountsByBucket, SessionsByBucket, TotalsByBucket

    frames = lambda: iter([pd.DataFrame({"user": ["a", "b", "", "a"], "value": [1.0, None, 2.0, 4.0], "event_type": ["x", None, "x", "x"], "at": [0, 5_000, 7_000, 90_000]})] * 2)
    store, p = Store(), TotalsByBucket()
    p.init(store)
    (out,) = p.handleInputRows((1,), frames(), None)
    assert sorted(map(tuple, out.to_numpy().tolist())) == [("", 2, 4.0), ("a", 4, 10.0), ("b", 2, 0.0)] and store.requests == 6
    store, p = Store(), CountsByBucket()
    p.init(store)
    p.handleInitialState((1,), pd.DataFrame({"user": ["a", "c"], "event_type": ["y", "y"], "n": [7, 1]}), None)
    (out,) = p.handleInputRows((1,), frames(), None)
    assert sorted(map(str, out.to_numpy().tolist())) == sorted(map(str, [["a", "x", 4], ["a", "y", 7], ["b", None, 2], ["", "x", 2]])) and store.requests == 10
    store, p = Store(), SessionsByBucket(10_000)
    p.init(store)
    assert list(p.handleInputRows((1,), frames(), None)) == [] and store.timers == [10] and store.requests == 6

    class Now:
        def getCurrentWatermarkInMs(self):
            return 16

    (out,) = p.handleExpiredTimer((1,), Now(), None)
    assert sorted(map(tuple, out.to_numpy().tolist())) == [("a", 0, 2), ("b", 5000, 2)]
    assert store.timers == [10, 17] and set(store.held) == {("a",), ("",)}
