"""P47-P51 on streams: the events table replayed as a stream must give what the batch gives."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.registry import query
from siltstone.sources.lines import LinesDataSource
from siltstone.sources.series import SeriesDataSource
from siltstone.storage import scratch_path
from siltstone.streaming import append_to_table, event_stream, in_files, in_order, interval_join, latest_table, run_to_table, with_rocksdb
from siltstone.streaming.stateful import CountsByBucket, RowTotals, SessionsByBucket, TotalsByBucket, count_batches


@query("select date_trunc('hour', ts) as start, event_type, count(*) as n from events group by all")
def p47_stream_tumbling(spark, t):
    windows = event_stream(spark, t.path("events")).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return latest_table(windows).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""
with a as (select *, case when ts >= lag(ts) over (partition by user_id order by ts) + interval 2 hour then 1 else 0 end as fresh from events),
b as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as s from a)
select user_id, min(ts) as start, count(*) as n from b group by user_id, s
""")
def p48_stream_session(spark, t):
    sessions = event_stream(spark, t.path("events")).groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return latest_table(sessions).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("""
with d as (select cast(date_trunc('day', ts) as timestamp) as day, count(*) as n from events group by 1)
select * from d where day + interval 1 day <= (select max(ts) - interval 1 hour from events)
""")
def p49_watermark(spark, t):
    """Day windows in append mode: the watermark holds back those that may still get rows."""
    days = event_stream(spark, t.path("events")).withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return append_to_table(days).select(F.col("w.start").cast("timestamp_ntz").alias("day"), "n")


def closing(events):
    """An event of nobody, long after all others."""
    late = events.agg((F.max("ts") + F.expr("interval 100 days")).alias("ts"))
    return late.select(*[F.col("ts") if f.name == "ts" else F.lit(-1).cast(f.dataType).alias(f.name) for f in events.schema.fields])


@query("""
select p.event_id as buy, v.event_id as seen from (select * from events where event_type = 'purchase') p
left join (select * from events where event_type = 'view') v on p.user_id = v.user_id and v.ts <= p.ts and v.ts >= p.ts - interval 6 hour
""")
def p49_stream_interval_join(spark, t):
    """Purchases with the same user's views in the six hours before, two streams; those without one come out when the watermarks have passed."""
    sides = []
    for kind, names in (("purchase", {"event_id": "buy", "ts": "ts"}), ("view", {"event_id": "seen", "ts": "seen_at"})):
        some = t.events.filter(F.col("event_type") == kind).select("event_id", "user_id", "ts")
        stream = event_stream(spark, in_order(some, "ts", 4, closing(some)), 2)
        sides.append(stream.withColumnsRenamed(names))
    pairs = interval_join(*sides, ["user_id"], "ts", "seen_at", "6 hours", "1 hour")
    return run_to_table(pairs.select("buy", "seen", "user_id")).table.filter("user_id >= 0").select("buy", "seen")


@query("select event_id from events")
def p50_stream_dedup(spark, t):
    """Each event sent twice, mostly in different batches, once kept; the delay spans the table, so nothing is late."""
    twice = t.events.withColumn("again", F.explode(F.array(F.lit(0), F.lit(1))))
    stream = event_stream(spark, in_files(twice, 4)).withWatermark("ts", "3650 days")
    return append_to_table(stream.dropDuplicatesWithinWatermark(["event_id"]).select("event_id"))


TOTALS = "select user_id, count(*) as n, round(sum(value), 2) as total from events group by all"


#: Groups of users that the stateful operators take together; a group has a cost whatever its rows.
USER_BUCKETS = 1024


def by_bucket(df, *columns):
    """df grouped into buckets of users: user (the id as text, empty if null) and the columns."""
    user = F.coalesce(F.col("user_id").cast("string"), F.lit("")).alias("user")
    return df.select(F.pmod(F.xxhash64("user_id"), F.lit(USER_BUCKETS)).alias("bucket"), user, *columns).groupBy("bucket")


def user_id():
    return F.expr("cast(nullif(user, '') as bigint)").alias("user_id")


def _totals(spark, t, apply):
    """Totals per user over four batches: each user's newest row has what all batches brought."""

    def run():
        return append_by_batch(apply(event_stream(spark, in_files(t.events.select("ts", "user_id", "value"), 4))))

    rows = with_rocksdb(spark, run)
    return rows.groupBy("user_id").agg(F.max_by(F.struct("n", "total"), "n").alias("x")).select("user_id", "x.n", F.round("x.total", 2).alias("total"))


@query(TOTALS)
def p51_transform_with_state(spark, t):
    out = lambda s: by_bucket(s, "value").transformWithStateInPandas(TotalsByBucket(), "user string, n long, total double", "Update", "None")
    return _totals(spark, t, lambda s: out(s).select(user_id(), "n", "total"))


@query(TOTALS)
def p51_transform_rows_with_state(spark, t):
    return _totals(spark, t, lambda s: s.groupBy("user_id").transformWithState(RowTotals(), "user_id long, n long, total double", "Update", "None"))


@query("select event_type, count(*) as n from events group by all")
def p51_apply_with_state(spark, t):
    counts = event_stream(spark, in_files(t.events, 4)).groupBy("event_type").applyInPandasWithState(count_batches, "event_type string, n long", "n long", "update", "NoTimeout")
    return append_by_batch(counts).groupBy("event_type").agg(F.max("n").alias("n"))


@query("""
with a as (select *, case when ts >= lag(ts) over (partition by user_id order by ts) + interval 2 hour then 1 else 0 end as fresh from events),
b as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as s from a)
select user_id, min(ts) as start, count(*) as n from b group by user_id, s
""")
def p51_sessions_by_timers(spark, t):
    """Sessions that end by an event-time timer, in append mode over four batches and a closing one."""

    def run():
        events = t.events.select("user_id", "ts")
        stream = event_stream(spark, in_order(events, "ts", 4, closing(events)), 2).withWatermark("ts", "10 minutes")
        rows = by_bucket(stream, "ts", F.unix_micros("ts").alias("at"))
        return run_to_table(rows.transformWithStateInPandas(SessionsByBucket(2 * 3600 * 1_000_000), "user string, start long, n long", "Append", "EventTime")).table

    return with_rocksdb(spark, run).select(user_id(), F.timestamp_micros("start").cast("timestamp_ntz").alias("start"), "n")


@query("select user_id, event_type, count(*) as n from events where user_id in (select user_id from events where event_id % 2 = 1) group by all")
def p51_initial_state(spark, t):
    """Counts go on from the state that half of the events gave in a batch; the other half comes as a stream of four batches."""

    def run():
        first = t.events.filter("event_id % 2 = 0").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
        stream = event_stream(spark, in_files(t.events.filter("event_id % 2 = 1").select("ts", "user_id", "event_type"), 4))
        counts = by_bucket(stream, "event_type").transformWithStateInPandas(CountsByBucket(), "user string, event_type string, n long", "Update", "None", by_bucket(first, "event_type", "n"))
        return append_by_batch(counts.select(user_id(), "event_type", "n"))

    return with_rocksdb(spark, run).groupBy("user_id", "event_type").agg(F.max("n").alias("n"))


@query("select range as id, range * range as square from range(40)")
def p03_custom_stream(spark, t):
    spark.dataSource.register(SeriesDataSource)
    return append_to_table(spark.readStream.format("series").options(n=40, step=40).load())


@query("select event_id, user_id, value from events where event_type = 'click'")
def p03_custom_stream_sink(spark, t):
    """A stream of four batches into a connector of our own, a commit for each batch."""
    spark.dataSource.register(LinesDataSource)
    path, clicks = scratch_path(spark), event_stream(spark, in_files(t.events, 4)).filter("event_type = 'click'").select("event_id", "user_id", "value")
    q = clicks.writeStream.format("lines").option("path", path).option("checkpointLocation", scratch_path(spark)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.format("lines").schema(clicks.schema).load(path)


@query("select event_id, event_type, value from events where user_id % 2 = 0")
def p03_custom_stream_reader(spark, t):
    """The connector's table, four commits of events, read as a stream: two runs of one checkpoint, the second gets only what came after the first."""
    spark.dataSource.register(LinesDataSource)
    path, events = scratch_path(spark), t.events.select("event_id", "user_id", "event_type", "value")
    parts = [events.filter(F.pmod(F.xxhash64("event_id"), F.lit(4)) == i) for i in range(4)]
    stream = spark.readStream.format("lines").schema(events.schema).load(path).filter("user_id % 2 = 0").select("event_id", "event_type", "value")
    run = None
    for two in (parts[:2], parts[2:]):
        for part in two:
            part.write.format("lines").mode("append").save(path)
        run = run_to_table(stream, run and run.checkpoint, run and run.path)
    return run.table


def append_by_batch(stream):
    """A stream in update mode, every batch's rows kept; the last row of a key is its newest."""
    spark, path = stream.sparkSession, scratch_path(stream.sparkSession)
    q = (
        stream.writeStream.outputMode("update").foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}"))
        .option("checkpointLocation", scratch_path(spark)).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
