"""Structured Streaming helpers: replayable event streams, sinks to tables, stateful operators."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import utc
from siltstone.storage import scratch_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def event_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A Parquet table as a stream, its column ts as an instant so that it can carry a watermark."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    path = f"{folder}/[{name[0]}]{name[1:]}"  # a pattern, for a stream may not name a file outright
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return stream.withColumn("ts", utc(stream["ts"]))


def in_files(table: DataFrame, n: int) -> str:
    """Path of a copy of the table in n files, so that a stream of one file a batch has n batches."""
    path = scratch_path(table.sparkSession)
    table.repartition(n).write.parquet(path)
    return path


def append_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, into a Parquet table with exactly-once files; returns the table."""
    spark, path = stream.sparkSession, scratch_path(stream.sparkSession)
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", scratch_path(spark)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def latest_table(stream: DataFrame) -> DataFrame:
    """Run an aggregation in complete mode over all that is there; returns the table of its last batch."""
    spark, path = stream.sparkSession, scratch_path(stream.sparkSession)

    def replace(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{number}")
        seen.append(number)

    seen: list[int] = []
    q = stream.writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", scratch_path(spark)).trigger(availableNow=True).start()
    q.awaitTermination()
    if not seen:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{path}/{max(seen)}")


def with_rocksdb(spark: SparkSession, run: Callable[[], DataFrame]) -> DataFrame:
    """Run with the RocksDB state store, which transformWithState needs, and put the setting back."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKSDB)
    try:
        return run()
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


class Run(NamedTuple):
    """A stream that has run over all that was there: its table, its checkpoint, the progress of its batches and the table's path."""

    table: DataFrame
    checkpoint: str
    progress: list[dict]
    path: str


def run_to_table(stream: DataFrame, checkpoint: str | None = None, path: str | None = None) -> Run:
    """append_to_table with what tests and state readers need; checkpoint and path of an earlier run go on where it ended."""
    spark = stream.sparkSession
    path, checkpoint = path or scratch_path(spark), checkpoint or scratch_path(spark)
    q = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return Run(spark.read.schema(stream.schema).parquet(path), checkpoint, list(q.recentProgress), path)


def in_order(table: DataFrame, time: str, n: int, closing: DataFrame | None = None, files: int = 2) -> str:
    """Path of a copy of the table in n slices of its time column, written one after the other, `files` files each.

    A stream of `files` files a batch gets them in this order, so that a watermark of any delay drops nothing.
    closing: rows that follow as a batch of their own, whose late time ends all that waits for the watermark.
    """
    spark, path = table.sparkSession, scratch_path(table.sparkSession)
    at = F.unix_micros(F.col(time).cast("timestamp"))
    # n - 1 numbers
    bounds = table.select(F.percentile_approx(at, [i / n for i in range(1, n)])).first()[0] or []
    edges = [None, *sorted(set(bounds)), None]
    for low, high in zip(edges[:-1], edges[1:]):
        inside = F.lit(True) if low is None else at >= low
        slice_ = table.filter(inside if high is None else inside & (at < high))
        slice_.repartition(files).write.mode("append").parquet(path)
    if closing is not None:
        closing.select(table.columns).coalesce(1).write.mode("append").parquet(path)
    return path


def interval_join(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, before: str, delay: str, how: str = "left_outer") -> DataFrame:
    """Rows of two streams with equal keys where the right time is at most `before` earlier than the left time, and not later.

    Both sides carry a watermark of `delay`, so a row's state goes once no partner can come; a left row without a
    partner comes out then. Null keys and null times match nothing. The right side's key columns are dropped.
    """
    marks = [f"_r_{c}" for c in by]
    r = right.withColumnsRenamed(dict(zip(by, marks))).withWatermark(right_time, delay)
    on = (F.col(right_time) <= F.col(left_time)) & (F.col(right_time) >= F.col(left_time) - F.expr(f"interval {before}"))
    for c, m in zip(by, marks):
        on = on & (F.col(c) == F.col(m))
    return left.withWatermark(left_time, delay).join(r, on, how).drop(*marks)


def read_state(spark: SparkSession, checkpoint: str, variable: str) -> DataFrame:
    """The keys and values of a state variable as the last batch left them."""
    return spark.read.format("statestore").option("path", checkpoint).option("stateVarName", variable).load()
