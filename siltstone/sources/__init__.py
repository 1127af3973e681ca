"""File, JDBC and custom sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from siltstone.storage import cut, scratch_path

FORMATS = ("parquet", "csv", "json", "orc", "text")


def read(spark: SparkSession, fmt: str, path: str, schema=None, **options) -> DataFrame:
    """A file source. CSV and JSON should have a schema: inferring one reads the data twice."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt}")
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema is not None and fmt != "text" else reader).load(path)


def write(df: DataFrame, fmt: str, path: str, partition_by: list[str] | None = None, mode: str = "errorifexists", **options) -> None:
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt}")
    writer = df.write.format(fmt).mode(mode).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def round_trip(df: DataFrame, fmt: str, **options) -> DataFrame:
    """df written to a scratch folder in a format and read from it."""
    path = scratch_path(df.sparkSession)
    write(df, fmt, path, **options)
    return read(df.sparkSession, fmt, path, df.schema, **options)


def create_table(df: DataFrame, partition_by: list[str] = ()) -> DataFrame:
    """df written as a table of the catalog, and the table's files; the catalog forgets it, its files are scratch files."""
    spark, name = df.sparkSession, f"siltstone_{uuid.uuid4().hex}"
    path = scratch_path(spark)
    writer = df.writeTo(name).using("parquet").option("path", path)
    (writer.partitionedBy(*[df[c] for c in partition_by]) if partition_by else writer).create()
    spark.sql(f"DROP TABLE {name}")  # an outside table: its files stay
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, low=None, high=None, n: int = 1, **options) -> DataFrame:
    """A JDBC table; with a column and its bounds, n partitions read ranges of it side by side."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if column:
        reader = reader.options(partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=n)
    return reader.load()


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **options) -> None:
    df.write.format("jdbc").options(url=url, dbtable=table, **options).mode(mode).save()


def read_pushed(spark: SparkSession, fmt: str, path: str, schema, condition: str) -> DataFrame:
    """The rows of a connector of our own (with the option skip) that fulfil a condition, as a scratch table; while it is read, Spark passes filters on."""
    key = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        return cut(spark.read.format(fmt).schema(schema).option("skip", "true").load(path).filter(condition))
    finally:
        spark.conf.set(key, before)
