"""Scratch tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: While a scratch table is written: the shuffle files of that write go when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_roots: set[str] = set()
_local: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir.

    Where that is unset, a temporary folder serves a local master; any other master raises,
    for executors on other machines would not see the files.
    """
    app = spark.sparkContext.applicationId
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if app not in _local:
            _local[app] = tempfile.mkdtemp(prefix="siltstone-")
        base = _local[app]
    root = f"{base.rstrip('/')}/siltstone-{app}"
    if root not in _roots:
        _roots.add(root)
        atexit.register(_remove, spark, root)
    return root


def scratch_path(spark: SparkSession) -> str:
    """A path that nothing has used."""
    return f"{scratch_dir(spark)}/{uuid.uuid4().hex}"


def _delete(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _remove(spark: SparkSession, root: str) -> None:
    """Delete a scratch folder when the driver ends, if its JVM is still there."""
    try:
        _delete(spark, root)
    except Exception:  # the JVM is gone: the cluster's own retention rules apply
        return


@contextmanager
def _tidy(spark: SparkSession):
    """Writes inside leave no shuffle files behind: their result is a table, so nothing reads them again."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def free(*tables: DataFrame) -> None:
    """Delete the files of tables made by cut() or cut_by(): call it when no plan is left that would read them."""
    for table in tables:
        path = table.__dict__.pop("_sl_scratch", None)
        if path:
            _delete(table.sparkSession, path)


def cut(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write df to the shared scratch folder and read it back.

    The result has no lineage: a lost executor costs the tasks that read the table, never
    the work before it, and what is computed is computed once.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    with _tidy(spark):
        df.write.option("compression", codec).parquet(path)
    held = spark.read.schema(df.schema).parquet(path)
    held.__dict__["_sl_scratch"] = path
    return held


def cut_by(df: DataFrame, column: str, n: int, codec: str = "zstd") -> DataFrame:
    """cut() into n buckets by a column: joins and groups by it in n partitions don't move the result's rows.

    The table is in the catalog only until it is read; its files are scratch files.
    """
    spark, name = df.sparkSession, f"siltstone_{uuid.uuid4().hex}"
    path = scratch_path(spark)
    writer = df.write.format("parquet").option("compression", codec).option("path", path)
    with _tidy(spark):
        writer.bucketBy(n, column).saveAsTable(name)
    held = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    held.__dict__["_sl_scratch"] = path
    return held
