"""Copy-on-write merge into a table of Parquet files: only files that hold a changed key are rewritten.

A table is a folder of data files and of numbered versions, each a list of the data files that it
consists of. A merge writes new files beside the old ones and publishes a version; whoever reads, reads
the files of one version. Until a version is there nothing that a merge wrote is seen, so a failed or
killed merge leaves the table as it was, with files that nothing names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .upsert import upsert


class Conflict(RuntimeError):
    """Another commit has published the version that this one was to be."""


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def version(spark: SparkSession, root: str) -> int:
    """The newest version, -1 where there is none."""
    fs, at = _fs(spark, f"{root}/_versions")
    return max((int(s.getPath().getName()) for s in fs.listStatus(at)), default=-1) if fs.exists(at) else -1


def files(spark: SparkSession, root: str, number: int | None = None) -> list[str]:
    """Data files of a version, the newest by default, relative to the table's folder."""
    number = version(spark, root) if number is None else number
    return [r.value for r in spark.read.text(f"{root}/_versions/{number:012d}").collect() if r.value] if number >= 0 else []


def read_version(spark: SparkSession, root: str, schema, number: int | None = None) -> DataFrame:
    names = files(spark, root, number)
    return spark.read.schema(schema).parquet(*[f"{root}/{n}" for n in names]) if names else spark.createDataFrame([], schema)


def _write(df: DataFrame, root: str) -> list[str]:
    """Write files that no version names yet."""
    spark, folder = df.sparkSession, f"data/{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{folder}")
    fs, at = _fs(spark, f"{root}/{folder}")
    return sorted(f"{folder}/{s.getPath().getName()}" for s in fs.listStatus(at) if s.getPath().getName().startswith("part-"))


def publish(spark: SparkSession, root: str, names: list[str], number: int) -> None:
    """Make a version, or raise Conflict where it is there already: the file system lets one writer create a file."""
    fs, at = _fs(spark, f"{root}/_versions/{number:012d}")
    if fs.exists(at):
        raise Conflict(f"{root}: version {number} is there")
    # the list is whole before it has the version's name
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_drafts/{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray("".join(f"{n}\n" for n in names).encode()))
    out.close()
    fs.mkdirs(at.getParent())
    taken = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_drafts/{number:012d}.taken")
    try:
        fs.create(taken, False).close()
    except Exception as e:
        raise Conflict(f"{root}: version {number} is being made") from e
    if not fs.rename(draft, at):
        raise Conflict(f"{root}: version {number} is there")


def release(spark: SparkSession, root: str) -> None:
    """Let versions be made again whose writer has died while it published; call it when no writer is at work."""
    fs, at = _fs(spark, f"{root}/_drafts/{version(spark, root) + 1:012d}.taken")
    fs.delete(at, False)


def create(df: DataFrame, root: str) -> int:
    """The first version of a table."""
    publish(df.sparkSession, root, _write(df, root), 0)
    return 0


def merge(changes: DataFrame, root: str, keys: list[str], deleted: str | None = None, base: int | None = None) -> int:
    """Put the rows of changes in the place of rows with their keys, add new ones, drop those marked as deleted; returns the version.

    Keys compare null-safe and must be unique in changes. Files without a changed key keep their names. base: the
    version that the changes were made for, the newest by default; raises Conflict if another has followed.
    """
    spark = changes.sparkSession
    base = version(spark, root) if base is None else base
    schema = changes.drop(deleted).schema if deleted else changes.schema
    held = files(spark, root, base)
    marks = [f"_m{i}" for i in range(len(keys))]
    changed = changes.select(*[F.col(k).alias(m) for k, m in zip(keys, marks)])
    table = read_version(spark, root, schema, base)
    touched: set[str] = set()
    if held:
        rows = table.select(*keys, F.substring_index(F.col("_metadata.file_path"), "/", -3).alias("_file"))
        on = [F.col(k).eqNullSafe(F.col(m)) for k, m in zip(keys, marks)]
        # one row a file at most
        touched = {r[0] for r in rows.join(changed, on, "left_semi").select("_file").distinct().collect()}
    old = spark.read.schema(schema).parquet(*[f"{root}/{n}" for n in sorted(touched)]) if touched else spark.createDataFrame([], schema)
    names = _write(upsert(old, changes, keys, deleted), root)
    publish(spark, root, [n for n in held if n not in touched] + names, base + 1)
    return base + 1
