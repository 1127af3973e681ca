"""Exact deduplication by 128-bit content hash, with a comparison of the bytes.

Method: every text gets the MD5 hash of its normalised bytes. Rows are grouped by that hash
*and* by the bytes themselves, so the grouping compares bytes and a collision splits into
its true texts; partial aggregation leaves one row per text and task before the shuffle,
so a text with a third of all rows is not a hot key of the grouping. exact_groups joins
hashes and counts back to the rows, by MD5 and SHA-256 (adaptive execution splits a hot text
there: it meets one row). drop_exact_copies needs no join: the grouping carries the row that
stays, so texts move once.

Defined cases: null text equals empty text (and equals other empty texts). A null id is
smaller than any other; a group of only null ids has keep_id null and one row of it stays.
Rows repeated with the same id and text: one of them stays. An empty table gives an empty
table. Extra columns are never read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, cut, text_bytes, with_plain_names


def _digests(with_text: bool, lower: bool):
    def run(batches):
        for b in batches:
            data, off = text_bytes(b.column("_sl_text"))
            view = (ascii_lower(data) if lower else data).tobytes()
            texts = [view[i:j] for i, j in zip(off[:-1], off[1:])]
            cols = {"_sl_id": b.column("_sl_id"), "_sl_h": pa.array([hashlib.md5(x).digest() for x in texts], pa.binary())}
            if with_text:
                cols["_sl_norm"] = pa.array(texts, pa.binary())
            else:
                cols["_sl_sha"] = pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string())
            yield pa.RecordBatch.from_pydict(cols)

    return run


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", lower: bool = True) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256.

    keep: "min" keeps the smallest id of each group, "max" the largest.
    """
    slim = docs.select(F.col(id_col).alias("_sl_id"), F.col(text_col).cast("string").alias("_sl_text"))
    id_type = slim.schema["_sl_id"].dataType.simpleString()
    best = F.min if keep == "min" else F.max
    texts = slim.mapInArrow(_digests(True, lower), f"_sl_id {id_type}, _sl_h binary, _sl_norm binary")
    classes = texts.groupBy("_sl_h", "_sl_norm").agg(best("_sl_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), F.count(F.col("_sl_id")).alias("_sl_ids"))
    classes = cut(classes.withColumn("_sl_sha", F.sha2("_sl_norm", 256)).drop("_sl_norm"))
    rows = slim.mapInArrow(_digests(False, lower), f"_sl_id {id_type}, _sl_h binary, _sl_sha string")
    # of rows repeated with one id and text, the first is the one that may stay
    once = rows.withColumn("_sl_turn", F.row_number().over(Window.partitionBy("_sl_h", "_sl_id", "_sl_sha").orderBy("_sl_id")))
    joined = once.join(classes, ["_sl_h", "_sl_sha"])
    kept = F.when(F.col("_sl_ids") > 0, F.col("_sl_id") == F.col("keep_id")).otherwise(F.col("_sl_id").isNull()) & (F.col("_sl_turn") == 1)
    return joined.select(
        F.col("_sl_id").alias(id_col), "keep_id", "group_size", F.coalesce(kept, F.lit(False)).alias("kept"), F.col("_sl_sha").alias("text_sha256")
    )


def _keyed(text_col: str, lower: bool):
    def run(batches):
        for b in batches:
            data, off = text_bytes(b.column(text_col).cast(pa.string()))
            view = (ascii_lower(data) if lower else data).tobytes()
            texts = [view[i:j] for i, j in zip(off[:-1], off[1:])]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([hashlib.md5(x).digest() for x in texts], pa.binary()), pa.array(texts, pa.binary())], names=[*b.schema.names, "_sl_h", "_sl_norm"])

    return run


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", lower: bool = True) -> DataFrame:
    """docs with one row of each group of equal texts, all columns as they are; a row without an id stays only if its group has no other."""
    rank = F.struct((F.col(id_col).isNull() if keep == "min" else F.col(id_col).isNotNull()).alias("x"), F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    best = F.min_by if keep == "min" else F.max_by

    def one_each(d: DataFrame) -> DataFrame:
        schema = T.StructType(d.schema.fields + [T.StructField("_sl_h", T.BinaryType()), T.StructField("_sl_norm", T.BinaryType())])
        keyed = d.mapInArrow(_keyed(text_col, lower), schema)
        return keyed.groupBy("_sl_h", "_sl_norm").agg(best(F.struct(*d.columns), rank).alias("_sl_row")).select("_sl_row.*")

    return with_plain_names(docs, (id_col, text_col), one_each)
