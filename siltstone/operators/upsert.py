"""Upsert without a catalog that has row-level operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(target: DataFrame, changes: DataFrame, keys: list[str], deleted: str | None = None) -> DataFrame:
    """target with the rows of `changes` put in the place of rows with their keys, and new ones added.

    deleted: a boolean column of changes; rows where it is true go. Keys are compared
    null-safe and must be unique in changes. The caller overwrites the table with the result.
    """
    marks = [f"_k{i}" for i in range(len(keys))]
    gone = changes.select(*[F.col(k).alias(m) for k, m in zip(keys, marks)]).distinct()
    on = [target[k].eqNullSafe(gone[m]) for k, m in zip(keys, marks)]
    kept = target.join(gone, on, "left_anti")
    added = changes.filter(~F.coalesce(F.col(deleted), F.lit(False))) if deleted else changes
    return kept.unionByName(added.select(*target.columns))
