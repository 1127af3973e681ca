"""Column functions beyond pyspark.sql.functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products of two arrays of numbers, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Null where either array has norm 0."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size)


def utc(ts: Column) -> Column:
    """A zoneless timestamp as an instant, for watermarks; the session zone is UTC."""
    return ts.cast("timestamp")
