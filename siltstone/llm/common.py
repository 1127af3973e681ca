"""Shared pieces of the training-data operators.

Text arithmetic works on the UTF-8 bytes of an Arrow string column with numpy, so no
Python object is made per word. Hashes are polynomials over the ring of 64-bit integers
followed by a finalising mix; they are equal on every machine and in every run.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.storage import cut

#: A word is a maximal run of bytes other than space and the five ASCII controls 9-13.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text hashed at a time: bounds the numpy temporaries (8 bytes per byte of text).
BLOCK_BYTES = 1 << 20

_MASK = (1 << 64) - 1


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def most_frequent(counts: DataFrame, count: str, limit: int) -> DataFrame:
    """The rows with the largest counts, `limit` of them at most and none of a lower level than another left out.

    A level is a sixteenth of a power of two. Only the sizes of the levels, about a thousand
    numbers at any size of the table, come to the driver; a sorted limit would bring `limit`
    rows from each partition.
    """
    level = F.floor(F.log2(F.col(count)) * 16)
    sizes = counts.groupBy(level.alias("_sl_level")).agg(F.count(F.lit(1)).alias("n")).collect()
    least, total = None, 0
    for at, n in sorted(sizes, reverse=True):
        total += n
        if total > limit:
            break
        least = at
    return counts.filter(F.lit(False) if least is None else level >= least)


# ---------------------------------------------------------------------- prefix sums


def prefix_sums(df: DataFrame, order: list[str], value: str, before: str, row: str) -> DataFrame:
    """Sum of `value` over all rows before each row in the order of the columns `order`.

    Two passes: rows are dealt by range of the order, each partition makes running sums and
    its total; then the totals of the partitions before it (one number per partition, the
    only thing that is collected) are added. No task holds more than a range of the rows.
    `row` gets a number unique to each row. Rows equal in every column of `order` follow
    each other in any order.
    """
    spark = df.sparkSession
    dealt = df.repartitionByRange(parts(spark), *order).sortWithinPartitions(*order)
    schema = T.StructType(df.schema.fields + [T.StructField(x, T.LongType()) for x in ("_sl_part", before, row)])

    def run(batches):
        from pyspark import TaskContext

        part, total, n = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            v = np.asarray(b.column(value).fill_null(0), dtype=np.int64)
            sums = np.cumsum(v) + total
            cols = [np.full(len(v), part, np.int64), sums - v, (part << 36) + n + np.arange(len(v), dtype=np.int64)]
            yield pa.RecordBatch.from_arrays(b.columns + [pa.array(c) for c in cols], names=b.schema.names + ["_sl_part", before, row])
            n += len(v)
            total = int(sums[-1]) if len(v) else total

    local = cut(dealt.mapInArrow(run, schema))
    totals = {r[0]: r[1] for r in local.groupBy("_sl_part").agg(F.sum(value)).collect()}
    base, bases = 0, []
    for part in sorted(totals):
        bases.append((part, base))
        base += totals[part] or 0
    # one row per partition: its size is bounded by the number of partitions
    held = spark.createDataFrame(bases, f"_sl_part int, _sl_base bigint").withColumn("_sl_part", F.col("_sl_part").cast("bigint"))
    return local.join(F.broadcast(held), "_sl_part").withColumn(before, F.col(before) + F.col("_sl_base")).drop("_sl_part", "_sl_base")


# ---------------------------------------------------------------------- text arrays


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary Arrow column and the offsets of its values; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or off[-1] == off[0]:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def blocks(off: np.ndarray, limit: int = BLOCK_BYTES):
    """Ranges (i, j) of values holding about `limit` bytes; one longer value is a range alone."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j
        i = j


def slices(batches, column: str, limit: int):
    """The batches, cut so that each holds about `limit` bytes of text, or one longer text."""
    for b in batches:
        _, off = text_bytes(b.column(column))
        for i, j in blocks(off, limit):
            yield b.slice(i, j - i)


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CODE = np.array([(x * 0x9E3779B97F4A7C15 + 0xD1B54A32D192ED03 * (x ^ 0x5A) ** 2 | 1) & _MASK for x in range(256)], dtype=np.uint64)
_P, _Q = 0x5851F42D4C957F2D, 0xDA942042E4DD58B5


def ascii_lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, every other byte as it is."""
    return _LOWER[data]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(q: int, n: int) -> np.ndarray:
    """q**0 .. q**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), np.uint64(q & _MASK), np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of the first word of each value (and one more)."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(off), np.int64)
    space = _SPACE[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0] = edge[-1] = True
    edge[1:-1] = space[:-1]
    inner = off[(off > 0) & (off < len(data))]
    edge[inner] = True
    starts = np.flatnonzero(~space & edge[:-1])
    edge[1:-1] = space[1:]
    edge[inner] = True
    ends = np.flatnonzero(~space & edge[1:]) + 1
    return starts, ends, np.searchsorted(starts, off)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each non-empty, ascending, disjoint span."""
    n = len(starts)
    if not n:
        return np.empty(0, np.uint64)
    length = ends - starts
    at = np.repeat(starts - np.concatenate(([0], np.cumsum(length)[:-1])), length) + np.arange(int(length.sum()))
    within = at - np.repeat(starts, length)
    terms = _CODE[data[at]] * powers(_P, int(length.max()))[within]
    first = np.concatenate(([0], np.cumsum(length)[:-1]))
    return mix(np.add.reduceat(terms, first) + length.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))


def window_hashes(h: np.ndarray, k: int, q: int = _Q) -> np.ndarray:
    """A hash of each run of k consecutive values of h."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    return range_hashes(h, np.arange(n), np.full(n, k), q)


def range_hashes(h: np.ndarray, start: np.ndarray, length: np.ndarray, q: int = _Q) -> np.ndarray:
    """A hash of each run h[start : start + length]; runs may overlap."""
    inverse = pow(q, -1, 1 << 64)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(q, len(h)), dtype=np.uint64, out=sums[1:])
    back = powers(inverse, len(h) + 1)
    value = (sums[start + length] - sums[start]) * back[start]
    return mix(value + length.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def crc_bucket(column: Column, modulus: int) -> Column:
    """crc32 of a value as text, modulo a number; null counts as empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def with_plain_names(docs: DataFrame, used: tuple[str, ...], operate) -> DataFrame:
    """operate(docs) for an operator that keeps all columns: within it, columns not in `used` have names that nothing clashes with or quotes."""
    names = docs.columns
    return operate(docs.toDF(*[c if c in used else f"column_{i}" for i, c in enumerate(names)])).toDF(*names)


def not_null_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
