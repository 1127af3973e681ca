"""Importance resampling of documents towards a target: bucket-partitioned inverted postings.

Method: every run of 1 to `max_run` words is a feature, hashed by crc32 into `buckets` buckets.
The first pass turns each block of documents into postings (bucket, document, count), packed
by group of buckets: one row per block and group. Both corpora's counts are grouped by bucket,
which gives every bucket its gain. The postings are shuffled by group of buckets and salt and
meet the gains of their group there; each row emits its documents' contributions, which are
reduced by block of documents. Scores add Gumbel noise made from the id, so the largest scores
are a draw without replacement in proportion to the weights' exponentials, and reruns agree.

Scale: a bucket's gain is an aggregate over at most one row per bucket and task. A word in
every document is a hot bucket, whose postings are spread by the salt, that is by block of
documents. A block has one row per group, so the reduction never holds more than a block.
Ranks come from prefix sums over ranges of the score; only one number per range is collected.

Defined cases: null text has no words; a document without features has weight 0. A null id is
drawn by the empty text after the seed and stands last among ties. Rows that repeat an id are
documents of their own; equal ones follow each other in any order. An empty target or an empty
table gives gains from counts of 0. Extra columns are never read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.storage import cut, free

from .common import ascii_lower, parts, prefix_sums, slices, text_bytes

#: Groups of buckets: rows of postings a block, and rows that its reduction meets.
GROUPS = 16
#: Bytes of text of a block.
BLOCK = 1 << 20
#: Spans longer than this go through zlib one by one.
_LONG = 48


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def crc32_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The unsigned crc32 of each span of bytes; spans may overlap."""
    length = ends - starts
    crc = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    live = np.flatnonzero(length <= _LONG)
    k = 0
    while len(live := live[length[live] > k]):
        c = crc[live]
        crc[live] = _CRC[(c ^ data[starts[live] + k]) & 0xFF] ^ (c >> np.uint32(8))
        k += 1
    crc ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(length > _LONG):
        crc[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes())
    return crc


_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def feature_buckets(data: np.ndarray, off: np.ndarray, max_run: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and document of every feature of the texts, and the words of each text.

    Words are runs of a-z after lower-casing A-Z, digits and bytes beyond ASCII; the words of a feature are joined by one space.
    """
    if not len(data):
        none = np.empty(0, np.int64)
        return none, none, np.zeros(len(off) - 1, np.int64)
    low = ascii_lower(data)
    word = _WORD[low]
    edge = np.zeros(len(low) + 1, bool)
    edge[off] = edge[0] = edge[-1] = True
    starts = np.flatnonzero(word & (edge[:-1] | ~np.concatenate(([False], word[:-1]))))
    ends = np.flatnonzero(word & (edge[1:] | ~np.concatenate((word[1:], [False])))) + 1
    doc = np.searchsorted(off, starts, "right") - 1
    n_words = np.bincount(doc, minlength=len(off) - 1)
    if max_run == 1:
        return crc32_spans(low, starts, ends).astype(np.int64) % buckets, doc, n_words
    # words side by side with one space between: a run of words is a span
    length = ends - starts
    at = np.concatenate(([0], np.cumsum(length + 1)))[:-1]
    joined = np.full(int((length + 1).sum()), 32, np.uint8)
    within = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    joined[np.repeat(at, length) + within] = low[np.repeat(starts, length) + within]
    out, docs = [], []
    for run in range(1, max_run + 1):
        first = np.flatnonzero(doc[: len(doc) - run + 1] == doc[run - 1 :]) if len(doc) >= run else np.empty(0, np.int64)
        out.append(crc32_spans(joined, at[first], at[first + run - 1] + length[first + run - 1]).astype(np.int64) % buckets)
        docs.append(doc[first])
    return np.concatenate(out), np.concatenate(docs), n_words


def _pack(doc: np.ndarray, bucket: np.ndarray, count: np.ndarray) -> bytes:
    return np.concatenate([doc.astype("<u4"), bucket.astype("<u4"), count.astype("<u4")]).tobytes()


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a = np.frombuffer(blob, "<u4").reshape(3, -1).astype(np.int64)
    return a[0], a[1], a[2]


def _postings(docs: DataFrame, id_col: str, text_col: str, max_run: int, buckets: int) -> DataFrame:
    """Per block a row with its ids (group -1), and one per group of buckets with its postings."""
    slim = docs.select(F.col(id_col).alias("_sl_id"), F.col(text_col).cast("string").alias("_sl_text"))
    id_type = slim.schema["_sl_id"].dataType.simpleString()
    names = ["_sl_block", "_sl_group", "_sl_ids", "_sl_words", "_sl_features", "_sl_blob"]

    def run(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 36
        for b in slices(batches, "_sl_text", BLOCK):
            data, off = text_bytes(b.column("_sl_text"))
            bucket, doc, n_words = feature_buckets(data, off, max_run, buckets)
            n = len(off) - 1
            features = np.bincount(doc, minlength=n)
            key, count = np.unique(doc * buckets + bucket, return_counts=True)
            at, bucket = key // buckets, key % buckets
            rows = [(-1, b.column("_sl_id").to_pylist(), n_words.tolist(), features.tolist(), None)]
            for g in range(GROUPS):
                mine = bucket % GROUPS == g
                if mine.any():
                    rows.append((g, None, None, None, _pack(at[mine], bucket[mine], count[mine])))
            cols = list(zip(*rows))
            kinds = [pa.int32(), pa.list_(b.schema.field("_sl_id").type), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            arrays = [pa.array(np.full(len(rows), block, np.int64))] + [pa.array(c, k) for c, k in zip(cols, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)
            block += 1

    schema = f"_sl_block bigint, _sl_group int, _sl_ids array<{id_type}>, _sl_words array<bigint>, _sl_features array<bigint>, _sl_blob binary"
    return slim.mapInArrow(run, schema)


def _counts(postings: DataFrame, buckets: int, own: str, other: str) -> DataFrame:
    """Partial counts by bucket, a row for each bucket and task at most."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for blob in b.column(0).to_pylist():
                _, bucket, count = _unpack(blob)
                np.add.at(total, bucket, count)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen]), pa.array(np.zeros(len(seen), np.int64))], names=["_sl_bucket", own, other])

    return postings.filter("_sl_group >= 0").select("_sl_blob").mapInArrow(run, f"_sl_bucket bigint, {own} bigint, {other} bigint")


def gains(postings: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """One row per bucket that occurs in either corpus: _sl_bucket, s, t, gain (in thousandths of the log ratio)."""
    both = _counts(postings, buckets, "s", "t").unionByName(_counts(target, buckets, "t", "s"))
    table = both.groupBy("_sl_bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    # two numbers
    all_s, all_t = table.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    over = (F.col("t").cast("double") + 1.0) * F.lit(float(all_s) + buckets)
    under = (F.col("s").cast("double") + 1.0) * F.lit(float(all_t) + buckets)
    return table.withColumn("gain", F.floor(1000.0 * F.log(over / under)))


def importance_weights(docs: DataFrame, target: DataFrame, max_run: int = 1, buckets: int = 10_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, n_words, n_features, weight (the floored mean of the gains of its features)."""
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    postings = cut(_postings(docs, id_col, text_col, max_run, buckets))
    table = gains(postings, _postings(target, target.columns[0], text_col, max_run, buckets), buckets)
    salts = max(1, -(-4 * parts(spark) // GROUPS))
    # at most `buckets` numbers over all groups, once for each salt
    held = cut(table.groupBy((F.col("_sl_bucket") % GROUPS).cast("int").alias("_sl_group")).agg(F.collect_list(F.struct("_sl_bucket", "gain")).alias("_sl_gains")))
    met = (
        postings.filter("_sl_group >= 0").select("_sl_block", "_sl_group", "_sl_blob", F.pmod(F.hash("_sl_block"), F.lit(salts)).alias("_sl_salt"))
        .join(held.withColumn("_sl_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge"), ["_sl_group", "_sl_salt"])
        .select("_sl_block", "_sl_blob", "_sl_gains")
    )

    def contributions(batches):
        for b in batches:
            out, gain = [], np.zeros(buckets, np.int64)
            lists, values = b.column("_sl_gains"), b.column("_sl_gains").flatten()
            at, of = np.asarray(values.field("_sl_bucket")), np.asarray(values.field("gain"))
            ends = np.cumsum(np.asarray(lists.value_lengths()))
            for i, blob in enumerate(b.column("_sl_blob").to_pylist()):
                mine = slice(0 if i == 0 else ends[i - 1], ends[i])
                gain[at[mine]] = of[mine]
                doc, bucket, count = _unpack(blob)
                sums = np.zeros(int(doc.max()) + 1, np.int64)
                np.add.at(sums, doc, gain[bucket] * count)
                out.append(sums.astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("_sl_block"), pa.array(out, pa.binary())], names=["_sl_block", "_sl_blob"])

    emitted = met.mapInArrow(contributions, "_sl_block bigint, _sl_blob binary")
    ids = postings.filter("_sl_group < 0").select("_sl_block", "_sl_ids", "_sl_words", "_sl_features", F.lit(None).cast("binary").alias("_sl_blob"))
    both = ids.unionByName(emitted, allowMissingColumns=True)

    def reduce(table):
        head = table.filter(pa.compute.is_valid(table.column("_sl_ids"))).slice(0, 1)
        out = {c: head.column(f"_sl_{c}").combine_chunks().flatten() for c in ("ids", "words", "features")}
        total = np.zeros(len(out["ids"]), np.int64)
        for blob in table.column("_sl_blob").drop_null().to_pylist():
            sums = np.frombuffer(blob, "<i8")
            total[: len(sums)] += sums
        n = np.maximum(np.asarray(out["features"]), 1)
        return pa.table({"_sl_id": out["ids"], "n_words": out["words"], "n_features": out["features"], "weight": total // n})

    scored = both.groupBy("_sl_block").applyInArrow(reduce, f"_sl_id {id_type}, n_words bigint, n_features bigint, weight bigint")
    result = cut(scored.withColumnRenamed("_sl_id", id_col))
    free(postings, held)
    return result


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, seed: int = 2024, max_run: int = 1, buckets: int = 10_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, n_features, weight, score, rank; rank is null for rows that aren't drawn.

    Of the N rows with at least `min_words` words the floor(percent * N / 100) largest scores are drawn, ties to the smaller id.
    """
    weighted = importance_weights(docs, target, max_run, buckets, id_col, text_col)
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = weighted.withColumn("score", F.col("weight") + noise)
    ordered = scored.select(
        "*", (-F.col("score")).alias("_sl_turn"), F.col(id_col).isNull().alias("_sl_last"), (F.col("n_words") >= min_words).cast("bigint").alias("_sl_in")
    )
    placed = prefix_sums(ordered, ["_sl_turn", "_sl_last", id_col], "_sl_in", "_sl_before", "_sl_row")
    free(weighted)
    # one number
    n = placed.agg(F.coalesce(F.sum("_sl_in"), F.lit(0))).first()[0]
    rank = F.when((F.col("_sl_in") == 1) & (F.col("_sl_before") < percent * n // 100), F.col("_sl_before") + 1)
    return placed.select(id_col, "n_features", "weight", "score", rank.alias("rank"))
