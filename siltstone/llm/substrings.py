"""Substring deduplication by seed and extend.

Method. Seeds: the hashes of all runs of SEED words are winnowed, that is, every window of
`length` words selects its smallest seed hash as its anchor. Windows equal word for word
select equal anchors, so documents need to be joined on anchors only; about one anchor in
(length - SEED) / 2 words is kept. Extension: consecutive windows of one document with the
same anchor form a stretch, the text from the first word of its first window to the last
word of its last window. Stretches that are equal as a whole (anchor and hash of the whole
stretch) are extended at once in both directions: every window of a later document is a
repeat. Where stretches on one anchor differ, because a repeat begins or ends inside, one
stretch of each kind is taken apart into its windows, and each window looks for the
smallest document that has it. The union of the windows found is the maximal repeats of at
least `length` words.

A window is a repeat if its word sequence also starts in a document with a smaller id.
Windows are judged on the input. Grouping needs only minima, which combine before the
shuffle: a passage in a third of all documents sends a row per task, not per document, and
no pairs of documents are made at all.

Defined cases: null text has no words; documents under `length` words lose nothing. A row
with a null id loses nothing and takes nothing from others. Repeats inside one document
stay. Rows repeated with the same id are one document to this comparison: neither takes
words from the other, both lose the same. An empty table gives none.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, cut, range_hashes, signed, span_hashes, text_bytes, window_hashes, word_spans

#: Words of a repeat, words of a seed.
LENGTH, SEED = 50, 20
_OTHER = 0xA24BAED4963EE407


def sliding_min(h: np.ndarray, k: int) -> np.ndarray:
    """Minimum of each run of k consecutive values, in log k steps."""
    n, width, out = len(h) - k + 1, 1, h
    while width * 2 <= k:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    return np.minimum(out[:n], out[k - width : k - width + n]) if width < k else out[:n]


def _stretches(h: np.ndarray, first: np.ndarray, length: int, seed: int):
    """(document, anchor, start, windows) of all stretches of a block."""
    n = len(h) - length + 1
    if n <= 0:
        return (np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    anchor = sliding_min(window_hashes(h, seed), length - seed + 1)
    ok = doc[:n] == doc[length - 1 :]
    begins = ok.copy()
    begins[1:] &= ~ok[:-1] | (anchor[1:] != anchor[:-1]) | (doc[1:n] != doc[: n - 1])
    start = np.flatnonzero(begins)
    # a stretch ends before the next one of its document, or with the document's last window
    last = first[doc[start] + 1] - length + 1
    stop = np.minimum(np.append(start[1:], n), last)
    return doc[start], anchor[start], start, stop - start


def _hashed(b, text_col):
    data_all, off_all = text_bytes(b.column(text_col))
    for i, j in blocks(off_all):
        off = off_all[i : j + 1] - off_all[i]
        data = data_all[off_all[i] : off_all[j]]
        starts, ends, first = word_spans(data, off)
        yield i, data, off, starts, ends, first


def _seed(length: int, seed: int):
    def run(batches):
        for b in batches:
            ids = b.column("_sl_id")
            for i, data, _, starts, ends, first in _hashed(b, "_sl_text"):
                h = span_hashes(data, starts, ends)
                doc, anchor, start, n = _stretches(h, first, length, seed)
                whole = range_hashes(h, start, n + length - 1, _OTHER)
                yield pa.RecordBatch.from_pydict({
                    "_sl_id": ids.take(pa.array(doc + i)), "_sl_f": b.column("_sl_f").take(pa.array(doc + i)),
                    "a": signed(anchor), "u": signed(whole), "s": pa.array((start - first[doc]).astype(np.int32)), "n": pa.array(n.astype(np.int32)),
                })

    return run


def _apart(length: int):
    """The windows of the stretches asked for: (a, id, fingerprint, start, hash)."""

    def run(batches):
        for b in batches:
            ids, asked = b.column("_sl_id"), b.column("_sl_asked").to_pylist()
            for i, data, _, starts, ends, first in _hashed(b, "_sl_text"):
                w = window_hashes(span_hashes(data, starts, ends), length, _OTHER)
                doc, a, at = [], [], []
                for d in range(len(first) - 1):
                    for x in asked[i + d]:
                        doc.append(np.full(x["n"], d))
                        a.append(np.full(x["n"], x["a"]))
                        at.append(np.arange(x["s"], x["s"] + x["n"]))
                if not doc:
                    continue
                doc, a, at = np.concatenate(doc), np.concatenate(a), np.concatenate(at)
                yield pa.RecordBatch.from_pydict({
                    "a": pa.array(a, pa.int64()), "m": ids.take(pa.array(doc + i)), "_sl_f": b.column("_sl_f").take(pa.array(doc + i)),
                    "s": pa.array(at.astype(np.int32)), "w": signed(w[first[doc] + at]),
                })

    return run


def _strike(length: int):
    def run(batches):
        for b in batches:
            spans = b.column("_sl_spans").to_pylist()
            out = {"_sl_words": np.zeros(b.num_rows, np.int64), "_sl_removed": np.zeros(b.num_rows, np.int64)}
            texts, gone = [b""] * b.num_rows, [None] * b.num_rows
            for i, data, _, starts, ends, first in _hashed(b, "_sl_text"):
                raw = data.tobytes()
                for d in range(len(first) - 1):
                    n = int(first[d + 1] - first[d])
                    cover = np.zeros(n + 1, np.int32)
                    for x in spans[i + d] or ():
                        cover[x["s"]] += 1
                        cover[min(n, x["s"] + x["n"] + length - 1)] -= 1
                    dead = np.cumsum(cover[:n]) > 0
                    keep = np.flatnonzero(~dead) + first[d]
                    texts[i + d] = b" ".join([raw[p:q] for p, q in zip(starts[keep].tolist(), ends[keep].tolist())])
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], dead.astype(np.int8), [0]))))
                    gone[i + d] = [{"start": int(p), "length": int(q - p)} for p, q in zip(edge[::2], edge[1::2])]
                    out["_sl_words"][i + d], out["_sl_removed"][i + d] = n, n - len(keep)
            cols = [c for c in b.schema.names if c not in ("_sl_spans", "_sl_f")]
            spans_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
            arrays = [b.column(c) for c in cols] + [pa.array(out["_sl_words"]), pa.array(out["_sl_removed"]), pa.array(texts, pa.binary()).cast(pa.string()), pa.array([x or [] for x in gone], spans_type)]
            arrays.append(pa.array([hashlib.sha256(t).hexdigest() for t in texts]))
            yield pa.RecordBatch.from_arrays(arrays, names=[*cols, "n_words", "n_removed", "kept_text", "removed_spans", "kept_sha256"])

    return run


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """Stretches of repeated windows: _sl_id, _sl_f (fingerprint of the text), s (first window), n (windows)."""
    slim = docs.select(F.col(id_col).alias("_sl_id"), F.xxhash64(text_col).alias("_sl_f"), F.col(text_col).cast("string").alias("_sl_text")).filter("_sl_id is not null")
    id_type = slim.schema["_sl_id"].dataType.simpleString()
    found = cut(slim.mapInArrow(_seed(length, seed), f"_sl_id {id_type}, _sl_f bigint, a bigint, u bigint, s int, n int"))
    # kinds of stretches with their first document; anchors of one stretch alone are no seeds
    kinds = found.groupBy("a", "u").agg(F.min("_sl_id").alias("m"), F.count(F.lit(1)).alias("c"))
    per_anchor = kinds.groupBy("a").agg(F.count(F.lit(1)).alias("_sl_kinds"), F.sum("c").alias("_sl_rows")).filter("_sl_rows > 1")
    shared = kinds.join(per_anchor, "a").select("a", "u", "m", "_sl_kinds")
    met = found.join(shared, ["a", "u"]).filter("_sl_id > m or _sl_kinds > 1")
    met = cut(met.select("_sl_id", "_sl_f", "a", "s", "n", (F.col("_sl_id") > F.col("m")).alias("_sl_later")))
    whole = met.filter("_sl_later").select("_sl_id", "_sl_f", "s", "n")
    # anchors with stretches of several kinds: the first document of each kind, window by window
    asked = met.filter("not _sl_later").groupBy(F.col("_sl_id").alias("_sl_key"), F.col("_sl_f").alias("_sl_kf")).agg(F.collect_list(F.struct("a", "s", "n")).alias("_sl_asked"))
    texts = slim.join(asked, (F.col("_sl_id") == F.col("_sl_key")) & (F.col("_sl_f") == F.col("_sl_kf"))).select("_sl_id", "_sl_f", "_sl_text", "_sl_asked")
    windows = cut(texts.mapInArrow(_apart(length), f"a bigint, m {id_type}, _sl_f bigint, s int, w bigint"))
    firsts = windows.groupBy("a", "w").agg(F.min("m").alias("_sl_first"), F.max("m").alias("_sl_last")).filter("_sl_first < _sl_last").select("a", "w", "_sl_first")
    single = windows.join(firsts, ["a", "w"]).filter("_sl_first < m").select(F.col("m").alias("_sl_id"), "_sl_f", "s", F.lit(1).alias("n"))
    return whole.unionByName(single)


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept_text, removed_spans (word start, length), kept_sha256."""
    id_type = docs.schema[id_col].dataType.simpleString()
    spans = repeated_spans(docs, id_col, text_col, length, seed)
    spans = spans.groupBy(F.col("_sl_id").alias("_sl_key"), F.col("_sl_f").alias("_sl_kf")).agg(F.collect_list(F.struct("s", "n")).alias("_sl_spans"))
    slim = docs.select(F.col(id_col).alias("_sl_id"), F.xxhash64(text_col).alias("_sl_f"), F.col(text_col).cast("string").alias("_sl_text"))
    joined = slim.join(spans, (F.col("_sl_id") == F.col("_sl_key")) & (F.col("_sl_f") == F.col("_sl_kf")), "left").select("_sl_id", "_sl_f", "_sl_text", "_sl_spans")
    schema = f"_sl_id {id_type}, _sl_text string, n_words bigint, n_removed bigint, kept_text string, removed_spans array<struct<start: bigint, length: bigint>>, kept_sha256 string"
    return joined.mapInArrow(_strike(length), schema).drop("_sl_text").withColumnRenamed("_sl_id", id_col)
