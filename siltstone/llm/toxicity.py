"""Toxicity by compression distance: two zstandard dictionaries and calibrated thresholds.

Method. One dictionary is trained on ordinary text, one on the telling part of toxic text:
words with a short byte sequence that occurs in toxic documents in many more different
contexts (neighbouring words) than in ordinary ones, so that copies of one document count
once. A window of a document is compressed with either dictionary; the difference of the
two lengths says which kind of text it looks like. Windows are single words with a fixed
carrier behind them, as every word of a dictionary has: a bare word is too short for a
compressed block, and longer windows drown the difference in the noise of their ordinary
words. The dictionaries are content only, the most frequent words last, where matches are
cheapest; the library's own trainer picks segments by frequency as well, but the entropy
tables that it adds hide most of the difference on windows this short (README). The lengths
of a window depend on it alone and are kept in a bounded cache of the worker.

A document's features count its windows with a difference at or above each threshold; a
logistic regression on them, fitted on labelled documents that trained no dictionary, turns
them into a score. The score reads nothing but the text.

Training reads a bounded sample (SAMPLE): at most `toxic` + `ordinary` labelled documents of
at most `bytes` each, taken in the order of a hash of the id. Scoring covers every document and whole texts in
one pass without a shuffle.

Defined cases: null text equals empty text, which has no windows and gets the score of a
document without any toxic window. Without labelled documents of both kinds every score is
0. Several labels of one id count as toxic if any is. Repeated rows score alike; a null id
stays null; an empty table gives none.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, with_plain_names

#: Most documents of either kind and most bytes of one that training reads.
SAMPLE = {"toxic": 2000, "ordinary": 4000, "bytes": 20_000}
#: Differences of length at which windows are counted.
THRESHOLDS = (3, 4, 5, 6, 7)
#: Least contexts of a sequence in toxic text, and how much more frequent there (natural log).
CONTEXTS, RATIO = 8, 3.0
CARRIER = b"0123456789ABCDEF"
LEVEL, TOXIC_BYTES, ORDINARY_BYTES = 6, 16384, 32768
#: ASCII other than letters and digits separates words.
_APART = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
CACHE = 500_000


@dataclass
class Model:
    """Dictionaries and weights; small and of fixed size, sent to the workers with the task."""

    ordinary: bytes
    toxic: bytes
    weights: list[float] = field(default_factory=list)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_APART).split()


class Distance:
    """Length with the ordinary dictionary less length with the toxic one, for one word."""

    def __init__(self, model: Model):
        import zstandard as zs

        def compressor(content):
            held = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=LEVEL)
            return zs.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False).compress

        self.a, self.b, self.seen = compressor(model.ordinary), compressor(model.toxic), {}

    def of(self, word: bytes) -> int:
        got = self.seen.get(word)
        if got is None:
            window = b" " + word + b" " + CARRIER
            got = len(self.a(window)) - len(self.b(window))
            if len(self.seen) >= CACHE:
                self.seen.clear()
            self.seen[word] = got
        return got

    def features(self, text: str | None) -> list[float]:
        counts = Counter(map(self.of, words_of(text)))
        above = [sum(n for d, n in counts.items() if d >= t) for t in THRESHOLDS]
        return [1.0, *[math.log1p(n) for n in above], *[float(n > 0) for n in above]]


def _contexts(texts: list[str]) -> tuple[Counter, int]:
    """Different (word before, word, word after) of each word, and their number."""
    seen = set()
    for t in texts:
        w = words_of(t)
        seen.update(zip([b""] + w[:-1], w, w[1:] + [b""]))
    return Counter(x[1] for x in seen), len(seen)


def _sequences(word: bytes) -> set[bytes]:
    p = b" " + word + b" "
    return {p[i : i + n] for n in (4, 5, 6) for i in range(len(p) - n + 1)}


def _dictionary(counts: Counter, size: int) -> bytes:
    """The most frequent words, each with its carrier, the most frequent last; at most size bytes."""
    held, left = [], size
    for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
        piece = b" " + w + b" " + CARRIER
        left -= len(piece)
        if left < 0:
            break
        held.append(piece)
    return b"".join(reversed(held)) or CARRIER


def train(toxic: list[str], ordinary: list[str]) -> Model | None:
    """A model from labelled texts: two thirds train the dictionaries, the rest the thresholds' weights."""
    if len(toxic) < 3 or len(ordinary) < 3:
        return None
    cut_t, cut_o = len(toxic) * 2 // 3, len(ordinary) * 2 // 3
    bad, n_bad = _contexts(toxic[:cut_t])
    good, n_good = _contexts(ordinary[:cut_o])
    in_bad, in_good = Counter(), Counter()
    for counts, into in ((bad, in_bad), (good, in_good)):
        for w, n in counts.items():
            for s in _sequences(w):
                into[s] += n
    telling = {s for s, n in in_bad.items() if n >= CONTEXTS and math.log((n + 0.5) / n_bad) - math.log((in_good[s] + 0.5) / n_good) > RATIO}
    chosen = Counter({w: n for w, n in bad.items() if good[w] * 8 <= n and not telling.isdisjoint(_sequences(w))})
    model = Model(_dictionary(good, ORDINARY_BYTES), _dictionary(chosen, TOXIC_BYTES))
    measure = Distance(model)
    x = np.array([measure.features(t) for t in toxic[cut_t:] + ordinary[cut_o:]])
    y = np.array([1.0] * (len(toxic) - cut_t) + [0.0] * (len(ordinary) - cut_o))
    model.weights = _logistic(x, y).tolist()
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Ridge logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + penalty * w
        hess = (x.T * (p * (1 - p))) @ x + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5) -> Model | None:
    """Train on labelled documents whose crc32 of the id as text, modulo folds, is not 0."""
    marked = labels.filter(F.col(label_col).isNotNull() & (crc_bucket(F.col(id_col), folds) != 0)).groupBy(F.col(id_col).alias("_sl_key")).agg(F.max(label_col).alias("_sl_y"))
    marked = marked.withColumn("_sl_order", F.xxhash64(F.col("_sl_key").cast("string")))
    ids = None
    for y, n in ((1, SAMPLE["toxic"]), (0, SAMPLE["ordinary"])):
        part = marked.filter(F.col("_sl_y") == y).orderBy("_sl_order", "_sl_key").limit(n)
        ids = part if ids is None else ids.unionByName(part)
    # at most SAMPLE["toxic"] + SAMPLE["ordinary"] ids, so the text is never shuffled
    read = docs.select(id_col, text_col).filter(F.col(text_col).isNotNull() & (F.octet_length(text_col) <= SAMPLE["bytes"]))
    rows = read.join(F.broadcast(ids), F.col(id_col) == F.col("_sl_key")).select("_sl_order", "_sl_key", "_sl_y", F.col(text_col).alias("_sl_text")).dropDuplicates(["_sl_key"]).collect()
    rows.sort(key=lambda r: (r["_sl_order"], r["_sl_key"]))
    return train([r["_sl_text"] for r in rows if r["_sl_y"] == 1], [r["_sl_text"] for r in rows if r["_sl_y"] != 1])


_live: dict[tuple, Distance] = {}


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs and _sl_score."""
    from pyspark.sql import types as T

    schema = T.StructType(docs.schema.fields + [T.StructField("_sl_score", T.DoubleType())])

    def run(batches):
        for b in batches:
            if model is None:
                values = np.zeros(b.num_rows)
            else:
                key = (model.ordinary, model.toxic)
                if key not in _live:
                    _live.clear()
                    _live[key] = Distance(model)
                features = _live[key].features
                x = np.array([features(t) for t in b.column(text_col).to_pylist()]).reshape(b.num_rows, -1)
                values = 1 / (1 + np.exp(-np.clip(x @ np.array(model.weights), -30, 30))) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(values)], names=[*b.schema.names, "_sl_score"])

    return docs.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per document: id, held_out, score, predicted."""
    model = fit(docs, labels, id_col, text_col, label_col)
    scored = score(docs.select(id_col, text_col), model, id_col, text_col)
    return scored.select(id_col, (crc_bucket(F.col(id_col), 5) == 0).alias("held_out"), F.col("_sl_score").alias("score"), (F.col("_sl_score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """docs without the documents predicted toxic, all columns as they are."""
    model = fit(docs, labels, id_col, text_col, label_col)
    return with_plain_names(docs, (id_col, text_col), lambda d: score(d, model, id_col, text_col).filter("_sl_score < 0.5").drop("_sl_score"))
