"""Quality rules with the frequency of lines across the documents of a host.

Method: lines are normalised (A-Z to a-z, runs of white space to one space, ends trimmed)
and hashed to 128 bits. For each host the distinct documents that hold a line are counted;
exact copies of one text count as one document, for copies are the business of
deduplication. A line above the limits (a number of documents and a share of the host's
documents) is boilerplate and is removed from the text, whose other lines stay byte for byte; a document that loses more than `depleted` of its
words that way is rejected. Documents without a host column use `source` as the host.

Base figures come from one vectorised pass over the bytes of the text. Repeated words are
those covered by a 5-word window found at least twice in the document, all finds included.

Scale: lines shuffle as hashes with partial aggregation, so a line in a third of all
documents or a host with a third of all rows is combined before it moves. A second pass over the text, joined on the
host with the host's lines above the limits (at most 1 / line_share times the lines of its
mean document), measures each document and rebuilds its text. These lists are broadcast where their table is small, so
no text moves; beyond that texts meet them by host, those of a host with more than a task's share of documents in as many
tasks as they need.

Defined cases: null text has no words, fails the base rules and stays null. A null host is a host of
its own. Repeated rows are judged alike. A null id stays null. An empty table gives none.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators.joins import estimated_bytes

from .common import ascii_lower, blocks, cut, parts, span_hashes, text_bytes, window_hashes, word_spans

#: Windows of this many words; least words; percent of repeated words that fails.
WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20
#: A line is boilerplate above both; a document is depleted when more than this share is removed.
LINE_DOCUMENTS, LINE_SHARE, DEPLETED = 20, 0.02, 0.5

#: Largest table of common lines that is broadcast.
COMMON_BYTES = 32 << 20

FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LOWER = ascii_lower(np.arange(256, dtype=np.uint8)).tobytes()


def repeated_words(doc: np.ndarray, h: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Per document, the words covered by a k-word window found twice or more in it."""
    n_docs = len(first) - 1
    if len(h) < k:
        return np.zeros(n_docs, np.int64)
    w = window_hashes(h, k)
    at = np.flatnonzero(doc[: len(w)] == doc[k - 1 :])
    key, owner = w[at], doc[at]
    order = np.lexsort((key, owner))
    same = (key[order][1:] == key[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    hits = at[order[twice]]
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, hits, 1)
    np.add.at(cover, hits + k, -1)
    covered = np.concatenate(([0], np.cumsum(np.cumsum(cover[:-1]) > 0)))
    return covered[first[1:]] - covered[first[:-1]]


def _line_words(raw: bytes):
    """The lines of a text, each with the hash of its normal form and its words (None and 0 of a blank line)."""
    for line in raw.split(b"\n"):
        words = line.translate(_LOWER).split()
        yield line, hashlib.md5(b" ".join(words)).digest() if words else None, len(words)


def _lines(batches):
    """Per document: its host, a hash of its text, and the hashes of its lines, each once."""
    for b in batches:
        data, off = text_bytes(b.column("_sl_text"))
        lines, content = [], []
        for i in range(b.num_rows):
            raw = data[off[i] : off[i + 1]].tobytes()
            lines.append(list({h for _, h, _ in _line_words(raw) if h}))
            content.append(hashlib.md5(raw).digest())
        yield pa.RecordBatch.from_arrays([b.column("_sl_host"), pa.array(content, pa.binary()), pa.array(lines, pa.list_(pa.binary()))], names=["_sl_host", "_sl_content", "_sl_lines"])


def _measure(batches):
    """Per document: its figures, the words of its host's common lines, and its text without them."""
    for b in batches:
        data_all, off_all = text_bytes(b.column("_sl_text"))
        figures = np.zeros((6, b.num_rows), np.int64)
        missing = b.column("_sl_text").is_null().to_pylist()
        hosts, common, texts = b.column("_sl_host").to_pylist(), {}, []
        for i, j in blocks(off_all):
            off = off_all[i : j + 1] - off_all[i]
            data = data_all[off_all[i] : off_all[j]]
            starts, ends, first = word_spans(data, off)
            doc = np.repeat(np.arange(j - i), np.diff(first))
            figures[0, i:j] = np.diff(first)
            points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
            chars = np.concatenate(([0], np.cumsum(points[ends] - points[starts])))
            figures[1, i:j] = chars[first[1:]] - chars[first[:-1]]
            symbols = np.concatenate(([0], np.cumsum(_SYMBOL[data])))
            figures[2, i:j] = symbols[off[1:]] - symbols[off[:-1]]
            figures[4, i:j] = repeated_words(doc, span_hashes(data, starts, ends), first, WINDOW)
            whole = data.tobytes()
            for d in range(j - i):
                host = hosts[i + d]
                if host not in common:
                    common[host] = frozenset(b.column("_sl_common")[i + d].as_py() or ())
                raw, gone = whole[off[d] : off[d + 1]], common[host]
                seen, left, again, removed = set(), [], 0, 0
                for line in raw.split(b"\n"):
                    if line.strip(b" \t\n\v\f\r"):
                        again += line in seen
                        seen.add(line)
                if gone:
                    for line, h, n in _line_words(raw):
                        if h in gone:
                            removed += n
                        else:
                            left.append(line)
                figures[3, i + d], figures[5, i + d] = again, removed
                texts.append(None if missing[i + d] else b"\n".join(left) if removed else raw)
        cols = {"_sl_id": b.column("_sl_id")}
        cols |= {k: pa.array(figures[x]) for x, k in enumerate(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_boilerplate_words"))}
        yield pa.RecordBatch.from_pydict(cols | {"text": pa.array(texts, pa.binary()).cast(pa.string())})


def meet_common(slim: DataFrame, common: DataFrame, broadcast_bytes: int = COMMON_BYTES) -> DataFrame:
    """Documents with the common lines of their host, by broadcast or dealt so that no task gets more of a host than its share."""
    if estimated_bytes(common) <= broadcast_bytes:
        return slim.join(F.broadcast(common), "_sl_host", "left")
    n, one = parts(slim.sparkSession), F.lit(1).cast("bigint")
    counts = cut(slim.groupBy("_sl_host").agg(F.count(F.lit(1)).alias("c")))
    total = counts.agg(F.sum("c")).first()[0] or 1
    # fewer than n hosts have more than one share of n
    hot = F.broadcast(counts.filter(F.col("c") * n > total).select("_sl_host", F.ceil(F.col("c") * n / total).alias("_sl_salts")))
    salts = F.coalesce("_sl_salts", one)
    dealt = slim.join(hot, "_sl_host", "left").withColumn("_sl_salt", F.pmod(F.xxhash64("_sl_id", "_sl_text"), salts)).drop("_sl_salts")
    repeated = common.join(hot, "_sl_host", "left").withColumn("_sl_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1))).drop("_sl_salts")
    return dealt.join(repeated, ["_sl_host", "_sl_salt"], "left").drop("_sl_salt")


def quality(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", line_documents: int = LINE_DOCUMENTS, line_share: float = LINE_SHARE, depleted: float = DEPLETED,
    broadcast_bytes: int = COMMON_BYTES,
) -> DataFrame:
    """One row per document: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_boilerplate_words, kept, text (without boilerplate lines)."""
    id_type = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("_sl_id"), F.coalesce(F.concat(F.lit("h"), F.col(host_col).cast("string")), F.lit("")).alias("_sl_host"), F.col(text_col).cast("string").alias("_sl_text"))
    rows = cut(slim.select("_sl_host", "_sl_text").mapInArrow(_lines, "_sl_host string, _sl_content binary, _sl_lines array<binary>"))
    lines = rows.select("_sl_host", "_sl_content", F.explode("_sl_lines").alias("h"))
    per_line = lines.distinct().groupBy("_sl_host", "h").agg(F.count(F.lit(1)).alias("_sl_in")).filter(F.col("_sl_in") > line_documents)
    per_host = rows.select("_sl_host", "_sl_content").distinct().groupBy("_sl_host").agg(F.count(F.lit(1)).alias("_sl_docs"))
    common = per_line.join(per_host, "_sl_host").filter(F.col("_sl_in") > F.col("_sl_docs") * line_share)
    common = cut(common.groupBy("_sl_host").agg(F.collect_list("h").alias("_sl_common")))
    schema = f"_sl_id {id_type}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_boilerplate_words bigint, text string"
    out = meet_common(slim, common, broadcast_bytes).select("_sl_id", "_sl_host", "_sl_text", "_sl_common").mapInArrow(_measure, schema)
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)
    verdict = F.col("n_boilerplate_words") <= F.col("n_words") * depleted
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict).withColumnRenamed("_sl_id", id_col).select(id_col, *FIGURES, "n_boilerplate_words", "base_failed", "kept", "text")
