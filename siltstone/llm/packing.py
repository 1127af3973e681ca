"""Packing documents into sequences of fixed length: concatenate and cut.

Method: the first pass tokenizes each partition and writes the ids with the running sum of
tokens inside the partition. The totals of the partitions (one number each) give every
partition its global offset: a prefix sum in two passes. The second pass cuts the one long
row of tokens into windows of `length` ids; a document across a boundary gives one piece
for each window it touches. Only the last sequence can have padding.

The tokenizer is never trained. Where its file has the normaliser, the splitter and the kind
of model that FORM states, pre-tokens are looked up in a bounded cache of the worker,
because the public tokenizer takes most of its time to normalise text that it has seen
before. Whatever is not plainly covered (letters beyond Latin-1, unusual white space,
special-token strings) goes through the tokenizer itself; the ids are the same either way,
which the tests check. Any other tokenizer is used as it is.

Defined cases: null text is empty and gives the end id alone. Rows repeated with one id are
packed as documents of their own. A null id stays null. An empty table gives no pieces.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Entries of the worker's cache; at the limit it is emptied.
PIECES = 600_000

#: The pattern by which the word BPE finds pre-tokens, and the parts of its file that CachedWordBpe stands for.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
FORM = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": WORD_PATTERN}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}

_BYTE_CHARS = [*range(33, 127), *range(161, 173), *range(174, 256)]


def _byte_map() -> list[str]:
    """The printable character that byte-level tokenizers write for each byte."""
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in _BYTE_CHARS:
            out[b] = chr(b)
        else:
            out[b] = chr(extra)
            extra += 1
    return out


class CachedWordBpe:
    """Ids of tokenizers' word BPE (NFC, lower case, white space dropped), as uint16 bytes.

    A text of Latin-1 characters is lower-cased and split into pre-tokens here (all of Latin-1
    is in NFC already), each of which is looked up. Any other text is taken chunk by chunk
    between ASCII white space, odd chunks by the tokenizer itself.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.split = regex.compile(WORD_PATTERN).findall
        self.bytes = _byte_map()
        self.beyond = re.compile(r"[^\t-\r\x20-\x7e\xa1-\xff]|<\|").search
        self.mixed = re.compile(r"[^a-z\xdf-\xf6\xf8-\xff\t-\r .,]|[.,][.,]").search
        self.latin = re.compile(r"[\x21-\x7e\xa1-\xff]*").fullmatch
        self.strange = regex.compile(r"[\x00-\x08\x0e-\x1f\x7f-\xa0\u1680\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff]|<\|").search
        self.pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        text = piece if piece.isascii() else "".join(map(self.bytes.__getitem__, piece.encode()))
        got = array("H", [t.id for t in self.model.tokenize(text)]).tobytes()
        if len(self.pieces) >= PIECES:
            self.pieces.clear()
        self.pieces[piece] = got
        return got

    def _latin(self, lower: str) -> bytes:
        if self.mixed(lower):
            tokens = self.split(lower)
        else:  # letters with single stops and commas
            tokens = lower.replace(".", " . ").replace(",", " , ").split()
        get, miss = self.pieces.get, self._piece
        return b"".join([get(t) or miss(t) for t in tokens])

    def _whole(self, text: str) -> bytes:
        return array("H", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        if not self.beyond(text):
            return self._latin(text.lower())
        if self.strange(text):
            return self._whole(text)
        return b"".join([self._latin(c.lower()) if self.latin(c) else self._whole(c) for c in text.split()])


def has_form(path: str) -> bool:
    """Whether CachedWordBpe gives this tokenizer's ids: its file has FORM, a BPE of ids below 65536, and added tokens that start with <|."""
    with open(path, encoding="utf-8") as f:
        form = json.load(f)
    model, added = form.get("model", {}), form.get("added_tokens") or []
    ids = [*model["vocab"].values(), *(x["id"] for x in added)] if model.get("type") == "BPE" and model.get("vocab") else [1 << 16]
    whole = not model.get("dropout") and not form.get("truncation") and not form.get("padding")
    return whole and all(form.get(k) == v for k, v in FORM.items()) and max(ids) < 1 << 16 and all(x["content"].startswith("<|") for x in added)


class PlainTokenizer:
    """Any tokenizer file, without caches, as uint32 bytes; whole texts, whatever limit the file sets."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_loaded: dict[tuple[str, bool], object] = {}


def _tokenizer(path: str, cached: bool):
    if (path, cached) not in _loaded:
        _loaded[path, cached] = (CachedWordBpe if cached else PlainTokenizer)(path)
    return _loaded[path, cached]


def pack(docs: DataFrame, tokenizer_path: str, length: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", cached: bool | None = None) -> DataFrame:
    """One row per piece: id, start, length, ids (uint32 little-endian bytes), ids_crc32, doc_tokens, sequence_id, offset.

    cached: whether pre-tokens are looked up; None where the tokenizer's file allows it, True
    for a file that doesn't is refused with a ValueError.
    """
    if cached and not has_form(tokenizer_path):
        raise ValueError(f"pack: {tokenizer_path} can't be cached")
    cached = has_form(tokenizer_path) if cached is None else cached
    id_type = docs.schema[id_col].dataType.simpleString()
    width = "<u2" if cached else "<u4"

    def tokenize(batches):
        from pyspark import TaskContext

        part, total = TaskContext.get().partitionId(), 0
        encode, end = _tokenizer(tokenizer_path, cached).encode, np.array([end_id], width).tobytes()
        for b in batches:
            ids = [encode(t or "") + end for t in b.column("_sl_text").to_pylist()]
            n = np.array([len(x) // np.dtype(width).itemsize for x in ids], np.int64)
            sums = np.cumsum(n) + total
            yield pa.RecordBatch.from_pydict({"_sl_id": b.column("_sl_id"), "_sl_n": n, "_sl_part": np.full(len(n), part, np.int64), "_sl_off": sums - n, "_sl_ids": pa.array(ids, pa.binary())})
            total = int(sums[-1]) if len(n) else total

    schema = f"_sl_id {id_type}, _sl_n bigint, _sl_part bigint, _sl_off bigint, _sl_ids binary"
    slim = docs.select(F.col(id_col).alias("_sl_id"), F.col(text_col).cast("string").alias("_sl_text"))
    rows = cut(slim.mapInArrow(tokenize, schema))
    totals = {r[0]: r[1] for r in rows.groupBy("_sl_part").agg(F.sum("_sl_n")).collect()}
    base, bases = 0, []
    for part in sorted(totals):
        bases.append((part, base))
        base += totals[part]
    # one row per partition of the input: its size is bounded by their number
    held = docs.sparkSession.createDataFrame(bases, "_sl_part bigint, _sl_base bigint")
    placed = rows.join(F.broadcast(held), "_sl_part").select("_sl_id", "_sl_n", (F.col("_sl_off") + F.col("_sl_base")).alias("_sl_off"), "_sl_ids")

    def slice_up(batches):
        for b in batches:
            out = {k: [] for k in ("_sl_doc", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
            for doc, n, off, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                wide = np.frombuffer(ids, width).astype("<u4")
                at = 0
                while at < n:
                    seq, inside = divmod(off + at, length)
                    take = min(length - inside, n - at)
                    piece = wide[at : at + take].tobytes()
                    for k, v in zip(out, (doc, at, take, piece, zlib.crc32(piece), n, seq, inside)):
                        out[k].append(v)
                    at += take
            arrays = [pa.array(out["_sl_doc"], b.schema.field(0).type)] + [pa.array(v, pa.binary() if k == "ids" else pa.int64()) for k, v in list(out.items())[1:]]
            yield pa.RecordBatch.from_arrays(arrays, names=list(out))

    pieces = placed.mapInArrow(slice_up, f"_sl_doc {id_type}, start bigint, length bigint, ids binary, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
    return pieces.withColumnRenamed("_sl_doc", id_col)
