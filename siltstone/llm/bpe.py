"""BPE encoding and decoding by content-defined chunk reuse.

Method: a rolling hash over the words of a text decides where it is cut (before white space,
after a window of words whose hash falls in one class of `mean`), so texts that share
passages share chunks wherever these stand. The distinct chunks of all documents are encoded
once each. A document's chunks are joined back in order; every join is checked by encoding the
words round it in one piece: where that agrees with the two chunks' ends, the join stands, where
it agrees only in its outer words, its ids take the place of the ends, and else the whole text
is encoded again. So the ids are those of the whole text. Ids are decoded by the tokenizer's own
rule.

Scale: a first pass counts the hashes of chunks; those met twice or more are shared. A scan
encodes whole documents without a shared chunk, and what others have for themselves. Shared chunks
are dealt, packed, to groups by their hash, where each is encoded once and its references are
answered, so neither texts nor ids are joined. A scan knows shared chunks by a Bloom filter of at most
2**FILTER bits; a chunk that it takes for shared by mistake goes the shared way with the same
result, and beyond the filter's capacity more do. Shared chunks with more than their group's share
of references are dealt by block instead and encoded once in each group that asks. Documents are
put together in the order of (document, place), streaming, so a task holds one document and the ids
of one group's chunks.

Defined cases: null text is empty and has no ids. A null id stays null. Rows that repeat an id are
documents of their own. An empty table gives no rows. A text without white space is one chunk.
Extra columns are never read. Truncation and padding that a tokenizer's file asks for are off.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.storage import cut, free

from .common import parts, slices, span_hashes, text_bytes, window_hashes, word_spans
from .packing import _tokenizer, has_form

#: Words of the rolling hash; one position in MEAN is a cut; least and largest number of words of a chunk, the last one apart.
WINDOW, MEAN, LEAST, MOST = 4, 128, 32, 1024
#: Words on each side of a join that are encoded together.
ROUND = 2
#: Bytes of text cut at a time; hashes that a task remembers.
BLOCK, SENT = 1 << 22, 1 << 20
#: Groups of chunks for each shuffle partition; references from which a chunk can be hot.
GROUPS, HOT = 4, 64
#: The filter of shared chunks has two to the power of this many bits at most: 8 MB, for 4 million chunks with one mistake in 70.
FILTER = 26


def cuts(data: np.ndarray, off: np.ndarray, mean: int = MEAN) -> list[list[tuple[int, int, bytes, bytes]]]:
    """Per text its chunks: start, end, the last ROUND words before the start (with their white space) and the first ROUND words after it."""
    starts, ends, first = word_spans(data, off)
    rolling = window_hashes(span_hashes(data, starts, ends), WINDOW) % np.uint64(mean) == 0
    after = np.flatnonzero(rolling) + WINDOW  # a chunk may start with this word's white space
    out = []
    for i in range(len(off) - 1):
        a, z = int(first[i]), int(first[i + 1])
        words = [a]
        for k in after[np.searchsorted(after, a + WINDOW) : np.searchsorted(after, z)].tolist():
            while k - words[-1] > MOST:
                words.append(words[-1] + MOST)
            if k - words[-1] >= LEAST:
                words.append(k)
        while z - words[-1] > MOST:
            words.append(words[-1] + MOST)
        at = [int(off[i])] + [int(ends[k - 1]) for k in words[1:]] + [int(off[i + 1])]
        chunks = []
        for n, (s, e) in enumerate(zip(at[:-1], at[1:])):
            if s == e:
                continue
            if n:
                k = words[n]
                before = int(ends[k - ROUND - 1]) if k - ROUND > words[n - 1] else at[n - 1]
                until = min(e, int(ends[min(k + ROUND, z) - 1]))
                chunks.append((s, e, data[before:s].tobytes(), data[s:until].tobytes()))
            else:
                chunks.append((s, e, b"", b""))
        out.append(chunks)
    return out


def _hashes(batches):
    """How often a task meets each chunk."""
    met: Counter = Counter()

    def emit():
        batch = pa.RecordBatch.from_arrays([pa.array(list(met), pa.binary()), pa.array(list(met.values()), pa.int64())], names=["h", "n"])
        met.clear()
        return batch

    for b in slices(batches, "_sl_text", BLOCK):
        data, off = text_bytes(b.column("_sl_text"))
        met.update(hashlib.md5(data[s:e].tobytes()).digest() for chunks in cuts(data, off) for s, e, _, _ in chunks)
        if len(met) > SENT:
            yield emit()
    yield emit()


def _pack(chunks: list[bytes]) -> bytes:
    lengths = np.array([len(c) for c in chunks], "<u4")
    return zstandard.ZstdCompressor(level=3).compress(np.array([len(chunks)], "<u4").tobytes() + lengths.tobytes() + b"".join(chunks))


def _unpack(blob: bytes):
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw[:4], "<u4")[0])
    at = 4 + 4 * n
    for k in np.frombuffer(raw[4:at], "<u4").tolist():
        yield raw[at : at + k]
        at += k


def _shared_filter(met: DataFrame, n: int) -> np.ndarray:
    """A Bloom filter of the hashes in met, n of them, as bytes: 2**FILTER bits at most, so the driver gets 2**(FILTER - 5) rows at most."""
    bits = 1 << min(FILTER, max(10, (16 * n).bit_length()))

    def words(batches):
        own = np.zeros(bits // 32, np.uint32)
        for b in batches:
            at = _positions(b.column(0).to_pylist(), bits).ravel()
            np.bitwise_or.at(own, at >> 5, np.uint32(1) << (at & 31).astype(np.uint32))
        seen = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(own[seen].astype(np.int64))], names=["at", "bits"])

    out = np.zeros(bits // 32, np.uint32)
    for at, own in met.select("h").mapInArrow(words, "at bigint, bits bigint").groupBy("at").agg(F.bit_or("bits")).collect():
        out[at] = own
    return out


def _positions(hashes: list[bytes], bits: int) -> np.ndarray:
    return (np.frombuffer(b"".join(hashes), "<u8").reshape(-1, 2) % np.uint64(bits)).astype(np.int64)


def _may_hold(words: np.ndarray, hashes: list[bytes]) -> np.ndarray:
    at = _positions(hashes, 32 * len(words))
    return ((words[at >> 5] >> (at & 31).astype(np.uint32)) & 1).all(axis=1)


#: Rows of a scan: finished documents; documents with shared chunks, their own pieces, texts of shared chunks, references to them.
_DONE, _DOCUMENT, _PIECE, _TEXTS, _REFERENCES = range(5)
_SOME = pa.list_(pa.binary())
_KINDS = [("kind", pa.int32()), ("grp", pa.int32()), ("row", pa.int64()), ("place", pa.int64()), ("blob", pa.binary()), ("md5", pa.binary()), ("tails", _SOME), ("heads", _SOME)]


def _scan(shared: np.ndarray, hot: set[bytes], groups: int, tokenizer, tell, more: list[tuple]):
    """Per block: documents without shared chunks are encoded; the others leave their own pieces, and shared chunks are dealt to groups.

    A chunk's group follows from its hash; a hot chunk goes to the group of the block that refers to it.
    """

    def run(batches):
        from pyspark import TaskContext

        encode, decode, width = tokenizer()
        part, known = TaskContext.get().partitionId(), {}
        row, block, sent = part << 36, part * 7919, set()
        for b in slices(batches, "_sl_text", BLOCK):
            data, off = text_bytes(b.column("_sl_text"))
            texts, refs, out = defaultdict(list), defaultdict(list), []
            own, block = block % groups, block + 1
            found = cuts(data, off)
            parts_ = [[data[s:e].tobytes() for s, e, _, _ in chunks] for chunks in found]
            hashes = [hashlib.md5(x).digest() for xs in parts_ for x in xs]
            flags = _may_hold(shared, hashes) if hashes else np.empty(0, bool)
            at = 0
            for i, (chunks, xs) in enumerate(zip(found, parts_)):
                hs, fs = hashes[at : at + len(xs)], flags[at : at + len(xs)].tolist()
                at += len(xs)
                tails, heads = [c[2] for c in chunks[1:]], [c[3] for c in chunks[1:]]
                if not any(fs):
                    ids = joined([encode(x.decode()) for x in xs], tails, heads, encode, width, known)
                    if ids is None:
                        ids = encode(data[off[i] : off[i + 1]].tobytes().decode())
                    out.append({"kind": _DONE, "i": i} | tell(ids, decode))
                    continue
                out.append({"kind": _DOCUMENT, "i": i, "row": row + i, "place": -1, "md5": hashlib.md5(data[off[i] : off[i + 1]].tobytes()).digest(), "tails": tails, "heads": heads})
                for place, (x, h, f) in enumerate(zip(xs, hs, fs)):
                    if not f:
                        out.append({"kind": _PIECE, "row": row + i, "place": place, "blob": encode(x.decode())})
                        continue
                    group = own if h in hot else int.from_bytes(h[:4], "little") % groups
                    key = (h, group) if h in hot else h
                    if key not in sent:
                        sent.add(key)
                        texts[group].append(x)
                    refs[group].append((row + i, place, h))
            if len(sent) > SENT:
                sent.clear()  # chunks met again are sent again, into the same group
            out += [{"kind": _TEXTS, "grp": g, "blob": _pack(x)} for g, x in texts.items()]
            out += [{"kind": _REFERENCES, "grp": g, "blob": np.array([x[:2] for x in r], "<u8").T.tobytes() + b"".join(x[2] for x in r)} for g, r in refs.items()]
            yield pa.RecordBatch.from_pydict({"_sl_id": b.column("_sl_id").take(pa.array([x.get("i") for x in out], pa.int64()))} | {k: pa.array([x.get(k) for x in out], t) for k, t in _KINDS + more})
            row += len(found)

    return run


def decoder(path: str):
    """Function from an array of ids to the text that the tokenizer's decode(ids, skip_special_tokens=False) gives."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    if tokenizer.decoder is not None:
        return lambda ids: tokenizer.decode(ids.tolist(), skip_special_tokens=False)
    # without a decoder, tokens are joined by spaces
    tokens = [tokenizer.id_to_token(i) for i in range(max(tokenizer.get_vocab(True).values()) + 1)]
    return lambda ids: " ".join(map(tokens.__getitem__, ids.tolist()))


def joined(chunks: list[bytes], tails: list[bytes], heads: list[bytes], encode, width: int, known: dict | None = None) -> bytes | None:
    """Ids of a text from those of its chunks, joins checked and mended; None where a join can't be mended."""
    out = bytearray(chunks[0]) if chunks else bytearray()
    known = {} if known is None else known
    for right, tail, head in zip(chunks[1:], tails, heads):
        key = (tail, head)
        if key not in known:
            if len(known) > 200_000:
                known.clear()
            t, h, both = (encode(x.decode()) for x in (tail, head, tail + head))
            first, last = tail.split(), head.split()
            outer = bool(first and last) and both.startswith(encode(first[0].decode())) and both.endswith(encode((b" " * (len(last) > 1) + last[-1]).decode()))
            known[key] = t, h, both, outer
        t, h, both, outer = known[key]
        if not (out.endswith(t) and right.startswith(h)):
            return None
        if both == t + h:
            out += right
        elif outer and len(both) >= 2 * width:
            del out[len(out) - len(t) :]
            out += both + right[len(h) :]
        else:
            return None
    return bytes(out)


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """One row per input row: id_col, n_tokens, ids_sha256, decoded_sha256; with keep also ids (uint32 little-endian bytes) and decoded."""
    spark = docs.sparkSession
    cached = has_form(tokenizer_path)
    kind = "<u2" if cached else "<u4"
    slim = docs.select(F.col(id_col).alias("_sl_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_sl_text"))
    id_type = slim.schema["_sl_id"].dataType.simpleString()

    n = parts(spark)
    met = slim.select("_sl_text").mapInArrow(_hashes, "h binary, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
    met = cut(met.filter("n > 1"))
    # two numbers, and at most GROUPS * n hashes: each has a share of one in that many of all references to shared chunks
    total, n_shared = met.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    hot = {bytes(r[0]) for r in met.filter((F.col("n") * GROUPS * n > total) & (F.col("n") >= HOT)).select("h").collect()}
    shared = _shared_filter(met, n_shared)
    free(met)

    def tokenizer():
        return _tokenizer(tokenizer_path, cached).encode, decoder(tokenizer_path), 2 if cached else 4

    def tell(ids: bytes, decode) -> dict:
        wide = np.frombuffer(ids, kind).astype("<u4")
        text = decode(wide)
        out = {"n_tokens": len(wide), "ids_sha256": hashlib.sha256(wide.tobytes()).hexdigest(), "decoded_sha256": hashlib.sha256(text.encode()).hexdigest()}
        return out | ({"ids": wide.tobytes(), "decoded": text} if keep else {})

    more = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + ([("ids", pa.binary()), ("decoded", pa.string())] if keep else [])
    types = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids binary, decoded string" if keep else "")
    fields = [f for f, _ in more]
    scanned = cut(
        slim.mapInArrow(
            _scan(shared, hot, GROUPS * n, tokenizer, tell, more),
            f"_sl_id {id_type}, kind int, grp int, row bigint, place bigint, blob binary, md5 binary, tails array<binary>, heads array<binary>, {types}",
        )
    )

    def encode_once(batches):
        (encode, _, _), group, known = tokenizer(), None, {}
        for b in batches:
            found = []
            for g, kind_, blob in zip(*(b.column(c).to_pylist() for c in ("grp", "kind", "blob"))):
                if g != group:
                    group, known = g, {}
                if kind_ == _TEXTS:
                    for text in _unpack(blob):
                        h = hashlib.md5(text).digest()
                        if h not in known:
                            known[h] = encode(text.decode())
                else:
                    k = len(blob) // 32
                    at = np.frombuffer(blob, "<u8", 2 * k).astype(np.int64).tolist()
                    found += [(at[j], at[k + j], known[blob[16 * (k + j) : 16 * (k + j + 1)]]) for j in range(k)]
            for j in range(0, len(found), 10_000):
                row, place, ids = zip(*found[j : j + 10_000])
                yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(place, pa.int64()), pa.array(ids, pa.binary())], names=["row", "place", "blob"])

    dealt = scanned.filter(F.col("kind").isin(_TEXTS, _REFERENCES)).select("grp", "kind", "blob").repartition(n, "grp").sortWithinPartitions("grp", "kind")
    pieces = scanned.filter(F.col("kind").isin(_DOCUMENT, _PIECE)).select("row", "place", "blob", "_sl_id", "md5", "tails", "heads")
    rows = pieces.unionByName(dealt.mapInArrow(encode_once, "row bigint, place bigint, blob binary"), allowMissingColumns=True).repartition(n, "row").sortWithinPartitions("row", "place")

    def batch(out, ids, id_kind):
        return pa.RecordBatch.from_pydict({"_sl_id": pa.array(ids, id_kind)} | {k: pa.array([x.get(k) for x in out], t) for k, t in [("md5", pa.binary())] + more})

    def assemble(batches):
        encode, decode, width = tokenizer()
        head, chunks, out, ids, size, known, id_kind = None, [], [], [], 0, {}, pa.null()

        def close():
            got = joined(chunks, head["tails"], head["heads"], encode, width, known)
            out.append({"md5": head["md5"]} | (tell(got, decode) if got is not None else {}))
            ids.append(head["_sl_id"])
            return len(got or b"") * 4 if keep else 64

        for b in batches:
            id_kind = b.schema.field("_sl_id").type
            cols = [b.column(c).to_pylist() for c in ("place", "blob", "_sl_id", "md5", "tails", "heads")]
            for place, blob, *rest in zip(*cols):
                if place >= 0:
                    chunks.append(blob)
                    continue
                if head is not None:
                    size += close()
                head, chunks = dict(zip(("_sl_id", "md5", "tails", "heads"), rest)), []
                if size > BLOCK:
                    yield batch(out, ids, id_kind)
                    out, ids, size = [], [], 0
        if head is not None:
            close()
            yield batch(out, ids, id_kind)

    put = cut(rows.mapInArrow(assemble, f"_sl_id {id_type}, md5 binary, {types}"))
    done = scanned.filter(F.col("kind") == _DONE).select("_sl_id", *fields).unionByName(put.filter(F.col("n_tokens").isNotNull()).drop("md5"))
    open_ = put.filter(F.col("n_tokens").isNull())
    if not open_.isEmpty():  # texts with a join that can't be mended: as a whole

        def whole(batches):
            encode, decode, _ = tokenizer()
            for b in batches:
                out = [{"md5": m} | tell(encode(t), decode) for t, m in zip(b.column("_sl_text").to_pylist(), b.column("md5").to_pylist())]
                yield batch(out, [None] * len(out), pa.null()).drop_columns(["_sl_id"])

        texts = slim.select("_sl_text", F.unhex(F.md5(F.col("_sl_text").cast("binary"))).alias("md5"))
        needed = texts.join(open_.select("md5").distinct(), "md5", "left_semi").dropDuplicates(["md5"])
        done = done.unionByName(open_.select("_sl_id", "md5").join(needed.mapInArrow(whole, f"md5 binary, {types}"), "md5").drop("md5"))
    return done.withColumnRenamed("_sl_id", id_col)
