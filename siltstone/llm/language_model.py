"""Hierarchical Pitman-Yor language model over word pairs, and the scores of all documents.

Model. Each context (the previous word) has a Chinese restaurant whose customers are the
tokens that follow it; a table serves one word and sends one customer to the parent, a
restaurant that all contexts share whose words begin and end alike (first two and last two
bytes); its tables send customers to the root, whose own parent is uniform over the known
words and one unknown. Contexts and words are told apart by 64-bit hashes, classes of
contexts by 32 bits. Every context has its own restaurant, and their number grows with the
corpus.

Inference. Given the parent's probabilities and the totals of a restaurant, the tables of
one word in it are drawn by seating its customers one by one (a blocked Gibbs step); then
the tables of the classes, then, between rounds, those of the root. Large counts are seated
in growing groups, by a binomial draw at each group's start. Predictive probabilities are
taken from a seating with its own totals, so those of a context sum to 1 over the known
words and the unknown; a text's score is the sum of the logs of their mean over SAMPLES
sweeps after BURN. Discounts come from the counts of counts.

Scale. A class and its contexts lie in one bucket, so only the root is shared: each bucket
sends its counts of words, packed, to shards by ranges of hashes and gets the root's state
for the words that it named, once a round. Tokens are dealt once, packed in columns of
about 5 bytes; later rounds read the packed table without a shuffle. Frequent words (KNOWN at
most, found in one pass) are written in two bytes, which changes no result. A class with more
tokens than a bucket's share, and than PIECE, has its texts dealt to several buckets by a hash of
their words; the counts of its pairs are added up once and given to each of these, so that each
holds the class's restaurants whole, with the finds of its own texts, and one of them sends to the
root. So neither how tokens are dealt nor the number of buckets changes the model, only the draws
of its sampler; a bucket holds PIECE tokens of a hot class, or its share, and the class's pairs. Equal texts of one chunk are read once. All documents
are learned from (but for the held-out fold) and scored, whole.

Defined cases: null text is empty: it has the end token alone. Rows repeated with one id
are documents of their own. Ids may be of any type that an array can hold; a null id stays
null and counts as empty text for its fold. An empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.storage import cut_by, free

from .common import ascii_lower, blocks, crc_bucket, cut, mix, most_frequent, parts, signed, slices, span_hashes, text_bytes, word_spans

#: Most frequent words with a code, and those that one chunk names.
KNOWN, CHUNK_WORDS = 65_000, 8000
#: Tokens of a class that one bucket takes whatever its share.
PIECE = 1 << 22
ROUNDS, BURN, SAMPLES = 1, 2, 4
#: Strengths of contexts, classes and the root.
STRENGTH, CLASS_STRENGTH, ROOT_STRENGTH = 1.0, 2.0, 2.0
#: Bytes of text dealt at a time: bounds a worker's arrays, about 40 bytes each for a byte of text.
CHUNK_BYTES = 4 << 20
#: Buckets for each shuffle partition: a worker holds one bucket at a time.
BUCKETS = 3
END, START = np.uint64(0x45D9F3B3335B369D), np.uint64(0x119DE1F3A1B2C3D5)
_LOW = np.uint64(0xFFFFFFFF)


# ------------------------------------------------------------------ packed columns


def _dump(arrays: list[np.ndarray]) -> bytes:
    """Arrays by planes of bytes, compressed, one after the other."""
    import zstandard

    press, out = zstandard.ZstdCompressor(level=1), []
    for a in arrays:
        code = a.dtype.str[1:].encode().ljust(4)
        body = press.compress(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes()) if len(a) else b""
        out += [code, len(a).to_bytes(8, "little"), len(body).to_bytes(8, "little"), body]
    return b"".join(out)


def _load(blob: bytes) -> list[np.ndarray]:
    import zstandard

    out, at, press = [], 0, zstandard.ZstdDecompressor()
    while at < len(blob):
        kind = np.dtype("<" + blob[at : at + 4].decode().strip())
        n, size = (int.from_bytes(blob[at + x : at + x + 8], "little") for x in (4, 12))
        at += 20
        if n:
            raw = np.frombuffer(press.decompress(blob[at : at + size]), np.uint8)
            out.append(np.ascontiguousarray(raw.reshape(kind.itemsize, -1).T).view(kind).ravel())
        else:
            out.append(np.empty(0, kind))
        at += size
    return out


def _texts(batch) -> tuple[pa.Array, np.ndarray]:
    """The different texts of a batch, and which of them each row has; null is empty."""
    column = batch.column("_sl_text").fill_null("").dictionary_encode()
    return column.dictionary, np.asarray(column.indices, np.int64)


def _tokens(texts) -> tuple[np.ndarray, ...]:
    """(word, context, class of the context, text) of all tokens, the end of each text included."""
    data, off = text_bytes(texts)
    out = [(np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64))]
    for i, j in blocks(off):
        low = ascii_lower(data[off[i] : off[j]])
        starts, ends, first = word_spans(low, off[i : j + 1] - off[i])
        h, n = span_hashes(low, starts, ends), np.diff(first)
        word = np.empty(len(h) + j - i, np.uint64)
        last = np.cumsum(n + 1) - 1
        inner = np.ones(len(word), bool)
        inner[last] = False
        word[inner], word[last] = h, END
        kind = np.full(len(word), END)
        if len(h):
            kind[inner] = mix(sum(low[at].astype(np.uint64) << np.uint64(8 * x) for x, at in enumerate((starts, np.minimum(starts + 1, ends - 1), np.maximum(ends - 2, starts), ends - 1))))
        before, kind = np.concatenate(([START], word[:-1])), np.concatenate(([START], kind[:-1]))
        begin = np.concatenate(([0], last[:-1] + 1))
        before[begin], kind[begin] = START, START
        out.append((word, before, kind & _LOW, np.repeat(np.arange(i, j), n + 1)))
    return tuple(np.concatenate(x) for x in zip(*out))


def _find(sorted_values: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Place of each value in sorted_values, or -1."""
    if not len(sorted_values):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)
    return np.where(sorted_values[at] == values, at, -1)


def _frequent(share: float):
    """What a chunk finds often: classes (kind 1), words (2), and its number of tokens (3)."""

    def run(batches):
        for b in slices(batches, "_sl_text", CHUNK_BYTES):
            word, _, kind, _ = _tokens(_texts(b)[0])
            rows = [(3, np.zeros(1, np.uint64), np.array([len(word)]))]
            for k, values in ((1, kind), (2, word)):
                key, n = np.unique(values, return_counts=True)
                keep = np.flatnonzero(n >= max(2.0, share * len(word))) if k == 1 else np.argsort(-n, kind="stable")[:CHUNK_WORDS]
                rows.append((k, key[keep], n[keep]))
            for k, key, n in rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), k, np.int32)), signed(key), pa.array(n.astype(np.int64))], names=["kind", "w", "n"])

    return run


class Plan:
    """Hot classes with the number of buckets that each is dealt to, and the words with a code; both ascending."""

    def __init__(self, classes, pieces, known):
        self.classes, self.pieces, self.known = classes, pieces, known


def _buckets(kinds, u, word, doc, of_pair, n_docs: int, n_buckets: int, plan: Plan) -> np.ndarray:
    """The bucket of each (context u, text of_pair): that of the context's class, or one of a hot class's by the text's words."""
    content = np.zeros(n_docs, np.uint64)
    np.add.at(content, doc, mix(word))
    bucket, at = (mix(kinds) >> np.uint64(33))[u], _find(plan.classes, kinds)[u]
    hot = np.flatnonzero(at >= 0)
    if len(hot):
        bucket[hot] += mix(content)[of_pair[hot]] % plan.pieces[at[hot]]
    return (bucket % np.uint64(n_buckets)).astype(np.int64)


def _coded(known: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, hashes without a code, place of each value in the row of both)."""
    names, at = np.unique(values, return_inverse=True)
    code = _find(known, names)
    order = np.argsort(code < 0, kind="stable")
    place = np.empty(len(names), np.int64)
    place[order] = np.arange(len(names))
    return code[code >= 0].astype(np.uint16), names[code < 0], place[at]


_INFO = "which array<int>, held array<boolean>, n array<bigint>"


def _deal(n_buckets: int, plan):
    """Tokens of each chunk by bucket (kind 0), and the chunk's documents (kind 2)."""

    def run(batches):
        from pyspark import TaskContext

        part, known = TaskContext.get().partitionId(), plan.value.known
        for number, b in enumerate(slices(batches, "_sl_text", CHUNK_BYTES)):
            chunk = (part << 24) + number
            texts, which = _texts(b)
            held = np.asarray(b.column("_sl_held").fill_null(False)).astype(bool)
            weight = np.bincount(which[~held], minlength=len(texts))
            word, before, kind, doc = _tokens(texts)
            counts = np.bincount(doc, minlength=len(texts))
            contexts, one, u = np.unique(before, return_index=True, return_inverse=True)
            kinds = kind[one]
            names, w = np.unique(word, return_inverse=True)
            low, mid = np.uint64(len(texts).bit_length()), np.uint64(len(names).bit_length())
            key, times = np.unique((((u.astype(np.uint64) << mid) | w.astype(np.uint64)) << low) | doc.astype(np.uint64), return_counts=True)
            of_token, (doc, key) = doc, ((key & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64), key >> low)
            u, w = (key >> mid).astype(np.int64), (key & ((np.uint64(1) << mid) - np.uint64(1))).astype(np.int64)
            bucket = _buckets(kinds, u, word, of_token, doc, len(texts), n_buckets, plan.value)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
            rows = []
            for k in np.flatnonzero(np.diff(edges)):
                o = order[edges[k] : edges[k + 1]]
                own, lens = np.unique(u[o], return_counts=True)
                context_code, context_rest, place = _coded(known, contexts[own])
                word_code, word_rest, at = _coded(known, names[w[o]])
                rows.append((int(k), _dump([context_code, context_rest, place.astype(np.uint32), kinds[own].astype(np.uint32), lens.astype(np.uint32), word_code, word_rest, at.astype(np.uint32), doc[o].astype(np.uint32), np.minimum(times[o], _LOW).astype(np.uint32), weight[doc[o]].astype(np.uint32)])))
            m = len(rows)
            ids = b.column("_sl_id")
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows] + [chunk % n_buckets], pa.int32()), pa.array([0] * m + [2], pa.int32()), pa.array([chunk] * (m + 1), pa.int64()),
                    pa.array([r[1] for r in rows] + [None], pa.binary()), pa.ListArray.from_arrays(pa.array([None] * m + [0, len(ids)], pa.int32()) if m else pa.array([0, len(ids)], pa.int32()), ids),
                    pa.array([None] * m + [which.astype(np.int32)], pa.list_(pa.int32())), pa.array([None] * m + [held.tolist()], pa.list_(pa.bool_())), pa.array([None] * m + [counts], pa.list_(pa.int64())),
                ],
                names=["b", "kind", "chunk", "payload", "ids", "which", "held", "n"],
            )

    return run


def _merge(plan):
    """One payload per bucket: contexts with classes, pairs with training counts, and their finds by chunk and text."""

    def run(table: pa.Table) -> pa.Table:
        known, kinds = plan.value.known, np.asarray(table.column("kind"))
        tokens, rest = table.filter(pa.array(kinds == 0)), table.filter(pa.array(kinds == 2))
        if not tokens.num_rows:
            return rest
        chunks = np.asarray(tokens.column("chunk"))
        order = np.argsort(chunks)
        columns = [[] for _ in range(7)]
        for i, k in enumerate(order):
            context_code, context_rest, place, kind, lens, word_code, word_rest, at, doc, times, weight = _load(tokens.column("payload")[int(k)].as_py())
            of = np.concatenate((known[context_code], context_rest))[place]
            for x, v in zip(columns, (np.repeat(of, lens), np.repeat(kind, lens), np.concatenate((known[word_code], word_rest))[at], np.full(len(at), i, np.uint32), doc, times, weight)):
                x.append(v)
        for i, pieces in enumerate(columns):  # one column at a time, so that pieces and whole aren't all held
            columns[i] = np.concatenate(pieces)
            pieces.clear()
        context, kind, word, chunk, doc, times, weight = columns
        contexts, one, u = np.unique(context, return_index=True, return_inverse=True)
        kinds = kind[one]
        names, w = np.unique(word, return_inverse=True)
        del columns, context, kind, word
        pair = (u.astype(np.uint64) << np.uint64(32)) | w.astype(np.uint64)
        by = np.argsort(pair)
        pair, chunk, doc, times, weight = pair[by], chunk[by], doc[by], times[by], weight[by]
        first = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
        c = np.add.reduceat(times.astype(np.int64) * weight, first)
        finds, pair = np.diff(np.append(first, len(pair))), pair[first]
        lens = np.bincount((pair >> np.uint64(32)).astype(np.int64), minlength=len(contexts))
        payload = _dump([names, contexts, kinds, lens.astype(np.uint32), (pair & _LOW).astype(np.uint32), np.minimum(c, _LOW).astype(np.uint32), finds.astype(np.uint32), chunk, doc, times, chunks[order].astype(np.int64)])
        made = {"b": [table.column("b")[0].as_py()], "kind": [0], "chunk": [-1], "payload": [payload]}
        one = pa.Table.from_arrays([pa.array(made.get(f.name, [None]), f.type) for f in table.schema], schema=table.schema)
        return pa.concat_tables([one, rest])

    return run


# ------------------------------------------------------------------------- sampler


def seat(rng, count: np.ndarray, new: np.ndarray, discount: float, tables: np.ndarray | None = None) -> np.ndarray:
    """Tables after `count` customers of one word sat down in turn; new: weight of a new table."""
    t = (count > 0).astype(np.int64) if tables is None else tables
    live, done = np.flatnonzero(count > 1), 1
    while len(live):
        group = 1 if done < 32 else done // 8
        left = np.minimum(group, count[live] - done)
        p = new[live] / (new[live] + np.maximum(done - discount * t[live], 1e-12))
        t[live] += rng.random(len(live)) < p if group == 1 else rng.binomial(left, p)
        done += group
        live = live[count[live] > done]
    return t


class Bucket:
    """The restaurants of one bucket: contexts, classes, pairs, and a sampler over their tables.

    shared: of each hot class that has texts here, whether this bucket sends its tables to the root, and its pairs (_hot).
    """

    def __init__(self, payload: bytes, shared: list[tuple[bool, bytes]] = ()):
        self.names, contexts, kinds, lens, word, c, self.finds, self.chunk, self.doc, self.times, self.chunks = _load(payload)
        self.context, self.word, self.c = np.repeat(np.arange(len(contexts)), lens), word.astype(np.int64), c.astype(np.int64)
        others = []
        for sends, blob in shared:
            contexts, kinds = self._whole(contexts, kinds, *_load(blob))
            others += [] if sends else [_load(blob)[0][0]]
        names, kind = np.unique(kinds, return_inverse=True)
        # dishes: words of a class; each pair of a context and a word orders one
        dish, self.dish = np.unique((kind[self.context].astype(np.uint64) << np.uint64(32)) | self.word.astype(np.uint64), return_inverse=True)
        self.kind, self.dish_word = (dish >> np.uint64(32)).astype(np.int64), (dish & _LOW).astype(np.int64)
        self.sends = ~np.isin(names, np.array(others, np.uint32))[self.kind]
        self.sizes = len(contexts), int(kind.max(initial=-1)) + 1
        self.local = np.bincount(self.word, weights=self.c * self.sends[self.dish], minlength=len(self.names)).astype(np.int64)
        self.customers = np.bincount(self.context, weights=self.c, minlength=len(contexts))

    def _whole(self, contexts, kinds, kind, all_contexts, lens, words, c) -> tuple[np.ndarray, np.ndarray]:
        """Take the counts of a class's pairs from all its buckets; pairs stay in the order of (context, word), so finds do."""
        own = kinds == kind[0]
        both, names = np.union1d(contexts, all_contexts), np.union1d(self.names, words)
        made = np.full(len(both), kind[0], np.uint32)
        made[np.searchsorted(both, contexts)] = kinds
        mine = (np.searchsorted(both, contexts)[self.context].astype(np.uint64) << np.uint64(32)) | np.searchsorted(names, self.names)[self.word].astype(np.uint64)
        theirs = (np.repeat(np.searchsorted(both, all_contexts), lens).astype(np.uint64) << np.uint64(32)) | np.searchsorted(names, words).astype(np.uint64)
        pair = np.union1d(mine, theirs)
        count, finds = np.zeros(len(pair), np.int64), np.zeros(len(pair), np.int64)
        at = np.searchsorted(pair, mine)
        count[at], finds[at] = np.where(own[self.context], 0, self.c), self.finds
        count[np.searchsorted(pair, theirs)] = c
        self.names, self.c, self.finds = names, count, finds
        self.context, self.word = (pair >> np.uint64(32)).astype(np.int64), (pair & _LOW).astype(np.int64)
        return both, made

    def sent(self, tables: np.ndarray) -> np.ndarray:
        """Customers of the root by word, for tables by dish."""
        return np.bincount(self.dish_word, weights=tables * self.sends, minlength=len(self.names)).astype(np.int64)

    def orders(self, t: np.ndarray) -> np.ndarray:
        """Customers of the classes by dish, for tables by pair."""
        return np.bincount(self.dish, weights=t, minlength=len(self.dish_word)).astype(np.int64)

    def first(self) -> tuple[np.ndarray, dict]:
        """Customers of the root when each word has one table in a restaurant, and counts of counts."""
        orders, mine = self.orders(self.c > 0), self.sends[self.dish]
        numbers = {"once": (self.c == 1) & mine, "two": (self.c == 2) & mine, "class_once": (orders == 1) & self.sends, "class_two": (orders == 2) & self.sends}
        return self.sent(orders > 0), {x: int(v.sum()) for x, v in numbers.items()}

    def sweeps(self, discounts, root: np.ndarray, seed: list[int], burn: int, samples: int):
        """(customers of the root by word, mean predictive probability by pair) after the sweeps; root: its probabilities by word."""
        rng = np.random.default_rng(seed)
        d, d1 = discounts
        p0 = root[self.dish_word]
        t, mean = (self.c > 0).astype(np.int64), np.zeros(len(self.c))
        orders = self.orders(t)
        s = (orders > 0).astype(np.int64)
        p, new = self._predict(d, d1, p0, t, orders, s)[1:]
        for sweep in range(burn + samples):
            t = seat(rng, self.c, new, d)
            orders = self.orders(t)
            of_kind = np.bincount(self.kind, weights=s, minlength=self.sizes[1])[self.kind]
            s = seat(rng, orders, (CLASS_STRENGTH + d1 * of_kind) * p0, d1)
            p, _, new = self._predict(d, d1, p0, t, orders, s)
            if sweep >= burn:
                mean += (p - mean) / (sweep - burn + 1)
        return self.sent(s), mean

    def _predict(self, d, d1, p0, t, orders, s):
        """(probability by pair, by dish, weight of a new table by pair) of a seating, with the totals of that seating."""
        members, tables = (np.bincount(self.kind, weights=x, minlength=self.sizes[1])[self.kind] for x in (orders, s))
        by_dish = (orders - d1 * s + (CLASS_STRENGTH + d1 * tables) * p0) / (CLASS_STRENGTH + members)
        new = (STRENGTH + d * np.bincount(self.context, weights=t, minlength=self.sizes[0])[self.context]) * by_dish[self.dish]
        return (self.c - d * t + new) / (STRENGTH + self.customers[self.context]), by_dish, new


#: From buckets to shards and back (kind 0: packed; above: numbers).
_STATS = "shard int, b int, kind int, value double, payload binary"
NUMBERS = ("tokens", "types", "customers", "tables", "root_once", "root_two", "once", "two", "class_once", "class_two")


class Root:
    """Sums over all shards."""

    def __init__(self, sums: dict[str, float]):
        rate = lambda one, two: min(max(one / (one + 2 * two), 0.05), 0.95) if one + two else 0.5
        self.tokens, self.types = int(sums["tokens"]), int(sums["types"])
        self.customers, self.tables = sums["customers"], sums["tables"]
        self.discount, self.discounts = rate(sums["root_once"], sums["root_two"]), (rate(sums["once"], sums["two"]), rate(sums["class_once"], sums["class_two"]))

    def new(self) -> float:
        return (ROOT_STRENGTH + self.discount * self.tables) / (self.types + 1)

    def probabilities(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """By word; a word without customers is unknown. They sum to 1 over the known words and one unknown."""
        return (customers - self.discount * tables + self.new()) / (ROOT_STRENGTH + self.customers)


def _stat_table(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.binary())
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], names=["shard", "b", "kind", "value", "payload"])


def _stat_rows(k: int, n_shards: int, bucket: Bucket, sent: np.ndarray, numbers: dict) -> pa.Table:
    """What bucket k sends: a packed row to each shard that holds some of its words, and numbers."""
    edges = np.searchsorted(bucket.names, np.array([(i << 64) // n_shards for i in range(n_shards)], np.uint64))
    edges = np.append(edges, len(bucket.names))
    rows = [(i, k, 0, None, _dump([x[edges[i] : edges[i + 1]] for x in (bucket.names, bucket.local.astype(np.uint32), sent.astype(np.uint32))])) for i in range(n_shards) if edges[i] < edges[i + 1]]
    return _stat_table(rows + [(k % n_shards, k, 1 + NUMBERS.index(x), float(v), None) for x, v in numbers.items()])


def _answer(root: Root | None, turn: int):
    """A shard's state of the root: by word to each bucket that named it, in its order; and sums."""

    def run(table: pa.Table) -> pa.Table:
        named, sent, sums = [], [], {}
        for shard, b, kind, value, payload in zip(*(x.to_pylist() for x in table.columns)):
            if kind == 0:
                named.append(b)
                sent.append(_load(payload))
            else:
                sums[kind] = sums.get(kind, 0.0) + value
        rows = []
        if sent:
            words, at = np.unique(np.concatenate([x[0] for x in sent]), return_inverse=True)
            count, customers = (np.bincount(at, weights=np.concatenate([x[i] for x in sent])).astype(np.int64) for i in (1, 2))
            tables = (customers > 0).astype(np.int64) if root is None else seat(np.random.default_rng([turn, shard]), customers, np.full(len(words), root.new()), root.discount)
            found = {"tokens": count.sum(), "types": (count > 0).sum(), "customers": customers.sum(), "tables": tables.sum(), "root_once": (customers == 1).sum(), "root_two": (customers == 2).sum()}
            for x, v in found.items():
                sums[1 + NUMBERS.index(x)] = float(v)
            ends = np.cumsum([len(x[0]) for x in sent])
            for b, x, end in zip(named, sent, ends):
                own = at[end - len(x[0]) : end]
                rows.append((shard, b, 0, None, _dump([x[own].astype(np.uint32) for x in (count, customers, tables)])))
        return _stat_table(rows + [(shard, None, kind, v, None) for kind, v in sums.items()])

    return run


def _hot(plan):
    """Of each bucket and each hot class that has texts there: class, contexts, their numbers of pairs, words, counts."""

    def run(batches):
        for b in batches:
            rows = []
            for k, payload in zip(b.column(0).to_pylist(), b.column(1)):
                names, contexts, kinds, lens, word, c, *_ = _load(payload.as_py())
                for kind in np.intersect1d(kinds, plan.value.classes.astype(np.uint32)):
                    pairs = np.flatnonzero(np.repeat(kinds == kind, lens) & (c > 0))
                    of = np.repeat(np.arange(len(contexts)), lens)[pairs]
                    own, n = np.unique(of, return_counts=True)
                    rows.append((int(kind), k, _dump([np.array([kind], np.uint32), contexts[own], n.astype(np.uint32), names[word[pairs]], c[pairs].astype(np.int64)])))
            columns = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int32(), pa.binary()))], names=["unit", "b", "payload"])

    return run


def _added(table: pa.Table) -> pa.Table:
    """A hot class's pairs with their counts in all buckets, and the buckets."""
    kind, contexts, words, counts = None, [], [], []
    for blob in table.column("payload"):
        kind, context, lens, word, c = _load(blob.as_py())
        for x, v in zip((contexts, words, counts), (np.repeat(context, lens), word, c)):
            x.append(v)
    names, u = np.unique(np.concatenate(contexts), return_inverse=True)
    known, w = np.unique(np.concatenate(words), return_inverse=True)
    pair, at = np.unique((u.astype(np.uint64) << np.uint64(32)) | w.astype(np.uint64), return_inverse=True)
    c = np.bincount(at, weights=np.concatenate(counts), minlength=len(pair)).astype(np.int64)
    lens = np.bincount((pair >> np.uint64(32)).astype(np.int64), minlength=len(names)).astype(np.uint32)
    blob = _dump([kind, names, lens, known[(pair & _LOW).astype(np.int64)], c])
    return pa.Table.from_arrays([pa.array([sorted(table.column("b").to_pylist())], pa.list_(pa.int32())), pa.array([blob], pa.binary())], names=["bs", "payload"])


def _built(buckets: pa.Table, beside: pa.Table):
    """(number, bucket) of each row, with the hot classes among the rows beside: shard is SENDS in the one that sends, below in others."""
    shard = beside.column("shard").to_pylist()
    shared = [(shard[i] == SENDS, beside.column("payload")[i].as_py()) for i in range(len(shard)) if shard[i] < 0]
    for k, payload in zip(buckets.column("b").to_pylist(), buckets.column("payload")):
        yield k, Bucket(payload.as_py(), shared)


#: Instead of a shard's number, in rows of hot classes: this bucket sends to the root.
SENDS = -1


def _first_totals(n_shards: int):
    def run(buckets: pa.Table, beside: pa.Table) -> pa.Table:
        return pa.concat_tables([_stat_rows(k, n_shards, bucket, *bucket.first()) for k, bucket in _built(buckets, beside)] or [_stat_table([])])

    return run


def _state(answers: pa.Table) -> tuple[np.ndarray, ...]:
    """Training count, customers and tables of the root by a bucket's words, from the shards' answers."""
    shard = np.asarray(answers.column("shard"))
    order = [i for i in np.argsort(shard) if shard[i] >= 0]
    pieces = [_load(answers.column("payload")[int(i)].as_py()) for i in order]
    return tuple(np.concatenate([p[x] for p in pieces]).astype(np.int64) for x in range(3))


def _resampled(root: Root, turn: int, n_shards: int):
    def run(buckets: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for k, bucket in _built(buckets, answers):
            sent, _ = bucket.sweeps(root.discounts, root.probabilities(*_state(answers)[1:]), [turn, k], BURN, 1)
            out.append(_stat_rows(k, n_shards, bucket, sent, {}))
        return pa.concat_tables(out) if out else _stat_table([])

    return run


def _scored(root: Root):
    """Per bucket and chunk: the texts' sums of log10 P, of log10(c + 1), and known tokens."""

    def run(buckets: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for k, bucket in _built(buckets, answers):
            count, customers, tables = _state(answers)
            _, mean = bucket.sweeps(root.discounts, root.probabilities(customers, tables), [1_000_003, k], BURN, SAMPLES)
            count = count[bucket.word]
            per_pair = np.stack([np.log10(mean), np.log10(count + 1.0), (count > 0).astype(float)])
            pair = np.repeat(np.arange(len(bucket.c)), bucket.finds)
            order = np.argsort(bucket.chunk, kind="stable")
            edges = np.searchsorted(bucket.chunk[order], np.arange(len(bucket.chunks) + 1))
            for i, chunk in enumerate(bucket.chunks):
                o = order[edges[i] : edges[i + 1]]
                doc, at = np.unique(bucket.doc[o], return_inverse=True)
                sums = [np.bincount(at, weights=per_pair[x][pair[o]] * bucket.times[o], minlength=len(doc)) for x in range(3)]
                out.append((chunk, _dump([doc, sums[0], sums[1], sums[2].astype(np.uint32)])))
        return pa.Table.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], names=["chunk", "payload"])

    return run


def _per_document(log_size: float):
    def run(table: pa.Table) -> pa.Table:
        payloads = [x for x in table.column("payload").to_pylist() if x is not None]
        at = int(np.flatnonzero(np.asarray(table.column("ids").is_valid()))[0])
        ids = table.column("ids")[at].values
        which, held, n = (np.array(table.column(c)[at].as_py()) for c in ("which", "held", "n"))
        sums = np.zeros((3, len(n)))
        for p in payloads:
            doc, *values = _load(p)
            for x in range(3):
                sums[x][doc] += values[x]
        known, base = sums[2].round().astype(np.int64), sums[1] - n * log_size
        return pa.Table.from_arrays([ids, pa.array(held, pa.bool_()), *[pa.array(x[which]) for x in (n, known, base, sums[0])]], names=["_sl_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def _plan(slim: DataFrame, n: int, piece: int) -> Plan:
    """Hot classes and frequent words, from one pass: n + KNOWN rows at most come to the driver, for n classes at most have more than an n-th of all tokens."""
    counts = cut(slim.mapInArrow(_frequent(0.1 / n), "kind int, w bigint, n bigint").groupBy("kind", "w").agg(F.sum("n").alias("n")))
    total = counts.filter("kind = 3").agg(F.sum("n")).first()[0] or 0
    most = max(total / n, piece)
    hot = counts.filter((F.col("kind") == 1) & (F.col("n") > most)).toPandas()
    classes = hot["w"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(classes)
    pieces = np.ceil(hot["n"].to_numpy(np.float64)[order] / most).astype(np.uint64)
    known = np.sort(most_frequent(counts.filter("kind = 2"), "n", KNOWN).toPandas()["w"].to_numpy(np.int64).view(np.uint64))
    free(counts)
    return Plan(classes[order], pieces, known)


def score_documents(docs: DataFrame, held_out=None, id_col: str = "doc_id", text_col: str = "text", piece: int = PIECE) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    held_out: a boolean Column; true rows are scored but not learned from. By default crc32 of
    the id as text, modulo 7, equal to 2. piece: as PIECE; it changes what a bucket holds, not the model.
    """
    spark = docs.sparkSession
    held_out = crc_bucket(F.col(id_col), 7) == 2 if held_out is None else held_out
    slim = docs.select(F.col(id_col).alias("_sl_id"), F.col(text_col).cast("string").alias("_sl_text"), F.coalesce(held_out, F.lit(False)).alias("_sl_held"))
    id_type = slim.schema["_sl_id"].dataType.simpleString()
    n, shards = BUCKETS * parts(spark), max(1, parts(spark) // BUCKETS)
    plan = spark.sparkContext.broadcast(_plan(slim, n, piece))
    schema = f"b int, kind int, chunk bigint, payload binary, ids array<{id_type}>, {_INFO}"
    packed = cut_by(slim.mapInArrow(_deal(n, plan), schema).groupBy("b").applyInArrow(_merge(plan), schema), "b", parts(spark), "uncompressed")
    buckets = packed.filter("kind = 0").select("b", "payload")
    beside = "b int, shard int, payload binary"
    if len(plan.value.classes):
        added = buckets.mapInArrow(_hot(plan), "unit bigint, b int, payload binary").groupBy("unit").applyInArrow(_added, "bs array<int>, payload binary")
        sends = F.when(F.col("b") == F.col("bs")[0], SENDS).otherwise(SENDS - 1)
        hot = cut(added.select(F.explode("bs").alias("b"), "bs", "payload").select("b", sends.alias("shard"), "payload"), "uncompressed")
    else:
        hot = spark.createDataFrame([], beside)

    def summed(stats: DataFrame, root: Root | None, turn: int) -> tuple[DataFrame, dict]:
        """The shards' answers, and their sums: a row for each of NUMBERS."""
        answers = cut(stats.groupBy("shard").applyInArrow(_answer(root, turn), _STATS), "uncompressed")
        rows = answers.filter("kind > 0").groupBy("kind").agg(F.sum("value")).collect()
        return answers, dict.fromkeys(NUMBERS, 0.0) | {NUMBERS[r[0] - 1]: r[1] for r in rows}

    def with_state(run, schema: str, answers: DataFrame | None) -> DataFrame:
        state = hot if answers is None else answers.filter("kind = 0").select("b", "shard", "payload").unionAll(hot)
        return buckets.groupBy("b").cogroup(state.groupBy("b")).applyInArrow(run, schema)

    answers, sums = summed(with_state(_first_totals(shards), _STATS, None), None, 0)
    for turn in range(1, ROUNDS + 1):
        before, root = answers, Root(sums)
        counts = {x: sums[x] for x in ("once", "two", "class_once", "class_two")}
        answers, sums = summed(with_state(_resampled(root, turn, shards), _STATS, answers), root, turn)
        sums |= counts
        free(before)
    root = Root(sums)
    scores = cut(with_state(_scored(root), "chunk bigint, payload binary", answers), "uncompressed")
    free(answers, hot)
    info = packed.filter("kind = 2").select("chunk", "payload", "ids", "which", "held", "n")
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("ids", f"array<{id_type}>"), ("which", "array<int>"), ("held", "array<boolean>"), ("n", "array<bigint>"))]
    log_size = float(np.log10(root.tokens + root.types + 1.0))
    done = cut(info.unionByName(scores.select("chunk", "payload", *empty)).groupBy("chunk").applyInArrow(
        _per_document(log_size), f"_sl_id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"
    ))
    free(packed, scores)
    return done.select(F.col("_sl_id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(root.tokens).cast("bigint").alias("train_tokens"), "base_score", "score")
