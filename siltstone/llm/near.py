"""Near duplicates: Jaccard join of word shingles by prefix filters under several token orders.

Method. A document's set holds its distinct 5-word shingles as 64-bit hashes. Two sets of
similarity t share a token among the first n - ceil(t * n) + 1 tokens of each under *any*
one order of all tokens. Several orders are used: each puts tokens found to be frequent
last (by their power of two), before them tokens of frequent words, which often coincide by
chance, and settles ties by a hash of its own. A pair is a candidate if under every order
it shares a prefix token with enough tokens from there on in both sets to reach the
threshold (the position filter); the filters are intersected before candidates' texts are
joined, and candidates are verified exactly. Only documents that share a token under the
first order are read for the others.

Equal sets are one class from the start (the hash of a set is 128 bits). Among classes
links are found in two steps, so that a group of many near copies doesn't make all its
pairs: first every member of a posting is tried with the posting's centre, which is the
member whose prefix meets most other documents, so the one closest to what the group has in
common; links found make components. (Further rounds, if asked for,
draw centres by a hash.) Then all pairs that share postings across components, and only
those, are tried. Of such a pair the
smaller set must have the token in the shorter prefix that two sets of its own size would
need, which spares most pairs of a group whose members are alike but not alike enough.
Pairs inside one component need no trial, for the answer is the component. Nothing is
capped or sampled.

Scale: prefix tokens travel as packed columns, about 8 bytes each, copies of one text
once per batch, and tokens that no second document has are dropped in the first task that
sees them all. Tokens that would make a posting of HOT_FINDS go as rows, since their
postings have no bound. Only frequent tokens and words, at most HEAVY and WORDS of them,
are broadcast; they order tokens and nothing else, so results don't depend on them. Texts of
documents with candidates move once into buckets by id, where they are verified.

Defined cases: null text or text without words has an empty set (n_shingles 0) and no links; fewer
than 5 words make one shingle of the whole. A null id has no links and component_id null.
Rows repeated with one id are one document: each row keeps its own n_shingles, links of any
of them are links of the id, and all get its component. Ids must be integers; any other type
is refused with a TypeError before anything runs. An empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.storage import cut_by, free

from .common import ascii_lower, blocks, cut, mix, most_frequent, parts, range_hashes, signed, span_hashes, text_bytes, with_plain_names, word_spans
from .components import components

SHINGLE, PERCENT, ORDERS = 5, 80, 2
#: Rounds of stars before the exact step.
ROUNDS = 1
#: Most frequent tokens that are broadcast; finds in one batch that make a token frequent there; finds in all from which postings go as rows.
HEAVY, OFTEN, HOT_FINDS = 1 << 18, 2, 100_000
#: Most frequent words that are broadcast, and those that one batch names.
WORDS, BATCH_WORDS = 1 << 16, 20_000
_ORDER = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5]


def _place(sorted_values: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Place of each value in sorted_values, or -1."""
    if not len(sorted_values):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)
    return np.where(sorted_values[at] == values, at, -1)


def _sorted(doc: np.ndarray, n_docs: int, key: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Order of the rows by (document, key, token): one sort of packed numbers, a full one only where they tie."""
    bits = max(1, int(n_docs - 1).bit_length())
    packed = (doc.astype(np.uint64) << np.uint64(64 - bits)) | (key >> np.uint64(bits))
    order = np.argsort(packed)
    p, t = packed[order], token[order]
    tied = p[1:] == p[:-1]
    return np.lexsort((token, key, doc)) if (t[1:][tied] != t[:-1][tied]).any() else order


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int = SHINGLE, rarity=None) -> tuple[np.ndarray, ...]:
    """(index of the first token of each value and one more, tokens ascending within a value), distinct.

    With a function from word hashes to their rarity, also the sum of it over each token's words.
    """
    data = ascii_lower(data)
    starts, ends, first = word_spans(data, off)
    h = span_hashes(data, starts, ends)
    n = np.diff(first)
    shingles = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(n)), shingles)
    begin = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    size = np.minimum(n[doc], k)
    token = range_hashes(h, begin, size)
    order = _sorted(doc, len(n), token, token)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[order][1:] != doc[order][:-1]) | (token[order][1:] != token[order][:-1])
    order = order[new]
    first = np.searchsorted(doc[order], np.arange(len(n) + 1))
    if rarity is None:
        return first, token[order]
    sums = np.concatenate(([0], np.cumsum(rarity(h))))
    return first, token[order], (sums[begin + size] - sums[begin])[order]


_READ = "kind int, id bigint, n bigint, p bigint, q bigint, t bigint, c bigint"


def _read(k: int):
    """Rows of three kinds: 0 size and hash of each document's set, 1 and 2 tokens and words that a batch finds often."""

    def rows(kind, m, **columns):
        names = ("id", "n", "p", "q", "t", "c")
        return pa.RecordBatch.from_arrays([pa.array(np.full(m, kind, np.int32))] + [columns.get(x, pa.nulls(m, pa.int64())) for x in names], names=["kind", *names])

    def run(batches):
        for b in batches:
            data, off = text_bytes(b.column("_sl_text"))
            n, p, q = (np.zeros(b.num_rows, t) for t in (np.int64, np.uint64, np.uint64))
            tokens, words = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
            for i, j in blocks(off):
                part, at = data[off[i] : off[j]], off[i : j + 1] - off[i]
                first, token = shingle_sets(part, at, k)
                n[i:j] = np.diff(first)
                for out, salt in ((p, _ORDER[0]), (q, _ORDER[1])):
                    sums = np.concatenate(([np.uint64(0)], np.cumsum(mix(token ^ np.uint64(salt)), dtype=np.uint64)))
                    out[i:j] = sums[first[1:]] - sums[first[:-1]]
                tokens.append(token)
                low = ascii_lower(part)
                words.append(span_hashes(low, *word_spans(low, at)[:2]))
            yield rows(0, b.num_rows, id=b.column("_sl_id"), n=pa.array(n), p=signed(p), q=signed(q))
            for kind, values in ((1, tokens), (2, words)):
                values = np.sort(np.concatenate(values))
                begin = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.empty(0, np.int64)
                value, count = values[begin], np.diff(np.append(begin, len(values)))
                keep = np.flatnonzero(count >= OFTEN)
                if kind == 2 and len(keep) > BATCH_WORDS:
                    keep = keep[np.argsort(-count[keep], kind="stable")[:BATCH_WORDS]]
                yield rows(kind, len(keep), t=signed(value[keep]), c=pa.array(count[keep].astype(np.int64)))

    return run


def _squeeze(values: np.ndarray) -> bytes:
    """64-bit values by planes of bytes, compressed: sorted hashes take about 6 bytes, near ids 2."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(values.view(np.uint8).reshape(-1, 8).T.tobytes())


def _unsqueeze(blob: bytes) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view(np.uint64).ravel()


def _prefixes(k: int, percent: int, orders: list[int], n_buckets: int, heavy):
    """Prefix tokens under the given orders, as packed columns by (order, bucket); those of unbounded postings in bucket -1."""

    def run(batches):
        often, level, hot, known, rare = heavy.value

        def rarity(words):
            at = _place(known, words)
            return np.where(at >= 0, rare[at], rare.max(initial=0) + 8) if len(known) else np.zeros(len(words), np.int64)

        for b in batches:
            # of equal texts in a batch the smallest id stands for all: it is the one that may stand for its class
            once = pa.Table.from_batches([b]).group_by("_sl_text").aggregate([("_sl_id", "min")]).combine_chunks()
            data, off = text_bytes(once.column("_sl_text"))
            ids = np.asarray(once.column("_sl_id_min"))
            got = {o: ([], [], [], []) for o in orders}
            for i, j in blocks(off):
                first, token, apart = shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], k, rarity)
                n = np.diff(first)
                doc = np.repeat(np.arange(j - i), n)
                length = n - (n * percent + 99) // 100 + 1
                at = _place(often, token)
                rank = np.where(at >= 0, level[at], 0).astype(np.uint64) if len(often) else np.zeros(len(token), np.uint64)
                rank = (rank << np.uint64(10)) | (1023 - np.minimum(apart, 1023)).astype(np.uint64)
                for o in orders:
                    key = (rank << np.uint64(48)) | (mix(token ^ np.uint64(_ORDER[o])) >> np.uint64(16))
                    order = _sorted(doc, j - i, key, token)
                    position = np.arange(len(order)) - first[doc]
                    chosen = position < length[doc]
                    chosen, position = order[chosen], position[chosen]
                    for x, v in zip(got[o], (token[chosen], ids[i + doc[chosen]], position, (at[chosen] >= 0) & hot[at[chosen]] if len(often) else np.zeros(len(chosen), bool))):
                        x.append(v)
            out = {x: [] for x in ("o", "b", "tokens", "ids", "positions")}
            for o in orders:
                if not got[o][0]:
                    continue
                token, owner, position, rows = (np.concatenate(x) for x in got[o])
                where = (token >> np.uint64(40)).astype(np.int64) % n_buckets
                where[rows] = -1
                order = np.argsort(token)
                order = order[np.argsort(where[order].astype(np.int16 if n_buckets < 1 << 15 else np.int64), kind="stable")]
                token, owner, position, where = token[order], owner[order].astype(np.int64), position[order].astype(np.int64), where[order]
                cuts = np.flatnonzero(np.diff(where)) + 1
                for t, d, q, w in zip(*(np.split(x, cuts) for x in (token, owner, position, where))):
                    if len(t):
                        for x, v in zip(out, (o, int(w[0]), _squeeze(t), _squeeze(d), _squeeze(q))):
                            out[x].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int32() if len(x) == 1 else pa.binary()) for x, v in out.items()], names=list(out))

    return run


def _unpack(batches):
    for b in batches:
        for o, t, d, q in zip(*(b.column(x).to_pylist() for x in (0, 2, 3, 4))):
            token, owner, position = _unsqueeze(t), _unsqueeze(d).view(np.int64), _unsqueeze(q).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(token), o, np.int32)), signed(token), pa.array(owner), pa.array(position)], names=["o", "t", "id", "at"])


def _postings(table: pa.Table) -> pa.Table:
    """Postings of one bucket with two ids or more: order, hash of the posting, id, least position, ids in it.

    Tokens with equal postings become one, with the least of their positions: that lets more
    pairs through the position filter, never fewer.
    """
    token = np.concatenate([_unsqueeze(x) for x in table.column("tokens").to_pylist()])
    owner, position = (np.concatenate([_unsqueeze(x).view(np.int64) for x in table.column(c).to_pylist()]) for c in ("ids", "positions"))
    order = np.lexsort((position, owner, token))
    token, owner, position = token[order], owner[order], position[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
    token, owner, position = token[new], owner[new], position[new]
    start = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
    size = np.diff(np.append(start, len(token)))
    start, size = start[size > 1], size[size > 1]
    h = range_hashes(mix(owner.view(np.uint64) ^ np.uint64(_ORDER[2])), start, size)
    at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    h, size, owner, position = np.repeat(h, size), np.repeat(size, size), owner[at], position[at]
    order = np.lexsort((position, owner, h))
    h, size, owner, position = h[order], size[order], owner[order], position[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    new = np.flatnonzero(new)
    o, likes = np.full(len(new), table.column("o")[0].as_py(), np.int32), np.add.reduceat(size, new) if len(new) else size
    return pa.Table.from_arrays([pa.array(o), signed(h[new]), pa.array(owner[new]), pa.array(position[new]), pa.array(likes)], names=["o", "t", "id", "at", "likes"])


def _verify(k: int, percent: int):
    def run(batches):
        for b in batches:
            sides = [text_bytes(b.column(c)) for c in ("tx", "ty")]
            ok = np.zeros(b.num_rows, bool)
            both = sides[0][1] + sides[1][1]
            for i, j in blocks(both):
                token, pair, n = [], [], []
                for data, off in sides:
                    first, t = shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], k)
                    n.append(np.diff(first))
                    token.append(t)
                    pair.append(np.repeat(np.arange(j - i), n[-1]))
                token, pair = np.concatenate(token), np.concatenate(pair)
                order = np.lexsort((token, pair))
                token, pair = token[order], pair[order]
                same = (token[1:] == token[:-1]) & (pair[1:] == pair[:-1])
                common = np.bincount(pair[1:][same], minlength=j - i)
                ok[i:j] = common * 100 >= percent * (n[0] + n[1] - common)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(ok)), b.column("b").filter(pa.array(ok))], names=["a", "b"])

    return run


def _may_reach(percent: int):
    """Whether the tokens from the shared one on can still make the similarity (sizes are checked with it)."""
    return F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py")) * (100 + percent) >= (F.col("nx") + F.col("ny")) * percent


def _shared(texts: DataFrame, orders: list[int], k: int, percent: int, held, hot: bool) -> DataFrame:
    """Postings with two documents or more under the orders: o, t, id, at, likes (documents met there)."""
    packed = cut(texts.mapInArrow(_prefixes(k, percent, orders, parts(texts.sparkSession), held), "o int, b int, tokens binary, ids binary, positions binary"), "uncompressed")
    rows = "o int, t bigint, id bigint, at bigint"
    postings = packed.filter("b >= 0").groupBy("o", "b").applyInArrow(_postings, f"{rows}, likes bigint")
    if hot:
        # unbounded postings: those that are equal become one as well, by a fingerprint that is a partial aggregate
        loose = cut(packed.filter("b < 0").mapInArrow(_unpack, rows))
        alike = loose.groupBy("o", "t").agg(F.bit_xor(F.xxhash64("id")).alias("f"), F.count(F.lit(1)).alias("c")).filter("c > 1")
        postings = postings.unionByName(loose.join(alike, ["o", "t"]).select("o", F.col("f").alias("t"), "id", "at", F.col("c").alias("likes")))
    postings = cut(postings.groupBy("o", "t", "id").agg(F.min("at").alias("at"), F.sum("likes").alias("likes")))
    free(packed, *([loose] if hot else []))
    return postings


def _unique_groups(slim: DataFrame, sets: DataFrame, counts: DataFrame, k: int, percent: int, orders: int, rounds: int, hot_finds: int) -> DataFrame:
    """(id, component) of the ids in sets; ids aren't repeated."""
    spark, n_parts = slim.sparkSession, parts(slim.sparkSession)
    full = sets.filter("n > 0 and id is not null")
    classes = cut(full.groupBy("n", "p", "q").agg(F.min("id").alias("rep")))
    reps = classes.select(F.col("rep").alias("id"), "n")
    texts = slim.filter("_sl_id is not null")

    def most(kind: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
        top = most_frequent(counts.filter(F.col("kind") == kind), "c", limit).toPandas()
        value = top["t"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(value)
        return value[order], top["c"].to_numpy(np.float64)[order]

    (often, finds), (known, frequency) = most(1, HEAVY), most(2, WORDS)
    frequency = np.log2(np.maximum(frequency, 1))
    rare = np.round((frequency.max(initial=0) - frequency) * 4).astype(np.int64)
    hot = finds >= hot_finds
    held = spark.sparkContext.broadcast((often, np.minimum(np.log2(np.maximum(finds, 1)), 63).astype(np.int64), hot, known, rare))

    first = _shared(texts, [0], k, percent, held, bool(hot.any()))
    # a document's place among its likes: the more of them its tokens meet, the more it has of what they have in common
    wanted = cut(first.groupBy("id").agg((-F.sum("likes")).alias("s")).join(reps.hint("merge"), "id").select("id", "n", "s"))
    # texts move once, by a merge join at every size: the ids are too many to broadcast in earnest
    held_texts = cut_by(texts.join(wanted.hint("merge"), texts["_sl_id"] == wanted["id"], "left_semi"), "_sl_id", n_parts)
    others = _shared(held_texts, list(range(1, orders)), k, percent, held, bool(hot.any())) if orders > 1 else first.limit(0)
    # postings lie in buckets by token, so that what follows groups and joins them in place
    joined = first.unionByName(others).drop("likes").join(wanted.hint("merge"), "id").select(F.xxhash64("o", "t").alias("t"), "o", "id", "at", "n", "s")
    postings = cut_by(joined.repartition(n_parts, "t"), "t", n_parts)  # dealt first: else each task would write a file for each bucket
    free(first, others)

    def _agreed(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.expr("shiftleft(1, o)").alias("o"))
        return pairs.groupBy("a", "b").agg(F.bit_or("o").alias("o")).filter(F.col("o") == (1 << orders) - 1).select("a", "b")

    def across(members: DataFrame, *more) -> DataFrame:
        return members.groupBy("t").agg(F.min("comp").alias("_sl_lo"), F.max("comp").alias("_sl_hi"), *more).filter("_sl_lo < _sl_hi")

    def stars(members: DataFrame, turn: int) -> DataFrame:
        """Each member with the posting's centre, where that is of another component (under every order)."""
        rank = [F.col("s")] if turn == 0 else [F.xxhash64("comp", F.lit(turn)), F.col("s")]
        low = across(members, F.min(F.struct(*[x.alias(f"r{i}") for i, x in enumerate(rank)], "id", "comp", "n", "at")).alias("h"))
        low = low.select("t", F.col("h.id").alias("a"), F.col("h.comp").alias("_sl_ca"), F.col("h.n").alias("nx"), F.col("h.at").alias("px"))
        other = members.select("t", "o", F.col("id").alias("b"), "comp", F.col("n").alias("ny"), F.col("at").alias("py"))
        return _agreed(other.join(low.hint("merge"), "t").filter((F.col("comp") != F.col("_sl_ca")) & _may_reach(percent)))

    def crossed(members: DataFrame) -> DataFrame:
        """All pairs across components that share a posting (under every order)."""
        members = members.join(across(members).select("t").hint("merge"), "t")
        # the smaller set has the token in its shorter prefix
        small = members.filter((F.col("n") - F.col("at")) * (100 + percent) >= F.col("n") * (2 * percent))
        small = small.select("t", "o", F.col("id").alias("a"), "comp", F.col("n").alias("nx"), F.col("at").alias("px"))
        large = members.select("t", F.col("id").alias("b"), F.col("comp").alias("_sl_cb"), F.col("n").alias("ny"), F.col("at").alias("py"))
        return _agreed(small.join(large.hint("merge"), "t").filter(F.expr("comp <> _sl_cb and (nx < ny or nx = ny and a < b)") & _may_reach(percent)))

    def verified(pairs: DataFrame) -> DataFrame:
        tx = held_texts.select(F.col("_sl_id").alias("a"), F.col("_sl_text").alias("tx"))
        ty = held_texts.select(F.col("_sl_id").alias("b"), F.col("_sl_text").alias("ty"))
        return cut(pairs.join(tx.hint("merge"), "a").join(ty.hint("merge"), "b").select("a", "b", "tx", "ty").mapInArrow(_verify(k, percent), "a bigint, b bigint"))

    members, links = postings.withColumn("comp", F.col("id")), None
    for turn in range(rounds):
        found = verified(stars(members, turn))
        links = found if links is None else links.unionByName(found)
        groups = components(links)
        comps = wanted.select("id").join(groups.hint("merge"), "id", "left").select("id", F.coalesce("component", "id").alias("comp"))
        before, members = members, cut_by(postings.join(comps.hint("merge"), "id").repartition(n_parts, "t"), "t", n_parts)
        if turn:
            free(before)
    links = links.unionByName(verified(crossed(members)))
    groups = components(links)
    free(members, held_texts, postings, wanted)
    # a row follows its class, a class its component
    found = classes.join(groups, classes["rep"] == groups["id"], "left").select("n", "p", "q", F.coalesce("component", "rep").alias("component"))
    out = cut(full.join(found, ["n", "p", "q"]).select("id", "component"))
    free(classes)
    return out


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = PERCENT, orders: int = ORDERS, rounds: int = ROUNDS, hot_finds: int = HOT_FINDS
) -> DataFrame:
    """One row per input row: id, n_shingles, component_id.

    rounds: of stars, one or more, before the exact step. hot_finds: finds from which a
    token's postings go as rows.
    """
    kind = docs.schema[id_col].dataType
    if not isinstance(kind, T.IntegralType):
        raise TypeError(f"near_groups: {id_col} must be an integer column, not {kind.simpleString()}")
    slim = docs.select(F.col(id_col).cast("bigint").alias("_sl_id"), F.col(text_col).cast("string").alias("_sl_text"))
    read = cut(slim.mapInArrow(_read(k), _READ))
    sets = read.filter("kind = 0").select("id", "n", "p", "q")
    twice = sets.filter("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").limit(1).count() > 0
    rows = None
    if twice:  # each row gets a number of its own, and rows of one id are linked
        rows = cut(slim.withColumn("_sl_row", F.when(F.col("_sl_id").isNotNull(), F.monotonically_increasing_id())))
        free(read)
        slim = rows.select(F.col("_sl_row").alias("_sl_id"), "_sl_text")
        read = cut(slim.mapInArrow(_read(k), _READ))
        sets = read.filter("kind = 0").select("id", "n", "p", "q")
    counts = cut(read.filter("kind > 0").groupBy("kind", "t").agg(F.sum("c").alias("c")))
    groups = _unique_groups(slim, sets, counts, k, percent, orders, rounds, hot_finds)
    found = cut(sets.join(groups.hint("merge"), "id", "left").select("id", "n", F.coalesce("component", "id").alias("component")))
    free(read, counts, groups)
    if twice:
        own = rows.select(F.col("_sl_row").alias("id"), "_sl_id")
        real = found.join(own, "id", "right").withColumn("n", F.coalesce("n", F.lit(0)))
        nulls = found.filter("id is null").select(F.lit(None).cast("bigint").alias("_sl_id"), "n", F.lit(None).cast("bigint").alias("component"))
        real = real.filter("_sl_id is not null")
        links = real.groupBy("_sl_id").agg(F.min("component").alias("b"), F.collect_set("component").alias("all")).select(F.explode("all").alias("a"), "b")
        joined = components(links)
        real = cut(real.join(joined.select(F.col("id").alias("component"), F.col("component").alias("root")), "component", "left").select("_sl_id", "n", F.coalesce("root", "component").alias("root")))
        least = real.groupBy("root").agg(F.min("_sl_id").alias("component"))
        found = real.join(least, "root").select(F.col("_sl_id").alias("id"), "n", "component").unionByName(nulls.withColumnRenamed("_sl_id", "id"))
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with the smallest id of each component, all columns as they are; rows without an id stay."""
    groups = near_groups(docs, id_col, text_col, **options)
    gone = groups.filter(F.col("component_id") != F.col(id_col)).select(F.col(id_col).alias("_sl_key")).distinct()
    return with_plain_names(docs, (id_col, text_col), lambda d: d.join(gone, d[id_col] == gone["_sl_key"], "left_anti").select(*d.columns))
