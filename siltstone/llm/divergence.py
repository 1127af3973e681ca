"""Audit of how the vocabularies of sources diverge: mergeable radix tries.

Method: each task counts the terms of its documents in a byte trie per language whose leaves
have a counter for each source; a trie gives its leaves in UTF-8 order. The leaves are merged
by ranges of (language, term), that is by ranges of prefixes: the same leaf of different tries
lands in one range, where counters add. Kept leaves travel on in the same order as chunks.
Every chunk meets the totals of its language and streams, for each pair of sources, the sum of
the divergences of its terms, and for each source its best terms, ties in UTF-8 order; sums of
pairs are added over chunks, best terms compete once more.

Scale: counters are added in tasks before anything is shuffled, so a frequent term or a hot
source sends a row per task. Ranges follow the sampled distribution of the terms, so a common
prefix is split. Totals of a language are one number a source; the result itself has a row for
each pair of sources, so such a list is the square root of the result. They meet the chunks by
language and salt, since a language may hold most of the rows. Sums of counts are exact below
9 * 10**15.

Defined cases: null text, lang and source count as ''. A group without terms is a pair's partner
like any other; a language without kept terms has pairs of value 0 and no terms. Repeated rows
and rows with null ids count as documents of their own. A very long text is counted in slices. An
empty table gives an empty result. Extra columns are never read.
"""

from __future__ import annotations

import gc
import re
from collections import Counter, defaultdict
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.storage import cut, free

from .common import parts

#: A term is a run of letters a-z (A-Z lower-cased before) and bytes beyond ASCII.
_TERM = re.compile(rb"[a-z\x80-\xff]+").findall
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Bytes of a text counted at a time; leaves of a task's tries before they are emitted; terms of a chunk.
SLICE, LEAVES, CHUNK = 1 << 20, 1 << 20, 1024


class RadixTrie:
    """A byte trie with compressed edges. A node is [edge, children by first byte, leaf or None]; a leaf is [documents, occurrences by source]."""

    def __init__(self):
        self.root = [b"", {}, None]
        self.leaves = 0

    def node(self, term: bytes) -> list:
        """The node of a term, made when it is new; its leaf may be None."""
        node, at = self.root, 0
        while at < len(term):
            children = node[1]
            child = children.get(term[at])
            if child is None:
                node = children[term[at]] = [term[at:], {}, None]
                return node
            edge = child[0]
            if not term.startswith(edge, at):
                same, most = 1, min(len(edge), len(term) - at)
                while same < most and edge[same] == term[at + same]:
                    same += 1
                # the edge is split where the term leaves it
                upper = children[term[at]] = [edge[:same], {edge[same]: child}, None]
                child[0] = edge = edge[same:]
                child, edge = upper, upper[0]
            node = child
            at += len(edge)
        return node

    def add(self, term: bytes, documents: int, occurrences: dict) -> None:
        """Add to the leaf of a term; a new leaf takes `occurrences` as its own."""
        node = self.node(term)
        leaf = node[2]
        if leaf is None:
            node[2] = [documents, occurrences]
            self.leaves += 1
            return
        leaf[0] += documents
        for source, n in occurrences.items():
            leaf[1][source] = leaf[1].get(source, 0) + n

    def traverse(self):
        """(term, leaf) in the order of the terms' bytes."""
        stack = [(b"", self.root)]
        while stack:
            prefix, node = stack.pop()
            prefix += node[0]
            if node[2] is not None:
                yield prefix, node[2]
            children = node[1]
            for first in sorted(children, reverse=True) if len(children) > 1 else children:
                stack.append((prefix, children[first]))

    def merge(self, other: RadixTrie) -> None:
        for term, (documents, occurrences) in other.traverse():
            self.add(term, documents, dict(occurrences))


def _pieces(text: bytes):
    """The text in slices that end where no term goes on."""
    at = 0
    while len(text) - at > SLICE:
        end = at + SLICE
        while end < len(text) and (text[end] >= 128 or 97 <= text[end] <= 122):
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


class TermCounts:
    """Counts of a task: plain counters by group, moved into the tries of the languages when they have grown."""

    def __init__(self):
        self.tries: dict[str, RadixTrie] = defaultdict(RadixTrie)
        self.terms: dict[tuple[str, str], Counter] = defaultdict(Counter)
        self.documents: dict[str, Counter] = defaultdict(Counter)

    def count(self, lang: str, source: str, text: bytes) -> None:
        self.tries[lang].add(b"", 0, {source: 1})
        low, seen, group = text.translate(_LOWER), set(), self.terms[lang, source]
        for piece in _pieces(low):
            found = _TERM(piece)
            group.update(found)
            seen.update(found)
        self.documents[lang].update(seen)

    def size(self) -> int:
        return sum(map(len, self.terms.values())) + sum(t.leaves for t in self.tries.values())

    def settle(self) -> None:
        by_lang: dict[str, dict[bytes, dict[str, int]]] = defaultdict(dict)
        for (lang, source), counts in self.terms.items():
            terms = by_lang[lang]
            for term, n in counts.items():
                if term in terms:
                    terms[term][source] = n
                else:
                    terms[term] = {source: n}
        for lang, terms in by_lang.items():
            add, documents = self.tries[lang].add, self.documents[lang]
            for term, occurrences in terms.items():
                add(term, documents[term], occurrences)
        self.terms.clear()
        self.documents.clear()


_LEAF = pa.schema([("lang", pa.string()), ("term", pa.string()), ("docs", pa.int64()), ("counters", pa.list_(pa.struct([("source", pa.string()), ("n", pa.int64())])))])
#: Leaves of an Arrow batch.
_BATCH = 10_000


def _batch(lang: str, terms: list[bytes], leaves: list[list]) -> pa.RecordBatch:
    ends = np.cumsum([0] + [len(x[1]) for x in leaves], dtype=np.int32)
    sources = pa.array([s for x in leaves for s in x[1]], pa.string())
    n = pa.array([v for x in leaves for v in x[1].values()], pa.int64())
    counters = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([sources, n], fields=list(_LEAF.field("counters").type.value_type)))
    arrays = [pa.array([lang] * len(terms), pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array([x[0] for x in leaves], pa.int64()), counters]
    return pa.RecordBatch.from_arrays(arrays, names=_LEAF.names)


def _leaves(batches):
    counts = TermCounts()

    def emit():
        counts.settle()
        for lang, trie in counts.tries.items():
            walk = trie.traverse()
            while some := list(islice(walk, _BATCH)):
                yield _batch(lang, *map(list, zip(*some)))
        counts.tries.clear()

    gc.disable()  # tries are millions of containers without a cycle, which the collector would walk again and again
    try:
        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                counts.count(lang, source, text.as_buffer().to_pybytes())
                if counts.size() > LEAVES:
                    yield from emit()
        yield from emit()
    finally:
        gc.enable()


def term_leaves(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Merged leaves: lang, term, docs, counters (source, n), in ranges of (lang, term); the term '' counts the documents of each source."""
    slim = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_sl_{i}") for i, c in enumerate((lang_col, source_col))], F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("_sl_text"))
    leaves = cut(slim.mapInArrow(_leaves, "lang string, term string, docs bigint, counters array<struct<source:string,n:bigint>>"))
    ranged = leaves.repartitionByRange(parts(docs.sparkSession), "lang", "term")
    added = ranged.select("lang", "term", "docs", F.posexplode("counters").alias("i", "c")).groupBy("lang", "term", F.col("c.source").alias("source")).agg(F.sum("c.n").alias("n"), F.sum(F.when(F.col("i") == 0, F.col("docs")).otherwise(0)).alias("docs"))
    merged = added.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("counters"))
    out = cut(merged)
    free(leaves)
    return out


def _share(count: np.ndarray, total: int, kinds: int) -> np.ndarray:
    """1 + floor(10**9 * (count + 2) / (total + 2 * kinds)), in steps that stay exact."""
    under = np.int64(total + 2 * kinds)
    rest, out = count.astype(np.int64) + 2, np.zeros(count.shape, np.int64)
    out, rest = rest // under, rest % under
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // under, rest % under
    return out + 1


def _divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def divergence(docs: DataFrame, min_docs: int = 10, top: int = 10, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Rows of two parts for each group (lang, source): lang, source, part, item, value, rank.

    Part `pair`: every other source of the language and its divergence, all ranks. Part `term`: the `top` kept
    terms that the group uses more than its language does. Terms in fewer than `min_docs` documents of a language aren't kept.
    """
    spark = docs.sparkSession
    leaves = term_leaves(docs, lang_col, source_col, text_col)
    kept = leaves.filter((F.col("term") == "") | (F.col("docs") >= min_docs))
    # totals: one row per language, one number per source of it
    counted = kept.select("lang", (F.col("term") != "").cast("bigint").alias("real"), F.explode("counters").alias("c"))
    by_source = counted.groupBy("lang", F.col("c.source").alias("source")).agg(F.sum(F.col("real") * F.col("c.n")).alias("n"))
    kinds = kept.filter("term != ''").groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    langs = by_source.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("sources")).join(kinds, "lang", "left").withColumn("v", F.coalesce("v", F.lit(0)))
    salts = parts(spark)
    langs = cut(langs)

    def chunks(batches):
        from pyspark import TaskContext

        part, no = TaskContext.get().partitionId(), 0
        one = lambda column: pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)
        for b in batches:
            codes = np.asarray(pc.dictionary_encode(b.column(0)).indices)
            edges = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), b.num_rows]
            for first, end in zip(edges[:-1], edges[1:]):
                for i in range(first, end, CHUNK):
                    some = b.slice(i, min(CHUNK, end - i))
                    yield pa.RecordBatch.from_arrays([some.column(0).slice(0, 1), pa.array([(part << 36) + no], pa.int64()), one(some.column(1)), one(some.column(2))], names=["lang", "no", "terms", "counters"])
                    no += 1

    leaf = "array<struct<source:string,n:bigint>>"
    chunked = kept.select("lang", "term", "counters").sortWithinPartitions("lang", "term").mapInArrow(chunks, f"lang string, no bigint, terms array<string>, counters array<{leaf}>")
    met = chunked.withColumn("salt", F.pmod(F.hash("no"), F.lit(salts))).join(langs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["lang", "salt"]).select("lang", "terms", "counters", "sources", "v")

    def stream(batches):
        for b in batches:
            lang, terms, counters, sources, v = b.columns
            for i in range(b.num_rows):
                yield from _of_chunk(lang[i].as_py(), terms[i].as_py(), counters[i].values, sources[i].as_py(), v[i].as_py(), top)

    said = cut(met.mapInArrow(stream, "lang string, source string, part string, item string, value bigint"))
    pairs = said.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    both = pairs.select("lang", "part", "value", F.explode(F.array(F.struct(F.col("source").alias("a"), F.col("item").alias("b")), F.struct(F.col("item").alias("a"), F.col("source").alias("b")))).alias("x"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = both.select("lang", F.col("x.a").alias("source"), "part", F.col("x.b").alias("item"), "value").withColumn("rank", F.row_number().over(order))
    terms = said.filter("part = 'term'").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.unionByName(terms)


_SAID = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _of_chunk(lang: str, terms: list[str], counters: pa.ListArray, sources: list[dict], kinds: int, top: int):
    """The rows of a chunk of leaves in UTF-8 order: a sum for each pair of sources, the best terms of each source."""
    names, totals = [s["source"] for s in sources], [s["n"] for s in sources]
    first = 1 if terms and terms[0] == "" else 0  # the root counts documents
    terms, counters = terms[first:], counters.slice(first)
    said = counters.flatten()
    at = np.repeat(np.arange(len(terms)), np.diff(np.asarray(counters.offsets)))
    count = np.zeros((len(names), len(terms)), np.int64)
    count[np.asarray(pc.index_in(said.field(0), pa.array(names, said.type.field(0).type))), at] = np.asarray(said.field(1))
    if terms:
        share = np.stack([_share(count[i], totals[i], kinds) for i in range(len(names))])
        whole = _share(count.sum(axis=0), sum(totals), kinds)
    for i, name in enumerate(names[:-1]):
        sums = _divergence(share[i], share[i + 1 :]).sum(axis=1) if terms else np.zeros(len(names) - i - 1, np.int64)
        yield _said(lang, name, "pair", names[i + 1 :], sums)
    for i, name in enumerate(names if terms else ()):
        at = np.flatnonzero((count[i] > 0) & (share[i] > whole))
        value = _divergence(share[i][at], whole[at])
        best = np.argsort(-value, kind="stable")[:top]
        yield _said(lang, name, "term", [terms[k] for k in at[best]], value[best])


def _said(lang: str, source: str, part: str, items: list[str], values: np.ndarray) -> pa.RecordBatch:
    n = len(items)
    return pa.RecordBatch.from_pydict({"lang": [lang] * n, "source": [source] * n, "part": [part] * n, "item": items, "value": values}, _SAID)
