"""Most similar vectors: exactly, a query set against all rows in blocks, and by an index of bounded lists."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.storage import cut, free

#: Rows and queries that meet in one task; entries of a matrix of similarities held at a time.
ROWS, QUERIES, CELLS = 50_000, 10_000, 1 << 19
#: About how many vectors an index is fitted on; decimals of a similarity, beyond which ids settle ties.
SAMPLE, DECIMALS = 20_000, 6

_PAIRS = "query_id bigint, id bigint, similarity double"


def _clean(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of rows that can be compared, exact repeats once."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    usable = F.col(id_col).isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)
    return df.filter(usable).select(F.col(id_col).cast("bigint").alias("id"), v.alias("v")).dropDuplicates(["id", "v"])


def _units(column) -> np.ndarray:
    """An Arrow column of lists of one length as rows of length 1."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.array(column.flatten(), dtype=np.float64)
    all_ = flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))
    for i in range(0, len(all_), 4096):
        rows = all_[i : i + 4096]
        rows /= np.abs(rows).max(axis=1, keepdims=True, initial=1e-300)  # so that no square overflows or vanishes
        rows /= np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return all_


def _best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int, itself: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, similarity) of each query's k best rows, ties to smaller ids."""
    found = []
    step = max(1, CELLS // max(1, len(ids)))
    for i in range(0, len(q_ids), step):
        s = q[i : i + step] @ v.T
        np.round(s, DECIMALS, out=s)
        s += 0.0
        if not itself:
            s[q_ids[i : i + step, None] == ids[None, :]] = -np.inf
        least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None] if s.shape[1] > k else -2.0
        at, hit = np.nonzero((s >= least) & (s > -np.inf))
        order = np.lexsort((ids[hit], -s[at, hit], at))
        at, hit = at[order], hit[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        at, hit = at[place < k], hit[place < k]
        found.append((q_ids[i + at], ids[hit], s[at, hit]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _meet(queries: DataFrame, vectors: DataFrame, keys: list[str], k: int, itself: bool) -> DataFrame:
    """The k best rows of each query among those that share a key with it: query_id, id, similarity, rank."""

    def run(some: pa.Table, rows: pa.Table) -> pa.Table:
        if not some.num_rows or not rows.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64())})
        q, i, s = _best(np.asarray(some["id"]), _units(some["v"]), np.asarray(rows["id"]), _units(rows["v"]), k, itself)
        return pa.table({"query_id": pa.array(q, pa.int64()), "id": pa.array(i, pa.int64()), "similarity": pa.array(s, pa.float64())})

    pairs = queries.groupBy(*keys).cogroup(vectors.groupBy(*keys)).applyInArrow(run, _PAIRS)
    # k rows a query from each task that it met; all but k go before the shuffle
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k)


def _dealt(df: DataFrame, pieces, name: str) -> DataFrame:
    return df.withColumn(name, F.pmod(F.xxhash64("id", "v"), pieces))


def _copied(df: DataFrame, pieces, name: str) -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(F.lit(0).cast("bigint"), pieces - 1)))


def _one_length(queries: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    longest = queries.agg(F.max(F.size("v"))).first()[0]
    return tuple(x.filter(F.size("v") == (longest or 0)) for x in (queries, vectors))


def top_k_exact(queries: DataFrame, vectors: DataFrame, id_col: str, vector_col: str, k: int, itself: bool = False, rows: int = ROWS, asked: int = QUERIES) -> DataFrame:
    """Each query's k most similar vectors by cosine, against all rows: query_id, id, similarity (6 decimals), rank.

    Rows are dealt into blocks of about `rows`, queries into blocks of about `asked`; each pair of blocks meets in one
    task, which sends k rows a query. Ids are integers; ties go to the smaller one. itself: whether a query may find
    its own id. Vectors with a null, an infinite or NaN element, all zeros, null, or of another length than the longest
    query take no part, nor do null ids; a query without partners has no rows. Rows repeated whole count once; an id with
    several vectors can be found by each.
    """
    some, all_ = _one_length(_clean(queries, id_col, vector_col), _clean(vectors, id_col, vector_col))
    blocks = F.lit(max(1, -(-vectors.count() // rows)))
    chunks = F.lit(max(1, -(-queries.count() // asked)))
    left = _copied(_dealt(some, chunks, "chunk"), blocks, "block")
    right = _copied(_dealt(all_, blocks, "block"), chunks, "chunk")
    return _meet(left, right, ["block", "chunk"], k, itself)


def _centres(sample: np.ndarray, n: int, rounds: int = 10) -> np.ndarray:
    """n directions by k-means on rows of length 1; the first ones are spread over the sample."""
    centres = sample[np.linspace(0, len(sample) - 1, n).astype(int)]
    for _ in range(rounds):
        nearest = np.concatenate([np.argmax(sample[i : i + 4096] @ centres.T, axis=1) for i in range(0, len(sample), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(size > 0, sums / np.where(size > 0, size, 1), centres)
    return centres


def _cells(v: np.ndarray, centres: np.ndarray, probes: int) -> np.ndarray:
    """The nearest `probes` centres of each row, nearest first."""
    out, step = [], max(1, CELLS // len(centres))
    for i in range(0, len(v), step):
        s = v[i : i + step] @ centres.T
        # a copy, for a view would hold all centres of each row
        out.append(np.argmax(s, axis=1)[:, None] if probes == 1 else np.argsort(-s, axis=1, kind="stable")[:, :probes].copy())
    return np.concatenate(out) if out else np.empty((0, probes), np.int64)


class Index(NamedTuple):
    """Lists of vectors by nearest centre (cell, piece, id, v), the centres, probes that reach the recall asked for, rows in all."""

    lists: DataFrame
    sizes: DataFrame
    centres: np.ndarray
    probes: int

    def free(self) -> None:
        free(self.lists, self.sizes)


def _in_cells(df: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    def run(batches):
        for b in batches:
            # copies of vectors: about 4,096 at a time, whatever the probes
            step = max(1, 4096 // probes)
            for i in range(0, b.num_rows, 4096):
                near = _cells(_units(b.slice(i, 4096).column("v")), centres, probes).astype(np.int64, copy=False)
                for j in range(0, len(near), step):
                    some = near[j : j + step]
                    taken = b.take(pa.array(np.repeat(np.arange(i + j, i + j + len(some)), some.shape[1])))
                    yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(some.ravel())], names=["id", "v", "cell"])

    return df.mapInArrow(run, f"id bigint, v {df.schema['v'].dataType.simpleString()}, cell bigint")


def build_index(vectors: DataFrame, id_col: str, vector_col: str, k: int, recall: float = 0.95, sample: int = SAMPLE, bound: int = ROWS) -> Index:
    """An index of all vectors for top_k_indexed.

    Centres come from k-means on about `sample` vectors picked by hash, the only rows that reach the driver; there are as
    many as the root of the number of rows, one to eight sampled vectors at most. Probes are the fewest that give the recall
    asked for among the sampled vectors, up to all lists. Every vector is indexed. A list longer than `bound` is dealt into
    pieces; a query that probes it meets all of them, so nothing is left out and no task holds more than a piece.
    Rows as in top_k_exact; the length is the longest one.
    """
    clean = cut(_clean(vectors, id_col, vector_col))
    total, longest = clean.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    rows = clean.filter(F.size("v") == (longest or 0))
    share = sample / max(total, 1)
    picked = rows if share >= 1 else rows.filter(F.pmod(F.xxhash64("v", "id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    # about `sample` vectors
    fitted = _units(picked.orderBy("id", "v").select("v").toArrow()["v"])
    if not len(fitted):
        fitted = np.eye(1, max(longest or 1, 1))
    centres = _centres(fitted, max(1, min(round(max(total, 1) ** 0.5), len(fitted) // 8)))
    probes = _probes(fitted, centres, k, recall)
    placed = cut(_in_cells(rows, centres, 1))
    sizes = cut(placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / bound).alias("pieces")))
    # one row a centre
    lists = cut(_dealt(placed.join(F.broadcast(sizes), "cell"), F.col("pieces"), "piece").drop("pieces"))
    free(clean, placed)
    return Index(lists, sizes, centres, probes)


def _probes(sample: np.ndarray, centres: np.ndarray, k: int, recall: float, asked: int = 500) -> int:
    """The fewest probes that find `recall` of the k nearest sampled vectors of `asked` sampled ones."""
    at = np.linspace(0, len(sample) - 1, min(asked, len(sample))).astype(int)
    k = min(k, len(sample) - 1)
    if k < 1 or len(centres) == 1:
        return 1
    s = sample[at] @ sample.T
    s[np.arange(len(at)), at] = -np.inf
    true = np.argpartition(-s, k - 1, axis=1)[:, :k]
    home = _cells(sample, centres, 1)[:, 0]
    order = _cells(sample[at], centres, len(centres))
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centres))[None, :], axis=1)
    needed = np.sort(np.take_along_axis(place, home[true], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1


def top_k_indexed(index: Index, queries: DataFrame, id_col: str, vector_col: str, k: int, itself: bool = False, probes: int | None = None, asked: int = QUERIES) -> DataFrame:
    """Each query's k most similar vectors among the lists of its nearest centres: columns as top_k_exact.

    Queries of a list that very many probe are dealt into chunks of about `asked`. With as many probes as there are
    centres the result is exact.
    """
    some = _clean(queries, id_col, vector_col).filter(F.size("v") == index.centres.shape[1])
    probed = cut(_in_cells(some, index.centres, min(probes or index.probes, len(index.centres))))
    chunks = cut(probed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / asked).alias("chunks")))
    # both have one row a centre
    left = _dealt(probed.join(F.broadcast(chunks), "cell"), F.col("chunks"), "chunk").drop("chunks").join(F.broadcast(index.sizes), "cell")
    repeats = chunks.select(F.col("cell").alias("of"), F.col("chunks").alias("copies"))
    right = _copied(index.lists.join(F.broadcast(repeats), F.col("cell") == F.col("of")).drop("of"), F.col("copies"), "chunk").drop("copies")
    return _meet(_copied(left, F.col("pieces"), "piece").drop("pieces"), right, ["cell", "piece", "chunk"], k, itself)


def recall_of(found: DataFrame, true: DataFrame) -> DataFrame:
    """One row: queries, pairs (of the truth), recall (share of them that was found)."""
    hits = true.select("query_id", "id").join(found.select("query_id", "id").withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    return hits.agg(F.count_distinct("query_id").alias("queries"), F.count(F.lit(1)).alias("pairs"), (F.count("hit") / F.count(F.lit(1))).alias("recall"))
