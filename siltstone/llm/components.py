"""Connected components of a graph given as a table of links."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.storage import free

from .common import cut


def _forest(batches):
    """A spanning forest of the links of one partition, as (larger id, smallest id of its tree).

    Vectorised pointer jumping: roots hook to the smaller neighbour root until nothing moves.
    """
    a, b = [], []
    for x in batches:
        a.append(np.asarray(x.column(0)))
        b.append(np.asarray(x.column(1)))
    if not a:
        return
    ids, at = np.unique(np.concatenate(a + b), return_inverse=True)
    n = len(at) // 2
    x, y = at[:n], at[n:]
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[x], root[y])
        after = root.copy()
        np.minimum.at(after, root[x], low)
        np.minimum.at(after, root[y], low)
        while True:
            jumped = after[after]
            if (jumped == after).all():
                break
            after = jumped
        if (after == root).all():
            break
        root = after
    moved = np.flatnonzero(root != np.arange(len(ids)))
    for i in range(0, len(moved), 100_000):
        part = moved[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(ids[part]), pa.array(ids[root[part]])], names=["a", "b"])


def components(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(id, component) for every id of links(a, b), component the smallest id reachable.

    Each partition first replaces its links by a spanning forest, so a dense group leaves one
    link per member. Then large-star and small-star rounds: every id is joined to the
    smallest neighbour of its neighbourhood, until the links are stars. A round costs two
    aggregations; the number of rounds grows with the logarithm of the longest path. Nothing
    is collected but one figure a round. Links with a null end are ignored.
    """
    links = links.select(F.col("a").cast("bigint"), F.col("b").cast("bigint")).filter("a is not null and b is not null and a <> b")
    star, before = cut(links.mapInArrow(_forest, "a bigint, b bigint").distinct()), None
    for _ in range(most_rounds):
        both = star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: larger neighbours of each id go to the smallest; small star: the id and its smaller neighbours do
        near = both.join(low, "a")
        after = near.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = near.filter("b < a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        after = cut(after.unionByName(small).filter("a <> b").distinct())
        free(star)
        # a round that changes nothing leaves stars: both kinds of step keep only those as they are
        now = tuple(after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.bit_xor(F.xxhash64("b", "a"))).first())
        star = after
        if now == before or not now[0]:
            break
        before = now
    else:
        raise RuntimeError("components: too many rounds")
    return star.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(star.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
