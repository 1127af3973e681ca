"""Resharding by minimum-cost flow.

Method: the bytes of the old shards are supplies, the capacities of the new shards are
demands, a byte that stays costs nothing and a moved byte costs 1 (or what the caller's
cost table says). Successive shortest paths solve this small network (old + new shards; the
rows never enter it), which moves the fewest bytes possible. The flows are carried out in
units of rows: the rows of an old shard stand in one order, largest first, and each flow
takes the next stretch of it, so the cuts fall among the smallest rows and the sizes come
out near equal. Only shards that gain or lose rows are written again.

Scale: the order of the rows is by ranges with two-pass prefix sums (common.prefix_sums),
so an old shard with a third of all rows is spread over many tasks. The driver holds one
number per old shard and one per flow.

Defined cases: null text is empty (size 8). A null id is a row like any other. Repeated
rows each count. A null old shard counts as one more old shard, which has no place among the new ones. An
empty table gives an empty table.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, cut, not_null_text, prefix_sums


def min_cost_flow(supply: list[int], demand: list[int], cost) -> dict[tuple[int, int], int]:
    """Flows (i, j) -> amount, all supply sent, at the least total cost(i, j); sum(supply) <= sum(demand).

    Successive shortest paths with potentials; costs are not negative.
    """
    n, m = len(supply), len(demand)
    source, sink, graph = n + m, n + m + 1, [[] for _ in range(n + m + 2)]

    def edge(a, b, room, price):
        graph[a].append([b, room, price, len(graph[b])])
        graph[b].append([a, 0, -price, len(graph[a]) - 1])

    for i, s in enumerate(supply):
        edge(source, i, s, 0)
        for j in range(m):
            edge(i, n + j, s, cost(i, j))
    for j, d in enumerate(demand):
        edge(n + j, sink, d, 0)
    level, left = [0] * len(graph), sum(supply)
    while left:
        far, came, heap = {source: 0}, {}, [(0, source)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > far.get(a, d):
                continue
            for k, (b, room, price, _) in enumerate(graph[a]):
                to = d + price + level[a] - level[b]
                if room and to < far.get(b, to + 1):
                    far[b], came[b] = to, (a, k)
                    heapq.heappush(heap, (to, b))
        if sink not in far:
            raise ValueError("the capacities are smaller than the supply")
        worst = far[sink]
        level = [x + min(far.get(a, worst), worst) for a, x in enumerate(level)]
        at, push = sink, left
        while at != source:
            a, k = came[at]
            push, at = min(push, graph[a][k][1]), a
        at = sink
        while at != source:
            a, k = came[at]
            graph[a][k][1] -= push
            graph[at][graph[a][k][3]][1] += push
            at = a
        left -= push
    return {(i, e[0] - n): supply[i] - e[1] for i in range(n) for e in graph[i] if n <= e[0] < n + m and e[1] < supply[i]}


def equal_capacities(total: int, n: int) -> list[int]:
    """n capacities that sum to total and differ by one at most."""
    return [total // n + (j < total % n) for j in range(n)]


def reshard(docs: DataFrame, old_shard, n_new: int, id_col: str = "doc_id", text_col: str = "text", capacities: list[int] | None = None, cost=None) -> DataFrame:
    """One row per input row: id, size, text_crc32, old_shard, shard, slot.

    old_shard: a Column with the present shard (int; shard i stays shard i). capacities: bytes
    of each new shard, equal ones by default. cost(i, j): per byte moved from old shard i to j.
    """
    spark = docs.sparkSession
    text = not_null_text(text_col)
    rows = docs.select(F.col(id_col).alias("_sl_id"), (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.coalesce(old_shard.cast("int"), F.lit(-1)).alias("old_shard"))
    rows = prefix_sums(rows.withColumn("_sl_less", -F.col("size")), ["old_shard", "_sl_less", "_sl_id", "text_crc32"], "size", "_sl_off", "_sl_row")
    rows = cut(rows)
    old = sorted((r[0], r[1], r[2]) for r in rows.groupBy("old_shard").agg(F.sum("size"), F.min("_sl_off")).collect())
    total = sum(r[1] for r in old)
    room = capacities or equal_capacities(total, n_new)
    names = [r[0] for r in old]
    price = cost or (lambda i, j: 0 if i == j else 1)
    flows = min_cost_flow([r[1] for r in old], room, lambda i, j: price(names[i], j))
    plan = []
    for i, (name, size, first) in enumerate(old):
        at = first
        for j in sorted((j for k, j in flows if k == i), key=lambda j: (price(name, j), j)):
            plan.append((name, j, at, at + flows[i, j]))
            at += flows[i, j]
    # one row per flow, at most old + new shards of them
    held = F.broadcast(spark.createDataFrame(plan, "_sl_old int, shard int, _sl_a bigint, _sl_b bigint"))
    middle = F.col("_sl_off") + F.expr("size div 2")
    moved = rows.join(held, (F.col("old_shard") == F.col("_sl_old")) & (middle >= F.col("_sl_a")) & (middle < F.col("_sl_b")))
    moved = moved.select("_sl_id", "size", "text_crc32", "old_shard", "shard", "_sl_off", F.lit(1).cast("bigint").alias("_sl_one"))
    placed = cut(prefix_sums(moved, ["shard", "_sl_off"], "_sl_one", "_sl_at", "_sl_key"))
    first = F.broadcast(placed.groupBy("shard").agg(F.min("_sl_at").alias("_sl_first")))  # one row per new shard
    return placed.join(first, "shard").select(F.col("_sl_id").alias(id_col), "size", "text_crc32", F.when(F.col("old_shard") >= 0, F.col("old_shard")).alias("old_shard"), "shard", (F.col("_sl_at") - F.col("_sl_first")).alias("slot"))


def affected_shards(placed: DataFrame) -> list[int]:
    """New shards whose files change: they gain rows, or the old shard of their number loses some."""
    moves = placed.filter(~F.col("old_shard").eqNullSafe(F.col("shard"))).select("old_shard", "shard").distinct().collect()
    return sorted({r[1] for r in moves} | {r[0] for r in moves if r[0] is not None})


def rewrite(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id") -> list[int]:
    """Write the affected shards of docs below path (shard=N folders), others untouched; returns them. Ids must be unique."""
    changed = affected_shards(placed)
    where = placed.select(F.col(id_col).alias("_sl_key"), "shard").filter(F.col("shard").isin(changed))
    out = docs.drop("shard").join(where, docs[id_col].eqNullSafe(where["_sl_key"])).drop("_sl_key")
    spark = docs.sparkSession
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        out.write.mode("overwrite").partitionBy("shard").parquet(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)
    return changed


def old_layout(id_col: str, n_old: int):
    """The layout that the query moves away from: crc32 of the id, modulo the number of old shards."""
    return crc_bucket(F.col(id_col), n_old).cast("int")
