"""As-of, range, size-checked and salted joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Largest estimated size of a side that is broadcast.
BROADCAST_BYTES = 64 << 20
#: Rows of a side of an overlap join's cell that meet the other side's in one task.
CELL_ROWS = 1 << 13


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of df, from the files that it reads."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its estimated size is within the limit, else as it is."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, values: list[str], strict: bool = False) -> DataFrame:
    """Each left row with `values` of the latest right row of its group at or before its time (before, if strict).

    A union of both sides in one window per group replaces the join on an inequality, so the
    cost is one shuffle and sort. Of right rows with equal times the one with the greatest
    values counts. Left rows without a match keep nulls; null times match nothing.
    """
    side = F.lit(0 if strict else 1)
    tagged = left.select("*", F.struct(*[F.lit(None).cast(right.schema[v].dataType).alias(v) for v in values]).alias("_r"), F.lit(False).alias("_is"), F.col(left_time).alias("_t"), side.alias("_side"))
    names = left.columns
    other = right.filter(F.col(right_time).isNotNull()).select(
        *[F.col(c) if c in by else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in names],
        F.struct(*[F.col(v) for v in values]).alias("_r"), F.lit(True).alias("_is"), F.col(right_time).alias("_t"), F.lit(1 if strict else 0).alias("_side"),
    )
    order = Window.partitionBy(*by).orderBy("_t", "_side", "_r").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("_is"), F.col("_r")), ignorenulls=True).over(order)
    rows = tagged.unionByName(other).withColumn("_m", F.when(F.col("_t").isNotNull(), last)).filter(~F.col("_is"))
    return rows.select(*names, *[F.col("_m")[v].alias(v) for v in values])


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float, extra: Column | None = None) -> DataFrame:
    """Pairs with low <= point < high, by bins of `width`.

    A range goes to each bin that it covers, a point to its own, and the bins are joined by
    equality with the inequality behind. `width` near the usual length of a range keeps the
    copies few; any width gives the same result.
    """
    a = points.withColumn("_bin", F.floor(F.col(point) / width))
    last = F.floor(F.col(high) / width)
    b = ranges.filter(F.col(high) > F.col(low)).withColumn("_rbin", F.explode(F.sequence(F.floor(F.col(low) / width), last)))
    on = (a["_bin"] == b["_rbin"]) & (a[point] >= b[low]) & (a[point] < b[high])
    if extra is not None:
        on = on & extra
    return a.join(b, on).drop("_bin", "_rbin")


def salted_join(left: DataFrame, right: DataFrame, on: list[str], salts: int = 16, how: str = "inner") -> DataFrame:
    """Equi-join whose hot keys on the left are spread over `salts` tasks; the right side is repeated as often."""
    a = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)))
    b = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    return a.join(b, [*on, "_salt"], how).drop("_salt")


def overlap_join(left: DataFrame, right: DataFrame, left_ends: tuple[str, str], right_ends: tuple[str, str], by: list[str] = (), finest: float = 1.0, levels: int = 40, block: int = CELL_ROWS) -> DataFrame:
    """Pairs of intervals [low, high) that overlap, of very different lengths: columns of both sides, whose names must differ.

    Bins form a hierarchy: those of a level are twice as wide as those of the one before, from `finest` on. An interval
    belongs to the level whose bins are at least as wide as itself, so it touches two of them at most, and meets the other
    side's intervals of that level and of all wider ones by equality of bins. Copies grow with the number of levels that
    occur on the other side, never with lengths. A pair is found in the bin of the greater of its two lows, on the coarser
    of its two levels, so exactly once; the kind of a copy keeps apart intervals that both are there from finer levels. A cell
    (level, kind, bin) with more than `block` rows of a side is dealt into pieces of about `block`, each pair of which meets in
    a task of its own. Empty intervals and null ends match nothing; intervals wider than the last level's bins are all met on
    one level more, in one bin. `by` are columns of both sides that must be equal; the right side's are dropped.
    For cells of any size see ranged_overlap_join, which neither copies to levels nor repeats rows for pieces.
    """
    rows = []
    for side, (low, high), tag in ((left, left_ends, "l"), (right, right_ends, "r")):
        width = F.col(high) - F.col(low)
        level = F.least(F.lit(levels), F.greatest(F.lit(0), F.ceil(F.log2(width / finest)))).cast("int")
        rows.append(side.filter(F.col(high) > F.col(low)).withColumn(f"_{tag}_level", level).withColumn(f"_{tag}_low", F.col(low).cast("double")).withColumn(f"_{tag}_high", F.col(high).cast("double")))
    # the levels that occur: at most levels + 1 numbers a side
    seen = [sorted(r[0] for r in side.select(f"_{tag}_level").distinct().collect()) for side, tag in zip(rows, "lr")]
    cell = ["_meet", "_kind", "_bin", *[f"_by_{i}" for i in range(len(by))]]

    def cells(side: DataFrame, tag: str, others: list[int]) -> DataFrame:
        # kind 0: the left interval is on its own level; kind 1: the right one only
        own, visiting = ((0,), 1) if tag == "l" else ((0, 1), 0)
        place = lambda at, kind: F.struct(at.alias("meet"), F.lit(kind).alias("kind"))
        level = F.col(f"_{tag}_level")
        met = F.array(*[place(level, kind) for kind in own])
        if others:
            met = F.concat(met, F.transform(F.filter(F.array(*[F.lit(x) for x in others]), lambda x: x > level), lambda x: place(x, visiting)))
        out = side.withColumn("_to", F.explode(met)).withColumns({"_meet": F.col("_to.meet"), "_kind": F.col("_to.kind")}).drop("_to")
        wide = F.lit(finest) * F.pow(F.lit(2.0), F.col("_meet"))
        first, last = F.floor(F.col(f"_{tag}_low") / wide), F.ceil(F.col(f"_{tag}_high") / wide) - 1
        one = F.col("_meet") >= levels
        out = out.withColumn("_bin", F.explode(F.when(one, F.array(F.lit(0).cast("bigint"))).otherwise(F.sequence(first, F.greatest(first, last)))))
        return out.withColumns({f"_by_{i}": F.col(c) for i, c in enumerate(by)}) if by else out

    a, b = cells(rows[0], "l", seen[1]), cells(rows[1], "r", seen[0])
    full = [x.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > block).select(*cell, F.ceil(F.col("_n") / block).alias(f"_{t}_pieces")) for x, t in ((a, "l"), (b, "r"))]
    # one row per `block` copies of a side at most
    hot = F.broadcast(full[0].join(full[1], cell, "full"))
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = []
    for x, t, o, names in ((a, "l", "r", left.columns), (b, "r", "l", right.columns)):
        pieces, copies = (F.coalesce(F.col(f"_{y}_pieces"), F.lit(1)) for y in (t, o))
        x = x.join(hot, cell, "left").withColumn(f"_{t}_piece", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in names]), pieces)).withColumn(f"_{o}_piece", F.explode(F.sequence(F.lit(0).cast("bigint"), copies - 1)))
        x = x.drop("_l_pieces", "_r_pieces", *(by if t == "r" else ()))
        # a number of partitions of our own: few bytes of a cell make very many pairs, so cells must not be put together by their size
        dealt.append(x.repartition(n, *cell, "_l_piece", "_r_piece"))
    wide = F.lit(finest) * F.pow(F.lit(2.0), F.col("_meet"))
    home = F.when(F.col("_meet") >= levels, F.lit(0)).otherwise(F.floor(F.greatest("_l_low", "_r_low") / wide))
    pairs = dealt[0].join(dealt[1], [*cell, "_l_piece", "_r_piece"]).filter((F.col("_bin") == home) & (F.col("_l_low") < F.col("_r_high")) & (F.col("_r_low") < F.col("_l_high")))
    return pairs.select(*[F.col(f"`{c}`") for c in left.columns], *[F.col(f"`{c}`") for c in right.columns if c not in by])
