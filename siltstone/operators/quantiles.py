"""Exact quantiles by selection: histograms narrow the bin that holds the rank, and nothing is gathered by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.storage import cut, free

from .joins import broadcast_if_small

#: Bins of a pass.
BINS = 512


def exact_quantiles(df: DataFrame, by: list[str], value: Column | str, quantiles: dict[str, float], bins: int = BINS) -> DataFrame:
    """One row per key with the interpolated quantiles of a number: {name: fraction}, as quantile_cont gives them.

    Every quantile lies between the values of two ranks. A pass counts, for each rank still sought, the values of
    its interval by bins of equal width, with the least and greatest value in each bin; the bin that holds the rank
    is the next interval, until that is one value. A task sends a row per key, rank and bin whatever the number of
    its rows, and passes shrink the interval by `bins`, faster where values are sparse. Null and NaN count for
    nothing; a key without values has null quantiles. Keys compare null-safe.
    """
    keys = [f"_sl_k{i}" for i in range(len(by))]
    column = F.col(value) if isinstance(value, str) else value
    rows = df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(by, keys)], column.cast("double").alias("_sl_x"))
    values = cut(rows.withColumn("_sl_x", F.when(~F.isnan("_sl_x"), F.col("_sl_x"))))
    ends = values.groupBy(*keys).agg(F.count("_sl_x").alias("_sl_n"), F.min("_sl_x").alias("_sl_lo"), F.max("_sl_x").alias("_sl_hi"))
    asked = F.array(*[F.struct(F.lit(i).alias("q"), F.lit(float(q)).alias("f")) for i, q in enumerate(quantiles.values())])
    # two ranks for each quantile: below and above its place
    state = (
        ends.withColumn("_sl_a", F.explode(asked)).withColumn("_sl_q", F.col("_sl_a.q")).withColumn("_sl_place", F.col("_sl_a.f") * (F.col("_sl_n") - 1)).withColumn("_sl_side", F.explode(F.array(F.lit(0), F.lit(1))))
        .withColumn("_sl_rank", F.when(F.col("_sl_n") > 0, F.least(F.floor("_sl_place") + F.col("_sl_side"), F.col("_sl_n") - 1)))
        .withColumn("_sl_below", F.lit(0).cast("bigint"))
    )
    names = [*keys, "_sl_q", "_sl_side"]
    state = cut(state.select(*names, "_sl_place", "_sl_rank", "_sl_below", "_sl_lo", "_sl_hi"))
    while not (seeking := state.filter("_sl_lo < _sl_hi")).isEmpty():
        sought = seeking.select(*[F.col(c).alias(f"{c}_s") for c in names], "_sl_rank", "_sl_below", "_sl_lo", "_sl_hi", "_sl_place")
        # one sorted list of intervals a key would do; ranks are few, so each interval joins by itself
        on = F.col("_sl_x").between(F.col("_sl_lo"), F.col("_sl_hi"))
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"{k}_s"))
        # halves first: the width of the whole range of doubles would overflow
        share = (F.col("_sl_x") / 2 - F.col("_sl_lo") / 2) / (F.col("_sl_hi") / 2 - F.col("_sl_lo") / 2)
        met = values.join(broadcast_if_small(sought), on).withColumn("_sl_bin", F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(share * bins))))
        group = [F.col(f"{c}_s").alias(c) for c in names]
        counts = met.groupBy(*group, "_sl_rank", "_sl_below", "_sl_place", "_sl_bin").agg(F.count(F.lit(1)).alias("_sl_c"), F.min("_sl_x").alias("_sl_lo"), F.max("_sl_x").alias("_sl_hi"))
        upto = Window.partitionBy(*names).orderBy("_sl_bin").rowsBetween(Window.unboundedPreceding, 0)  # `bins` rows at most
        summed = counts.withColumn("_sl_to", F.col("_sl_below") + F.sum("_sl_c").over(upto))
        held = summed.filter((F.col("_sl_rank") < F.col("_sl_to")) & (F.col("_sl_rank") >= F.col("_sl_to") - F.col("_sl_c")))
        narrowed = held.select(*names, "_sl_place", "_sl_rank", (F.col("_sl_to") - F.col("_sl_c")).alias("_sl_below"), "_sl_lo", "_sl_hi")
        before, state = state, cut(narrowed.unionByName(state.filter("not coalesce(_sl_lo < _sl_hi, false)")))
        free(before)
    low = F.max(F.when(F.col("_sl_side") == 0, F.col("_sl_lo")))
    high = F.max(F.when(F.col("_sl_side") == 1, F.col("_sl_lo")))
    at = F.max("_sl_place") - F.floor(F.max("_sl_place"))
    found = state.groupBy(*keys, "_sl_q").agg((low + (high - low) * at).alias("_sl_v"))
    out = [F.max(F.when(F.col("_sl_q") == i, F.col("_sl_v"))).alias(name) for i, name in enumerate(quantiles)]
    result = cut(found.groupBy(*keys).agg(*out)) if keys else cut(found.agg(*out))
    free(values, state)
    return result.withColumnsRenamed(dict(zip(keys, by)))
