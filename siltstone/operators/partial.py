"""Aggregates of one's own in two phases: states of each task first, merged after the shuffle."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame


def two_phase(df: DataFrame, by: list[str], partial: Callable[[pd.DataFrame], pd.DataFrame], merge: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """One row per key with its state: the columns of `schema`, which begin with those of `by`.

    partial makes a row of state per key from rows; merge makes one per key from rows of state, and must give the
    same in any order and grouping. Before the shuffle a task holds and sends a row per key, however many rows
    a key has, so a hot key is merged from one row a task. Null keys are a key.
    """

    def merged(frame: pd.DataFrame) -> pd.DataFrame:
        out = merge(frame)
        for c in by:  # grouping makes NaN of null keys
            if out[c].isna().any():
                out[c] = pd.Series([None if pd.isna(v) else v for v in out[c]], index=out.index, dtype=object)
        return out

    def states(frames):
        held: list[pd.DataFrame] = []
        for frame in frames:
            held.append(partial(frame))
            if len(held) > 8:
                held = [merged(pd.concat(held, ignore_index=True))]
        if held:
            yield merged(pd.concat(held, ignore_index=True))

    return df.mapInPandas(states, schema).groupBy(*by).applyInPandas(merged, schema)


def moments(by: list[str], x: str, y: str):
    """partial, merge and the columns of n, means, co-moment and second moments of two numbers; rows with a null in either count for nothing."""
    names = ["n", "mx", "my", "cxy", "cxx", "cyy"]

    def partial(frame: pd.DataFrame) -> pd.DataFrame:
        f = frame.dropna(subset=[x, y])
        g = f.groupby(by, dropna=False)
        n, mx, my = g[x].size(), g[x].mean(), g[y].mean()
        dx, dy = f[x] - g[x].transform("mean"), f[y] - g[y].transform("mean")
        keys = [f[c] for c in by]
        sums = {k: v.groupby(keys, dropna=False).sum() for k, v in (("cxy", dx * dy), ("cxx", dx * dx), ("cyy", dy * dy))}
        return pd.DataFrame({"n": n, "mx": mx, "my": my, **sums}).reset_index()[[*by, *names]]

    def merge(states: pd.DataFrame) -> pd.DataFrame:
        s = states.copy()
        s["sx"], s["sy"] = s["n"] * s["mx"], s["n"] * s["my"]
        g = s.groupby(by, dropna=False)
        n = g["n"].transform("sum")
        # of each part: its means against the means of all
        dx, dy = s["mx"] - g["sx"].transform("sum") / n, s["my"] - g["sy"].transform("sum") / n
        s["cxy"], s["cxx"], s["cyy"] = s["cxy"] + s["n"] * dx * dy, s["cxx"] + s["n"] * dx * dx, s["cyy"] + s["n"] * dy * dy
        out = s.groupby(by, dropna=False)[["n", "sx", "sy", "cxy", "cxx", "cyy"]].sum().reset_index()
        out["mx"], out["my"] = out["sx"] / out["n"], out["sy"] / out["n"]
        return out[[*by, *names]]

    return partial, merge, ", ".join(f"{c} {'long' if c == 'n' else 'double'}" for c in names)
