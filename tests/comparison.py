"""Order-insensitive comparison of a Spark result with a DuckDB one."""

import math
from decimal import Decimal

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sql, folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return con.execute(sql).fetchdf()


def _text(x):
    if isinstance(x, (list, tuple, np.ndarray)):
        return "[" + ",".join(map(_text, x)) + "]"
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, (float, np.floating)) and math.isnan(x)):
        return "-"
    if isinstance(x, (bool, np.bool_)):
        return str(bool(x))
    if isinstance(x, (int, np.integer)):
        return str(int(x)) if abs(int(x)) >= 1 << 50 else f"{float(x):.9g}"
    if isinstance(x, (float, np.floating, Decimal)):
        return f"{float(x):.9g}"
    return str(x)


def rows(frame):
    names = sorted(frame.columns)
    return sorted("|".join(map(_text, r)) for r in frame[names].itertuples(index=False, name=None))


def assert_same(spark_frame, duck_frame):
    assert sorted(spark_frame.columns) == sorted(duck_frame.columns)
    a, b = rows(spark_frame), rows(duck_frame)
    assert len(a) == len(b)
    assert a == b
