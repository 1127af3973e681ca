import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import build_index, recall_of, top_k_exact, top_k_indexed

KIND = "vec_id bigint, embedding array<float>, v int, id string, block int"


def brute(queries, rows, k, itself=False):
    dim = max((len(v) for i, v in queries if ok(i, v)), default=0)
    rows = {(i, tuple(v)) for i, v in rows if ok(i, v) and len(v) == dim}
    out = set()
    for q, a in {(i, tuple(v)) for i, v in queries if ok(i, v) and len(v) == dim}:
        a = np.array(a, np.float32).astype(float)
        s = []
        for i, b in rows:
            b = np.array(b, np.float32).astype(float)
            s.append((-round(float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)), 6), i))
        s = sorted(x for x in s if itself or x[1] != q)[:k]
        out |= {(q, i, n + 1) for n, (_, i) in enumerate(s)}
    return out


def ok(i, v):
    return i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)


def made(n, dim=6, seed=3):
    r = random.Random(seed)
    return [(i, [r.randrange(-5, 6) + r.random() for _ in range(dim)]) for i in range(n)]


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "x", 2) for i, v in rows], KIND).repartition(3)


AWKWARD = [(900, None), (901, [0.0] * 6), (902, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (903, [float("nan")] * 6), (904, [float("inf")] * 6), (905, [1.0, 2.0]), (None, [1.0] * 6), (906, [])]


@pytest.mark.parametrize("rows,asked", [(50_000, 10_000), (17, 4)])
def test_exact_in_blocks(spark, rows, asked):
    data = made(120)
    data += [data[3], (200, data[5][1]), (201, data[5][1]), (202, [2.0 * x for x in data[5][1]]), *AWKWARD]
    queries = data[::10] + [data[5], (500, [1.0] * 6), *AWKWARD]
    got = {(r.query_id, r.id, r["rank"]) for r in top_k_exact(table(spark, queries), table(spark, data), "vec_id", "embedding", 4, rows=rows, asked=asked).collect()}
    assert got == brute(queries, data, 4)


def test_itself_and_few_rows(spark):
    data = made(3)
    got = {(r.query_id, r.id, r["rank"]) for r in top_k_exact(table(spark, data), table(spark, data), "vec_id", "embedding", 5, itself=True).collect()}
    assert got == brute(data, data, 5, True)
    empty = table(spark, data).limit(0)
    assert top_k_exact(empty, table(spark, data), "vec_id", "embedding", 5).count() == 0
    assert top_k_exact(table(spark, data), empty, "vec_id", "embedding", 5).count() == 0


def clustered(n, dim=16, groups=12, seed=1):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, dim))
    return [(i, [float(x) for x in centres[0 if i % 3 == 0 else i % groups] + r.normal(size=dim) * 0.4]) for i in range(n)]


def test_index_recall_pieces_and_whole_probe(spark):
    data = clustered(600)
    rows, asked = table(spark, [*data, data[0], *AWKWARD]), table(spark, data[::20])
    index = build_index(rows, "vec_id", "embedding", 10, bound=10)
    assert index.lists.count() == 600 and index.probes < len(index.centres)
    # longer lists are dealt into pieces
    assert index.sizes.agg(F.max("pieces")).first()[0] > 1
    exact = top_k_exact(asked, rows, "vec_id", "embedding", 10)
    assert recall_of(top_k_indexed(index, asked, "vec_id", "embedding", 10, asked=5), exact).first().recall >= 0.9
    key = lambda df: sorted((r.query_id, r["rank"], r.id) for r in df.collect())
    assert key(top_k_indexed(index, asked, "vec_id", "embedding", 10, probes=len(index.centres), asked=5)) == key(exact)
    index.free()


def test_index_fitted_on_a_sample(spark):
    data = clustered(800)
    index = build_index(table(spark, data), "vec_id", "embedding", 10, sample=200)
    assert index.lists.count() == 800 and len(index.centres) <= 40
    exact = top_k_exact(table(spark, data[::20]), table(spark, data), "vec_id", "embedding", 10)
    assert recall_of(top_k_indexed(index, table(spark, data[::20]), "vec_id", "embedding", 10), exact).first().recall >= 0.9


def test_index_of_nothing(spark):
    index = build_index(table(spark, made(1)).limit(0), "vec_id", "embedding", 3)
    assert top_k_indexed(index, table(spark, made(2)), "vec_id", "embedding", 3).count() == 0


def test_memory_of_a_task_is_bounded():
    """A full block against its queries, and rows against the most centres an index has."""
    import tracemalloc

    from siltstone.operators import similar

    r = np.random.default_rng(5)
    v, q = r.normal(size=(similar.ROWS, 4)), r.normal(size=(300, 4))
    centres = r.normal(size=(similar.SAMPLE // 8, 4))
    for work in (lambda: similar._best(np.arange(300), q, np.arange(len(v)), v, 10, True), lambda: similar._cells(v[:4096], centres, 1), lambda: similar._cells(v[:4096], centres, 100)):
        tracemalloc.start()
        work()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 32 << 20
