import os

import pytest
from comparison import assert_same, duck

from siltstone import catalog

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", QUERIES)
def test_query_agrees_with_oracle(spark, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    if name in ORACLES:
        assert_same(got, duck(ORACLES[name], FOLDER))
    else:
        assert len(got) > 0


def test_every_capability_has_a_query():
    have = {n.split("_")[0] for n in QUERIES}
    assert {f"p{i:02d}" for i in range(1, 56)} <= have


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
