import inspect

from siltstone.llm import queries


def test_only_queries_are_registered():
    named = queries.queries()
    assert [n.split("_")[0] for n in named] == [f"op{i}" for i in range(1, 14)]
    assert all(list(inspect.signature(f).parameters) == ["spark", "sf_dir"] for f in named.values())
    assert set(queries.oracle_sql()) <= set(named)
