from siltstone import catalog


def test_no_sketch_is_held_for_each_user(spark):
    """The sketch stands only in aggregates by event type: beside a distinct count it would be held for each pair (type, user)."""
    df = catalog.queries()["p25_approximate_distinct"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    held = [line for line in plan.splitlines() if "Aggregate(" in line and "approx_count_distinct" in line]
    assert held and not any("user_id" in line.split("functions=")[0] for line in held)
