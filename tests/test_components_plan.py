"""Tables of nodes do not pass through the driver."""

from __future__ import annotations

from wardlight.operators.components import _Attach


def test_nodes_are_not_broadcast(spark):
    steps = spark.range(50).selectExpr("id AS node", "id % 7 AS parent")
    joined = _Attach(None)(steps, steps.toDF("parent", "above"), "parent")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert joined.count() == 50
