"""Tables in the shared folder."""

from loomgraph.sources.shared import BROADCAST_BYTES, materialize


def test_a_large_table_in_a_small_file_is_not_broadcast(spark):
    n = 400_000
    rows = spark.range(n).selectExpr("1 AS g", "id % 3 AS center", "id DIV 1000 AS leaf", "id % 7 AS x")
    held = materialize(rows.repartition(1).sortWithinPartitions("center", "x", "leaf"), "many")
    met = spark.range(2 * n).selectExpr("1 AS g", "id % 3 AS center", "id DIV 1000 AS leaf").join(held, ["g", "center", "leaf"], "left_semi")
    assert n * 8 * 4 > BROADCAST_BYTES
    assert "BroadcastHashJoin" not in met._jdf.queryExecution().executedPlan().toString()


def test_a_small_table_may_be_broadcast(spark):
    held = materialize(spark.range(100).selectExpr("id", "id % 3 AS k"), "few")
    assert "BroadcastHashJoin" in spark.range(10_000_000).join(held, "id")._jdf.queryExecution().executedPlan().toString()
