"""Keys of growing tables meet edges by shuffles, whatever the files' sizes say: none goes through the driver."""

import __spark_entry__

SF = "/root/testdata/sf0.001"


def test_only_teams_are_broadcast_in_the_resolved_view(spark):
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        plan = __spark_entry__.queries()["graph_view_resolved"](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    joins = [x for x in plan.split("\n") if "HashJoin" in x or "SortMergeJoin" in x]
    assert len(joins) > 10
    assert len([x for x in joins if "BroadcastHashJoin" in x]) == 2  # services and people with their teams
