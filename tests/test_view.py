"""The drawing of the resolved graph: ends meet nodes as numbers."""

import __spark_entry__

from tessergraph.operators import typed
from tessergraph.sources import tables

SF = "/root/testdata/sf0.001"


def test_ends_met_as_numbers_give_the_links_that_names_give(spark):
    near = tables.edges(spark, SF, within=tables.live_keys(spark, SF))
    want = typed.graph_view(tables.nodes(spark, SF), tables.edges(spark, SF))[1]
    have = typed.graph_view(tables.nodes(spark, SF), near, ends_live=True)[1]
    assert want.count() < tables.edges(spark, SF).where("edge_type != 'MERGE_INTO'").count()
    assert sorted(map(tuple, have.collect())) == sorted(map(tuple, want.collect()))
    plan = __spark_entry__.queries()["graph_view_resolved"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.split("\n") if "LeftSemi" in x and ("node_id" in x or "src#" in x or "dst#" in x)]
