"""The sink of nodes writes the whole merge: events as a set, properties overlaid one by one, the first time."""

import json

from pyspark.sql import functions as F

import __spark_entry__
from tessergraph.operators import extraction
from tessergraph.sources.store import Store

SF = "/root/testdata/sf0.001"


def test_the_query_writes_nodes_with_their_events_and_properties(spark, monkeypatch):
    written, write = {}, Store.write

    def kept(self, name, *args, **more):
        version = write(self, name, *args, **more)
        written[name] = self.read(name)
        return version

    monkeypatch.setattr(Store, "write", kept)
    shown = __spark_entry__.queries()["sink_node_merge"](spark, SF)
    events = spark.read.parquet(f"{SF}/events.parquet").where("event_id % 7 > 1").select(F.concat(F.lit("ev-"), "event_id").alias("event"), "user_id", "event_type").collect()
    want = {("Service", f"svc-{e.user_id}", e.event) for e in events} | {("Team", f"team-{e.event_type}", e.event) for e in events}
    rows = written["node_rows"].where("kind = 'event'").collect()
    assert len(rows) == len(want) and {(r.label, r.key, r.name) for r in rows} == want
    nodes = {r.node_id: r for r in written["nodes"].collect()}
    assert all(n.props == {"tier": "1"} and n.canonical_name == n.id for n in nodes.values())
    assert {r.node_id: r.n_events for r in shown.collect()} == {k: n.n_events for k, n in nodes.items()}


def test_a_merge_adds_events_once_and_overlays_properties(spark, tmp_path):
    def entity(name, **props):
        return {"type": "Person", "canonical_name": name, "properties": props, "evidence_quote": "q", "confidence": 0.9}

    def parsed(*said):
        rows = [(e, f"2024-01-0{day} 00:00:00", json.dumps({"entities": entities, "relationships": []})) for e, day, entities in said]
        made = spark.createDataFrame(rows, "event_id string, created_at string, raw string").withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
        return extraction.parsed_replies(made)

    store = Store(spark, f"file://{tmp_path}/store")
    first = parsed(("ev-1", 2, [entity("Al Li", team="a", mail="x"), entity("@al li", team="b", id="no")]), ("ev-0", 1, [entity("al li", team="c", desk="1")]))
    extraction.sink_nodes(store, first).collect()
    extraction.sink_nodes(store, first).collect()
    (node,) = extraction.sink_nodes(store, parsed(("ev-2", 3, [entity("Al Li", mail="y")]))).collect()
    assert node.node_id == "Person:al-li" and node.n_events == 3 and str(node.created_at).startswith("2024-01-01")
    assert node.props == {"team": "b", "mail": "y", "desk": "1"} and node.canonical_name == "Al Li"
