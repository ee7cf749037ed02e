"""Replies are parsed once and their nodes counted without a list of events."""

import json

from pyspark.sql import functions as F

from tessergraph.operators import extraction


def entity(kind, name):
    return {"type": kind, "canonical_name": name, "properties": {}, "evidence_quote": "q", "confidence": 0.9}


def test_nodes_are_counted_by_sums_of_replies_that_are_parsed_once(spark):
    def said(*entities):
        return json.dumps({"entities": list(entities), "relationships": []})

    raws = [said(entity("Service", "a"), entity("Team", "t"), entity("Service", "a")), said(entity("Service", "a")), "{not json", '{"entities": []}', None, said()]
    rows = spark.createDataFrame([(f"ev-{i}", f"2024-01-0{9 - i} 00:00:00", r) for i, r in enumerate(raws)], "event_id string, created_at string, raw string")
    rows = rows.withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    parsed = extraction.parsed_replies(rows)
    assert {r["event_id"]: r["error_stage"] for r in parsed.collect()} == {"ev-0": None, "ev-1": None, "ev-2": "json", "ev-3": "schema", "ev-4": "json", "ev-5": None}
    good = parsed.where("error_stage IS NULL")
    counted = extraction.counted_nodes(good)
    listed = extraction.merged_nodes(good).select("node_id", "label", "id", "created_at", F.size("source_event_ids").cast("long").alias("n_events"))
    assert sorted(counted.collect()) == sorted(listed.collect())
    assert {r["node_id"]: r["n_events"] for r in counted.collect()} == {"Service:a": 2, "Team:t": 1}
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1 and "collect_" not in plan
