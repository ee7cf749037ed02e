"""Live ingestion as a request and its response, cases of an evaluation run against a store, and a snapshot of the metrics."""

from __future__ import annotations

import datetime as dt
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessergraph.sources.schema import SOURCE_TYPES
from tessergraph.streaming import ingest
from tessergraph.streaming.ingest import Reconciler, revert_event

MOST_EXTERNAL_ID = 200


def checked(case: dict) -> tuple:
    """A request (source_type, content, created_at, and maybe source_external_id) as a row of an event; raises where it is unfit."""
    kind, content, at, key = (case.get(n) for n in ("source_type", "content", "created_at", "source_external_id"))
    if kind not in SOURCE_TYPES:
        raise ValueError(f"source_type must be one of {', '.join(SOURCE_TYPES)}")
    if not isinstance(content, str) or not ingest.LEAST_CONTENT <= len(content) <= ingest.MOST_CONTENT:
        raise ValueError(f"content must have {ingest.LEAST_CONTENT} to {ingest.MOST_CONTENT} characters")
    if not isinstance(at, dt.datetime):
        raise ValueError("created_at must be a time")
    if key is not None and not 0 < len(key) <= MOST_EXTERNAL_ID:
        raise ValueError(f"source_external_id must have 1 to {MOST_EXTERNAL_ID} characters")
    return None, kind, key, content, at


def respond(reconciler: Reconciler, event_id: str, deduplicated: bool = False) -> dict:
    """What an event's run did: stages, nodes, merges, edges and contradictions, told by provenance.

    A repeated event has the stored run's stages and cost, and no
    contradictions, whose number its run keeps.
    """
    graph = reconciler.graph
    ids = reconciler.store.spark.createDataFrame([(event_id,)], "event_id string")
    run = graph["ingestion_runs"].at(ids).first()
    if run is None:
        raise ValueError(f"event {event_id} has no run")
    nodes = graph["nodes"].at(graph["assertions"].at(ids).select("node_id"))
    held = nodes.select("node_id", "label", F.coalesce("canonical_name", "id").alias("display_name")).orderBy("node_id").collect()  # of one event
    own = reconciler.store.spark.createDataFrame([(r["node_id"],) for r in held], "loser string")
    batch = graph["merge_audit"].at(ids.select(F.lit(run["batch"]).alias("batch"))).select(F.explode(F.array("source_node_id", "target_node_id")).alias("loser")).distinct()
    merges = graph["merges"].at(batch.union(own).distinct())
    mine = {r["node_id"] for r in held}
    edges = graph["edges_of"].at(ids.withColumnRenamed("event_id", "source_event_id")).collect()
    said = [r for r in edges if r["edge_type"] == "CONTRADICTS"]
    confidence = {} if deduplicated or not said else {(r["src"], r["dst"]): r["confidence"] for r in graph["edges"].at(reconciler.store.spark.createDataFrame([(r["src"],) for r in said], "src string")).collect()}
    return {
        "event_id": event_id, "status": run["status"], "error": run["error"], "deduplicated": deduplicated,
        "stages_run": [s.asDict() for s in run["stages"]],
        "nodes_created": [r.asDict() for r in held],
        "nodes_merged": sorted(({"loser": r["loser"], "winner": r["winner"], "label": r["label"], "tier": r["tier"], "confidence": r["confidence"]} for r in merges.collect() if {r["loser"], r["winner"]} & mine), key=lambda m: (m["loser"], m["winner"])),
        "edges_created": sorted(({"type": r["edge_type"], "source": r["src"], "target": r["dst"]} for r in edges if r["edge_type"] != "CONTRADICTS"), key=str),
        "contradictions_detected": sorted(({"message": r["src"], "decision": r["dst"], "confidence": confidence.get((r["src"], r["dst"]))} for r in said), key=str) if not deduplicated else [],
        "contradictions_count": run["contradictions_count"], "cost_usd": run["cost_usd"],
    }


def ingest_event(reconciler: Reconciler, case: dict, force: bool = False) -> dict:
    """Stores and reconciles one event and says what came of it; a known key gives the stored run, unless ``force`` runs it again."""
    began = time.monotonic()
    batch = reconciler.store.spark.createDataFrame([checked(case)], ingest.EVENT_SCHEMA)
    key = reconciler.graph["event_keys"].at(ingest.prepared(batch)).first()
    done = key is not None and not reconciler.graph["ingestion_runs"].at(reconciler.store.spark.createDataFrame([(key["id"],)], "event_id string")).isEmpty()
    if done and force:
        reconciler.force([key["id"]])
    elif not done:
        reconciler(batch, time.time_ns() // 1_000_000)
        key = reconciler.graph["event_keys"].at(ingest.prepared(batch)).first()
    out = respond(reconciler, key["id"], deduplicated=done and not force)
    return out | {"duration_ms": 0.0 if out["deduplicated"] else round(1000 * (time.monotonic() - began), 1)}


def expected(response: dict, wanted: dict) -> list[str]:
    """What a response lacks of what a case expects: status, nodes, merges (loser, winner), edges (type, source, target) and contradictions (message, decision)."""
    faults = [] if response["status"] == wanted.get("status", "reconciled") else ["status"]
    there = {
        "nodes": {r["node_id"] for r in response["nodes_created"]}, "merges": {(r["loser"], r["winner"]) for r in response["nodes_merged"]},
        "edges": {(r["type"], r["source"], r["target"]) for r in response["edges_created"]}, "contradictions": {(r["message"], r["decision"]) for r in response["contradictions_detected"]},
    }
    for name, found in there.items():
        faults += [f"{name}: {x}" for x in wanted.get(name, ()) if (tuple(x) if isinstance(x, list) else x) not in found]
    return faults


def run_cases(reconciler: Reconciler, cases: list[dict]) -> DataFrame:
    """(name, ok, passed, faults, latency_ms, cost) of evaluation cases, each a request with a name and what it expects; each is reverted before the next."""
    rows = []
    for case in cases:
        try:
            response = ingest_event(reconciler, case)
        except ValueError as error:
            rows.append((case["name"], False, False, str(error), 0.0, 0.0))
            continue
        faults = expected(response, case.get("expected", {}))
        rows.append((case["name"], response["status"] != "failed", not faults, "; ".join(faults) or None, response["duration_ms"], float(response["cost_usd"])))
        if not response["deduplicated"]:
            revert_event(reconciler.store, response["event_id"])
    return reconciler.store.spark.createDataFrame(rows, "name string, ok boolean, passed boolean, faults string, latency_ms double, cost double")


def metrics_snapshot(metrics: DataFrame) -> DataFrame:
    """(name, tag, n, p50, p95, most, mean, total) over recorded metrics (name, tag, value): by stage, by status and overall; percentiles are interpolated."""
    overall = metrics.where("name IN ('ingestion', 'resolution')").withColumn("tag", F.lit("all"))
    return metrics.unionByName(overall).groupBy("name", "tag").agg(
        F.when(F.first("name") == "resolution", F.sum("value").cast("long")).otherwise(F.count("*")).alias("n"),
        F.round(F.percentile("value", 0.5), 1).alias("p50"), F.round(F.percentile("value", 0.95), 1).alias("p95"), F.round(F.max("value"), 1).alias("most"),
        F.round(F.avg("value"), 6).alias("mean"), F.round(F.sum("value"), 6).alias("total"),
    )
