"""From extractor replies to nodes and edges: strict parsing, merging by key, scopes, reverts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessergraph.functions.exprs import ENDPOINTS, LABELS
from tessergraph.functions.text import key_value, safe_properties, without_fences
from tessergraph.sources.store import Store

ENTITY = "struct<type:string,canonical_name:string,properties:map<string,string>,evidence_quote:string,confidence:double>"
RELATION = "struct<type:string,source_canonical_name:string,target_canonical_name:string,evidence_quote:string,confidence:double>"
EXTRACTABLE = tuple(x for x in LABELS if x != "Message")


def parsed_replies(replies: DataFrame, raw: str = "raw") -> DataFrame:
    """entities, relationships and error_stage (json, schema, or null) of each reply; nothing of a reply in error is kept."""
    # Each reply is parsed once: generators stand between, since what is used in several columns or filters would be copied into each.
    told = replies.withColumn("_t", F.explode(F.array(without_fences(F.col(raw)))))
    once = F.struct(F.from_json("_t", f"entities array<{ENTITY}>, relationships array<{RELATION}>").alias("both"), F.try_parse_json("_t").isNotNull().alias("is_json"))
    told = told.withColumn("_p", F.explode(F.array(once))).select(*replies.columns, "_p.both.entities", "_p.both.relationships", "_p.is_json")
    entity_ok = F.forall(
        "entities",
        lambda e: e["type"].isin(*EXTRACTABLE) & (F.length(e["canonical_name"]) > 0) & e["confidence"].between(0, 1) & e["evidence_quote"].isNotNull(),
    )
    relation_ok = F.forall(
        "relationships",
        lambda e: e["type"].isin(*ENDPOINTS) & e["source_canonical_name"].isNotNull() & e["target_canonical_name"].isNotNull() & e["confidence"].between(0, 1) & e["evidence_quote"].isNotNull(),
    )
    good = F.col("entities").isNotNull() & F.col("relationships").isNotNull() & F.coalesce(entity_ok, F.lit(False)) & F.coalesce(relation_ok, F.lit(False))
    stage = F.when(~F.coalesce("is_json", F.lit(False)), "json").when(~good, "schema")
    judged = told.withColumn("error_stage", F.explode(F.array(stage)))
    return judged.select(*replies.columns, "error_stage", *(F.when(F.col("error_stage").isNull(), F.col(c)).alias(c) for c in ("entities", "relationships")))


def extract(events: DataFrame, extractor: Callable[[str], str], cache: DataFrame | None = None, model: str | None = None) -> DataFrame:
    """(event_id, created_at, raw): the reply of ``extractor`` to each event that ``cache`` (event_id, raw) lacks.

    model: the extractor's name; then ``cache`` has a column model too, and
    only that model's replies count.

    extractor: a function of the content, called per event in the Python
    workers: the seam for a model. A null content gets no reply.
    """
    wanted = events.select(F.col("id").alias("event_id"), "created_at", "content").where("content IS NOT NULL")
    if cache is not None and model is not None:
        cache = cache.where(F.col("model") == model)
    known = wanted.join(cache, "event_id").select("event_id", "created_at", "raw") if cache is not None else None
    if cache is not None:
        wanted = wanted.join(cache.select("event_id"), "event_id", "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame[["event_id", "created_at"]].assign(raw=[extractor(x) for x in frame["content"]])

    new = wanted.mapInPandas(run, "event_id string, created_at timestamp_ntz, raw string")
    return new if known is None else known.unionByName(new)


def merged_nodes(parsed: DataFrame) -> DataFrame:
    """One node per label and key: the first mention's time, all events in order, the last mention's properties."""
    each = parsed.select("event_id", "created_at", F.explode("entities").alias("e"))
    each = each.select("event_id", "created_at", F.col("e.type").alias("label"), key_value(F.col("e.type"), F.col("e.canonical_name")).alias("key"), "e.canonical_name", safe_properties(F.col("e.properties")).alias("props"))
    order = F.struct("created_at", "event_id")
    grouped = each.groupBy("label", "key").agg(
        F.min("created_at").alias("created_at"), F.array_sort(F.collect_set(order)).alias("events"), F.max_by("props", order).alias("props"), F.max_by("canonical_name", order).alias("canonical_name")
    )
    return grouped.select(F.concat_ws(":", "label", "key").alias("node_id"), "label", F.col("key").alias("id"), "canonical_name", "created_at", F.col("events.event_id").alias("source_event_ids"), "props")


def node_rows(parsed: DataFrame) -> DataFrame:
    """The merge of nodes as rows, so that no row grows with a node's events: (label, key, kind, name, created_at, last).

    Kind event: one row for each event of a node, whatever it says and however often. Kind property: one for each property, kind name: one for the
    canonical name. created_at is the first mention's time; last has the last writer's place and its value, so properties that it lacks stay.
    """
    each = parsed.select("event_id", "created_at", F.posexplode("entities").alias("place", "e"))
    told = F.transform(F.map_entries(F.coalesce(safe_properties(F.col("e.properties")), F.create_map().cast("map<string,string>"))), lambda p: F.struct(F.lit("property").alias("kind"), p["key"].alias("name"), p["value"].alias("value")))
    own = F.array(
        F.struct(F.lit("event").alias("kind"), F.col("event_id").alias("name"), F.lit(None).cast("string").alias("value")),
        F.struct(F.lit("name").alias("kind"), F.lit("canonical_name").alias("name"), F.col("e.canonical_name").alias("value")),
    )
    mentions = each.select("event_id", "created_at", "place", F.col("e.type").alias("label"), key_value(F.col("e.type"), F.col("e.canonical_name")).alias("key"), F.explode(F.concat(own, told)).alias("part"))
    last = F.struct("created_at", F.when(F.col("part.kind") != "event", F.col("event_id")).alias("event_id"), "place", "part.value")
    return _united_rows(mentions.select("label", "key", "part.kind", "part.name", "created_at", last.alias("last")))


def _united_rows(rows: DataFrame) -> DataFrame:
    return rows.groupBy("label", "key", "kind", "name").agg(F.min("created_at").alias("created_at"), F.max("last").alias("last"))


def nodes_of_rows(rows: DataFrame) -> DataFrame:
    """One node of all its `node_rows`, with the number of its events, ``n_events``: sums and the few properties are all that moves."""

    def of(kind: str) -> Column:
        return F.col("kind") == kind

    props = F.map_from_entries(F.collect_list(F.when(of("property"), F.struct("name", F.col("last.value").alias("value")))))
    grouped = rows.groupBy("label", "key").agg(
        F.min(F.when(of("event"), F.col("created_at"))).alias("created_at"), F.count(F.when(of("event"), 1)).alias("n_events"), props.alias("props"),
        F.max(F.when(of("name"), F.col("last.value"))).alias("canonical_name"),
    )
    return grouped.select(F.concat_ws(":", "label", "key").alias("node_id"), "label", F.col("key").alias("id"), "canonical_name", "created_at", "n_events", "props")


def sink_nodes(store: Store, parsed: DataFrame) -> DataFrame:
    """Merges the nodes of ``parsed`` into the store's tables node_rows and nodes, each by label and key, and gives the stored nodes.

    A node that is there gains events, each once, and the later properties; replies that come again change nothing.
    """
    rows = node_rows(parsed)
    if store.exists("node_rows"):
        rows = _united_rows(store.read("node_rows").unionByName(rows))
    store.write("node_rows", rows)
    store.write("nodes", nodes_of_rows(store.read("node_rows")))
    return store.read("nodes")


def counted_nodes(parsed: DataFrame) -> DataFrame:
    """The nodes of `sink_nodes` with the numbers of their events, without their properties and without a store."""
    return nodes_of_rows(node_rows(parsed)).select("node_id", "label", "id", "created_at", "n_events")


def merged_edges(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, skipped): one edge per source, type and target, first time and last writer; skipped are relations without known ends of allowed labels.

    Ends are looked for in the reply of the relation itself (a row of ``parsed`` for each event), so nothing is joined.
    """
    def ends(side: str, node: str) -> Column:
        """The entities of the relation's own reply that have the name of one of its ends; one without a node if there is none."""
        named = F.filter("entities", lambda e: e["canonical_name"] == F.col(f"r.{side}_canonical_name"))
        known = F.array_distinct(F.transform(named, lambda e: F.struct(e["type"].alias(f"{side}_label"), F.concat_ws(":", e["type"], key_value(e["type"], e["canonical_name"])).alias(node))))
        return F.explode_outer(known)

    each = parsed.select("event_id", "created_at", "entities", F.posexplode("relationships").alias("place", "r"))
    met = each.withColumn("_s", ends("source", "src")).withColumn("_t", ends("target", "dst")).select("event_id", "created_at", "place", "r.*", "_s.*", "_t.*")
    allowed = F.lit(False)
    for kind, (sources, targets) in ENDPOINTS.items():
        allowed = allowed | ((F.col("type") == kind) & F.col("source_label").isin(*sources) & F.col("target_label").isin(*targets))
    met = met.withColumn("ok", F.coalesce(allowed, F.lit(False)))
    order = F.struct("created_at", "event_id", "place")
    edges = met.where("ok").groupBy("src", "type", "dst").agg(
        F.min("created_at").alias("created_at"), F.max_by(F.struct("confidence", F.col("event_id").alias("source_event_id"), "evidence_quote"), order).alias("last")
    )
    skipped = met.groupBy("event_id", "place").agg(F.max("ok").alias("ok")).where("NOT ok").groupBy("event_id").agg(F.count("*").alias("edges_skipped"))
    return edges.select(F.col("type").alias("edge_type"), "src", "dst", "created_at", "last.*"), skipped


def scope_of(nodes: DataFrame, events: DataFrame) -> DataFrame:
    """Nodes that each event (id) asserted; new if no other event did."""
    held = nodes.select("node_id", F.explode("source_event_ids").alias("event_id"), (F.size("source_event_ids") == 1).alias("newly_created"))
    return held.join(events.select(F.col("id").alias("event_id")), "event_id", "left_semi")


def reverted(nodes: DataFrame, edges: DataFrame, event_id: str) -> tuple[DataFrame, DataFrame]:
    """The graph without one event: its edges, nodes of that event alone, and its id elsewhere."""
    only = (F.size("source_event_ids") == 1) & F.array_contains("source_event_ids", event_id)
    left = nodes.where(~only).withColumn("source_event_ids", F.array_remove("source_event_ids", event_id))
    return left, edges.where(F.col("source_event_id").isNull() | (F.col("source_event_id") != event_id))


def provenance_missing(nodes: DataFrame, events: DataFrame) -> DataFrame:
    """Cited events that are not in the log, with how many nodes cite them."""
    cited = nodes.select("node_id", F.explode("source_event_ids").alias("event_id"))
    return cited.join(events.select(F.col("id").alias("event_id")), "event_id", "left_anti").groupBy("event_id").agg(F.count("*").alias("n_nodes"))


def provenance_orphans(nodes: DataFrame, events: DataFrame) -> DataFrame:
    """Events of the log that no node cites."""
    cited = nodes.select(F.explode("source_event_ids").alias("event_id"))
    return events.select(F.col("id").alias("event_id")).join(cited, "event_id", "left_anti")


def endpoint_violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose ends have labels that the type doesn't allow."""
    label = nodes.select("node_id", "label")
    met = edges.join(label.select(F.col("node_id").alias("src"), F.col("label").alias("a")), "src").join(label.select(F.col("node_id").alias("dst"), F.col("label").alias("b")), "dst")
    allowed = F.lit(False)
    for kind, (sources, targets) in ENDPOINTS.items():
        allowed = allowed | ((F.col("edge_type") == kind) & F.col("a").isin(*sources) & F.col("b").isin(*targets))
    return met.where(F.col("edge_type").isin(*ENDPOINTS) & ~allowed).select("edge_type", "src", "dst", F.col("a").alias("src_label"), F.col("b").alias("dst_label"))
