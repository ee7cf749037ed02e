"""Ground truth and provenance: canonical mentions, expected facts, pairs of clusters, envelopes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessergraph.functions.text import normalized
from tessergraph.operators import pairs as blocks
from tessergraph.operators.matching import occurring_anywhere
from tessergraph.operators.traverse import components


def alias_index(surfaces: DataFrame) -> DataFrame:
    """(label, alias, canonical) from (label, surface, canonical, place): the first entry of an alias counts, empty names never."""
    named = surfaces.withColumn("alias", normalized(F.col("surface"))).where("alias != ''")
    return named.groupBy("label", "alias").agg(F.min_by("canonical", "place").alias("canonical"))


def canonicalized(mentions: DataFrame, index: DataFrame) -> DataFrame:
    """mentions (label, name) with ``canonical``: by the index of their label, or else the normalized name."""
    return mentions.withColumn("alias", normalized(F.col("name"))).join(index, ["label", "alias"], "left").withColumn("canonical", F.coalesce("canonical", "alias")).drop("alias")


def canonical_endpoints(relations: DataFrame, index: DataFrame, side: str, labels: tuple[str, ...]) -> DataFrame:
    """``{side}_key`` of a relation's end: the first of ``labels`` whose index knows the name, or else the normalized name."""
    rank = F.array_position(F.array(*map(F.lit, labels)), F.col("label"))
    known = index.where(F.col("label").isin(*labels)).groupBy("alias").agg(F.min_by("canonical", rank).alias(f"{side}_known"))
    named = relations.withColumn("alias", normalized(F.col(f"{side}_name")))
    return named.join(known, "alias", "left").withColumn(f"{side}_key", F.coalesce(f"{side}_known", "alias")).drop("alias", f"{side}_known")


def expected_entities(surfaces: DataFrame, events: DataFrame) -> DataFrame:
    """(label, canonical) of which some surface occurs in the log, anywhere in a text and in any case. surfaces: (label, surface, canonical)."""
    named = surfaces.withColumn("name", F.lower("surface"))
    said = occurring_anywhere(events.select(F.lower("content").alias("text")), named.select("name"))
    return named.join(said, "name").select("label", "canonical").distinct()


def expected_edges(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Planted edges (edge_type, src, dst) of which both ends are expected."""
    known = entities.select("canonical").distinct()
    return edges.join(known.withColumnRenamed("canonical", "src"), "src", "left_semi").join(known.withColumnRenamed("canonical", "dst"), "dst", "left_semi")


def predicted_pairs(merges: DataFrame) -> DataFrame:
    """All pairs a < b within each component of merge links (src, dst), for scoring against `evaluation.truth_pairs`."""
    return blocks.met(components(merges), ["component"], "node").select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))


def provenance_union(provenance: DataFrame) -> DataFrame:
    """Sorted distinct events of each element (element_key, event_id); null and empty ids don't count."""
    return provenance.where("event_id IS NOT NULL AND event_id != ''").groupBy("element_key").agg(F.sort_array(F.collect_set("event_id")).alias("events"))


def envelope(answer: DataFrame, provenance: DataFrame) -> dict:
    """An answer with its provenance, at the API's boundary: rows, events by element, all events sorted."""
    by_element = {r["element_key"]: r["events"] for r in provenance_union(provenance).toLocalIterator()}
    return {"value": [r.asDict(recursive=True) for r in answer.collect()], "by_element": by_element, "all_event_ids": sorted({e for ids in by_element.values() for e in ids})}


def earliest_events(nodes: DataFrame, events: DataFrame) -> DataFrame:
    held = nodes.select("node_id", F.explode("source_event_ids").alias("id"))
    return held.join(events.select("id", "created_at"), "id").groupBy("node_id").agg(F.min("created_at").alias("first_event"))
