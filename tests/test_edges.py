"""Edges of replies."""

from tessergraph.operators import extraction
from tessergraph.operators.extraction import ENTITY, RELATION


def test_ends_are_found_in_the_reply_without_a_join(spark):
    def entity(kind, name):
        return (kind, name, {}, "q", 0.9)

    def owned(a, b):
        return ("OWNED_BY", a, b, "q", 0.8)

    rows = [
        ("e1", "2024-01-01", [entity("Service", "a"), entity("System", "a"), entity("Service", "a"), entity("Team", "t")], [owned("a", "t"), owned("t", "a"), owned("gone", "t"), owned(None, "t")]),
        ("e2", "2024-01-02", [entity("Service", "a"), entity("Person", "Ann B")], [owned("a", "Ann B"), owned("a", "t")]),
        ("e3", "2024-01-03", [entity("Service", "a"), entity("Team", "t")], [owned("a", "t")]),
        ("e4", "2024-01-04", [], [owned("a", "t")]),
    ]
    parsed = spark.createDataFrame(rows, f"event_id string, at string, entities array<{ENTITY}>, relationships array<{RELATION}>").selectExpr("event_id", "cast(at AS timestamp_ntz) AS created_at", "entities", "relationships")
    edges, skipped = extraction.merged_edges(parsed)
    assert sorted((r["src"], r["dst"], r["source_event_id"]) for r in edges.collect()) == [("Service:a", "Person:ann-b", "e2"), ("Service:a", "Team:t", "e3"), ("System:a", "Team:t", "e1")]
    assert sorted(map(tuple, skipped.collect())) == [("e1", 3), ("e2", 1), ("e4", 1)]
    assert "Join" not in edges._jdf.queryExecution().executedPlan().toString()
