import pytest
from pyspark.sql import functions as F

from tessergraph.operators import evaluation, extraction, temporal, truth
from tessergraph.sources import schema, synthetic, tables
from tessergraph.sources.store import Store

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_synthetic_log_is_deterministic(spark):
    a, b = synthetic.event_log(spark, 60), synthetic.event_log(spark, 60).repartition(7)
    assert rows(a) == rows(b)
    assert a.where("content IS NULL OR content LIKE '%{%'").count() == 0
    assert a.where(F.col("content").contains("supersedes")).count() == 10


def test_faults(spark):
    nodes, edges = tables.nodes(spark, SF), tables.edges(spark, SF)
    assert schema.node_faults(nodes).count() == 0
    broken = nodes.limit(3).withColumn("label", F.when(F.col("canonical_name").isNotNull(), F.lit("Planet")).otherwise(F.col("label")))
    assert {r["fault"] for r in schema.node_faults(broken).collect()} == {"label"}
    bad = edges.limit(1).withColumn("confidence", F.lit(2.0)).union(edges.limit(1).withColumn("dst", F.lit("nowhere")))
    assert sorted(r["fault"] for r in schema.edge_faults(bad, nodes).collect()) == ["confidence", "end"]


def test_migrations_run_once(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    store.write("edges", spark.createDataFrame([("a", "b")], "src string, dst string"))
    assert schema.migrate(store) == list(schema.MIGRATIONS)
    assert "tier" in store.read("edges").columns and schema.migrate(store) == []


def test_canonical_mentions(spark):
    surfaces = spark.createDataFrame([("Service", "Auth Svc", "auth", 0), ("Service", "auth-svc", "other", 1), ("Team", "Auth Svc", "team-auth", 2), ("Team", "--", "none", 3)], "label string, surface string, canonical string, place int")
    index = truth.alias_index(surfaces)
    assert rows(index) == [("Service", "auth-svc", "auth"), ("Team", "auth-svc", "team-auth")]
    mentions = spark.createDataFrame([("Service", "AUTH svc"), ("Team", "New Team")], "label string, name string")
    assert rows(truth.canonicalized(mentions, index).select("canonical")) == [("auth",), ("new-team",)]
    relation = spark.createDataFrame([("auth svc",)], "source_name string")
    assert truth.canonical_endpoints(relation, index, "source", ("Team", "Service")).first()["source_key"] == "team-auth"
    events = spark.createDataFrame([("1", "the Auth Svc is slow"), ("2", None)], "id string, content string")
    found = truth.expected_entities(surfaces.select("label", "surface", "canonical"), events)
    assert rows(found) == [("Service", "auth"), ("Team", "team-auth")]


def test_pairs_of_clusters_are_scored(spark):
    merges = spark.createDataFrame([("b", "a"), ("c", "b"), ("y", "x")], "src string, dst string")
    predicted = truth.predicted_pairs(merges)
    assert rows(predicted) == [("a", "b"), ("a", "c"), ("b", "c"), ("x", "y")]
    expected = evaluation.truth_pairs(spark.createDataFrame([("g", "a"), ("g", "b"), ("g", "c")], "group string, member string"))
    assert evaluation.prf(expected, predicted, ["a", "b"]).first()[:3] == (3, 1, 0)


def test_envelope(spark):
    p = spark.createDataFrame([("x", "e2"), ("x", "e1"), ("y", "e1"), ("y", None), ("y", "")], "element_key string, event_id string")
    made = truth.envelope(spark.createDataFrame([(1,)], "v int"), p)
    assert made == {"value": [{"v": 1}], "by_element": {"x": ["e1", "e2"], "y": ["e1"]}, "all_event_ids": ["e1", "e2"]}


def test_supersessions_of_the_synthetic_log(spark):
    log = synthetic.event_log(spark, 60)
    found = log.select(F.regexp_extract("content", r"^(D-\d{4})", 1).alias("own"), "content").where("own != ''")
    from tessergraph.functions.text import supersedes_target

    targets = found.select(supersedes_target(F.col("content"), F.col("own")).alias("t")).where("t IS NOT NULL")
    assert targets.count() == 10 and temporal is not None


def test_insert_raises_on_a_known_key(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    one = spark.createDataFrame([("a", 1)], "id string, v int")
    store.insert("t", one, ["id"])
    for rows in (one, spark.createDataFrame([("b", 1), ("b", 2)], one.schema)):
        with pytest.raises(ValueError):
            store.insert("t", rows, ["id"])
    store.insert("t", spark.createDataFrame([("b", 2)], one.schema), ["id"])
    assert sorted(map(tuple, store.read("t").collect())) == [("a", 1), ("b", 2)]


def test_json_cases(spark, tmp_path):
    (tmp_path / "cases.json").write_text('[\n {"q": "who owns it",\n  "route": "kq1"},\n {"q": "x", "route": null}\n]')
    found = tables.json_cases(spark, f"file://{tmp_path}/cases.json", "q string, route string")
    assert sorted(tuple(r) for r in found.collect()) == [("who owns it", "kq1"), ("x", None)]


def test_replies_of_another_model_are_not_taken(spark):
    events = spark.createDataFrame([("a", None, "x"), ("b", None, "y")], "id string, created_at timestamp_ntz, content string")
    cache = spark.createDataFrame([("a", "m1", "old"), ("b", "m2", "other")], "event_id string, model string, raw string")
    found = extraction.extract(events, str.upper, cache, model="m1")
    assert sorted((r["event_id"], r["raw"]) for r in found.collect()) == [("a", "old"), ("b", "Y")]
