"""Rounds of lookups and joins: what they take, and what passes through the driver. And texts of one word."""

import json

import pytest

from tessergraph.operators import traverse
from tessergraph.operators.traverse import chain_heads
from tessergraph.plans import catalog
from tessergraph.sources.store import Store
from tessergraph.streaming import graph


def test_a_text_of_one_word_names_no_owner():
    links = [json.loads(catalog.first_words(t))["relationships"] for t in ("aaaaaaaaaaaa", "  aaaaaaaaaaaa \n", "svc team other", "same same x")]
    assert [[(r["source_canonical_name"], r["target_canonical_name"]) for r in x] for x in links] == [[], [], [("svc", "team")], []]
    assert [e["canonical_name"] for e in json.loads(catalog.first_words("aaaaaaaaaaaa"))["entities"]] == ["aaaaaaaaaaaa", "none"]


def merges_of(spark, root, links):
    held = graph.Graph(Store(spark, str(root)))
    rows = spark.createDataFrame(links, "loser string, winner string")
    held["merges"].put(rows.selectExpr("*", "'Team' AS label", "1 AS tier", "0.99D AS confidence", "'auto_merge' AS decision", "array() AS gained", "'b' AS batch"))
    return held


def test_heads_take_few_rounds_for_many_spellings_of_a_name(spark, tmp_path, monkeypatch):
    links = [(f"n{i:02d}", f"n{j:02d}") for i in range(25) for j in range(i)]  # each lost to all before it
    links += [("n00", "z"), ("z", "y"), ("p", "q"), ("p", "r")]  # the last of them later, and one with two ends
    held, rounds = merges_of(spark, f"file://{tmp_path}", links), []
    cut = graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df: rounds.append(1) or cut(df))
    asked = ["n03", "n24", "n00", "p", "y", "unknown"]
    got = held.heads(spark.createDataFrame([(x,) for x in asked], "node_id string"))
    every = chain_heads(spark.createDataFrame(links, "src string, dst string")).where(f"node IN ({', '.join(map(repr, asked))})")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, every.collect())) == [("n00", "y"), ("n03", "y"), ("n24", "y"), ("p", "q"), ("p", "r")]
    assert len(rounds) < 20


def test_heads_of_a_circle_are_an_error(spark, tmp_path):
    held = merges_of(spark, f"file://{tmp_path}", [("a", "b"), ("b", "c"), ("c", "b"), ("d", "e")])
    with pytest.raises(ValueError, match="cycle"):
        held.heads(spark.createDataFrame([("a",)], "node_id string"))
    assert [tuple(r) for r in held.heads(spark.createDataFrame([("d",)], "node_id string")).collect()] == [("d", "e")]


def test_depths_are_joined_without_the_driver(spark, monkeypatch):
    plans, cut = [], traverse.cut_lineage
    monkeypatch.setattr(traverse, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    links = spark.range(2, 300).selectExpr("id AS src", "id div 2 AS dst")
    got = {r["node"]: r["depth"] for r in traverse.longest_depth(links).collect()}
    assert got == {i: i.bit_length() - 1 for i in range(1, 300)}
    assert len(plans) > 8 and not [p for p in plans if "Broadcast" in p]
