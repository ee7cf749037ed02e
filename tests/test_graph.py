"""Semantics on small planted graphs."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessergraph.functions import text
from tessergraph.operators import evaluation, extraction, resolution, search, temporal, traverse, typed
from tessergraph.sources.store import Store
from tessergraph.sources.tables import EDGE_SCHEMA, NODE_SCHEMA

NAMES = [f.name for f in NODE_SCHEMA]
DAY = dt.datetime(2026, 6, 1)


def node(label, key, **more):
    field = {"Person": "canonical_id", "Decision": "id", "Message": "id"}.get(label, "canonical_name")
    row = {"node_id": f"{label}:{key}", "label": label, "id": key, field: key, "source_event_ids": [f"e-{key}"]} | more
    return tuple(row.get(n) for n in NAMES)


def link(kind, src, dst, event="e", confidence=1.0, tier=None):
    return (kind, src, dst, event, confidence, tier)


@pytest.fixture(scope="module")
def graph(spark):
    nodes = [
        node("Decision", "D-0001", title="drop ledger", valid_from=DAY - dt.timedelta(days=20)),
        node("Decision", "D-0002", title="older", status="superseded", valid_from=DAY - dt.timedelta(days=200)),
        node("System", "ledger"), node("Service", "pay"), node("Service", "web", status="deprecated"), node("Service", "bill"), node("Service", "gone", status="merged"), node("Service", "lone"),
        node("Team", "Core"), node("Team", "Empty"), node("Person", "ann", handle="@Ann"), node("Person", "bob"), node("Person", "cat", status="merged"),
        node("Message", "slack:1", content="but D-0001", created_at=DAY - dt.timedelta(days=3)), node("Message", "slack:2", content="old", created_at=DAY - dt.timedelta(days=100)),
    ]
    edges = [
        link("DEPRECATES", "Decision:D-0001", "System:ledger"), link("DEPENDS_ON", "Service:pay", "System:ledger"), link("DEPENDS_ON", "Service:bill", "System:ledger"),
        link("DEPENDS_ON", "Service:web", "Service:pay"), link("DEPENDS_ON", "Service:bill", "Service:web"), link("DEPENDS_ON", "Service:bill", "Service:pay"), link("DEPENDS_ON", "Service:pay", "Service:bill"),
        link("OWNED_BY", "Service:pay", "Team:Core"), link("OWNED_BY", "Service:bill", "Team:Empty"), link("OWNED_BY", "Service:web", "Person:bob"), link("OWNED_BY", "Service:gone", "Team:Core"),
        link("MEMBER_OF", "Person:ann", "Team:Core"), link("MEMBER_OF", "Person:cat", "Team:Core"), link("SUPERSEDES", "Decision:D-0001", "Decision:D-0002"), link("APPROVED_BY", "Decision:D-0001", "Person:bob"),
        link("ABOUT", "Decision:D-0001", "Service:pay"), link("CONTRADICTS", "Message:slack:1", "Decision:D-0001", "e1", 0.9), link("CONTRADICTS", "Message:slack:2", "Decision:D-0001"),
        link("MERGE_INTO", "Service:gone", "Service:lone", "e", 0.99, 1),
    ]
    return spark.createDataFrame(nodes, NODE_SCHEMA).cache(), spark.createDataFrame(edges, EDGE_SCHEMA).cache()


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_chain_owner_opens_teams_and_keeps_empty_ones(graph):
    got = typed.find_chain_owner(*graph, "D-0001").select("service", "owner_id", "person_id", "hops")
    assert sorted(map(tuple, got.collect()), key=str) == [("bill", "Empty", None, 3), ("pay", "Core", "ann", 4)]
    assert typed.find_chain_owner(*graph, "D-9999").count() == 0


def test_contradictions_by_window(graph):
    assert rows(typed.find_contradictions(*graph, "2026-06-01", 30).select("decision_id", "n_messages")) == [("D-0001", 1)]
    assert rows(typed.find_contradictions(*graph, "2026-06-01", 100).select("n_messages")) == [(2,)]


def test_longest_trail_on_a_cycle(graph):
    got = dict((s, (a, b)) for s, a, b in rows(typed.blast_services(*graph, "pay", 5)))
    assert got == {"web": (1, 3), "bill": (1, 4)} or got["web"][0] == 1 and got["bill"][0] == 1
    brute = {"web": set(), "bill": set()}
    links = [("pay", "ledger"), ("bill", "ledger"), ("web", "pay"), ("bill", "web"), ("bill", "pay"), ("pay", "bill")]

    def walk(at, used, depth):
        for l in links:
            if l[1] == at and l not in used and depth < 5:
                if l[0] in brute:
                    brute[l[0]].add(depth + 1)
                walk(l[0], used | {l}, depth + 1)

    walk("pay", frozenset(), 0)
    assert got == {k: (min(v), max(v)) for k, v in brute.items()}
    assert typed.blast_services(*graph, "nothing").count() == 0


def test_blast_people_and_decisions(graph):
    assert rows(typed.blast_people(*graph, "pay")) == [("ann",), ("bob",)]
    assert rows(typed.blast_decisions(*graph, "pay")) == [("D-0001",)]


def test_changes(graph):
    target = graph[0].where("canonical_name = 'pay'").select("node_id")
    got = typed.track_changes(*graph, target, "2026-06-01", 90).collect()
    assert [(r["decision_id"], r["approvers"], r["supersedes"]) for r in got] == [("D-0001", "bob", "D-0002")]


def test_enumerate_modes(graph):
    def names(**a):
        return [r["name"] for r in typed.enumerate_nodes(*graph, **a).orderBy("place").collect()]

    assert names(label="Service") == ["bill", "lone", "pay"]
    assert names(label="Service", status="deprecated") == ["web"]
    assert names(label="Service", status="all") == ["bill", "lone", "pay", "web"]
    assert names(label="Service", without_edge="OWNED_BY") == ["lone"]
    assert names(label="Person", team="core") == ["ann"]
    limited = typed.enumerate_nodes(*graph, "Service", limit=1).collect()
    assert [(r["name"], r["total_count"]) for r in limited] == [("bill", 3)]
    with pytest.raises(ValueError):
        typed.enumerate_nodes(*graph, "Service", limit=501)


def test_aggregate_entity_neighbors(graph):
    assert typed.aggregate_total(graph[0], "Service").first()[0] == 3
    assert rows(typed.aggregate_groups(*graph, "Service", "OWNED_BY")) == [("Core", "Team", 1), ("Empty", "Team", 1)]
    entity = typed.get_entity(*graph, "@ANN").collect()
    assert [(r["entity"], r["direction"], r["edge_type"], r["n_edges"]) for r in entity] == [("ann", "out", "MEMBER_OF", 1)]
    assert rows(typed.neighbors(*graph, "core", direction="in").select("neighbor")) == [("ann",), ("pay",)]
    assert typed.neighbors(*graph, "core", direction="out").count() == 0
    assert typed.neighbors(*graph, "core", limit=1).first()["total_count"] == 2
    assert typed.get_entity(*graph, "cat").count() == 0


def test_views(graph):
    nodes, links = typed.graph_view(*graph, "resolved")
    assert nodes.where("node_id = 'Service:gone'").count() == 0 and links.where("is_merge_into").count() == 0
    _, every = typed.graph_view(*graph, "fragmented")
    assert every.count() == graph[1].count()


def test_projection_is_idempotent(graph):
    made = resolution.project_edges(graph[1])
    assert rows(made.select("edge_type", "src", "dst")) == [("OWNED_BY", "Service:lone", "Team:Core")]
    again = graph[1].unionByName(made.select(*graph[1].columns))
    assert resolution.project_edges(again).count() == 0


def test_heads_components_depth(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "x"), ("m", "n")], "src string, dst string")
    assert rows(traverse.chain_heads(links)) == [("a", "d"), ("a", "x"), ("b", "d"), ("c", "d"), ("m", "n")]
    assert rows(traverse.components(links)) == sorted([(n, "a") for n in "abcdx"] + [("m", "m"), ("n", "m")])
    assert dict(rows(traverse.longest_depth(links)))["a"] == 3
    with pytest.raises(ValueError):
        traverse.longest_depth(spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string"), rounds=5)


def test_merge_moves_events_and_marks(graph):
    merges = graph[0].sparkSession.createDataFrame([("Service:pay", "Service:bill", 0.99, 1)], "winner string, loser string, confidence double, tier int")
    after, edges = resolution.apply_merges(*graph, merges)
    got = {r["node_id"]: r for r in after.collect()}
    assert got["Service:bill"]["status"] == "merged" and got["Service:pay"]["source_event_ids"] == ["e-pay", "e-bill"]
    assert edges.where("edge_type = 'MERGE_INTO'").count() == 2


def test_rules_and_tiers(spark):
    cols = "key string, label string, id string, canonical_name string, former_name string, email string, handle string, n_events int"
    nodes = spark.createDataFrame(
        [("1", "Service", "x", "Auth Svc", None, None, None, 1), ("2", "Service", "y", "auth-svc", None, None, None, 2), ("3", "Service", "z", "login", "Auth svc", None, None, 1), ("4", "Person", "p", None, None, " A@x.io", "@ann", 1), ("5", "Person", "q", None, None, "a@X.io ", "ann", 1)], cols
    )
    nodes = resolution.with_aliases(nodes, spark.createDataFrame([("login", "auth")], "alias string, canonical string"))
    conditions = {n: getattr(resolution, n)() for n in ("exact_email", "exact_handle", "exact_canonical_name", "known_alias", "former_name")}
    rated = resolution.tiers(resolution.pairs_of(nodes), resolution.rules_matched(F.col("a.label"), conditions), F.lit(0.1))
    got = {(r["a"]["key"], r["b"]["key"]): (r["rules"], r["tier"], r["decision"]) for r in rated.collect()}
    assert got[("1", "2")] == (["exact_canonical_name"], 1, "auto_merge")
    assert got[("1", "3")] == (["former_name"], 1, "auto_merge")
    assert got[("4", "5")] == (["exact_email", "exact_handle"], 1, "auto_merge")
    none = resolution.tiers(resolution.pairs_of(nodes), F.array().cast("array<string>"), F.lit(0.8)).first()
    assert (none["tier"], none["decision"]) == (2, "llm_no_merge")


def test_consolidation_skips_absorbed(spark):
    v = [1.0, 0.0]
    at = [DAY - dt.timedelta(days=d) for d in (0, 1, 2, 90)]
    decisions = spark.createDataFrame([("D-0001", v, at[0], 3), ("a", v, at[1], 1), ("b", v, at[2], 1), ("D-0002", v, at[0], 1), ("c", v, at[3], 1)], "key string, embedding array<float>, created_at timestamp_ntz, n_events int")
    pairs = resolution.consolidation_pairs(decisions)
    done = resolution.consolidated(pairs).collect()
    assert sorted((d["winner"], d["loser"]) for d in done) == [("D-0001", "a"), ("D-0001", "b")]
    late = decisions.withColumn("created_at", F.when(F.col("key") != "c", F.col("created_at")))
    every = {(r["a"]["key"], r["b"]["key"]) for r in resolution.consolidation_pairs(late).collect()}
    assert every == {("D-0001", "a"), ("D-0001", "b"), ("D-0001", "c"), ("D-0002", "a"), ("D-0002", "b"), ("D-0002", "c"), ("a", "b"), ("a", "c"), ("b", "c")}
    some = {(r["a"]["key"], r["b"]["key"]) for r in resolution.consolidation_pairs(late, touched=late.where("key IN ('a', 'c')")).collect()}
    assert some == {p for p in every if {"a", "c"} & set(p)}


def test_text_rules(spark):
    df = spark.createDataFrame([(" @@Ann  Lee! ", "It supersedes D-0001, superseded the D-0042", "[evt: a ] x [evt:b][evt: a]", '```json\n{"same": true, "confidence": 0.5, "reasoning": "r"}\n```')], "a string, b string, c string, d string")
    r = df.select(text.normalized(F.col("a")), text.slug(F.lit("@-")), text.supersedes_target(F.col("b"), F.lit("D-0001")), text.inline_citations(F.col("c")), text.verdict(F.col("d"), "same"), text.verdict(F.lit("no"), "same")).first()
    assert r[0] == "ann-lee" and r[1] == "unknown" and r[2] == "D-0042" and r[3] == ["a", "b"] and r[4]["same"] and not r[5]["same"]
    assert df.select(text.mentions(F.lit("see D-0001."), F.lit("D-0001")), text.mentions(F.lit("see D-00010"), F.lit("D-0001"))).first() == (True, False)


def test_contradiction_gate(spark):
    messages = spark.createDataFrame([("1", "re D-0001 ok"), ("2", "we should not use Ledger"), ("3", "ledger is fine"), ("4", None)], "id string, content string")
    decisions = spark.createDataFrame([("D-0001", ["ledger"]), ("D-0002", [])], "id string, subjects array<string>")
    assert rows(temporal.contradiction_candidates(messages, decisions)) == [("1", "D-0001", "id"), ("2", "D-0001", "subject")]


def test_temporal_and_supersession(spark):
    decisions = spark.createDataFrame([("Decision:1", "D-0001", ["e1", "e2"], None, DAY), ("Decision:2", "D-0002", [], None, DAY)], "node_id string, id string, source_event_ids array<string>, valid_from timestamp_ntz, created_at timestamp_ntz")
    events = spark.createDataFrame([("e1", DAY - dt.timedelta(days=1)), ("e2", DAY - dt.timedelta(days=5))], "id string, created_at timestamp_ntz")
    got = {r["id"]: r for r in temporal.valid_from(decisions, events).collect()}
    assert got["D-0001"]["valid_from"] == DAY - dt.timedelta(days=5) and got["D-0001"]["from_events"] and got["D-0002"]["valid_from"] == DAY
    texts = spark.createDataFrame([("Decision:2", 0, "superseded D-0001"), ("Decision:1", 0, "superseding D-7777")], "node_id string, position int, text string")
    assert rows(temporal.supersession_links(decisions, texts)) == [("D-0002", "D-0001")]


def test_extraction_errors_and_merges(spark):
    good = '{"entities": [{"type": "Service", "canonical_name": "pay", "properties": {"lang": "go", "id": "x"}, "evidence_quote": "q", "confidence": 1}, {"type": "Team", "canonical_name": "core", "properties": {}, "evidence_quote": "q", "confidence": 0.5}], "relationships": [{"type": "OWNED_BY", "source_canonical_name": "pay", "target_canonical_name": "core", "evidence_quote": "q", "confidence": 0.7}, {"type": "OWNED_BY", "source_canonical_name": "pay", "target_canonical_name": "nobody", "evidence_quote": "q", "confidence": 0.7}]}'
    replies = [("e1", DAY, good), ("e2", DAY + dt.timedelta(days=1), good.replace("go", "rust")), ("e3", DAY, "nope"), ("e4", DAY, '{"entities": []}'), ("e5", DAY, good.replace('"Team"', '"Planet"')), ("e6", DAY, None)]
    parsed = extraction.parsed_replies(spark.createDataFrame(replies, "event_id string, created_at timestamp_ntz, raw string"))
    assert rows(parsed.select("event_id", F.coalesce("error_stage", F.lit("-")))) == [("e1", "-"), ("e2", "-"), ("e3", "json"), ("e4", "schema"), ("e5", "schema"), ("e6", "json")]
    ok = parsed.where("error_stage IS NULL")
    service = extraction.merged_nodes(ok).where("label = 'Service'").first()
    assert service["source_event_ids"] == ["e1", "e2"] and service["props"] == {"lang": "rust"} and service["created_at"] == DAY
    edges, skipped = extraction.merged_edges(ok)
    assert [(r["src"], r["dst"], r["source_event_id"]) for r in edges.collect()] == [("Service:pay", "Team:core", "e2")]
    assert rows(skipped) == [("e1", 1), ("e2", 1)]


def test_search_filters_after_candidates(spark):
    vectors = spark.createDataFrame([(f"d{i}", [1.0, i / 10]) for i in range(8)], "event_id string, embedding array<double>")
    events = spark.createDataFrame([(f"d{i}", "doc" if i % 2 else "slack_message", DAY) for i in range(8)], "id string, source_type string, created_at timestamp_ntz")
    entities = spark.createDataFrame([("d3", 9, ["Service"])], "event_id string, entity_count long, labels array<string>")
    got = search.hybrid_search(vectors, events, entities, [1.0, 0.0], 1, source_types=["DOC"]).collect()
    assert [r["event_id"] for r in got] == ["d3"]
    assert search.hybrid_search(vectors, events, entities, [1.0, 0.0], 1, labels=["person"]).count() == 0


def test_metrics_of_empty_sets(spark):
    empty = spark.createDataFrame([], "k string")
    assert evaluation.prf(empty, empty, ["k"]).first()[3:] == (0.0, 0.0, 0.0)
    r = spark.range(1).select(evaluation.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>")), evaluation.jaccard(F.array(F.lit("a")), F.array(F.lit("b")))).first()
    assert r == (1.0, 0.0)
    ranked, expected = spark.createDataFrame([("q", "a", 1)], "question string, item string, place int"), spark.createDataFrame([("q", None)], "question string, item string")
    assert evaluation.recall_mrr(ranked, expected).first()["recall"] == 1.0


def test_store_versions(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    assert store.insert_new("t", df, ["k"], "v") == 2
    assert store.insert_new("t", df, ["k"], "v") == 0
    store.upsert("t", spark.createDataFrame([(2, "z"), (3, "y")], "k int, v string"), ["k"])
    assert rows(store.read("t")) == [(1, "a"), (2, "z"), (3, "y")]


def test_traversals_have_no_silent_end(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(150)], "src long, dst long")
    end = spark.createDataFrame([(150,)], "node long")
    assert dict(rows(traverse.reachable(chain, end))) == {150 - k: k for k in range(1, 151)}
    assert dict(rows(traverse.reachable(chain, end, 7))) == {150 - k: k for k in range(1, 8)}
    assert dict(rows(traverse.chain_heads(chain))) == {i: 150 for i in range(150)}
    circle = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (7, 1)], "src long, dst long")
    with pytest.raises(ValueError):
        traverse.chain_heads(circle)
    with pytest.raises(ValueError):
        traverse.longest_depth(circle)
    assert dict(rows(traverse.reachable(circle, spark.createDataFrame([(1,)], "node long")))) == {2: 2, 3: 1, 7: 1}


@pytest.mark.parametrize("one_task", [0, 10**6])
def test_components_either_way(spark, one_task):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(300 + i, 400) for i in range(20)] + [(7, 7), (900, 900), (None, 3)]
    got = dict(rows(traverse.components(spark.createDataFrame(links, "src long, dst long"), one_task)))
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {300 + i: 300 for i in range(20)} | {400: 300, 900: 900}
    assert traverse.components(spark.createDataFrame([], "src long, dst long"), one_task).count() == 0


def test_blast_passes_through_nodes_of_any_label(spark):
    nodes = [node("Service", "a"), node("Team", "t"), node("Service", "c"), node("Service", "m", status="merged"), node("Service", "d")]
    edges = [link("DEPENDS_ON", "Team:t", "Service:a", "e1"), link("DEPENDS_ON", "Service:c", "Team:t", "e2"), link("DEPENDS_ON", "Service:m", "Service:a"), link("DEPENDS_ON", "Service:d", "Service:m")]
    g = spark.createDataFrame(nodes, NODE_SCHEMA), spark.createDataFrame(edges, EDGE_SCHEMA)
    assert rows(typed.blast_services(*g, "a")) == [("c", 2, 2)]
    assert {e for _, e in rows(typed.blast_provenance(*g, "a"))} == {"e1", "e2"}


def test_provenance_of_contradictions_and_changes(graph):
    got = rows(typed.contradiction_provenance(*graph, "2026-06-01", 30))
    assert got == [("edge:CONTRADICTS:slack:1->D-0001", "e-slack:1"), ("edge:CONTRADICTS:slack:1->D-0001", "e1"), ("node:Decision:D-0001", "e-D-0001")]
    assert rows(typed.contradicting_messages(*graph, "2026-06-01", 30).select("message_id", "said_at")) == [("slack:1", "2026-05-29 00:00:00")]
    target = graph[0].where("canonical_name = 'pay'").select("node_id")
    assert rows(typed.change_provenance(*graph, target, "2026-06-01", 90)) == [("edge:APPROVED_BY:D-0001", "e"), ("edge:SUPERSEDES:D-0001", "e"), ("node:Decision:D-0001", "e-D-0001")]


def test_contradiction_candidates_anywhere_in_a_text(spark):
    said = [("1", "we should not touch oauth"), ("2", "pre-D-100 plans"), ("3", "D-1000 and xD-100"), ("4", "AUTH is stale"), ("5", "auth is fine"), ("6", None), ("7", ""), ("8", "so D-100.")]
    messages = spark.createDataFrame(said, "id string, content string")
    decisions = spark.createDataFrame([("D-100", ["auth", None, ""]), ("D-2", ["Auth", "billing"]), ("D-3", [])], "id string, subjects array<string>")
    want = [("1", "D-100", "subject"), ("1", "D-2", "subject"), ("2", "D-100", "id"), ("4", "D-100", "subject"), ("4", "D-2", "subject"), ("8", "D-100", "id")]
    assert rows(temporal.contradiction_candidates(messages, decisions)) == want


@pytest.mark.parametrize("apart", [False, True])
@pytest.mark.parametrize("n, window, letters", [(6, 1 << 20, "ab"), (400, 7, "ab_ é-"), (9_000, 64, "abcdefgh.€")])
def test_occurring_equals_a_slow_search(spark, apart, n, window, letters):
    """9,000 names more than fill a bitmap of 2^15 bits; windows are shorter than texts and names."""
    from tessergraph.operators import matching

    draw = random.Random(n)
    made = {"".join(draw.choices(letters, k=draw.choice([1, 2, 3, 4, 5, 7, 8, 9, 17]))) for _ in range(n)} | {letters * 9, "ab"}
    said = ["".join(draw.choices(letters, k=draw.choice([0, 1, 5, 40, 300]))) for _ in range(60)] + ["", letters * 10, "x" + letters * 9 + "x", "ab", "ab"]
    texts = spark.createDataFrame([*enumerate(said), (99, None)], "key long, text string").repartition(3)
    names = spark.createDataFrame([(x,) for x in [*sorted(made), None, "", "ab"]], "name string")

    def edge(text, at):
        before, after = (0 <= i < len(text) and text[i].isascii() and (text[i].isalnum() or text[i] == "_") for i in (at - 1, at))
        return before != after

    want = []
    for key, text in enumerate(said):
        places = {text[i:j]: 0 for i in range(len(text)) for j in range(i + 1, min(len(text), i + 91) + 1) if text[i:j] in made and (not apart or edge(text, i) and edge(text, j))}
        want += [(key, x) for x in places]
    got = [(r["key"], r["name"]) for r in matching.occurring(texts, names, apart, max_bits=15, window=window).collect()]
    assert sorted(got) == sorted(want) and len(want) > 5
    anywhere = [r["name"] for r in matching.occurring_anywhere(texts, names, apart, max_bits=15, window=window).collect()]
    assert sorted(anywhere) == sorted({x for _, x in want})
    assert matching.occurring_anywhere(texts, names.limit(0)).count() == matching.occurring(texts, names.limit(0)).count() == matching.occurring(texts.limit(0), names).count() == 0


def test_scoped_candidates_and_edges(spark):
    messages = spark.createDataFrame(
        [("slack:1", "Message:1", "D-1 is wrong", DAY, ["e1", "e2"]), ("slack:2", "Message:2", "D-1 is right", DAY - dt.timedelta(days=70), []), ("slack:3", "Message:3", "not D-2", DAY, ["e3"])],
        "id string, node_id string, content string, created_at timestamp_ntz, source_event_ids array<string>",
    )
    decisions = spark.createDataFrame([("D-1", "Decision:D-1", None, ["x"]), ("D-2", "Decision:D-2", "two", ["x"])], "id string, node_id string, title string, subjects array<string>")
    assert rows(temporal.candidates_of_message(messages, decisions, "slack:2")) == [("slack:2", "D-1", "id")]
    assert rows(temporal.candidates_of_decision(messages, decisions, "D-1", "2026-06-01")) == [("slack:1", "D-1", "id")]
    every = temporal.contradiction_candidates(messages, decisions)

    def judge(content, decision_id, title):
        return '{"contradicts": true, "confidence": 0.5}' if "wrong" in content else "no json"

    got = temporal.contradiction_edges(every, messages, decisions, judge).select("src", "dst", "confidence", "source_event_id")
    assert rows(got) == [("Message:1", "Decision:D-1", 0.5, "e1")]
    column = F.when(F.col("title") == "two", '{"contradicts": true, "confidence": 1.0}').otherwise('{"contradicts": true, "confidence": 7}')
    assert rows(temporal.contradiction_edges(every, messages, decisions, column).select("src")) == [("Message:3",)]


def test_appends_write_their_own_rows_alone(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    for i in range(12):
        store.append("t", spark.createDataFrame([(i, "x")], "k int, v string").coalesce(1))
    assert rows(store.read("t")) == [(i, "x") for i in range(12)]
    assert len(list(tmp_path.glob("t/part-*/*.parquet"))) == 12 and len(store.parts("t")) == 12
    assert store.read("t", 3).count() == 3
    with pytest.raises(ValueError):
        store.append("t", spark.createDataFrame([(1,)], "k int"))
    assert store.insert_new("t", spark.createDataFrame([(3, "again"), (50, "new")], "k int, v string"), ["k"], "v") == 1
    store.compact("t")
    store.vacuum("t", 1)
    assert store.read("t").count() == 13 and len(list(tmp_path.glob("t/part-*"))) == 1


def test_many_vector_queries_equal_one_by_one(spark):
    vectors = spark.createDataFrame([(f"d{i}", [float(i % 7), float(i % 3), 1.0]) for i in range(60)] + [("zero", [0.0, 0.0, 0.0])], "event_id string, embedding array<float>")
    queries = [(q, [float(q), 1.0, 0.5]) for q in range(6)] + [(9, [0.0, 0.0, 0.0])]
    got = search.vector_topk_many(vectors, spark.createDataFrame(queries, "query_id long, embedding array<float>"), 5, block=2).collect()
    for q, v in queries:
        want = [(r["event_id"], round(r["similarity"], 9)) for r in search.vector_topk(vectors, v, 5).collect()]
        assert sorted((r["event_id"], round(r["similarity"], 9)) for r in got if r["query_id"] == q) == sorted(want) or {s for _, s in want} == {round(r["similarity"], 9) for r in got if r["query_id"] == q}
