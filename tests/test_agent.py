import pytest
from pyspark.sql import functions as F

from tessergraph.agent import ask
from tessergraph.sources import tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tools(spark):
    def search(question):
        return tables.event_log(spark, SF).limit(3).select(F.col("id").alias("event_id"))

    return ask.Tools(tables.nodes(spark, SF), tables.edges(spark, SF), search, "2024-01-31")


def test_answer_cites_its_events(tools):
    answer = ask.ask("What depends on part-6?", tools)
    assert answer.route == "neighbors" and answer.verified and answer.citations


def test_a_writer_that_invents_is_refused(tools):
    calls = []

    def writer(*args):
        calls.append(args[-1])
        return "made up [evt: nothing]"

    answer = ask.ask("notes about latency", tools, writer=writer)
    assert answer.error == "provenance_failed" and calls == [False, True, True]


def test_missing_input_and_broken_router_search(tools):
    assert ask.checked_input(ask.Route("kq3")).name == "search"
    assert ask.checked_input(ask.Route("neighbors", "", {"entity_id": "x", "edge_type": "LIKES"})).tool_input == {"entity_id": "x"}

    def router(question):
        raise RuntimeError

    assert ask.ask("anything at all", tools, router=router).route == "search"


def test_out_of_scope(tools):
    assert ask.ask("tell me a joke", tools).route == "unknown"
    with pytest.raises(ValueError):
        ask.ask("?", tools)


@pytest.mark.parametrize("question", ["Which decisions are contradicted in 30 days?", "What breaks if part-3 fails?", "Who owns the service behind D-100?"])
def test_graph_answers_cite_only_what_their_tool_gave(tools, question):
    good = ask.ask(question, tools)
    assert good.route in ("kq1", "kq2", "kq3") and good.verified and good.citations
    for text in ("made up [evt: nothing]", "no citation at all", f"half made up [evt: {good.citations[0]}] [evt: nothing]"):
        bad = ask.ask(question, tools, writer=lambda *a, text=text: text)
        assert not bad.verified and bad.error == "provenance_failed" and not bad.citations and bad.retries == ask.MAX_RETRIES


def test_only_structural_routes_stand_without_events():
    assert ask.accepted("aggregate", "42 [evt: nothing]", []) == (True, [])
    for route in ("kq1", "kq2", "kq3", "kq4", "search"):
        assert not ask.accepted(route, "42", [])[0] and not ask.accepted(route, "42 [evt: nothing]", [])[0]
    assert ask.accepted("neighbors", "x", ["e1"]) == (False, []) and ask.accepted("neighbors", "x [evt: e1]", ["e1"]) == (True, ["e1"])


def test_changes_are_cited(spark):
    nodes, edges = tables.nodes(spark, SF), tables.edges(spark, SF)
    tools = ask.Tools(nodes, edges, None, "2001-08-01")
    busiest = edges.where("edge_type = 'ABOUT'").groupBy("dst").count().orderBy(F.desc("count"), "dst").first()["dst"].split(":")[1]
    answer = ask.ask(f"What changed about part-{busiest} in 600 days?", tools)
    assert answer.route == "kq4" and answer.verified and set(answer.citations) <= {r["event_id"] for r in tools.provenance(ask.Route("kq4", "", {"target": f"part-{busiest}", "window_days": 600})).collect()}


def test_stream_has_the_events_of_every_step(tools):
    import json

    def read(frames):
        return [(f.split("\n")[0].removeprefix("event: "), json.loads(f.split("\n")[1].removeprefix("data: "))) for f in frames]

    events = read(ask.ask_stream("What depends on part-6?", tools))
    kinds = [k for k, _ in events]
    assert kinds[:3] == ["route", "tool_start", "tool_done"] and kinds[-3:] == ["verify_start", "verify_done", "complete"]
    text = "".join(d["text"] for k, d in events if k == "synthesis_token")
    assert events[-1][1]["verified"] and events[-1][1]["answer"] == text

    def broken(*args):
        raise RuntimeError("no model")

    assert read(ask.ask_stream("What depends on part-6?", tools, writer=broken))[-1] == ("error", {"error": "no model", "stage": "unknown"})
    assert read(ask.ask_stream("?", tools))[-1][0] == "error"


def test_citations_are_resolved_in_order(spark, tools):
    events = spark.createDataFrame([("a", "x" * 300), ("b", "short")], "id string, content string")
    got = ask.resolve_citations(spark.createDataFrame([(["b", "none", "a"],)], "ids array<string>"), events).collect()
    assert [(r["position"], r["id"], len(r["snippet"])) for r in got] == [(0, "b", 5), (2, "a", 200)]
    assert ask.entity_exists(tools.nodes, "PART-6") and not ask.entity_exists(tools.nodes, "no such name")
