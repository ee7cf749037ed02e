"""Questions in plain language: one route, one tool, an answer whose citations are checked.

Routing and writing are control plane and run on the driver; the tool call is
the only Spark job. Both take a model by injection; without one, a keyword
router and a template are used, so answers are deterministic.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessergraph.functions.exprs import ENDPOINTS, LABELS, answers_to
from tessergraph.functions.text import CITATION
from tessergraph.operators import typed
from tessergraph.operators.evaluation import STRUCTURAL_ROUTES

ROUTES = ("kq1", "kq2", "kq3", "kq4", "get_entity", "neighbors", "enumerate", "aggregate", "search", "unknown")
MAX_RETRIES = 2
_CITED = re.compile(CITATION)
_DECISION = re.compile(r"\bD-\d+\b")
_NAME = re.compile(r"@?[A-Za-z]+[-_#][\w#-]*\w")


@dataclass
class Route:
    name: str
    reasoning: str = ""
    tool_input: dict = field(default_factory=dict)


@dataclass
class Answer:
    text: str
    route: str
    citations: list[str]
    verified: bool
    retries: int = 0
    error: str | None = None
    rows: list[dict] = field(default_factory=list)


def route_question(question: str) -> Route:
    """The keyword router: the most specific route whose words occur."""
    low = question.lower()
    decision = _DECISION.search(question)
    name = next((m for m in _NAME.findall(question) if not _DECISION.fullmatch(m)), None)
    label = next((x for x in LABELS if re.search(rf"\b{x.lower()}s?\b|\bpeople\b" if x == "Person" else rf"\b{x.lower()}s?\b", low)), None)

    def said(*words: str) -> bool:
        return any(w in low for w in words)

    if decision and said("owner", "owns", "own "):
        return Route("kq1", "ownership behind a decision", {"decision_id": decision[0]})
    if said("contradict"):
        return Route("kq2", "contradicted decisions", _number(low, "window_days"))
    if name and said("blast", "fails", "breaks", "affected", "impact", "goes down"):
        return Route("kq3", "what an outage hits", {"service": name} | _number(low, "max_depth", "depth"))
    if name and said("changed", "changes", "what happened"):
        return Route("kq4", "changes of a target", {"target": name} | _number(low, "window_days"))
    if label and said("how many", "count", "number of"):
        return Route("aggregate", "a count", {"node_type": label} | ({"group_by": "OWNED_BY"} if said("per owner", "by owner", "per team", "by team") else {}))
    if name and said("depend", "who owns", "owned by", "member", "connected", "on the team"):
        kind = "DEPENDS_ON" if said("depend") else "OWNED_BY" if said("own") else "MEMBER_OF" if said("member") else None
        return Route("neighbors", "one hop", {"entity_id": name} | ({"edge_type": kind} if kind else {}))
    if label and said("list", "which", "show", "all "):
        return Route("enumerate", "a list", {"node_type": label} | ({"has_no_edge": "OWNED_BY"} if said("no owner", "without owner", "orphan") else {}))
    if (decision or name) and said("what is", "who is", "status", "handle", "tell me about"):
        return Route("get_entity", "one entity", {"entity_id": decision[0] if decision else name})
    if said("weather", "recipe", "football", "joke"):
        return Route("unknown", "not about the graph")
    return Route("search", "free text")


def _number(low: str, key: str, word: str = "day") -> dict:
    m = re.search(rf"(\d+)[ -]{word}|{word} (\d+)", low)
    return {key: int(m[1] or m[2])} if m else {}


def checked_input(route: Route) -> Route:
    """Known labels and edge types only (others are dropped); a route without what it needs becomes a search."""
    given = dict(route.tool_input)
    for key, known in (("node_type", LABELS), ("edge_type", ENDPOINTS), ("has_no_edge", ENDPOINTS), ("group_by", typed.GROUP_EDGES)):
        if key in given and given[key] not in known:
            del given[key]
    needs = {"kq1": "decision_id", "kq3": "service", "kq4": "target", "get_entity": "entity_id", "neighbors": "entity_id", "enumerate": "node_type", "aggregate": "node_type"}
    need = needs.get(route.name)
    if route.name not in ROUTES or (need and not given.get(need)):
        return Route("search", f"missing {need}" if need else "no such route")
    return Route(route.name, route.reasoning, given)


class Tools:
    """The closed set of tools over one graph. search: question -> DataFrame with event_id."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, search: Callable[[str], DataFrame], as_of: str):
        self.nodes, self.edges, self.search, self.as_of = nodes, edges, search, as_of

    def _target(self, name: str) -> DataFrame:
        return self.nodes.where(F.col("canonical_name") == name).select("node_id")

    def provenance(self, route: Route) -> DataFrame | None:
        """(element_key, event_id) behind an answer whose rows don't carry their events."""
        n, e, a = self.nodes, self.edges, route.tool_input
        if route.name == "kq2":
            return typed.contradiction_provenance(n, e, self.as_of, a.get("window_days", 30))
        if route.name == "kq3":
            return typed.blast_provenance(n, e, a["service"], a.get("max_depth", 5))
        if route.name == "kq4":
            return typed.change_provenance(n, e, self._target(a["target"]), self.as_of, a.get("window_days", 90))
        return None

    def run(self, route: Route, question: str) -> DataFrame | None:
        n, e, a = self.nodes, self.edges, route.tool_input
        if route.name == "kq1":
            return typed.find_chain_owner(n, e, a["decision_id"])
        if route.name == "kq2":
            return typed.find_contradictions(n, e, self.as_of, a.get("window_days", 30))
        if route.name == "kq3":
            return typed.blast_services(n, e, a["service"], a.get("max_depth", 5))
        if route.name == "kq4":
            return typed.track_changes(n, e, self._target(a["target"]), self.as_of, a.get("window_days", 90))
        if route.name == "get_entity":
            return typed.get_entity(n, e, a["entity_id"], a.get("node_type_hint"))
        if route.name == "neighbors":
            return typed.neighbors(n, e, a["entity_id"], a.get("edge_type"), a.get("direction", "both"), a.get("limit", 50))
        if route.name == "enumerate":
            return typed.enumerate_nodes(n, e, a["node_type"], a.get("status", "active"), a.get("has_no_edge"), a.get("team"), limit=a.get("limit", 100))
        if route.name == "aggregate":
            if "group_by" in a:
                return typed.aggregate_groups(n, e, a["node_type"], a["group_by"])
            return typed.aggregate_total(n, a["node_type"])
        return None if route.name == "unknown" else self.search(question)


def provenance(rows: list[dict]) -> list[str]:
    """Event ids of the rows: columns named event_id or ending in _event or event_id."""
    held = [r[c] for r in rows for c in r if (c == "event_id" or c.endswith(("_event", "event_id"))) and r[c]]
    return list(dict.fromkeys(held))


def template(question: str, route: Route, rows: list[dict], events: list[str], strict: bool) -> str:
    shown = "; ".join(", ".join(f"{k}={v}" for k, v in r.items() if v is not None) for r in rows[:5])
    return f"{len(rows)} rows by {route.name}: {shown}" + "".join(f" [evt: {e}]" for e in events[:5])


def inline_citations(text: str) -> list[str]:
    return list(dict.fromkeys(_CITED.findall(text)))


def is_verified(text: str, events: list[str]) -> bool:
    cited = inline_citations(text)
    return bool(cited) and set(cited) <= set(events)


def accepted(route: str, text: str, events: list[str]) -> tuple[bool, list[str]]:
    """Whether an answer stands, and its citations.

    Only a structural route without events stands without a citation, and then
    what it cites nevertheless is dropped. Every other answer cites, and cites
    nothing but events of its tool.
    """
    if route in STRUCTURAL_ROUTES and not events:
        return True, []
    return is_verified(text, events), inline_citations(text)


def _steps(question: str, tools: Tools, router: Callable[[str], Route], writer: Callable[..., str], most: int) -> Iterator[tuple[str, dict]]:
    """The steps of an answer as they happen: (event type, data); the last one holds the answer."""
    if not 3 <= len(question) <= 500:
        raise ValueError("a question has 3 to 500 characters")
    try:
        route = checked_input(router(question))
    except Exception:
        route = Route("search", "the router failed")
    yield "route", {"route": route.name, "reasoning": route.reasoning, "tool_input": route.tool_input}
    yield "tool_start", {"tool": route.name}
    found = tools.run(route, question)
    if found is None:
        yield "tool_done", {"tool": route.name, "rows": 0, "events": 0}
        yield "complete", {"answer": Answer("This is not about the graph.", route.name, [], False)}
        return
    rows = [r.asDict(recursive=True) for r in found.limit(most).collect()]
    events = provenance(rows)
    behind = tools.provenance(route) if rows else None
    if behind is not None:
        events = [r["event_id"] for r in behind.select("event_id").distinct().orderBy("event_id").limit(most).collect()]
    yield "tool_done", {"tool": route.name, "rows": len(rows), "events": len(events)}
    if not rows or (not events and route.name not in STRUCTURAL_ROUTES):
        yield "complete", {"answer": Answer("Nothing in the graph answers this.", route.name, [], False, rows=rows)}
        return
    text, retry = "", 0
    for retry in range(MAX_RETRIES + 1):
        yield "synthesis_start", {"retry": retry > 0}
        text = writer(question, route, rows, events, retry > 0)
        for word in re.findall(r"\S+\s*", text):
            yield "synthesis_token", {"text": word}
        yield "synthesis_done", {"characters": len(text)}
        yield "verify_start", {}
        verified, citations = accepted(route.name, text, events)
        yield "verify_done", {"verified": verified, "citations": citations, "retry": retry}
        if verified:
            yield "complete", {"answer": Answer(text, route.name, citations, True, retry, None, rows)}
            return
    yield "complete", {"answer": Answer(text, route.name, [], False, retry, "provenance_failed", rows)}


def ask(question: str, tools: Tools, router: Callable[[str], Route] = route_question, writer: Callable[..., str] = template, most: int = 200) -> Answer:
    """Route, run, write, verify. An answer that cites what the tool didn't return is written again, more strictly, at most twice.

    most: rows shown to the writer, and events that it may cite.
    """
    *_, (_, last) = _steps(question, tools, router, writer, most)
    return last["answer"]


def framed(kind: str, data: dict) -> str:
    """A server-sent event: its type, its data as JSON, an empty line."""
    return f"event: {kind}\ndata: {json.dumps(data, default=str)}\n\n"


def ask_stream(question: str, tools: Tools, router: Callable[[str], Route] = route_question, writer: Callable[..., str] = template, most: int = 200) -> Iterator[str]:
    """The same as server-sent events, while it happens; what goes wrong is the last event, of type error."""
    began = time.monotonic()
    try:
        for kind, data in _steps(question, tools, router, writer, most):
            if kind == "complete":
                a = data["answer"]
                data = {"answer": a.text, "route": a.route, "citations": a.citations, "verified": a.verified, "retries": a.retries, "error": a.error, "latency_ms": round(1000 * (time.monotonic() - began), 1)}
            yield framed(kind, data)
    except Exception as error:
        yield framed("error", {"error": str(error)[:500], "stage": "unknown"})


def resolve_citations(cited: DataFrame, events: DataFrame, size: int = 200) -> DataFrame:
    """cited: (ids array) -> position, id, snippet of those that exist, in order."""
    each = cited.select(F.posexplode("ids").alias("position", "id"))
    return each.join(events.select("id", F.substring("content", 1, size).alias("snippet")), "id").orderBy("position")


def entity_exists(nodes: DataFrame, name: str) -> bool:
    return not nodes.where(answers_to(name)).isEmpty()

