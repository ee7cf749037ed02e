"""The closed set of typed queries over the resolved view. DataFrame in, flat DataFrame out."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessergraph.functions.exprs import MERGE, answers_to, display_name, effective_status, in_window, joined, resolved, stamp, status_mode, view_label
from tessergraph.operators.traverse import MAX_DEPTH, levels, reachable, trails

GROUP_EDGES = ("OWNED_BY", "MEMBER_OF", "DEPENDS_ON")
ORDERS = ("name", "valid_from_asc", "valid_from_desc", "created_at_asc", "created_at_desc")


def edge(edges: DataFrame, *kinds: str) -> DataFrame:
    return edges.where(F.col("edge_type").isin(*kinds))


#: Edges as a table, or as a function that gives those at some nodes (ids), for sources that find them by key.
Edges = DataFrame | Callable[[list[str] | None], DataFrame]
#: Nodes whose ids are sent to a scan; of more the edges are joined.
MOST_IDS = 1000


def edges_at(edges: Edges, nodes: DataFrame) -> DataFrame:
    """The edges that touch ``nodes`` (node_id), or a few more: their ids are a filter of the scan while they are few."""
    ids = [r[0] for r in nodes.select("node_id").distinct().limit(MOST_IDS + 1).collect()]
    few = len(ids) <= MOST_IDS
    if callable(edges):
        return edges(ids if few else None)
    return edges.where(F.col("src").isin(ids) | F.col("dst").isin(ids)) if few else edges


def live(nodes: DataFrame, *labels: str) -> DataFrame:
    found = nodes.where(resolved())
    return found.where(F.col("label").isin(*labels)) if labels else found


def bounded(value: int, low: int, high: int, what: str) -> int:
    if not low <= value <= high:
        raise ValueError(f"{what} must lie between {low} and {high}")
    return value


def find_chain_owner(nodes: DataFrame, edges: Edges, decision_id: str) -> DataFrame:
    """KQ1: decision -DEPRECATES-> system <-DEPENDS_ON- service -OWNED_BY-> owner, teams opened to their members.

    One row per chain. A team whose members are all merged, or that has none,
    gives one chain with a null person. Services without an owner vanish.
    """
    d = live(nodes, "Decision").where(F.col("id") == decision_id).select(F.col("node_id").alias("d"), F.col("title").alias("decision_title"))
    systems = live(nodes, "System").select(F.col("node_id").alias("y"), F.col("canonical_name").alias("system"))
    services = live(nodes, "Service").select(F.col("node_id").alias("s"), F.col("canonical_name").alias("service"))
    owners = live(nodes).select(F.col("node_id").alias("o"), F.col("label").alias("owner_type"), F.coalesce("canonical_name", "canonical_id").alias("owner_id"), F.col("canonical_id").alias("owner_person"))
    people = live(nodes, "Person").select(F.col("node_id").alias("p"), F.col("canonical_id").alias("member"))
    # A decision's systems and their services are found by key, owners by a join.
    dropped = edge(edges_at(edges, d.select(F.col("d").alias("node_id"))), "DEPRECATES")
    used = edge(edges_at(edges, dropped.join(d.select(F.col("d").alias("src")), "src", "left_semi").select(F.col("dst").alias("node_id"))), "DEPENDS_ON")
    edges = edges(None) if callable(edges) else edges
    members = edge(edges, "MEMBER_OF").select(F.col("src").alias("p"), F.col("dst").alias("team"), F.col("source_event_id").alias("member_event")).join(people, "p")

    chain = (
        d.join(dropped.select(F.col("src").alias("d"), F.col("dst").alias("y"), F.col("source_event_id").alias("deprecates_event")), "d")
        .join(systems, "y")
        .join(used.select(F.col("src").alias("s"), F.col("dst").alias("y"), F.col("source_event_id").alias("depends_event")), "y")
        .join(services, "s")
        .join(edge(edges, "OWNED_BY").select(F.col("src").alias("s"), F.col("dst").alias("o"), F.col("source_event_id").alias("owned_event")), "s")
        .join(owners, "o")
    )
    opened = chain.join(members, (F.col("o") == F.col("team")) & (F.col("owner_type") == "Team"), "left")
    person = F.when(F.col("owner_type") == "Team", F.col("member")).when(F.col("owner_type") == "Person", F.col("owner_person"))
    hops = F.when((F.col("owner_type") == "Team") & F.col("member").isNotNull(), 4).otherwise(3)
    return opened.select(
        "decision_title", "system", "service", "owner_type", "owner_id", person.alias("person_id"), hops.cast("long").alias("hops"),
        "deprecates_event", "depends_event", "owned_event", "member_event",
    )


def find_contradictions(nodes: DataFrame, edges: DataFrame, as_of: str, window_days: int = 30) -> DataFrame:
    """KQ2: active decisions that messages of the window contradict, with the messages; most messages first."""
    bounded(window_days, 1, 365, "window_days")
    messages = live(nodes, "Message").where(in_window(F.col("created_at"), as_of, window_days)).select(F.col("node_id").alias("src"), F.col("id").alias("message_id"))
    decisions = nodes.where((F.col("label") == "Decision") & (effective_status() == "active")).select(F.col("node_id").alias("dst"), F.col("id").alias("decision_id"), "title")
    met = edge(edges, "CONTRADICTS").select("src", "dst", "confidence").join(messages, "src").join(decisions, "dst")
    rows = met.groupBy("decision_id", "title").agg(
        F.count("*").alias("n_messages"), F.array_join(F.sort_array(F.collect_list("message_id")), ",").alias("message_ids"), F.max("confidence").alias("max_confidence")
    )
    return rows.orderBy(F.desc("n_messages"), "decision_id")


def _contradicting(nodes: DataFrame, edges: DataFrame, as_of: str, window_days: int) -> DataFrame:
    messages = live(nodes, "Message").where(in_window(F.col("created_at"), as_of, window_days))
    messages = messages.select(F.col("node_id").alias("src"), F.col("id").alias("message_id"), F.col("created_at").alias("said_at"), F.col("source_event_ids").alias("message_events"))
    decisions = nodes.where((F.col("label") == "Decision") & (effective_status() == "active"))
    decisions = decisions.select(F.col("node_id").alias("dst"), F.col("id").alias("decision_id"), F.col("source_event_ids").alias("decision_events"))
    return edge(edges, "CONTRADICTS").select("src", "dst", "confidence", "source_event_id").join(messages, "src").join(decisions, "dst")


def contradicting_messages(nodes: DataFrame, edges: DataFrame, as_of: str, window_days: int = 30) -> DataFrame:
    """KQ2 in long form: one row per decision and message, with when it was said and how sure the verdict is."""
    bounded(window_days, 1, 365, "window_days")
    return _contradicting(nodes, edges, as_of, window_days).select("decision_id", "message_id", stamp(F.col("said_at")).alias("said_at"), "confidence", "source_event_id")


def _provenance(*parts: tuple[DataFrame, Column, Column]) -> DataFrame:
    """(element_key, event_id) of parts (rows, key, events), distinct, without null and empty events."""
    each = [rows.select(key.alias("element_key"), F.explode(events).alias("event_id")) for rows, key, events in parts]
    return reduce(DataFrame.union, each).where("event_id IS NOT NULL AND event_id != ''").distinct()


def contradiction_provenance(nodes: DataFrame, edges: DataFrame, as_of: str, window_days: int = 30) -> DataFrame:
    """KQ2: the events behind each decision and behind each contradicting message and its edge, in long form."""
    bounded(window_days, 1, 365, "window_days")
    met = _contradicting(nodes, edges, as_of, window_days)
    decision, link = F.concat(F.lit("node:Decision:"), "decision_id"), F.concat(F.lit("edge:CONTRADICTS:"), "message_id", F.lit("->"), "decision_id")
    return _provenance((met, decision, F.col("decision_events")), (met, link, F.array("source_event_id")), (met, link, F.col("message_events")))


def dependency_links(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """DEPENDS_ON links between nodes of any label that are not merged."""
    merged = nodes.where(~resolved()).select("node_id")  # of most labels there are none, so little is read
    links = edge(edges, "DEPENDS_ON").select("src", "dst")
    return links.join(merged, F.col("src") == F.col("node_id"), "left_anti").join(merged, F.col("dst") == F.col("node_id"), "left_anti")


def _seed(nodes: DataFrame, service: str) -> DataFrame:
    return live(nodes, "Service").where(F.col("canonical_name") == service).select(F.col("node_id").alias("node"))


def blast_services(nodes: DataFrame, edges: DataFrame, service: str, max_depth: int = 5, acyclic: bool = False) -> DataFrame:
    """KQ3: services that depend on ``service`` through at most max_depth links, with the least and longest trail.

    Longest is that of trails, not the distance. On a graph known to be acyclic
    walks are trails, and `levels` avoids listing them.
    """
    links, seed = dependency_links(nodes, edges), _seed(nodes, service)
    found = levels(links, seed, max_depth) if acyclic else trails(links, seed, max_depth)
    names = live(nodes, "Service").select(F.col("node_id").alias("node"), F.col("canonical_name").alias("service"))
    depths = found.groupBy("node").agg(F.min("depth").cast("long").alias("min_depth"), F.max("depth").cast("long").alias("max_depth"))
    return depths.join(names, "node").where(F.col("service") != service).select("service", "min_depth", "max_depth")


def _impacted(nodes: DataFrame, edges: DataFrame, service: str, max_depth: int) -> DataFrame:
    """The seed and the services that reach it; a shortest path is a trail, so no trail has to be listed."""
    seed = _seed(nodes, service)
    found = reachable(dependency_links(nodes, edges), seed, max(1, min(max_depth, MAX_DEPTH))).select("node")
    services = live(nodes, "Service").select(F.col("node_id").alias("node"))
    return seed.union(found.join(services, "node", "left_semi")).distinct()


def blast_people(nodes: DataFrame, edges: DataFrame, service: str, max_depth: int = 5) -> DataFrame:
    """KQ3: people who own what is hit or belong to an owning team; a team without members adds nobody."""
    hit = _impacted(nodes, edges, service, max_depth)
    owners = live(nodes).select(F.col("node_id").alias("owner"), F.col("canonical_id").alias("owner_person"))
    owned = hit.join(edge(edges, "OWNED_BY").select(F.col("src").alias("node"), F.col("dst").alias("owner")), "node").join(owners, "owner").select("owner", "owner_person").distinct()
    people = live(nodes, "Person").select(F.col("node_id").alias("p"), F.col("canonical_id").alias("member"))
    members = edge(edges, "MEMBER_OF").select(F.col("src").alias("p"), F.col("dst").alias("owner")).join(people, "p")
    return owned.join(members, "owner", "left").select(F.coalesce("member", "owner_person").alias("person_id")).where("person_id IS NOT NULL").distinct()


def blast_decisions(nodes: DataFrame, edges: DataFrame, service: str, max_depth: int = 5) -> DataFrame:
    """KQ3: decisions, superseded ones too, about or deprecating what is hit."""
    hit = _impacted(nodes, edges, service, max_depth)
    decisions = live(nodes, "Decision").select(F.col("node_id").alias("src"), F.col("id").alias("decision_id"))
    touching = edge(edges, "ABOUT", "DEPRECATES").select("src", F.col("dst").alias("node"))
    return hit.join(touching, "node").join(decisions, "src").select("decision_id").distinct()


def blast_provenance(nodes: DataFrame, edges: DataFrame, service: str, max_depth: int = 5) -> DataFrame:
    """KQ3: the events behind every link of every trail, in long form."""
    used = trails(dependency_links(nodes, edges), _seed(nodes, service), max_depth).select(F.explode("links").alias("element_key")).distinct()
    asserted = edge(edges, "DEPENDS_ON").select(F.concat_ws(">", "src", "dst").alias("element_key"), F.col("source_event_id").alias("event_id"))
    return used.join(asserted, "element_key").distinct()


def _changes(nodes: DataFrame, edges: DataFrame, target: DataFrame, as_of: str, window_days: int) -> DataFrame:
    """Decisions (src and their columns) of the window about or deprecating ``target``."""
    bounded(window_days, 1, 3650, "window_days")
    goal = live(nodes, "System", "Service").join(target, "node_id", "left_semi").select(F.col("node_id").alias("dst"))
    decisions = live(nodes, "Decision").where(in_window(F.col("valid_from"), as_of, window_days))
    decisions = decisions.select(F.col("node_id").alias("src"), F.col("id").alias("decision_id"), "title", "status", "valid_from", "source_event_ids")
    return edge(edges, "ABOUT", "DEPRECATES").select("src", "dst").join(goal, "dst").select("src").distinct().join(decisions, "src")


def _approved(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    people = live(nodes, "Person").select(F.col("node_id").alias("p"), F.col("canonical_id").alias("approver"))
    return edge(edges, "APPROVED_BY").select("src", F.col("dst").alias("p"), "source_event_id").join(people, "p").select("src", "approver", "source_event_id")


def _replaced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    older = nodes.where("label = 'Decision'").select(F.col("node_id").alias("q"), F.col("id").alias("older"))
    return edge(edges, "SUPERSEDES").select("src", F.col("dst").alias("q"), "source_event_id").join(older, "q").select("src", "older", "source_event_id")


def track_changes(nodes: DataFrame, edges: DataFrame, target: DataFrame, as_of: str, window_days: int = 90) -> DataFrame:
    """KQ4: decisions of the window about or deprecating ``target`` (node_id), newest first by their valid_from.

    Approvers are resolved persons; superseded decisions are named whatever their status.
    """
    met = _changes(nodes, edges, target, as_of, window_days).drop("source_event_ids")
    rows = met.join(_approved(nodes, edges), "src", "left").join(_replaced(nodes, edges), "src", "left").groupBy("decision_id", "title", "status", "valid_from")
    rows = rows.agg(joined(F.col("approver")).alias("approvers"), joined(F.col("older")).alias("supersedes"))
    return rows.orderBy(F.desc("valid_from"), "decision_id").withColumn("valid_from", stamp(F.col("valid_from")))


def change_provenance(nodes: DataFrame, edges: DataFrame, target: DataFrame, as_of: str, window_days: int = 90) -> DataFrame:
    """KQ4: the events behind each decision, its approvals and its supersessions, in long form."""
    met = _changes(nodes, edges, target, as_of, window_days).select("src", "decision_id", "source_event_ids")

    def key(kind: str) -> Column:
        return F.concat(F.lit(f"{kind}:"), "decision_id")

    event = F.array("source_event_id")
    return _provenance(
        (met, key("node:Decision"), F.col("source_event_ids")),
        (met.join(_approved(nodes, edges), "src"), key("edge:APPROVED_BY"), event),
        (met.join(_replaced(nodes, edges), "src"), key("edge:SUPERSEDES"), event),
    )


def _ordering(order: str) -> list[Column]:
    if order not in ORDERS:
        raise ValueError(f"order {order!r}")
    if order == "name":
        return [F.col("name").asc_nulls_last(), F.col("node_id")]
    column, _, way = order.rpartition("_")
    key = F.col(column)
    # Nulls are the largest values, so they end an ascending order and begin a descending one.
    return [key.asc_nulls_last() if way == "asc" else key.desc_nulls_first(), F.col("node_id")]


def enumerate_nodes(
    nodes: DataFrame, edges: DataFrame, label: str, status: str = "active", without_edge: str | None = None, team: str | None = None, order: str = "name", limit: int = 100
) -> DataFrame:
    """Nodes of a label, with their number before the limit.

    without_edge: no outgoing edge of the type, to any node. team: an outgoing
    OWNED_BY or MEMBER_OF edge to a team of the name, in any case.
    """
    bounded(limit, 1, 500, "limit")
    found = nodes.where((F.col("label") == label) & status_mode(status))
    if without_edge is not None:
        found = found.join(edge(edges, without_edge).select(F.col("src").alias("node_id")), "node_id", "left_anti")
    if team is not None:
        teams = nodes.where((F.col("label") == "Team") & (F.lower("canonical_name") == team.lower())).select(F.col("node_id").alias("dst"))
        held = edge(edges, "OWNED_BY", "MEMBER_OF").join(teams, "dst", "left_semi").select(F.col("src").alias("node_id"))
        found = found.join(held, "node_id", "left_semi")
    named = found.select("node_id", display_name().alias("name"), effective_status().alias("status"), "valid_from", "created_at")
    top = named.orderBy(*_ordering(order)).limit(limit)
    place = F.row_number().over(Window.orderBy(*_ordering(order)))  # over at most ``limit`` rows
    total = named.agg(F.count("*").alias("n"))
    return top.select(place.cast("long").alias("place"), "name", "status").withColumn("total_count", total.scalar())


def aggregate_total(nodes: DataFrame, label: str, status: str = "active") -> DataFrame:
    return nodes.where((F.col("label") == label) & status_mode(status)).agg(F.count("*").alias("total"))


def aggregate_groups(nodes: DataFrame, edges: DataFrame, label: str, group_by: str, status: str = "active", order: str = "count_desc", limit: int = 20) -> DataFrame:
    """Edges of a type from nodes of a label, counted by the node they lead to."""
    if group_by not in GROUP_EDGES:
        raise ValueError(f"group_by {group_by!r}")
    bounded(limit, 1, 100, "limit")
    sources = nodes.where((F.col("label") == label) & status_mode(status)).select(F.col("node_id").alias("src"))
    ends = live(nodes).select(F.col("node_id").alias("dst"), display_name().alias("group_name"), F.col("label").alias("group_type"))
    counted = (
        edge(edges, group_by).select("src", "dst").join(sources, "src", "left_semi").groupBy("dst").agg(F.count("*").alias("n"))
        .join(ends, "dst").groupBy("group_name", "group_type").agg(F.sum("n").alias("n_edges"))
    )
    orders = {"count_desc": [F.desc("n_edges")], "count_asc": [F.asc("n_edges")], "name_asc": []}
    return counted.orderBy(*orders[order], "group_name", "group_type").limit(limit)


def anchors(nodes: DataFrame, name: str, label: str | None = None) -> DataFrame:
    found = live(nodes).where(answers_to(name))
    return found.where(F.col("label") == label) if label else found


def get_entity(nodes: DataFrame, edges: Edges, name: str, label: str | None = None) -> DataFrame:
    """The first node by display name that answers to ``name``, with its edge types to resolved nodes, by direction."""
    first = anchors(nodes, name, label).select("node_id", display_name().alias("entity"), F.col("label").alias("node_type")).orderBy("entity", "node_id").limit(1)
    other = live(nodes).select(F.col("node_id").alias("other"))
    edges = edges_at(edges, first)
    ways = [
        edges.where(F.col("edge_type") != MERGE).select(F.col(a).alias("node_id"), F.col(b).alias("other"), "edge_type", F.lit(w).alias("direction"))
        for a, b, w in (("src", "dst", "out"), ("dst", "src", "in"))
    ]
    met = reduce(DataFrame.union, ways).join(F.broadcast(first), "node_id").join(other, "other", "left_semi")
    return met.groupBy("entity", "node_type", "direction", "edge_type").agg(F.count("*").alias("n_edges"))


def neighbors(nodes: DataFrame, edges: Edges, name: str, edge_type: str | None = None, direction: str = "both", limit: int = 50) -> DataFrame:
    """Resolved neighbours of all nodes that answer to ``name``; a self-loop counts once, as outgoing."""
    bounded(limit, 1, 200, "limit")
    anchored = anchors(nodes, name).select(F.col("node_id").alias("anchor"))
    edges = edges_at(edges, anchored.select(F.col("anchor").alias("node_id")))
    wanted = edges.where(F.col("edge_type") != MERGE) if edge_type is None else edge(edges, edge_type)
    out = wanted.select(F.col("src").alias("anchor"), F.col("dst").alias("other"), "edge_type", "source_event_id", F.lit(True).alias("outgoing"))
    back = wanted.where("src != dst").select(F.col("dst").alias("anchor"), F.col("src").alias("other"), "edge_type", "source_event_id", F.lit(False).alias("outgoing"))
    ways = {"out": out, "in": back, "both": out.union(back)}[direction]
    if direction == "in":
        ways = ways.union(out.where("anchor = other").withColumn("outgoing", F.lit(False)))
    ends = live(nodes).select(F.col("node_id").alias("other"), display_name().alias("neighbor"), F.col("label").alias("neighbor_type"))
    met = ways.join(anchored, "anchor").join(ends, "other")
    met = met.select("neighbor", "neighbor_type", "edge_type", "outgoing", F.nullif("source_event_id", F.lit("")).alias("source_event_id"))
    top = met.orderBy("edge_type", "neighbor", "outgoing", "source_event_id", "neighbor_type").limit(limit)
    return top.withColumn("total_count", met.agg(F.count("*").alias("n")).scalar())


def graph_view(nodes: DataFrame, edges: DataFrame, view: str = "resolved", ends_live: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a drawing. resolved: no merged node, no MERGE_INTO, no edge at a merged node or at none.

    ends_live: the source has seen to the ends already, so edges needn't meet nodes.
    """
    shown, links = nodes, edges.withColumn("is_merge_into", F.col("edge_type") == MERGE)
    if view == "resolved":
        shown, links = live(nodes), links.where("NOT is_merge_into")
        if not ends_live:
            ids = shown.select("node_id")
            links = links.join(ids, F.col("src") == F.col("node_id"), "left_semi").join(ids, F.col("dst") == F.col("node_id"), "left_semi")
    elif view != "fragmented":
        raise ValueError(f"view {view!r}")
    return shown.select("node_id", "label", view_label().alias("shown"), effective_status().alias("status")), links.select("src", "dst", "edge_type", "is_merge_into")


def node_exists(nodes: DataFrame, label: str, name: str) -> bool:
    """Merged nodes exist, too."""
    return not nodes.where((F.col("label") == label) & (display_name() == name)).isEmpty()
