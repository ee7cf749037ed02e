"""Registered queries over ground truth, sinks, merges and text rules, each with SQL for the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessergraph.agent import ask
from tessergraph.functions import exprs, text
from tessergraph.operators import extraction, resolution, temporal, truth
from tessergraph.plans.catalog import GRAPH, INSIDE_SQL, LOG, NODES, NORMAL, _graph, _inside, query
from tessergraph.sources import tables
from tessergraph.sources.store import Store, hadoop_path, shared_folder

# ground truth


def _normal(x: str) -> str:
    return NORMAL.format(x=x)


#: Surfaces by which things are known: parts by names that several share, persons by two, teams by names that persons have, too.
SURFACES = f"""s AS (SELECT 'Service' AS label, p_name AS surface, 'part-' || p_partkey AS canonical, p_partkey AS place FROM part
  UNION ALL SELECT 'Person', c_name, 'c-' || c_custkey, c_custkey FROM customer UNION ALL SELECT 'Person', '@c' || c_custkey, 'c-' || c_custkey, c_custkey FROM customer
  UNION ALL SELECT 'Team', 'CUSTOMER ' || lpad(n_nationkey::VARCHAR, 9, '0'), 'team-' || n_nationkey, n_nationkey FROM nation),
ix AS (SELECT label, {_normal("surface")} AS alias, arg_min(canonical, place) AS canonical FROM s WHERE {_normal("surface")} <> '' GROUP BY 1, 2)"""


def _index(spark, sf) -> DataFrame:
    def named(name: str, label: str, surface, prefix: str, key: str) -> DataFrame:
        return tables.table(spark, sf, name).select(F.lit(label).alias("label"), surface.alias("surface"), tables.name_of(prefix, key).alias("canonical"), F.col(key).cast("long").alias("place"))

    people = named("customer", "Person", F.col("c_name"), "c-", "c_custkey").union(named("customer", "Person", tables.name_of("@c", "c_custkey"), "c-", "c_custkey"))
    teams = named("nation", "Team", F.concat(F.lit("CUSTOMER "), F.lpad(F.col("n_nationkey").cast("string"), 9, "0")), "team-", "n_nationkey")
    return truth.alias_index(named("part", "Service", F.col("p_name"), "part-", "p_partkey").union(people).union(teams))


@query("truth_canonicalize", f"""WITH {SURFACES}, m AS (SELECT 'Service' AS label, ' ' || upper(p_name) || '! ' AS name, p_partkey AS key FROM part UNION ALL SELECT 'Person', '@' || upper(c_name), c_custkey FROM customer
  UNION ALL SELECT 'Person', s_name, s_suppkey FROM supplier UNION ALL SELECT 'Team', c_name, c_custkey FROM customer)
SELECT m.label, m.key, coalesce(ix.canonical, {_normal("m.name")}) AS canonical FROM m LEFT JOIN ix ON ix.label = m.label AND ix.alias = {_normal("m.name")}""")  # fmt: skip
def truth_canonicalize(spark, sf):
    """Parts and persons by altered names, suppliers and persons under labels that don't know them."""

    def mentions(name: str, label: str, said, key: str) -> DataFrame:
        return tables.table(spark, sf, name).select(F.lit(label).alias("label"), said.alias("name"), F.col(key).alias("key"))

    parts = mentions("part", "Service", F.concat(F.lit(" "), F.upper("p_name"), F.lit("! ")), "p_partkey")
    people = mentions("customer", "Person", F.concat(F.lit("@"), F.upper("c_name")), "c_custkey")
    others = mentions("supplier", "Person", F.col("s_name"), "s_suppkey").union(mentions("customer", "Team", F.col("c_name"), "c_custkey"))
    return truth.canonicalized(parts.union(people).union(others), _index(spark, sf)).select("label", "key", "canonical")


@query("truth_endpoints", f"""WITH {SURFACES}, k AS (SELECT alias, arg_min(canonical, CASE label WHEN 'Team' THEN 1 ELSE 2 END) AS canonical FROM ix WHERE label IN ('Team', 'Person') GROUP BY 1),
r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '@C' || o_custkey WHEN o_orderkey % 3 = 1 THEN 'customer ' || lpad(o_custkey::VARCHAR, 9, '0') ELSE 'Nobody ' || o_custkey END AS src_name FROM orders)
SELECT o_orderkey, coalesce(k.canonical, {_normal("src_name")}) AS src_key FROM r LEFT JOIN k ON k.alias = {_normal("src_name")}""")  # fmt: skip
def truth_endpoints(spark, sf):
    """Who approved each order: a team if one has the name, else a person, else the name itself."""
    k, who = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    said = F.when(k % 3 == 0, F.concat(F.lit("@C"), who)).when(k % 3 == 1, F.concat(F.lit("customer "), F.lpad(who, 9, "0"))).otherwise(F.concat(F.lit("Nobody "), who))
    relations = tables.table(spark, sf, "orders").select("o_orderkey", said.alias("src_name"))
    return truth.canonical_endpoints(relations, _index(spark, sf), "src", ("Team", "Person")).select("o_orderkey", "src_key")


#: Surfaces of documents: two words of each; those of every second one are turned round, so few texts have them.
EXPECTED = f"""WITH {LOG}, s AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN w ELSE reverse(w) END AS surface FROM (SELECT doc_id, regexp_extract(text, '([a-z]+ [a-z]+)', 1) AS w FROM documents) WHERE w <> ''),
u AS (SELECT DISTINCT surface FROM s), f AS (SELECT surface FROM u WHERE EXISTS (SELECT 1 FROM log WHERE contains(lower(log.content), lower(u.surface)))), x AS (SELECT DISTINCT doc_id FROM s JOIN f USING (surface))"""


def _expected(spark, sf) -> DataFrame:
    two = F.regexp_extract("text", "([a-z]+ [a-z]+)", 1)
    surfaces = tables.table(spark, sf, "documents").select("doc_id", two.alias("w")).where("w != ''")
    named = surfaces.select(F.lit("Service").alias("label"), F.when(F.col("doc_id") % 2 == 0, F.col("w")).otherwise(F.reverse("w")).alias("surface"), tables.name_of("doc-", "doc_id").alias("canonical"))
    return truth.expected_entities(named, tables.event_log(spark, sf))


@query("truth_entities", f"{EXPECTED} SELECT 'Service' AS label, 'doc-' || doc_id AS canonical FROM x")
def truth_entities(spark, sf):
    return _expected(spark, sf)


@query("truth_edges", f"{EXPECTED} SELECT 'DEPENDS_ON' AS edge_type, 'doc-' || d.doc_id AS src, 'doc-' || d.doc_id // 2 AS dst FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM x) AND d.doc_id // 2 IN (SELECT doc_id FROM x)")
def truth_edges(spark, sf):
    planted = tables.table(spark, sf, "documents").select(F.lit("DEPENDS_ON").alias("edge_type"), tables.name_of("doc-", "doc_id").alias("src"), F.concat(F.lit("doc-"), F.expr("doc_id div 2").cast("string")).alias("dst"))
    return truth.expected_edges(planted, _expected(spark, sf)).select("edge_type", "src", "dst")


@query("provenance_union", f"""{GRAPH}, p AS (SELECT node_id AS element_key, unnest(source_event_ids) AS event_id FROM nodes UNION ALL SELECT src, source_event_id FROM edges)
SELECT element_key, string_agg(DISTINCT event_id, ',' ORDER BY event_id) AS events FROM p WHERE event_id IS NOT NULL AND event_id <> '' GROUP BY 1""")  # fmt: skip
def provenance_union(spark, sf):
    """The events of each node and of the edges that leave it."""
    nodes, edges = _graph(spark, sf)
    held = nodes.select(F.col("node_id").alias("element_key"), F.explode("source_event_ids").alias("event_id")).union(edges.select("src", "source_event_id"))
    return truth.provenance_union(held).select("element_key", F.array_join("events", ",").alias("events"))


@query("earliest_events", f"""WITH {NODES}, c AS (SELECT node_id, unnest(source_event_ids) AS event_id FROM nodes)
SELECT c.node_id, strftime(min(e.ts), '%Y-%m-%d %H:%M:%S') AS first_event FROM c JOIN events e ON 'ev-' || e.event_id = c.event_id GROUP BY 1""")  # fmt: skip
def earliest_events(spark, sf):
    return truth.earliest_events(tables.nodes(spark, sf), tables.raw_events(spark, sf)).select("node_id", exprs.stamp(F.col("first_event")).alias("first_event"))


@query("resolve_citations", f"""WITH {LOG}, c AS (SELECT unnest([1, 2, 3]) - 1 AS position, unnest(['gone-' || doc_id, 'doc-' || doc_id, 'doc-' || doc_id // 2]) AS id FROM documents)
SELECT c.position::INT AS position, c.id, left(log.content, 200) AS snippet FROM c JOIN log ON log.id = c.id""")  # fmt: skip
def resolve_citations(spark, sf):
    """Each document cites an event that was never logged, itself, and an earlier one."""
    half = F.concat(F.lit("doc-"), F.expr("doc_id div 2").cast("string"))
    cited = tables.table(spark, sf, "documents").select(F.array(tables.name_of("gone-", "doc_id"), tables.name_of("doc-", "doc_id"), half).alias("ids"))
    return ask.resolve_citations(cited, tables.event_log(spark, sf))


# merges


@query("transitive_losers", """WITH RECURSIVE m AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey > 1 AND p_partkey % 7 <> 0),
w(k) AS (SELECT src FROM m WHERE dst = 1 UNION SELECT m.src FROM m JOIN w ON m.dst = w.k) SELECT 'Service:' || k AS node FROM w""")  # fmt: skip
def transitive_losers(spark, sf):
    """All that went into the first part, when each part but every seventh is merged into the one of half its number."""
    parts = tables.table(spark, sf, "part").where("p_partkey > 1 AND p_partkey % 7 != 0")
    merges = parts.select(tables.name_of("Service:", "p_partkey").alias("src"), F.concat(F.lit("Service:"), F.expr("p_partkey div 2").cast("string")).alias("dst"))
    return resolution.transitive_losers(merges, "Service:1")


MERGED_BY = "doc-100"


@query("merges_of_event", f"""{GRAPH}, t AS (SELECT node_id FROM nodes WHERE list_contains(source_event_ids, '{MERGED_BY}'))
SELECT DISTINCT src AS loser, dst AS winner, confidence, tier FROM edges WHERE edge_type = 'MERGE_INTO' AND (src IN (SELECT node_id FROM t) OR dst IN (SELECT node_id FROM t))""")  # fmt: skip
def merges_of_event(spark, sf):
    return resolution.merges_of_event(*_graph(spark, sf), MERGED_BY)


@query("canonical_candidates", f"""WITH {NODES} SELECT label, coalesce(CASE label WHEN 'Person' THEN canonical_id ELSE canonical_name END, id) AS key, node_id FROM nodes
WHERE label IN ('Person', 'Service', 'Decision') AND coalesce(status, 'active') <> 'merged'""")  # fmt: skip
def canonical_candidates(spark, sf):
    nodes = tables.nodes(spark, sf)
    people = resolution.canonical_candidates(nodes, "Person", "canonical_id")
    named = resolution.canonical_candidates(nodes, "Service", "canonical_name").unionByName(resolution.canonical_candidates(nodes, "Decision", "canonical_name"))
    return people.unionByName(named).select("label", "key", "node_id")


# contradictions by message and by decision

SCOPED_DECISION, SCOPED_UNTIL, SCOPED_DAYS = "D-1", "2024-02-03 12:00:00", 2


@query("contradiction_candidates_of_decision", f"""{INSIDE_SQL} SELECT message_id, decision_id, CASE WHEN named THEN 'id' ELSE 'subject' END AS "by" FROM f JOIN conversations c ON 'msg-' || c.conv_id || '-' || c.turn = f.message_id
WHERE decision_id = '{SCOPED_DECISION}' AND TIMESTAMP '2024-02-01' + to_minutes(c.conv_id * 60 + c.turn) BETWEEN TIMESTAMP '{SCOPED_UNTIL}' - INTERVAL {SCOPED_DAYS} DAY AND TIMESTAMP '{SCOPED_UNTIL}'""")  # fmt: skip
def contradiction_candidates_of_decision(spark, sf):
    return temporal.candidates_of_decision(*_inside(spark, sf), SCOPED_DECISION, SCOPED_UNTIL, SCOPED_DAYS)


@query("message_nodes", f"WITH {LOG} SELECT 'Message:' || source_external_id AS node_id, 'slack:' || source_external_id AS id, md5(content) AS said, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created, id AS event_id FROM log WHERE source_type = 'slack_message'")
def message_nodes(spark, sf):
    made = temporal.message_nodes(tables.event_log(spark, sf))
    return made.select("node_id", "id", F.md5(F.col("content").cast("binary")).alias("said"), exprs.stamp(F.col("created_at")).alias("created"), F.array_join("source_event_ids", ",").alias("event_id"))


# sinks


@query("sink_events", """WITH l AS (SELECT 'doc-' || doc_id AS id, doc_id % 4 AS way, text FROM documents)
SELECT id, CASE way WHEN 0 THEN text WHEN 1 THEN text WHEN 2 THEN 'redone ' || text ELSE 'first ' || text END AS content FROM l""")  # fmt: skip
def sink_events(spark, sf):
    """Three ways into a stored log: seeded rows stand when their keys come again, an upsert replaces, and of new keys that come twice the first counts."""
    root = f"{shared_folder(spark)}/tessergraph/{uuid.uuid4().hex}"
    fs, folder = hadoop_path(spark, root)
    fs.deleteOnExit(folder)
    store = Store(spark, root)
    way = F.col("doc_id") % 4
    docs = tables.table(spark, sf, "documents").select(tables.name_of("doc-", "doc_id").alias("id"), way.alias("way"), F.col("text").alias("content"), F.lit(0).alias("place"))
    seeded = docs.where("way != 3")
    store.insert("log", seeded, ["id"])
    again = docs.where("way IN (1, 3)")
    twice = again.withColumn("content", F.concat(F.lit("first "), "content")).union(again.withColumns({"content": F.concat(F.lit("second "), "content"), "place": F.lit(1)}))
    store.insert_new("log", twice, ["id"], "place")
    store.upsert("log", docs.where("way = 2").withColumn("content", F.concat(F.lit("redone "), "content")), ["id"])
    return store.read("log").select("id", "content")


# text rules


@query("text_decisions", """WITH o AS (SELECT o_orderkey AS k, 'D-' || lpad((o_orderkey % 20000)::VARCHAR, greatest(3, length((o_orderkey % 20000)::VARCHAR))::INT, '0') AS id,
  CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE o_orderpriority END AS title, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS body, o_orderdate AS began, o_orderpriority AS p, o_custkey AS c FROM orders)
SELECT k AS o_orderkey, regexp_full_match(id, 'D-[0-9]{3,4}') AS formal, CASE WHEN trim(concat_ws(' ', title, body)) = '' THEN id ELSE trim(concat_ws(' ', title, body)) END AS said,
  CASE WHEN k % 11 <> 0 THEN (k % 1000 * 13)::DOUBLE / 10 END AS took_ms, CASE WHEN k % 3 = 0 THEN strftime(began, '%Y-%m-%dT%H:%M:%S') ELSE strftime(began + to_microseconds(k % 3 * 1250), '%Y-%m-%dT%H:%M:%S.%f') END AS began,
  sha256(concat_ws(chr(31), p, id)) AS fingerprint, CASE WHEN k % 240 >= 120 AND c % 3 <> 0 THEN '@old' || c ELSE '@c' || c END AS handle FROM o""")  # fmt: skip
def text_decisions(spark, sf):
    """Formal ids, decision texts, durations, ISO times, prompt fingerprints and handles by age, of all orders."""
    k, number = F.col("o_orderkey"), (F.col("o_orderkey") % 20000).cast("string")
    key = F.concat(F.lit("D-"), F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number))
    title = F.when(k % 5 == 1, "  ").when(k % 5 != 0, F.col("o_orderpriority"))
    began = F.col("o_orderdate").cast("timestamp_ntz")
    ended = F.when(k % 11 != 0, F.timestamp_add("MICROSECOND", k % 1000 * 1300, began))
    who = F.col("o_custkey").cast("string")
    former = F.when(F.col("o_custkey") % 3 != 0, F.concat(F.lit("@old"), who))
    return tables.table(spark, sf, "orders").select(
        "o_orderkey", text.is_formal_id(key).alias("formal"), text.decision_text(title, F.when(k % 3 == 0, F.col("o_orderstatus")), key).alias("said"),
        text.duration_ms(began, ended).alias("took_ms"), exprs.iso(F.timestamp_add("MICROSECOND", k % 3 * 1250, began)).alias("began"),
        text.prompt_fingerprint(F.col("o_orderpriority"), key).alias("fingerprint"), text.handle_at_age(F.concat(F.lit("@c"), who), former, k % 240).alias("handle"),
    )


@query("text_properties", """WITH e AS (SELECT event_id, ts, event_type, CASE WHEN event_id % 4 <> 0 THEN props->>'$.k' END AS k, CASE WHEN event_id % 2 = 1 THEN user_id::VARCHAR END AS who FROM events)
SELECT event_id, CASE WHEN k IS NULL AND who IS NULL THEN '(none)' ELSE concat_ws(', ', 'k=''' || k || '''', 'user=''' || who || '''') END AS block,
  '{"event_id":' || event_id || ',"ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '","event_type":"' || event_type || '"}' AS shown FROM e""")  # fmt: skip
def text_properties(spark, sf):
    """What an extractor may set of a node's properties, and rows as JSON, of all events."""
    n = F.col("event_id")
    given = F.create_map(
        F.lit("user"), F.when(n % 2 == 1, F.col("user_id").cast("string")), F.lit("k"), F.when(n % 4 != 0, F.get_json_object("props", "$.k")),
        F.lit("id"), F.lit("mine"), F.lit("source_event_ids"), F.lit("ev-0"), F.lit("created_at"), F.lit("now"),
    )
    return tables.table(spark, sf, "events").select("event_id", text.properties_block(text.safe_properties(given)).alias("block"), exprs.jsonable("event_id", "ts", "event_type").alias("shown"))


@query("revert_edges", f"""{GRAPH} SELECT edge_type, src, dst FROM edges WHERE source_event_id IS NULL OR source_event_id <> 'ev-3'""")
def revert_edges(spark, sf):
    """The edges that stay when one event is taken back."""
    return extraction.reverted(*_graph(spark, sf), "ev-3")[1].select("edge_type", "src", "dst")
