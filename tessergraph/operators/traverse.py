"""Traversals: trails, levels, reachability, chain heads, components, depth.

None of them has a bound on its rounds: each goes on until nothing changes, or
raises if a cycle leaves the question without an answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessergraph.sources.store import cut_lineage

MAX_DEPTH = 10
#: Links up to which components are found in one task; more are dealt.
ONE_TASK_LINKS = 500_000


def trails(links: DataFrame, seed: DataFrame, depth: int, clamp: int = MAX_DEPTH) -> DataFrame:
    """All trails that end at a seed, followed against the links: no link twice, 1 to ``depth`` links.

    links: (src, dst). seed: (node). Returns node, depth and the trail's links.
    The number of trails can grow with the power of the depth; where only
    nodes or the depths of an acyclic graph are asked for, `reachable` and
    `levels` are the cheap forms. Each length is written, and the next one
    grows from it.
    """
    depth = max(1, min(depth, clamp))
    steps = cut_lineage(links.select("src", "dst", F.concat_ws(">", "src", "dst").alias("link")))
    start = seed.join(steps, F.col("node") == F.col("dst")).select(F.col("src").alias("node"), F.array("link").alias("links"))
    found = front = cut_lineage(start.withColumn("depth", F.lit(1)))
    for k in range(2, depth + 1):
        s = steps.alias("s")
        front = cut_lineage(
            front.alias("f")
            .join(s, F.col("f.node") == F.col("s.dst"))
            .where(~F.array_contains("f.links", F.col("s.link")))
            .select(F.col("s.src").alias("node"), F.array_append("f.links", F.col("s.link")).alias("links"), F.lit(k).alias("depth"))
        )
        if front.isEmpty():
            break
        found = found.unionByName(front)
    return found


def levels(links: DataFrame, seed: DataFrame, depth: int, clamp: int = MAX_DEPTH) -> DataFrame:
    """(node, depth) pairs of an acyclic graph: which nodes lie how many links before the seed. At most nodes x depth rows."""
    depth = max(1, min(depth, clamp))
    links = cut_lineage(links.select("src", "dst"))
    front, found = seed.select("node"), None
    for k in range(1, depth + 1):
        front = cut_lineage(front.join(links, F.col("node") == F.col("dst")).select(F.col("src").alias("node")).distinct())
        if found is not None and front.isEmpty():
            break
        level = front.withColumn("depth", F.lit(k))
        found = level if found is None else found.union(level)
    return found


def reachable(links: DataFrame, seed: DataFrame, depth: int | None = None) -> DataFrame:
    """(node, distance) of everything that reaches a seed, within ``depth`` links if that is given; each node once, at its least distance."""
    links = cut_lineage(links.select("src", "dst"))
    seen = front = cut_lineage(seed.select("node", F.lit(0).alias("distance")).distinct())
    k = 0
    while depth is None or k < depth:
        k += 1
        new = front.join(links, F.col("node") == F.col("dst")).select(F.col("src").alias("node")).distinct()
        front = cut_lineage(new.join(seen, "node", "left_anti").withColumn("distance", F.lit(k)))
        if front.isEmpty():
            break
        seen = seen.union(front)
        if k % 20 == 0:
            seen = cut_lineage(seen)
    return seen.where("distance > 0")


def chain_heads(merges: DataFrame) -> DataFrame:
    """(node, head): every node that is merged, and each node at the end of its chains.

    Pointers are doubled each round, so a chain of n links takes log n joins.
    A node with several ends gets a row for each. Merges that run in a circle
    have no end and raise an error.
    """
    hops = cut_lineage(merges.select(F.col("src").alias("node"), F.col("dst").alias("head")).distinct())
    reach, most = 1, None
    while True:
        more = hops.alias("a").join(hops.alias("b"), F.col("a.head") == F.col("b.node"))
        if more.isEmpty():
            return hops
        most = hops.select("node").distinct().count() if most is None else most
        if reach > most:
            raise ValueError("merges run in a circle")
        ended = hops.alias("a").join(hops.select(F.col("node").alias("inner")).distinct(), F.col("a.head") == F.col("inner"), "left_anti")
        hops = cut_lineage(more.select(F.col("a.node").alias("node"), F.col("b.head").alias("head")).union(ended.select("node", "head")).distinct())
        reach *= 2


def _in_one_task(pairs: DataFrame) -> DataFrame:
    """(u, v) with the smallest node reachable as v, by union-find over all of ``pairs``, whose number is checked."""
    schema = pairs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}

        def root(x):
            top = x
            while parent.setdefault(top, top) != top:
                top = parent[top]
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        kinds = None
        for batch in batches:
            kinds = batch.schema
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        if kinds is not None:
            rows = [(x, root(x)) for x in list(parent)]
            rows = [r for r in rows if r[0] != r[1]]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds.field(i).type) for i in (0, 1)], names=["u", "v"])

    return pairs.coalesce(1).mapInArrow(run, schema)


def _large(links: DataFrame) -> DataFrame:
    """Each node hands the smallest of its neighbours and itself to its larger neighbours."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # Written, so that the join is of two dealt sides and the rows of a hub can be split.
    least = cut_lineage(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m")))
    return both.join(least, both["u"] == least["c"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(links: DataFrame) -> DataFrame:
    """Each node hands the smallest of its smaller neighbours to the others and itself."""
    least = cut_lineage(links.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m"))
    met = links.join(least, links["u"] == least["c"])
    moved = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("c").alias("u"), F.col("m").alias("v")))
    return moved.where("u != v").distinct()


def components(links: DataFrame, one_task: int = ONE_TASK_LINKS) -> DataFrame:
    """(node, component): the smallest node reachable when links (src, dst) go both ways.

    Up to ``one_task`` distinct links are joined in one task; more by
    alternating large and small stars, each round written. Both give the same.
    A node that only has a link to itself is its own component; a null end
    links nothing; an empty table has no nodes.
    """
    ends = links.where("src IS NOT NULL AND dst IS NOT NULL")
    pairs = cut_lineage(ends.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    alone = pairs.where("u = v").select(F.col("u").alias("node"))
    pairs = pairs.where("u != v")
    if pairs.count() <= one_task:
        pairs = cut_lineage(_in_one_task(pairs))
    else:
        while True:
            pairs = cut_lineage(_small(cut_lineage(_large(pairs))))
            # Done once every larger node has one link, and its other end has none itself.
            again = pairs.groupBy("u").count().where("count > 1").select("u")
            inner = pairs.join(pairs.select(F.col("u").alias("w")).distinct(), F.col("v") == F.col("w"), "left_semi").select("u")
            if again.union(inner).isEmpty():
                break
    found = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = pairs.select(F.col("v").alias("node")).union(alone).distinct().join(found.select("node"), "node", "left_anti")
    return found.union(roots.select("node", F.col("node").alias("component")))


def longest_depth(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, depth) of an acyclic graph: links on the longest path from the node; nodes without outgoing links have 0.

    A cycle raises an error, and so does a path of ``rounds`` links, if that is given.
    Each round writes the nodes that have a path of so many links. They are most
    nodes in most rounds, so the join is of dealt sides: a small file can be many
    rows, which would go through the driver each round.
    """
    links = cut_lineage(links.select("src", "dst"))
    front = cut_lineage(links.select(F.col("src").alias("node")).union(links.select("dst")).distinct())
    found, k = front.withColumn("depth", F.lit(0)), 0
    most = min(front.count(), rounds or front.count())
    while True:
        k += 1
        front = cut_lineage(links.join(front.select(F.col("node").alias("dst")).hint("merge"), "dst").select(F.col("src").alias("node")).distinct())
        if front.isEmpty():
            return found.groupBy("node").agg(F.max("depth").alias("depth"))
        if k >= most:
            raise ValueError(f"a path of {most} links, or a cycle")
        found = found.union(front.withColumn("depth", F.lit(k)))
