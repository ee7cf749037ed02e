"""Exact top-k by inner product: dual-tree search with cover trees.

A cover tree nests balls: a node's children are points of its ball, farther
apart than half its reach, and their balls hold all its points. Queries and
candidates are indexed alike. Of two balls the largest possible inner product
is known from their centres and radii, so a pair of nodes is left out when
that lies under the worst k-th score of the group's queries so far. What isn't
left out is compared in whole numbers.

On Spark, vectors are dealt to shards of bounded size, each of which is a tree
of its own. Dense balls, told from a bounded sample by the same tree, are
shards of their own, and a query isn't sent to a ball that it can't need: the
sample's k-th score is a floor of the true one. Each shard gives out k rows a
query at most, from which each query's k best are ranked.

Vectors are scaled and floored to whole numbers first. Vectors (or ids) that
are null and vectors that hold null or non-finite components take no part. Of
rows with one id the smallest vector counts. Vectors of different lengths
don't meet; those of length 0 score 0. Scores are exact; those beyond 64 bits
count as the largest 64-bit number. Equal scores go to the smaller id, in
copies of any number. Columns beside id and vector are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessergraph.llm.common import drop, map_rows, prepare, written

#: Rows of the sample that finds dense balls and floors; rows of a shard; queries searched at once.
SAMPLE, SHARD, BLOCK = 4096, 8192, 256
#: A dense ball holds one in so many rows of the sample at least.
DENSE = 64
#: Points of a node that is not split further.
LEAF = 16
_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers, exact; beyond 64 bits the nearest 64-bit number."""
    most = [float(np.abs(x).max(initial=0)) for x in (a, b)]
    if most[0] * most[1] * max(a.shape[1], 1) < 2**53:  # sums of this size are exact in doubles
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, _LOW, _HIGH).astype(np.int64)


class CoverTree:
    """Nodes as arrays: centre (a place in ``order``), radius, the stretch of ``order`` below it, and its children, which follow each other.

    Children's centres are more than half the node's reach apart (separation),
    the first is the node's own (nesting), and radii hold all points below
    (covering). Nodes of few or equal points have their points as children.
    """

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.points = vectors.astype(float)
        self.square = (self.points * self.points).sum(1)
        self.order = np.arange(len(vectors))
        # Rounding of a distance, relative to the longest vector; whole numbers below 2^53 have none.
        self.slack = 0.0 if self.square.max(initial=0) < 2**52 else 1e-6 * float(np.sqrt(self.square.max()))
        self.row: list[int] = [0]
        self.radius: list[float] = [0.0]
        self.low: list[int] = [0]
        self.high: list[int] = [len(vectors)]
        self.first: list[int] = [0]
        self.last: list[int] = [0]
        node = 0
        while node < len(self.row):
            self._split(node)
            node += 1
        for name in ("row", "low", "high", "first", "last"):
            setattr(self, name, np.array(getattr(self, name), np.int64))
        self.radius = np.array(self.radius)
        self.length = np.sqrt(self.square[self.row]) if len(vectors) else np.zeros(1)
        self.single = self.high - self.low == 1

    def _distances(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Squared, between the rows a and b."""
        near = self.square[a][:, None] + self.square[b][None] - 2 * (self.points[a] @ self.points[b].T)
        return np.maximum(near, 0)

    def _split(self, node: int) -> None:
        lo, hi = self.low[node], self.high[node]
        rows = self.order[lo:hi]
        if hi - lo <= 1:
            self.row[node] = int(rows[0]) if hi > lo else 0
            return
        far = float(np.sqrt(self._distances(rows[:1], rows).max()))
        self.row[node], self.radius[node] = int(rows[0]), far * (1 + 1e-9) + self.slack
        if hi - lo <= LEAF or far <= self.slack:
            owner = np.arange(hi - lo)
        else:
            owner = self._net(rows, 2.0 ** (np.ceil(np.log2(far)) - 1))
        put = np.argsort(owner, kind="stable")
        self.order[lo:hi] = rows[put]
        begins = np.flatnonzero(np.diff(owner[put], prepend=-1)) + lo
        self.first[node] = len(self.row)
        self.row += [0] * len(begins)
        self.radius += [0.0] * len(begins)
        self.low += begins.tolist()
        self.high += [*begins[1:].tolist(), hi]
        self.first += [0] * len(begins)
        self.last += [0] * len(begins)
        self.last[node] = len(self.row)

    def _net(self, rows: np.ndarray, reach: float, block: int = 256) -> np.ndarray:
        """For each row the place of its centre: the first is a centre, and each later one that lies beyond ``reach`` of all centres before."""
        owner = np.full(len(rows), -1)
        left, most = np.arange(len(rows)), reach * reach
        while len(left):
            head, rest = left[:block], left[block:]
            near = self._distances(rows[head], rows[head]) <= most
            taken, chosen = np.zeros(len(head), bool), []
            for i in range(len(head)):
                if not taken[i]:
                    chosen.append(i)
                    owner[head[near[i] & ~taken]] = head[i]
                    taken |= near[i]
            if len(rest):
                close = self._distances(rows[rest], rows[head[chosen]]) <= most
                hit = close.any(1)
                owner[rest[hit]] = head[np.array(chosen)[close[hit].argmax(1)]]
                rest = rest[~hit]
            left = rest
        return owner

    def children(self, node: int) -> np.ndarray:
        return np.arange(self.first[node], self.last[node])


class DualSearch:
    """The k best of ``held`` for each vector of ``asked``; ``compared`` counts the pairs of vectors that were multiplied."""

    def __init__(self, asked: CoverTree, asked_ids: np.ndarray, floors: np.ndarray, held: CoverTree, held_ids: np.ndarray, k: int):
        """floors: for each query a score that its k-th best has at least."""
        self.asked, self.held, self.k, self.compared = asked, held, k, 0
        self.asked_ids, self.held_ids = asked_ids[asked.order], held_ids  # queries by their place in the tree's order
        self.scores = np.full((len(asked_ids), k), _LOW)
        self.ids = np.zeros((len(asked_ids), k), np.int64)
        self.count = np.zeros(len(asked_ids), np.int64)
        self.floors = floors[asked.order]
        self.worst_of = self.floors.copy()
        if len(asked_ids) and len(held_ids):
            self._visit(np.array([0]), np.array([0]))

    def _worst(self, nodes: np.ndarray) -> np.ndarray:
        """The least k-th score of each query node's queries."""
        a = self.asked
        return np.array([self.worst_of[x:y].min() for x, y in zip(a.low[nodes], a.high[nodes], strict=True)], float)

    def _visit(self, qs: np.ndarray, cs: np.ndarray) -> None:
        """Compares the query nodes with the candidate nodes."""
        a, h = self.asked, self.held
        q_one, c_one = a.single[qs], h.single[cs]
        if q_one.any() and c_one.any():
            self._take(qs[q_one], cs[c_one])
        wide = np.flatnonzero(~c_one)
        if len(wide):
            bound = self._bounds(qs, cs[wide])
            for j in np.argsort(-bound.max(0), kind="stable").tolist():
                live = qs[bound[:, j] >= self._worst(qs)]
                if len(live):
                    self._visit(self._opened(live, h.radius[cs[wide[j]]]), h.children(cs[wide[j]]))
        narrow = cs[c_one]
        for q in qs[~q_one].tolist() if len(narrow) else []:
            near = narrow[self._bounds(np.array([q]), narrow)[0] >= self._worst(np.array([q]))[0]]
            if len(near):
                self._visit(a.children(q), near)

    def _opened(self, qs: np.ndarray, radius: float) -> np.ndarray:
        """Query nodes as wide as the candidate's are replaced by their children."""
        wide = ~self.asked.single[qs] & (self.asked.radius[qs] >= radius)
        return np.concatenate([qs[~wide], *(self.asked.children(q) for q in qs[wide].tolist())])

    def _bounds(self, qs: np.ndarray, cs: np.ndarray) -> np.ndarray:
        """No inner product of a query and a candidate below the nodes is larger."""
        a, h = self.asked, self.held
        near = a.points[a.row[qs]] @ h.points[h.row[cs]].T
        lengths = np.outer(a.length[qs] + a.radius[qs], h.length[cs] + h.radius[cs])
        bound = near + np.outer(a.length[qs], h.radius[cs]) + np.outer(a.radius[qs], h.length[cs] + h.radius[cs])
        return bound + 1e-9 * lengths

    def _take(self, qs: np.ndarray, cs: np.ndarray) -> None:
        """Compares queries with candidates one by one."""
        rows, held = self.asked.low[qs], self.held.row[cs]
        held = held[np.argsort(self.held_ids[held], kind="stable")]
        ids = self.held_ids[held]
        found = products(self.asked.vectors[self.asked.row[qs]], self.held.vectors[held])
        self.compared += found.size
        own = self.asked_ids[rows][:, None] == ids[None]
        fit = (found >= self.worst_of[rows][:, None]) & ~own
        for i in np.flatnonzero(fit.any(1)).tolist():
            at = np.flatnonzero(fit[i])
            score = found[i, at]
            if len(at) > self.k:  # of equal scores at the edge those of the smaller ids, which stand first
                edge = np.partition(score, len(score) - self.k)[len(score) - self.k]
                above, equal = np.flatnonzero(score > edge), np.flatnonzero(score == edge)
                pick = np.concatenate([above, equal[: self.k - len(above)]])
                at, score = at[pick], score[pick]
            r = rows[i]
            n = self.count[r]
            score, names = np.concatenate([self.scores[r, :n], score]), np.concatenate([self.ids[r, :n], ids[at]])
            best = np.lexsort((names, ~score))[: self.k]
            self.count[r] = n = len(best)
            self.scores[r, :n], self.ids[r, :n] = score[best], names[best]
            self.worst_of[r] = max(self.floors[r], self.scores[r, -1])

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """query id, id and score of all that was found."""
        found = np.arange(self.k)[None] < self.count[:, None]
        return np.repeat(self.asked_ids, self.k).reshape(found.shape)[found], self.ids[found], self.scores[found]


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A list column's values, end to end, and the length of each list."""
    return column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows of each vector length, and their vectors."""
    values, lengths = _numbers(column)
    begins = np.cumsum(lengths) - lengths
    for n in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == n)
        yield rows, values[begins[rows][:, None] + np.arange(n)[None]].astype(np.int64)


class Balls:
    """Dense balls of a sample: centres and reaches, the widest nodes of its cover tree that hold enough points in half the root's radius."""

    def __init__(self, sample: np.ndarray):
        tree = CoverTree(sample)
        least, found, open_ = max(len(sample) // DENSE, LEAF), [], [0]
        while open_:
            node = open_.pop()
            if tree.high[node] - tree.low[node] < least:
                continue
            if tree.radius[node] <= tree.radius[0] / 2 and node:
                found.append(node)
            else:
                open_ += tree.children(node).tolist()
        self.centres = tree.points[tree.row[found]] if found else np.zeros((0, sample.shape[1]))
        self.reach = tree.radius[found] if found else np.zeros(0)

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """1, 2, ... for the first ball that holds a vector, 0 for those in none."""
        if not len(self.reach):
            return np.zeros(len(vectors), np.int64)
        points = vectors.astype(float)
        far = (points * points).sum(1)[:, None] + (self.centres * self.centres).sum(1)[None] - 2 * points @ self.centres.T
        inside = far <= self.reach[None] ** 2
        return np.where(inside.any(1), inside.argmax(1) + 1, 0)


def _whole(vectors: DataFrame, id_column: str, vector_column: str, scale: float, asked: Column) -> DataFrame:
    """id, v and asked: vectors of whole numbers, one row for each id."""
    x = F.col(vector_column)
    fit = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) != float("inf")))
    rows = vectors.where(F.col(id_column).isNotNull() & x.isNotNull() & fit)
    rows = rows.select(F.col(id_column).cast("long").alias("id"), F.transform(x, lambda e: F.floor(F.lit(float(scale)) * e.cast("double"))).alias("v"), F.coalesce(asked, F.lit(False)).alias("asked"))
    return rows.groupBy("id").agg(F.min("v").alias("v"), F.max("asked").alias("asked"))


def _route(queries: DataFrame, shared, k: int, shards_of: list[tuple[int, int]]) -> DataFrame:
    """(shard, kind, id, floor, v) of each query for each shard that it may need. shards_of: the first shard of each ball and how many; 0 are the rest."""

    def make():
        balls, sample_ids, sample = shared.value

        def route(batch: pa.RecordBatch) -> dict[str, list]:
            out: dict[str, list] = {"at": [], "floor": [], "cells": []}
            for rows, vectors in _matrices(batch.column(1)):
                ids = batch.column(0).to_numpy()[rows]
                floors, near = np.full(len(rows), _LOW), np.ones((len(rows), len(shards_of)), bool)
                if vectors.shape[1] == sample.shape[1] and len(sample) > k:
                    found = products(vectors, sample)
                    own = ids[:, None] == sample_ids[None]
                    if (~own).sum(1).min() >= k:
                        found[own] = _LOW
                        floors = np.partition(found, found.shape[1] - k, axis=1)[:, found.shape[1] - k]
                    points = vectors.astype(float)
                    length = np.sqrt((points * points).sum(1))
                    most = points @ balls.centres.T + length[:, None] * balls.reach[None]
                    most += 1e-9 * length[:, None] * (np.sqrt((balls.centres**2).sum(1)) + balls.reach)[None]
                    near[:, 1:] = most >= floors[:, None]
                elif vectors.shape[1] != sample.shape[1]:
                    near[:, 1:] = False  # balls hold vectors of the sample's length
                out["at"].append(rows)
                out["floor"].append(floors)
                out["cells"] += [np.flatnonzero(x) for x in near]
            at = pa.array(np.concatenate(out["at"]))
            return {"id": batch.column(0).take(at), "v": batch.column(1).take(at), "floor": np.concatenate(out["floor"]), "cells": out["cells"]}

        return route

    routed = map_rows(queries.select("id", "v"), "id long, v array<long>, floor long, cells array<int>", make)
    spans = F.array(*(F.sequence(F.lit(a), F.lit(a + n - 1)) if n else F.array().cast("array<int>") for a, n in shards_of))
    shards = F.flatten(F.transform("cells", lambda c: F.get(spans, c)))
    return routed.select(F.explode(shards).alias("shard"), F.lit(1).alias("kind"), "id", "floor", "v")


class _Shards:
    """Reads rows sorted by shard, length and kind; gives out what each block of queries finds in its shard."""

    def __init__(self, k: int, block: int):
        self.k, self.block = k, block
        self.key, self.tree, self.held, self.asked = None, None, [], []

    def search(self) -> list[tuple]:
        out = []
        if self.asked and self.held:
            if self.tree is None:
                self.held = [tuple(np.concatenate(x) for x in zip(*self.held, strict=True))]
                self.tree = CoverTree(self.held[0][1])
            ids, floors, vectors = (np.concatenate(x) for x in zip(*self.asked, strict=True))
            for a in range(0, len(ids), self.block):
                some = slice(a, a + self.block)
                found = DualSearch(CoverTree(vectors[some]), ids[some], floors[some], self.tree, self.held[0][0], self.k)
                out.append(found.rows())
        self.asked = []
        return out

    def add(self, key: tuple, kind: int, ids: np.ndarray, floors: np.ndarray, vectors: np.ndarray) -> list[tuple]:
        out = []
        if key != self.key:
            out = self.search()
            self.key, self.tree, self.held = key, None, []
        if kind == 0:
            self.held.append((ids, vectors))
        else:
            self.asked.append((ids, floors, vectors))
            if sum(len(x[0]) for x in self.asked) >= self.block:
                out += self.search()
        return out


def _search(rows: DataFrame, k: int, block: int) -> DataFrame:
    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        columns = [np.concatenate([x[i] for x in found]) if found else np.empty(0, np.int64) for i in range(3)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = _Shards(k, block)
        for batch in batches:
            shard, size, kind, ids, floors = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            values, lengths = _numbers(batch.column(5))
            begins = np.concatenate([[0], np.cumsum(lengths)])
            turns = np.flatnonzero((np.diff(shard) != 0) | (np.diff(size) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *turns.tolist()], [*turns.tolist(), len(shard)], strict=True):
                if b > a:
                    vectors = values[begins[a] : begins[b]].astype(np.int64).reshape(b - a, int(size[a]))
                    found = shards.add((int(shard[a]), int(size[a])), int(kind[a]), ids[a:b], floors[a:b], vectors)
                    if found:
                        yield batch_of(found)
        yield batch_of(shards.search())

    return rows.mapInArrow(run, "query_id long, id long, score long")


def top_k(
    vectors: DataFrame, asked: Column, k: int, id_column: str = "vec_id", vector_column: str = "embedding", scale: float = 256.0, sample_rows: int = SAMPLE,
    shard_rows: int = SHARD, block: int = BLOCK,
) -> DataFrame:
    """query_id, rank (from 1), ``id_column`` and score: the k largest inner products of each vector for which ``asked`` holds with all others.

    Fewer if there are fewer. Components are floor(scale * x). The sample
    decides only where rows are searched, never which.
    """
    if k < 1:
        raise ValueError("k must be 1 at least")
    spark = vectors.sparkSession
    prepare(spark)
    points, points_path = written(_whole(vectors, id_column, vector_column, scale, asked), "vectors")
    drawn = points.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("id", "v").toArrow().combine_chunks()
    ids, sample = np.empty(0, np.int64), np.zeros((0, 0), np.int64)
    if drawn.num_rows:
        ids, column = drawn.column(0).combine_chunks().to_numpy(), drawn.column(1).combine_chunks()
        rows, sample = max(_matrices(column), key=lambda x: len(x[0]))  # the most frequent length
        ids = ids[rows]
    balls = Balls(sample)
    shared = spark.sparkContext.broadcast((balls, ids, sample))  # at most sample_rows vectors

    def make():
        held, _, some = shared.value

        def place(batch: pa.RecordBatch) -> dict[str, list]:
            cell = np.zeros(batch.num_rows, np.int64)
            for rows, matrix in _matrices(batch.column(1)):
                if matrix.shape[1] == some.shape[1]:
                    cell[rows] = held.of(matrix)
            return {"id": batch.column(0), "v": batch.column(1), "asked": batch.column(2), "cell": cell}

        return place

    placed, placed_path = written(map_rows(points, "id long, v array<long>, asked boolean, cell int", make), "placed")
    drop(spark, points_path)
    counts = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row a ball
    shards_of, total = [], 0
    for cell in range(len(balls.reach) + 1):
        n = -(-counts.get(cell, 0) // shard_rows)
        shards_of.append((total, n))
        total += n
    first, many = (F.array(*(F.lit(x[i]) for x in shards_of)) for i in (0, 1))
    shard = F.get(first, F.col("cell")) + F.pmod(F.xxhash64("id"), F.get(many, F.col("cell")).cast("long")).cast("int")
    held = placed.select(shard.alias("shard"), F.lit(0).alias("kind"), "id", F.lit(_LOW).cast("long").alias("floor"), "v")
    rows = held.unionByName(_route(placed.where("asked"), shared, k, shards_of)).withColumn("size", F.size("v"))
    tasks = min(max(2 * total, 1), 20_000)
    dealt = rows.repartition(tasks, "shard").sortWithinPartitions("shard", "size", "kind").select("shard", "size", "kind", "id", "floor", "v")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    ranked = _search(dealt, k, block).withColumn("rank", place).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_column), "score")
