"""The stored vector index against a comparison with all vectors."""

import numpy as np
import pytest

from tessergraph.operators import search, vector_index
from tessergraph.sources.store import Store

ROWS, ASKED = "event_id string, embedding array<float>", "query_id long, embedding array<float>"


def slow(vectors, query, k):
    """The k best (similarity, id) in plain numpy."""

    def unit(v, n):
        v = np.array(v, float) if v is not None and len(v) == n and None not in v else np.zeros(n)
        v = v if np.isfinite(v).all() else np.zeros(n)
        return v / np.linalg.norm(v) if v.any() else v

    q = unit(query, 8)
    ranked = sorted((-round(float(unit(v, 8) @ q), 9) + 0.0, i) for i, v in vectors)
    return [(i, -s + 0.0) for s, i in ranked[:k]]


def found(index, spark, queries, k):
    got = {}
    for r in index.topk_many(spark.createDataFrame(queries, ASKED), k).collect():
        got.setdefault(r["query_id"], []).append((r["event_id"], round(r["similarity"], 9)))
    return {q: sorted(x, key=lambda p: (-p[1], p[0])) for q, x in got.items()}


def close(rng, groups, per_group):
    middle = rng.normal(size=(groups, 8))
    return [(f"v{g:03d}-{j:03d}", (middle[g] + 0.05 * rng.normal(size=8)).astype(np.float32).tolist()) for g in range(groups) for j in range(per_group)]


def like(got, want):
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=1e-7)


@pytest.mark.parametrize("groups", [12, 400])
def test_equals_all_vectors(spark, tmp_path, groups):
    rng = np.random.default_rng(groups)
    vectors = close(rng, groups, 1200 // groups)
    queries = [(q, vectors[q * 50][1]) for q in range(20)] + [(100 + q, rng.normal(size=8).astype(np.float32).tolist()) for q in range(20)]
    index = vector_index.VectorIndex.create(Store(spark, str(tmp_path)), spark.createDataFrame(vectors, ROWS), cell_rows=100)
    assert len(index.cells) > 1 and sum(n for _, n in index.cells.values()) == 1200
    like(found(index, spark, queries, 7), {q: slow(vectors, v, 7) for q, v in queries})
    one = [(r["event_id"], round(r["similarity"], 9)) for r in index.topk(queries[0][1], 7).collect()]
    like({0: one}, {0: slow(vectors, queries[0][1], 7)})


def test_cells_and_codes_prune(spark, tmp_path, monkeypatch):
    vectors = close(np.random.default_rng(1), 12, 100)
    index = vector_index.VectorIndex.create(Store(spark, str(tmp_path)), spark.createDataFrame(vectors, ROWS), cell_rows=100)
    asked = spark.createDataFrame([(q, vectors[q * 100][1]) for q in range(12)], ASKED).withColumn("least", vector_index.F.lit(0.95))
    visits = index._visits(asked, 5, True).count() + index._visits(asked, 5, False).count()
    assert visits <= 3 * 12 < 12 * len(index.cells)
    assert index.candidates(asked.drop("least"), 5).count() <= 12 * 15


def test_added_vectors_and_a_reopened_index(spark, tmp_path):
    rng = np.random.default_rng(5)
    vectors, store = close(rng, 10, 30), Store(spark, str(tmp_path))
    more = [(f"w{i}", rng.normal(size=8).astype(np.float32).tolist()) for i in range(100)]
    index = vector_index.VectorIndex.create(store, spark.createDataFrame(vectors, ROWS), cell_rows=30)
    index.add(spark.createDataFrame([*more, more[0], ("v000-000", [1.0] * 8)], ROWS))  # a known id stays as it was
    queries = [(q, rng.normal(size=8).astype(np.float32).tolist()) for q in range(10)]
    want = {q: slow(vectors + more, v, 4) for q, v in queries}
    like(found(index, spark, queries, 4), want)
    like(found(vector_index.VectorIndex(store), spark, queries, 4), want)
    with pytest.raises(ValueError):
        vector_index.VectorIndex.create(store, spark.createDataFrame(vectors, ROWS))


def test_an_add_that_was_broken_off_is_repeated(spark, tmp_path, monkeypatch):
    rng, store = np.random.default_rng(6), Store(spark, str(tmp_path))
    vectors = close(rng, 6, 30)
    more = [(f"w{i}", rng.normal(size=8).astype(np.float32).tolist()) for i in range(50)]
    index = vector_index.VectorIndex.create(store, spark.createDataFrame(vectors, ROWS), cell_rows=30)
    append = Store.append

    def broken(self, name, df):
        if name.endswith("_rows"):
            raise RuntimeError("killed")
        return append(self, name, df)

    monkeypatch.setattr(Store, "append", broken)
    with pytest.raises(RuntimeError):
        index.add(spark.createDataFrame(more, ROWS))
    monkeypatch.setattr(Store, "append", append)
    queries = [(q, rng.normal(size=8).astype(np.float32).tolist()) for q in range(5)]
    like(found(vector_index.VectorIndex(store), spark, queries, 4), {q: slow(vectors, v, 4) for q, v in queries})
    index.add(spark.createDataFrame(more, ROWS))
    like(found(index, spark, queries, 4), {q: slow(vectors + more, v, 4) for q, v in queries})


def test_odd_vectors_copies_and_ties(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "PART_ROWS", 64)
    rng = np.random.default_rng(9)
    copies = [(f"c{i:03d}", [1.0, 2.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.5]) for i in range(300)]  # a hot cell, split
    odd = [("null", None), ("empty", []), ("short", [1.0]), ("zero", [0.0] * 8), ("hole", [1.0] * 7 + [None]), ("nan", [float("nan")] * 8), ("endless", [float("inf")] + [1.0] * 7)]
    vectors = copies + odd + [(f"r{i:03d}", rng.normal(size=8).astype(np.float32).tolist()) for i in range(200)]
    given = spark.createDataFrame([*vectors, (None, [1.0] * 8)], ROWS).selectExpr("*", "1 AS cell", "2 AS query_id", "3 AS code")
    index = vector_index.VectorIndex.create(Store(spark, str(tmp_path)), given, cell_rows=100)
    assert sum(n for _, n in index.cells.values()) == len(vectors) and vector_index.NOWHERE in index.cells
    queries = [(0, copies[0][1]), (1, [0.0] * 8), (2, None), (3, [1.0, 1.0]), (4, [-1.0] * 8)]
    for k in (3, 10):
        like(found(index, spark, queries, k), {q: slow(vectors, v, k) for q, v in queries})
    asked = spark.createDataFrame(queries, ASKED)
    assert index.candidates(asked.where("query_id = 0"), 10).count() <= 10 * 8  # not all copies
    every = found(index, spark, queries[:1], 1000)
    assert len(every[0]) == len(vectors)


def test_no_vectors_and_none_with_length(spark, tmp_path):
    for name, rows in (("none", []), ("flat", [("a", None), ("b", []), ("z", [0.0, 0.0])])):
        index = vector_index.VectorIndex.create(Store(spark, str(tmp_path)), spark.createDataFrame(rows, ROWS), name)
        got = found(index, spark, [(1, [1.0, 0.0])], 2)
        assert got == ({} if not rows else {1: [("a", 0.0), ("b", 0.0)]})
    with pytest.raises(ValueError):
        index.topk([1.0], 0)


def test_hybrid_search_over_an_index(spark, tmp_path):
    vectors = spark.createDataFrame(close(np.random.default_rng(3), 5, 20), ROWS)
    events = vectors.selectExpr("event_id AS id", "if(event_id < 'v002', 'doc', 'slack') AS source_type", "TIMESTAMP_NTZ '2024-01-01 00:00:00' AS created_at")
    entities = vectors.selectExpr("event_id", "cast(substring(event_id, 6, 3) AS int) % 4 AS entity_count", "array('Service') AS labels")
    index = vector_index.VectorIndex.create(Store(spark, str(tmp_path)), vectors, cell_rows=20)
    query = vectors.where("event_id = 'v001-003'").first()["embedding"]
    for kinds in (None, ["doc"]):
        a, b = (search.hybrid_search(v, events, entities, query, 6, kinds).collect() for v in (vectors, index))
        assert [tuple(map(str, r)) for r in a] == [tuple(map(str, r)) for r in b] and len(a) == 6
