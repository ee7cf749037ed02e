"""Cover-tree search, importance resampling and collocations against brute-force versions."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessergraph.llm import collocations, cover_tree, importance, queries

SF = "/root/testdata/sf0.001"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# cover-tree search


def best(rows, step, k, scale=256):
    """id -> [(score, id)] of the k best, by all pairs."""
    held = {}
    for key, v in rows:
        if key is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ints = [math.floor(scale * x) for x in v]
            held[key] = min(held.get(key, ints), ints)
    out = {}
    for q, v in held.items():
        if q % step == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), c) for c, w in held.items() if c != q and len(w) == len(v))
            out[q] = [(-s, c) for s, c in scored[:k]]
    return {q: x for q, x in out.items() if x}


def found(df):
    out = collections.defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out[r["query_id"]].append((r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return dict(out)


def test_tree_holds_its_invariants():
    draw = np.random.default_rng(5)
    vectors = np.concatenate([draw.integers(-200, 200, (300, 8)), draw.integers(-5, 5, (200, 8)) + 90, np.full((60, 8), 7)])
    tree = cover_tree.CoverTree(vectors)
    assert sorted(tree.order.tolist()) == list(range(560))
    for node in range(len(tree.row)):
        below = tree.order[tree.low[node] : tree.high[node]]
        assert np.sqrt(((tree.points[below] - tree.points[tree.row[node]]) ** 2).sum(1)).max() <= tree.radius[node] + 1e-9
        children = tree.children(node)
        if len(children):
            assert tree.row[children[0]] == tree.row[node]  # nesting
            assert np.concatenate([tree.order[tree.low[c] : tree.high[c]] for c in children]).tolist() == below.tolist()
            if len(below) > cover_tree.LEAF and tree.radius[node] > 0:
                centres = tree.points[tree.row[children]]
                apart = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(2)) + np.eye(len(children)) * 1e9
                assert apart.min() > tree.radius[node] / 4  # separation


def test_dual_search_prunes_and_misses_nothing():
    draw = np.random.default_rng(6)
    copies = draw.integers(-90, 90, (1, 32)) + draw.integers(-3, 3, (1500, 32))
    vectors = np.concatenate([copies, draw.integers(-40, 40, (1500, 32))])
    ids, asked = np.arange(3000), np.arange(0, 3000, 10)
    search = cover_tree.DualSearch(cover_tree.CoverTree(vectors[asked]), asked, np.full(300, np.iinfo(np.int64).min), cover_tree.CoverTree(vectors), ids, 5)
    q, c, s = search.rows()
    scores = vectors[asked] @ vectors.T
    got = collections.defaultdict(list)
    for x in zip(q.tolist(), s.tolist(), c.tolist()):
        got[x[0]].append((-x[1], x[2]))
    for i, key in enumerate(asked.tolist()):
        assert sorted(got[key]) == sorted((-int(scores[i, j]), j) for j in range(3000) if j != key)[:5]
    assert search.compared < 0.8 * 300 * 3000


def test_top_k_equals_all_pairs(spark):
    draw = random.Random(8)
    base = [draw.gauss(0, 1) for _ in range(12)]
    rows = [(i, [draw.gauss(0, 1) for _ in range(12)]) for i in range(300)] + [(300 + i, [x + draw.gauss(0, 0.01) for x in base]) for i in range(300)]
    rows += [(600 + i, base) for i in range(100)]  # ties
    rows += [(1000, None), (1001, []), (1050, []), (1002, [1.0, None]), (1003, [float("nan")] * 12), (1004, [float("inf")] * 12), (None, base), (1100, [1.0, 2.0]), (1101, [2.0, 1.0]), (1102, [-1.0, 0.0]), (50, base), (50, base), (1150, [9.0, 9.0, 9.0])]
    draw.shuffle(rows)
    df = spark.createDataFrame([(*r, 0.5, "x") for r in rows], "vec_id long, embedding array<double>, score double, query_id string")
    for shard_rows in (8192, 90):
        got = found(cover_tree.top_k(df, F.col("vec_id") % 50 == 0, k=5, shard_rows=shard_rows, block=16, sample_rows=200))
        assert got == best(rows, 50, 5)
    assert cover_tree.top_k(df.limit(0), F.col("vec_id") % 50 == 0, k=5).count() == 0


def test_top_k_of_large_numbers(spark):
    rows = [(i, [2.0**40 * (i + 1), -(2.0**30) * i, 1.0]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = {q: [(min(s, 2**63 - 1), c) for s, c in x] for q, x in best(rows, 50, 60).items()}
    got = found(cover_tree.top_k(df, F.col("vec_id") % 50 == 0, k=60))
    assert {q: sorted(x) for q, x in got.items()} == {q: sorted(x) for q, x in want.items()}


def test_recall_of_the_registered_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    assert found(queries.op11_top_k(spark, "/root/testdata/sf0.01")) == best(rows, 50, 5)


# importance resampling


def drawn_slowly(docs, target, percent=10, least=20, buckets=10_000, ngram=1):
    def words(text):
        return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text).encode())

    def feats(text):
        w = words(text)
        return [zlib.crc32(b" ".join(w[i : i + n])) % buckets for n in range(1, ngram + 1) for i in range(len(w) - n + 1)]

    s, t = collections.Counter(), collections.Counter()
    for _, text in docs:
        s.update(feats(text))
    for text in target:
        t.update(feats(text))
    ss, tt = float(sum(s.values())), float(sum(t.values()))
    rows = []
    for key, text in docs:
        f = feats(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1.0) * (ss + buckets) / ((s[b] + 1.0) * (tt + buckets)))) for b in f)
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append([key, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    fit = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[4] = rank
    return rows


def odd_texts(draw, n):
    alphabet = ["a", "B", "Zz", "é", "日本", "9", "_", "x" * 40]
    texts = [None, "", "...", "word", "é", "A b\x00c", "w" * 1000 + " tail", "ab" * 300 + "é" * 200]
    return texts + ["".join(draw.choice(alphabet) + draw.choice(["", " ", " ", "-", "\n"]) for _ in range(draw.randint(1, 90))) for _ in range(n)]


def test_features_of_adjoining_rows():
    draw = random.Random(3)
    texts = ["abc", "def", None, "", "g h", *odd_texts(draw, 60)]
    for column in (pa.array(texts), pa.array(["zz", *texts]).slice(1)):
        row, bucket, n_words = importance.features(column, ngram=3, buckets=1 << 32)
        got = collections.Counter(zip(row.tolist(), bucket.tolist()))
        want = collections.Counter()
        for i, text in enumerate(texts):
            w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text).encode())
            assert n_words[i] == len(w)
            want.update((i, zlib.crc32(b" ".join(w[j : j + n]))) for n in (1, 2, 3) for j in range(len(w) - n + 1))
        assert got == want
    assert [len(x) for x in importance.features(pa.array([], pa.string()))] == [0, 0, 0]


@pytest.mark.parametrize("ngram", [1, 2])
def test_resampling_equals_slow_version(spark, ngram):
    draw = random.Random(4)
    docs = [(i, t) for i, t in enumerate(odd_texts(draw, 300))]
    docs += [(7, "same words " * 30), (7, "same words " * 30), (None, "no id " * 30), (None, None)]
    target = [None, "", "日本 a b 9", "same words here", "é"]
    df = spark.createDataFrame([(*d, 1.0, 2) for d in docs], "doc_id long, text string, score double, bucket int")
    rows = importance.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), ngram=ngram).collect()
    got = sorted(([r[c] for c in ("doc_id", "n_features", "weight", "score", "rank", "n_words")] for r in rows), key=str)
    assert got == sorted(drawn_slowly(docs, target, ngram=ngram), key=str)


def test_resampling_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    empty = importance.resample(docs.limit(0), docs.select("text"))
    assert empty.count() == 0
    rows = {r["doc_id"]: r for r in importance.resample(docs, docs.select("text").limit(0), least_words=1, percent=100).collect()}
    assert rows[1]["rank"] == 1 and rows[2]["rank"] is None and rows[2]["weight"] == 0


# collocations


def mined_slowly(docs, least, first, longest=5):
    counts, totals = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        held = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in held.items():
            longer = (q for q, b in held.items() if len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)))
            if next(longer, None) is None:
                score, _, l, r = min((1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                rows.append((" ".join(p), a, l, r, totals[lang], score))
        rows.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        out += [(lang, i, *r) for i, r in enumerate(rows[:first], 1)]
    return sorted(out)


def mined(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def test_collocations_equal_slow_version(spark, monkeypatch):
    draw = random.Random(9)
    words = ["the", "of", "a\x00", "é", "日本", "New", "york", "x", "\x1c", "z" * 300]
    docs = []
    for i in range(250):
        text = "".join(draw.choices(words, [9, 6, 2, 2, 1, 3, 3, 2, 1, 1])[0] + draw.choice([" ", " ", "\t", "  ", ". ", "\n", "; "]) for _ in range(draw.randint(1, 70)))
        docs.append((draw.choice(["en", "en", "en", "de", None]), text))
    docs += [("en", "a set phrase that comes often")] * 40 + [("fr", None), ("fr", ""), ("xx", " .,; \t"), (None, "the of " * 400), ("en", "the")]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "lang string, text string, n long, phrase string")
    want = mined_slowly(docs, 12, 50)
    assert any(len(r[2].split(" ")) == 5 for r in want)
    assert mined(collocations.collocations(df, least=12, first=50)) == want
    # A filter of few bits and small stretches change the work, not the result.
    monkeypatch.setattr(collocations, "FILTER_BITS", 64)
    monkeypatch.setattr(collocations, "STRETCH", 7)
    phrases, sizes = collocations.frequent_phrases(df, least=12, filter_bits=64)
    all_cuts = collocations.cuts(phrases, sizes).join(collocations.covered(phrases), ["lang", "phrase"], "left_anti")
    assert sorted((r["lang"], r["phrase"], r["a"], r["score"]) for r in all_cuts.collect()) == sorted((r[0], r[2], r[3], r[7]) for r in mined_slowly(docs, 12, 10**9))
    assert collocations.collocations(df.limit(0)).count() == 0


def test_growth_goes_on_across_batches():
    draw = random.Random(1)
    rows = sorted({("en", *(draw.choice("ab") for _ in range(3)), *draw.choice([(None, None), ("a", None), ("a", "b"), ("b", "a"), ("b", None)])): draw.randint(1, 9) for _ in range(60)}.items(), key=lambda r: [(x is not None, x or "") for x in r[0]])
    want = collections.Counter()
    for words, n in rows:
        for depth in range(4, 7):
            if words[depth - 1] is not None:
                want[words[:depth]] += n
    for size in (1, 2, 7, 100):
        growth, out = collocations._Growth(5, 5), []
        for a in range(0, len(rows), size):
            part = rows[a : a + size]
            growth.rows([np.array([r[0][j] for r in part], object) for j in range(6)], np.array([r[1] for r in part]), out)
        growth.finish(out)
        assert dict(out) == {w: c for w, c in want.items() if c >= 5} and len(out) == len(dict(out))


def test_pointers_are_summed_and_packed(monkeypatch):
    monkeypatch.setattr(collocations, "HELD_POINTERS", 20)
    draw = random.Random(2)
    held, want = collocations._Pointers(5), collections.Counter()
    for _ in range(12):
        words = [b"", *draw.sample([b"a", b"b\x00", "é".encode(), b"d" * 300, b"\x1c"], 4)]
        rows = np.array([[*(draw.randint(1, 4) for _ in range(2)), *draw.choice([(0, 0, 0), (1, 0, 0), (2, 3, 0), (2, 3, 4)])] for _ in range(9)])
        counts = np.array([draw.choice([1, 7, 2**31]) for _ in range(9)])
        for row, n in zip(rows.tolist(), counts.tolist()):
            want[tuple(words[i] for i in row)] += n
        held.add(*collocations._unpacked(collocations._packed(rows, counts, words), 5))
    assert held.held < 12 * 9  # some were summed before the end
    rows, counts = held.summed()
    got = [tuple(held.numbers.words[i] for i in row) for row in rows.tolist()]
    assert len(set(got)) == len(got) and dict(zip(got, counts.tolist())) == dict(want)


def test_rows_of_pointers_do_not_grow_with_frequent_pairs(spark, monkeypatch):
    draw = random.Random(12)
    docs = [(lang, " ".join(f"w{draw.randrange(70)}" for _ in range(300)) + ".") for lang in ("en", "de") for _ in range(60)]
    spoken = collocations._spoken(spark.createDataFrame(docs, "lang string, text string").repartition(4), "lang", "text")
    filters = [spark.sparkContext.broadcast(np.full(8, 255, np.uint8)) for _ in range(3)]  # all may be frequent

    def longer():
        return sorted(tuple(r) for r in collocations._grown(collocations._pointers(spoken, filters, 5), 5, 3).collect())

    counts = collections.Counter()
    for lang, text in docs:
        words = text[:-1].split()
        counts.update((lang, " ".join(words[i : i + k]), k) for k in range(2, 6) for i in range(len(words) - k + 1))
    want = sorted((*p, f) for p, f in counts.items() if f >= 3)
    assert {r[2] for r in want} >= {2, 3}
    slots = 1 << 32 - collocations.SLOT_BITS
    assert collocations._pointers(spoken, filters, 5).count() <= 4 * 2 * slots
    assert longer() == want
    monkeypatch.setattr(collocations, "GATHER_BYTES", 3000)
    monkeypatch.setattr(collocations, "HELD_POINTERS", 2000)
    assert longer() == want


def test_scores_beyond_64_bits(spark):
    big = 3 * 10**9
    phrases = spark.createDataFrame([("en", "a", 1, big), ("en", "b", 1, big), ("en", "a b", 2, big - 1)], "lang string, phrase string, k int, f long")
    n = 9 * 10**12
    row = collocations.cuts(phrases, spark.createDataFrame([("en", n)], "lang string, n long")).first()
    assert row["score"] == 1000 * (big - 1) * n // (big * big)
