import hashlib
import random
import re

import pytest

from tessergraph.llm import near_dedup, phrase_dedup

SCHEMA = "doc_id long, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus():
    """Copies, near copies that only chain, shared passages, short and odd texts."""
    draw = random.Random(11)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows, next_id = [], 0

    def add(words):
        nonlocal next_id
        rows.append((next_id, " ".join(words)))
        next_id += draw.choice([1, 1, 2])

    passage = draw.choices(vocabulary, k=60)
    for _ in range(30):
        add(draw.choices(vocabulary, k=draw.randint(3, 200)))
    base = draw.choices(vocabulary, k=150)
    for _ in range(60):
        near = list(base)
        for _ in range(draw.randint(0, 8)):
            near[draw.randrange(len(near))] = draw.choice(vocabulary)
        add(near)
    for _ in range(5):
        add(base)
    for _ in range(10):
        words = draw.choices(vocabulary, k=80)
        a, b = draw.randint(0, 30), draw.randint(32, 60)
        add(words[:40] + passage[a:b] + words[40:])
    draw.shuffle(rows)
    rows += [(9000, None), (9001, ""), (9002, " \n\t "), (9003, "Two words"), (9004, "two WORDS"), (9005, "É two"), (9006, "é two"), (None, "two words"), (9007, "tail " * 40), (9008, "tail " * 40), (9008, "tail " * 40)]
    return rows


def groups(rows, percent=75):
    sets = {}
    for key, text in rows:
        if key is not None:
            words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
            sets[key] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()
    parent = {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), root(k)) for k in keys}


def test_groups_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", rep int, band string")
    got = near_dedup.near_duplicates(df).collect()
    assert len(got) == len(rows)
    want = groups(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] == r["component_id"])
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def test_estimate_is_near_the_truth(spark):
    import numpy as np

    draw = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.75, 0.95):
        n = 2000
        both = draw.integers(0, 2**63, int(n * share), np.uint64)
        a, b = (np.unique(np.concatenate((both, draw.integers(0, 2**63, n - len(both), np.uint64)))) for _ in range(2))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        x, y = (near_dedup.packed(near_dedup.minima(s)).tolist() for s in (a, b))
        names = near_dedup.SIGNATURE
        df = spark.createDataFrame([(*x, *y)], ", ".join([f"p{c} long" for c in names] + [f"q{c} long" for c in names]))
        df = df.selectExpr("named_struct(" + ", ".join(f"'{c}', p{c}" for c in names) + ") AS p", "named_struct(" + ", ".join(f"'{c}', q{c}" for c in names) + ") AS q")
        assert abs(df.selectExpr(near_dedup.estimate("p", "q")).first()[0] - true) < 0.2


def test_links_that_only_others_have_are_found():
    import numpy as np

    sets = {1: range(0, 100), 2: range(10, 110), 3: range(20, 120), 4: range(500, 600)}
    rows = [(asks, k, 1 if k < 3 else k, np.array(s, np.uint64).tobytes()) for k, s in sets.items() for asks in ((False, True) if k > 2 else (False,))]
    assert near_dedup.crossed(rows) == [(3, 2)]


def removed(rows):
    words = [(k, WORD.findall(t or "")) for k, t in rows]
    first: dict = {}
    for k, w in words:
        if k is not None:
            for i in range(len(w) - 12):
                g = tuple(w[i : i + 13])
                first[g] = min(k, first.get(g, k))
    out = []
    for k, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - 12):
            if k is not None and first[tuple(w[i : i + 13])] < k:
                gone[i : i + 13] = [True] * 13
        left = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((k, len(w), sum(gone), hashlib.sha256(left.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("common", [1000, 3])
def test_removed_words_equal_brute_force(spark, monkeypatch, common):
    monkeypatch.setattr(phrase_dedup, "COMMON", common)
    monkeypatch.setattr(phrase_dedup, "SHARD_ROWS", 200)
    rows = corpus()
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", key int")
    got = phrase_dedup.without_repeats(df).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == removed(rows)


def test_words_of_like_hashes_are_not_taken_for_one(spark):
    import xxhash

    like = ("w57212", "w67677")
    assert xxhash.xxh3_64_intdigest(like[0]) >> 32 == xxhash.xxh3_64_intdigest(like[1]) >> 32
    same = [f"c{i}" for i in range(12)]
    rows = [(k, " ".join([*same[: k % 13], like[k % 2], *same[k % 13 :]])) for k in range(13)] + [(50, " ".join([*same, like[0]])), (51, " ".join([*same, like[1]]))]
    got = phrase_dedup.without_repeats(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == removed(rows)
    assert not any(r["n_removed"] for r in got if r["doc_id"] < 13)


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    import numpy as np

    monkeypatch.setattr(phrase_dedup, "window_hashes", lambda words, n: np.zeros(len(words) - n + 1, np.uint64))
    same, other = b" ".join(b"a%d" % i for i in range(13)), b" ".join(b"b%d" % i for i in range(13))
    rows = [(1, 1, same, 3, 3), (1, 2, same + b" x", 5, 9), (1, 3, other, 1, 1)]
    assert list(phrase_dedup.locate(rows)) == [(1, 1, [0], [3]), (1, 2, [0, 1], [3, 5])]


def test_very_long_texts(spark):
    draw = random.Random(4)
    long = [f"w{draw.randrange(9000)}" for _ in range(25_000)]
    rows = [(1, " ".join(long)), (2, " ".join(["x", *long[5000:20_000], "y"])), (3, " ".join(long[:24_000] + ["z"] * 50)), (4, "q " * 30_000), (5, "q " * 20)]
    got = phrase_dedup.without_repeats(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == removed(rows)
    sets = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sets == groups(rows)


def test_kept_text_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(20))
    rows = [(1, text), (2, f"a {text} b"), (3, text), (4, "short")]
    got = {r["doc_id"]: r["kept_text"] for r in phrase_dedup.without_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: None, 2: "a b", 3: "", 4: None}
    assert phrase_dedup.without_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_substring_stage_of_rows_that_share_an_id(spark):
    import corpus_pipeline

    common = " ".join(f"w{i}" for i in range(20))
    texts = [(1, common), (2, "own words before " + common + " and after"), (2, "an untouched\ttext  of the same id é"), (2, common), (2, ""), (2, None), (3, "x " + common), (3, "y"), (None, common)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    want = []
    for i, t in texts:
        words, gone = (t or "").split(), set()
        for k in range(len(words) - 12):
            gram = " ".join(words[k : k + 13])
            if i is not None and any(j is not None and j < i and gram in " ".join((u or "").split()) for j, u in texts):
                gone.update(range(k, k + 13))
        left = t if not gone else " ".join(w for k, w in enumerate(words) if k not in gone)
        if not gone or left:
            want.append((i, left))
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.by_substring_dedup(spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
