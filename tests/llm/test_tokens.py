import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessergraph.llm import bpe, packing, token_shards

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ODD = [None, "", " ", "\n a   b\n  c \t d  ", "  lead", "trail  ", "don'tstop 'sab 'S q zqz", "ß ẞ <|endoftext|><|endoftext|>", "a\x85 b  c 中文 👍👍 x", "Σας ΑΣ  x\x1cy \xa0z 12é́", "İ ſx 1½²", "x " * 3000]
SCHEMA = "doc_id long, text string"


def noise(n):
    draw = random.Random(7)
    return ["".join(draw.choice([" ", " ", "\n", "\t", "a", "B", "é", "É", "ß", "×", "1", "2", "!", ".", "'", "s", "t", "\xa0", "́", "中", "”", "\x1c", "q", "z", "<|endoftext|>", "="]) for _ in range(25)) for _ in range(n)]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_ids_equal_the_library(path):
    codec, library = bpe.codec(path), Tokenizer.from_file(path)
    texts = ODD + noise(500)
    ids, bounds = codec.encode_many(pa.array(texts, pa.string()))
    for text, a, b in zip(texts, bounds, bounds[1:]):
        assert ids[a:b].tolist() == library.encode(text or "", add_special_tokens=False).ids, text


def test_decode_equals_the_library():
    codec, library = bpe.codec(WORD), Tokenizer.from_file(WORD)
    for text in ODD:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert codec.decode(np.array(ids, int)) == library.decode(ids, skip_special_tokens=False)


def test_a_cut_pair_is_inside_no_token():
    codec = bpe.codec(WORD)
    for word in ("qzqz", "xjwqk", "thequickbrownfox"):
        parts = codec.cuts(word)
        assert "".join(parts) == word
        assert all((a[-1], b[0]) not in codec.pairs for a, b in zip(parts, parts[1:]))


def test_encode_decode_rows(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "a"), (3, "again")]
    df = spark.createDataFrame([(*r, "clash", b"x") for r in rows], SCHEMA + ", key string, ids binary")
    assert bpe.encode_decode(df, WORD).count() == len(rows)
    assert bpe.encode_decode(df.limit(0), WORD).count() == 0


def test_shards_round_trip(spark):
    rows = [(i * 3, t) for i, t in enumerate(ODD)] + [(None, "no id"), (-(1 << 63), "the smallest id")]
    manifest, _ = token_shards.write_shards(spark.createDataFrame(rows, SCHEMA), BYTE, end_id=2)
    library = Tokenizer.from_file(BYTE)
    got = {r["doc_id"]: r for r in token_shards.read_shards(manifest).collect()}
    start = 0
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        r = got[key]
        assert (r["start"], r["n_tokens"], bytes(r["ids"])) == (start, len(ids), np.array(ids, "<u4").tobytes())
        start += len(ids)
    empty, _ = token_shards.write_shards(spark.createDataFrame([], SCHEMA), BYTE, end_id=2)
    assert token_shards.read_shards(empty).count() == 0


def test_a_shard_is_read_at_random_and_checks_its_dictionary(spark):
    manifest, folder = token_shards.write_shards(spark.createDataFrame([(i, f"text number {i} " * 5) for i in range(50)], SCHEMA), BYTE, end_id=2)
    uris = [r["uri"] for r in manifest.orderBy("part", "shard").collect()]
    shard = token_shards.Shard(uris[-1])
    assert shard[len(shard) - 1][-1] == 2 and len(shard.header["dictionary"]) == 64
    where, base = token_shards.open_fs(folder)
    with where.open_output_stream(f"{base}/ids.zdict") as f:
        f.write(b"another dictionary")
    token_shards._decompressor.cache_clear()
    with pytest.raises(ValueError):
        token_shards.Shard(uris[0])


def optimum(lengths, capacity):
    """Fewest bins, by search over all assignments."""
    best = len(lengths)

    def put(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= capacity:
                bins[k] += lengths[i]
                put(i + 1, bins)
                bins[k] -= lengths[i]
        bins.append(lengths[i])
        put(i + 1, bins)
        bins.pop()

    lengths = sorted(lengths, reverse=True)
    put(0, [])
    return best


def test_plans_are_whole_and_optimal_on_small_cases():
    draw = random.Random(3)
    for _ in range(150):
        lengths = [draw.randint(1, 40) for _ in range(draw.randint(1, 10))]
        counts = {n: lengths.count(n) for n in lengths}
        steps = packing.plan(counts, 40)
        assert all(sum(f) <= 40 for _, f in steps)
        used = sorted(n for k, f in steps for _ in range(k) for n in f)
        assert used == sorted(lengths)
        bins = sum(k for k, _ in steps)
        assert packing.lower_bound({n: c for n, c in counts.items() if n < 40}, 40) + counts.get(40, 0) <= optimum(lengths, 40) == bins


def test_fillings_are_the_undominated_ones():
    """Against all subsets: nothing that fits is better than what is given."""
    from itertools import combinations

    draw = random.Random(6)
    for _ in range(60):
        pieces = sorted((draw.randint(1, 20) for _ in range(draw.randint(1, 8))), reverse=True)
        room, waste = draw.randint(1, 40), draw.randint(0, 10)
        given = list(packing.fillings(Counter(pieces), room, waste, packing.Steps(10**9)))
        every = {c for k in range(len(pieces) + 1) for c in combinations(pieces, k) if room - waste <= sum(c) <= room}
        assert set(given) <= every and len(set(given)) == len(given)
        assert [sum(g) for g in given] == sorted(map(sum, given), reverse=True)
        assert all(any(g == c or packing.dominates(g, c) for g in given) for c in every)
    assert packing.dominates((7,), (4, 3)) and packing.dominates((5, 4), (4, 4)) and not packing.dominates((4, 4), (5, 3)) and not packing.dominates((4, 3), (7,))


def test_a_hard_mix_beats_best_fit_and_the_same_plan_comes_twice():
    draw = random.Random(0)
    counts = dict(Counter(draw.randint(300, 900) for _ in range(1000)))
    plans = [packing.plan(counts, 2048, 100_000) for _ in range(2)]
    assert plans[0] == plans[1]
    assert sum(k for k, _ in plans[0]) < sum(k for k, _ in packing.best_fit(counts, 2048))


def test_packed_pieces(spark):
    draw = random.Random(5)
    rows = [(i, "word " * draw.randint(0, 60)) for i in range(80)] + [(500, None), (None, "no id"), (501, "x " * 300)]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", task int")
    got = packing.pack_documents(df, WORD, capacity=64).collect()
    library = Tokenizer.from_file(WORD)
    want = []
    for key, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        want += [(key, p, s, len(ids[s : s + 64]), zlib.crc32(np.array(ids[s : s + 64], "<u4").tobytes())) for p, s in enumerate(range(0, len(ids), 64))]
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=str) == sorted(want, key=str)
    by: dict = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 64
    assert len(by) <= -(-sum(w[3] for w in want) // 64) + 1
    assert packing.pack_documents(df.limit(0), WORD).count() == 0


def test_queries_equal_the_library_in_every_column(spark):
    import hashlib

    from tessergraph.llm import queries

    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    word, byte = Tokenizer.from_file(WORD), Tokenizer.from_file(BYTE)

    def packed(ids):
        return np.array(ids, "<u4").tobytes()

    ids = {k: word.encode(t, add_special_tokens=False).ids for k, t in docs.items()}
    want = {k: (len(i), hashlib.sha256(packed(i)).hexdigest(), hashlib.sha256(word.decode(i, skip_special_tokens=False).encode()).hexdigest()) for k, i in ids.items()}
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.op2_bpe(spark, sf).collect()} == want

    start, want = 0, {}
    for k in sorted(docs):
        row = [*byte.encode(docs[k], add_special_tokens=False).ids, 2]
        want[k] = (start, len(row), zlib.crc32(packed(row)))
        start += len(row)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries.op7_token_shards(spark, sf).collect()} == want

    want, places = {}, {}
    for k, i in ids.items():
        row = [*i, 0]
        want |= {(k, p): (s, len(row[s : s + 2048]), zlib.crc32(packed(row[s : s + 2048]))) for p, s in enumerate(range(0, len(row), 2048))}
    got = queries.op8_packing(spark, sf).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want and len(got) == len(want)
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in places.values():
        ends = [0, *np.cumsum([n for _, n in sorted(parts)]).tolist()]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 2048
    assert len(places) == packing.lower_bound(Counter(n for _, n, _ in want.values()), 2048)


def test_clashing_names_and_repeated_ids(spark):
    rows = [(3, "one text", "clash"), (3, "another", "clash"), (3, "one text", "clash"), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string").withColumn("ids", F.lit("x")).withColumn("task", F.lit(1)).withColumn("key", F.lit(2))
    library = Tokenizer.from_file(BYTE)
    manifest, _ = token_shards.write_shards(df, BYTE, end_id=2)
    got = token_shards.read_shards(manifest).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 3, 3, 3]
    assert sorted(bytes(r["ids"]) for r in got) == sorted(np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes() for _, t, _ in rows)
    assert packing.pack_documents(df, WORD, capacity=64).count() == 4
    encoded = {(r["doc_id"], bytes(r["ids"])) for r in bpe.encode_decode(df, WORD).collect()}
    library = Tokenizer.from_file(WORD)
    assert encoded == {(k, np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()) for k, t, _ in rows}


def test_what_a_worker_remembers_is_bounded():
    """An executor's workers keep their memos through all stages of a pipeline, so these must be small beside its memory."""
    from tessergraph.llm import common

    c = bpe.FragmentCodec(WORD)
    want = c.encode("w0x w1x w2x")
    for a in range(0, 600_000, 50_000):
        c.encode_many(pa.array([" ".join(f"w{i}x" for i in range(a, a + 50_000))]))
        assert len(c.memo) + len(c.memo.old) + len(c.parts) + len(c.parts.old) <= 350_000
        common.word_hashes([b"%d" % i for i in range(a, a + 50_000)])
        assert len(common._words) + len(common._words.old) <= 250_000
    assert c.encode("w0x w1x w2x") == want


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_new_words_are_encoded_together(path, monkeypatch):
    """One call of Python a word cost more than the library's work; ids stay the library's."""
    alone, chunk = [], bpe.FragmentCodec._chunk
    monkeypatch.setattr(bpe.FragmentCodec, "_chunk", lambda self, c: alone.append(c) or chunk(self, c))
    draw = random.Random(3)
    words = ["".join(draw.choice("abcdeinorstxzqvjQZXÀÉÞßéüÿñth") for _ in range(draw.randint(1, 14))) for _ in range(3000)]
    codec, library = bpe.FragmentCodec(path), Tokenizer.from_file(path)
    texts = [" ".join(words[a : a + 100]) for a in range(0, 3000, 100)]
    ids, bounds = codec.encode_many(pa.array(texts))
    assert len(alone) < 100
    for text, a, b in zip(texts, bounds, bounds[1:]):
        assert ids[a:b].tolist() == library.encode(text, add_special_tokens=False).ids


def test_what_is_remembered_is_held_once():
    from tessergraph.llm.common import Memo

    memo = Memo(str, 4)
    assert memo.many([1, 2, 3], lambda new: list(map(str, new))) == ["1", "2", "3"]
    memo.trim()
    assert (memo[1], memo.many([2, 9], lambda new: [f"{x}!" for x in new])) == ("1", ["2", "9!"])
    assert not memo.keys() & memo.old.keys()
