"""The pipeline's stages and run() against brute-force versions, row by row."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tessergraph.llm import language, repetition
from tessergraph.llm.queries import WORD_BPE

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALPHABETS = {"en": "the of and to in is that it was for on with as by at from".split(), "de": "der die und das ist nicht mit für auf ein über größer schön".split()}


def corpus():
    draw = random.Random(21)
    out = []

    def words(lang, n):
        return [draw.choice(ALPHABETS[lang]) + draw.choice("abcdeghkmnost") + draw.choice(ALPHABETS[lang]) for _ in range(n)]

    for i in range(120):
        lang = draw.choice(["en", "de"])
        out.append((i * 2, " ".join(words(lang, draw.randint(4, 90))), lang))
    base, passage = words("en", 80), words("en", 30)
    for i in range(12):  # near copies
        near = list(base)
        near[draw.randrange(80)] = "changed"
        out.append((301 + i * 2, " ".join(near), "en"))
    for i in range(8):  # a passage that others have, too
        w = words("en", 40)
        out.append((401 + i * 2, " ".join(w[:20] + passage + w[20:]), "en"))
    whole = words("de", 50)
    out += [
        (500, None, "en"), (501, "", "en"), (502, " \n\t ", None), (503, "12 34 !!", "en"), (504, "中文 " * 20, None), (505, "only five words in here", "en"),
        (506, "again and again " * 30, "en"), (507, "\n".join(["the same line of text it is"] * 12), "en"),
        (600, " ".join(whole), "de"), (600, " ".join(words("de", 50)), "de"), (600, " ".join(words("en", 45) + passage), "en"), (600, " ".join(words("en", 45) + passage), None),
        (700, " ".join(whole), "de"), (701, " ".join(whole), "de"), (702, "x\ty  " + "  ".join(words("en", 30)), "en"),
        (800, " ".join(words("en", 30_000)), "en"), (801, " ".join(words("de", 40)), None), (None, " ".join(words("de", 40)), "de"), (None, " ".join(whole), "de"),
    ]
    out.append((702, out[-5][1], "en"))  # equal rows
    draw.shuffle(out)
    return [(i, t, lang, "s", len(t or "")) for i, t, lang in out]


def slow_language(rows):
    """Every kernel value written out from sets of places; the sample and its order are those of the operator, which the test gives."""

    def keep(text, model):
        if not text or not any(c.isalpha() for c in text) or not model.languages:
            return False
        row = np.zeros(language.DIMENSIONS, np.uint8)
        language.presence(text, row)
        own = set(np.flatnonzero(row).tolist())
        kernel = np.array([len(own & m) / (len(own) * len(m)) ** 0.5 for m in (set(np.flatnonzero(x).tolist()) for x in model.landmarks)])
        out = np.clip(kernel @ model.weights[:-1] + model.weights[-1], 1e-6, None)
        return out.max() / out.sum() >= corpus_pipeline.LEAST_LANGUAGE_SCORE

    return keep


def slow_quality(text):
    words = WORD.findall(text or "")
    chars = sum(map(len, words))

    def inside(n):
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        counts, hit = Counter(grams), set()
        for i, g in enumerate(grams):
            if counts[g] > 1:
                hit.update(range(i, i + n))
        return hit

    if len(words) < 10 or 100 * len(inside(5)) > 20 * len(words):
        return False
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if line in seen:
            repeated += sum(map(len, WORD.findall(line)))
        seen.add(line)
    return repeated / chars <= repetition.LINE_LIMIT and all(sum(len(words[i]) for i in inside(n)) / chars <= limit for n, limit in repetition.LIMITS.items())


def slow_near(rows):
    sets = []
    for _, text, *_ in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = {r[0]: r[0] for r in rows if r[0] is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(rows):
        for j in range(i):
            b = rows[j]
            if a[0] is None or b[0] is None or not sets[i] or not sets[j]:
                continue
            both = len(sets[i] & sets[j])
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                x, y = root(a[0]), root(b[0])
                parent[max(x, y)] = min(x, y)
    return [r for r in rows if r[0] is None or root(r[0]) == r[0]]


def slow_substring(rows):
    first = {}
    for key, text, *_ in rows:
        w = WORD.findall(text or "")
        for i in range(len(w) - 12):
            if key is not None:
                g = tuple(w[i : i + 13])
                first[g] = min(key, first.get(g, key))
    out = []
    for key, text, lang, source, n in rows:
        w, gone = WORD.findall(text or ""), set()
        for i in range(len(w) - 12):
            if key is not None and first[tuple(w[i : i + 13])] < key:
                gone.update(range(i, i + 13))
        if not gone:
            out.append((key, text, lang, source, n))
        elif len(gone) < len(w):
            left = " ".join(x for i, x in enumerate(w) if i not in gone)
            out.append((key, left, lang, source, len(left)))
    return out


def slow_pieces(rows):
    library = Tokenizer.from_file(WORD_BPE)
    out = []
    for key, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        out += [(key, p, s, len(ids[s : s + 2048]), zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes())) for p, s in enumerate(range(0, len(ids), 2048))]
    return out


def taken(df):
    return sorted(map(tuple, df.select("doc_id", "text", "lang", "source", "n_chars").collect()), key=str)


def check_pieces(df, rows):
    got = df.collect()
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=str) == sorted(slow_pieces(rows), key=str)
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in places.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048


def test_stages_and_run_equal_brute_force(spark, tmp_path):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1, "x", 0.5) for r in rows], SCHEMA + ", key int, starts string, score double")
    df.repartition(5).write.parquet(f"file://{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "quality", "near_dedup", "substring_dedup", "packing"]

    docs = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    model, keep = language.fit(docs), slow_language(rows)
    want = [r for r in rows if keep(r[1], model)]
    texts = [t for _, t, *_ in want]
    assert not {"", " \n\t ", "12 34 !!", None} & set(texts) and len(want) < len(rows)
    slow = {
        "language": lambda held: [r for r in held if keep(r[1], model)],
        "quality": lambda held: [r for r in held if slow_quality(r[1])],
        "near_dedup": slow_near,
        "substring_dedup": slow_substring,
    }
    # each stage on what the one before kept, and on all rows
    held = rows
    for name in list(slow):
        given = spark.createDataFrame([(*r, 1, "x", 0.5) for r in held], SCHEMA + ", key int, starts string, score double")
        if name == "language":
            given = docs
        held_after = slow[name](held)
        got = stages[name](spark, given, str(tmp_path))
        assert got.columns == list(corpus_pipeline.COLUMNS)
        assert taken(got) == sorted(held_after, key=str), name
        assert len(held_after) < len(held) or name == "substring_dedup"
        held = held_after
    for name in ("quality", "near_dedup", "substring_dedup"):
        assert taken(stages[name](spark, docs, "")) == sorted(slow[name](rows), key=str), name
    assert held != slow["near_dedup"](held) or any(r not in rows for r in held)  # passages were cut
    check_pieces(corpus_pipeline.run(spark, f"file://{tmp_path}"), held)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_of_an_empty_table(spark, name, stage):
    empty = spark.createDataFrame([], SCHEMA + ", key int")
    assert stage(spark, empty, "").count() == 0
