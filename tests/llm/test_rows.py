import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessergraph.llm import discriminant, language, media, queries, repetition

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# quality rules


def brute(text):
    words = WORD.findall(text or "")
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts, inside, seen, lines = Counter(grams), set(), set(), 0
    for i, g in enumerate(grams):
        if counts[g] > 1:
            inside.update(range(i, i + 5))
    for line in (text or "").split("\n"):
        lines += bool(WORD.search(line)) and line in seen
        seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), lines, len(inside), len(words) < 10 or 100 * len(inside) > 20 * len(words)


def test_repetition_equals_brute_force(spark):
    draw = random.Random(2)
    texts = [None, "", "\n\n", "a\na\n a\nb", "é x y\x1cz", "x " * 50, "one two three four five six seven eight nine ten"]
    texts += ["".join(draw.choice(["a", "b", "cé", "#", "*"]) + draw.choice([" ", "\n", "\t", "  "]) for _ in range(draw.randint(1, 120))) for _ in range(150)]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], SCHEMA + ", n_words int")
    for r in repetition.repetition_rules(df).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute(texts[r["doc_id"]])
        assert not (r["base_failed"] and r["kept"])
    assert repetition.repetition_rules(df.limit(0)).count() == 0


def test_repetition_verdict():
    prose = " ".join(f"w{i}" for i in range(300))
    assert repetition.measure(prose.encode())["kept"]
    lines = "\n".join(["ab cd"] * 30 + [f"w{i} x{i} y{i} z{i} a{i}" for i in range(10)])
    assert not repetition.measure(lines.encode())["kept"]


# language


def test_held_out_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = queries.op10_language(spark, "/root/testdata/sf0.01").join(docs, "doc_id").where("held_out").collect()
    assert len(rows) > 200 and sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_odd_texts(spark):
    train = [(i, w * 5, l) for i, (w, l) in enumerate([("the and of ", "en"), ("und der die ", "de")] * 20)] + [(900, None, "en"), (901, "123 !!", "de"), (902, "lost", None)]
    df = spark.createDataFrame([(*r, 0.5) for r in train], SCHEMA + ", lang string, score double")
    model = language.fit(df)
    assert model.languages == ["de", "en"]
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !?"), (4, "the of and"), (5, "中文"), (None, "und die der"), (4, "the of and")], SCHEMA)
    got = language.predict(odd, model).collect()
    by = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got}
    assert len(got) == 7 and by[1] == by[2] == by[3] == ("und", 0.0) and by[4][0] == "en" and by[None][0] == "de" and by[5][0] in ("de", "en")
    nothing = language.fit(df.limit(0))
    assert {r["lang_pred"] for r in language.predict(odd, nothing).collect()} == {"und"}


# quality


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = queries.op5_quality(spark, sf).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 80 and sum(r["predicted"] == r["quality"] for r in rows) >= 0.95 * len(rows)


def test_quality_of_odd_texts(spark):
    docs = spark.createDataFrame([(i, "plain words of text " * 9 if i % 2 else "AA!! BB!! " * 20) for i in range(40)] + [(50, None), (51, ""), (None, "x"), (1, "again")], SCHEMA)
    labels = spark.createDataFrame([(i, i % 2, "clash") for i in range(40)] + [(None, 1, "c"), (50, None, "c")], "doc_id long, quality int, x string")
    got = discriminant.quality_scores(docs, labels).collect()
    assert len(got) == 44 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    assert {r["predicted"] for r in got if r["doc_id"] is not None and r["doc_id"] % 2 == 0 and r["doc_id"] < 40} == {0}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got if r["doc_id"] is not None)
    assert {r["score"] for r in discriminant.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert discriminant.quality_scores(docs.limit(0), labels).count() == 0


# media


def test_media_rows_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for r in docs:
        data = (r["text"] or "").encode()
        payload = data + bytes(-len(data) % 64 if data else 64)
        image = slow_png(payload)
        want[r["doc_id"]] = (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(image), hashlib.sha256(image).hexdigest(), slow_feature(payload))
    names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    got = {r["doc_id"]: tuple(r[n] for n in names) for r in queries.op6_media(spark, SF).collect()}
    assert got == want


def slow_png(payload):
    """The format written down once more, byte by byte."""
    def chunk(kind, body):
        return len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")

    height = len(payload) // 64
    lines = b"".join(b"\0" + payload[64 * y : 64 * y + 64] for y in range(height))
    head = (64).to_bytes(4, "big") + height.to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines, 4)) + chunk(b"IEND", b"")


def slow_feature(payload):
    n = len(payload)
    bins = [sum(1 for b in payload if b // 32 == k) * 1000 // n for k in range(8)]
    return f"m{sum(payload) * 1000 // n} q{sum(b * b for b in payload) * 1000 // n} h" + "-".join(map(str, bins))


def test_media_edges(spark):
    rows = [(1, None, "c"), (1, "", "c"), (2, "é" * 40, "c"), (2, "é" * 40, "c"), (None, "no id", "c"), (3, "long " * 40_000, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, media string")
    stored = media.store(df)
    assert stored.count() == 6 and media.store(df.limit(0)).count() == 0
    assert {r["digest"] for r in stored.where("key = 1").collect()} == {hashlib.sha256(bytes(64)).hexdigest()}
    known = media.features(stored)
    assert known.count() == 4 and {r["payload_bytes"] for r in known.collect()} == {64, 128, 200_000}
    pages = spark.createDataFrame([(1, f'<img src="sha256:{hashlib.sha256(bytes(64)).hexdigest()}">' * 3)] * 2 + [(2, "<svg><text>no</text></svg><p>t"), (3, '<img src="sha256:unknown">')], "page_id long, html string")
    found = media.resolve(media.sequences(pages, "page_id", "html"), known).collect()
    assert sorted((r["key"], [(i["position"], i["kind"], i["payload"] and i["payload"]["payload_bytes"]) for i in r["items"]]) for r in found) == [
        (1, [(0, "media", 64), (1, "media", 64), (2, "media", 64)])] * 2 + [(2, [(0, "text", None)]), (3, [(0, "media", None)])]


def test_sequences_of_the_pages_table(spark):
    """Pages with media put into them: every text and medium comes back, in order."""
    pages = spark.read.parquet(f"{SF}/pages.parquet").limit(40).select("page_id", "html")
    stored = media.store(spark.createDataFrame([(i, f"payload {i}") for i in range(5)], SCHEMA))
    digests = [r["digest"] for r in stored.orderBy("key").collect()]
    rows = [(r["page_id"], r["html"].replace("</p>", "".join(f'</p><img alt="m{k}" src="sha256:{digests[k]}">' for k in range(r["page_id"] % 5)), 2)) for r in pages.collect()]
    plain = {r["key"]: [i["text"] for i in r["items"]] for r in media.sequences(pages, "page_id", "html").collect()}
    found = media.resolve(media.sequences(spark.createDataFrame(rows, "page_id long, html string"), "page_id", "html"), media.features(stored)).collect()
    assert len(found) == 40
    for r in found:
        assert [i["position"] for i in r["items"]] == list(range(len(r["items"])))
        assert [i["text"] for i in r["items"] if i["kind"] == "text"] == plain[r["key"]]
        shown = [(i["caption"], i["payload"]["payload_sha256"]) for i in r["items"] if i["kind"] == "media"]
        assert all(s == (f"m{digests.index(s[1])}", s[1]) for s in shown) and len(shown) % max(r["key"] % 5, 1) == 0


def test_png_round_trip_and_damage():
    for data in (b"", b"a", b"x" * 64, bytes(range(256)) * 3):
        assert media.from_png(media.to_png(media.padded(data))) == media.padded(data)
    bad = bytearray(media.to_png(media.padded(b"abc")))
    bad[50] ^= 1
    with pytest.raises((ValueError, zlib.error)):
        media.from_png(bytes(bad))


def test_sequences_keep_order_and_captions(spark):
    stored = media.store(spark.createDataFrame([(1, "one"), (2, None), (3, "one")], SCHEMA))
    digest = {r["key"]: r["digest"] for r in stored.collect()}
    assert digest[1] == digest[3]
    page = f'<p>before</p><figure><img src="sha256:{digest[1]}" alt="a"><figcaption>cap</figcaption></figure>mid<img src="sha256:{digest[2]}" alt="b"><img src="http://x"><img src="sha256:{digest[1]}"><p>after'
    pages = spark.createDataFrame([(7, page), (8, None), (9, "")], "page_id long, html string")
    found = media.resolve(media.sequences(pages, "page_id", "html").withColumn("row", F.col("key")), media.features(stored))
    assert {r["key"]: len(r["items"]) for r in found.collect()} == {7: 7, 8: 0, 9: 0}
    items = found.select(F.explode("items").alias("i")).select("i.*", "i.payload.payload_bytes")
    got = [(r["position"], r["kind"], r["text"], r["caption"], r["payload_bytes"]) for r in items.orderBy("position").collect()]
    assert got == [(0, "text", "before", None, None), (1, "media", None, "cap", 64), (2, "text", "mid", None, None), (3, "media", None, "b", 64), (4, "media", None, None, None), (5, "media", None, None, 64), (6, "text", "after", None, None)]


def test_posterior_equals_brute_force(spark):
    """Densities written down from the definition, over the rows that may be learnt from."""
    import numpy as np

    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: discriminant.statistics((r["text"] or "").encode()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 and r["doc_id"] in docs]
    x = {k: np.array([docs[i] for i, q in labels if q == k]) for k in (0, 1)}
    p, n = len(discriminant.NAMES), sum(map(len, x.values()))
    unit = np.sqrt(np.maximum(sum(((v - v.mean(0)) ** 2).sum(0) for v in x.values()) / n, 1e-6))
    logs = {}
    for k, v in x.items():
        c = np.cov(v.T) / np.outer(unit, unit)
        c = (1 - discriminant.TO_DIAGONAL - discriminant.TO_SCALE) * c + discriminant.TO_DIAGONAL * np.diag(np.diag(c)) + discriminant.TO_SCALE * max(np.trace(c) / p, 0.1) * np.eye(p)
        c = c * np.outer(unit, unit)
        for i, s in docs.items():
            d = np.array(s) - v.mean(0)
            logs[i, k] = np.log(len(v) / n) - 0.5 * (d @ np.linalg.solve(c, d) + np.linalg.slogdet(c / np.outer(unit, unit))[1])
    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in queries.op5_quality(spark, sf).collect()}
    assert set(got) == set(docs)
    for i, (score, predicted) in got.items():
        want = 1 / (1 + np.exp(np.clip(logs[i, 0] - logs[i, 1], -50, 50)))
        assert abs(score - want) < 1e-6 and predicted == int(score >= 0.7)


def test_kernel_equals_brute_force():
    """The kernel of two texts from their sets of places, and the scores from all kernel values at once."""
    import numpy as np

    texts = ["the cat and the dog", "der Hund und die Katze", "le chat et le chien", "a", "x" * 50_000]
    rows = language.rows_of(texts)

    def places(text):
        row = np.zeros(language.DIMENSIONS, np.uint8)
        language.presence(text, row)
        return set(np.flatnonzero(row).tolist())

    for i, a in enumerate(map(places, texts)):
        for j, b in enumerate(map(places, texts)):
            assert abs(float(rows[i] @ rows[j]) - len(a & b) / (len(a) * len(b)) ** 0.5) < 1e-5
    train = [(l, w) for l, w in (("en", "the cat sat on the mat "), ("de", "der Hund lag auf der Matte "), ("fr", "le chien dort sur le tapis ")) for _ in range(4)]
    train = [(l, w + w[k:]) for k, (l, w) in enumerate(train)]
    bits = np.array([np.packbits(np.isin(np.arange(language.DIMENSIONS), list(places(w)))) for _, w in train])
    model = language.fit_sample([l for l, _ in train], bits)
    # with every row a landmark, the regression is that of kernels with an intercept, written out in full
    k = np.array([[len(places(a) & places(b)) / (len(places(a)) * len(places(b))) ** 0.5 for _, b in train] for _, a in train])
    values, vectors = np.linalg.eigh(k)
    good = values > 1e-6 * values.max()
    features = np.column_stack((k @ (vectors[:, good] / np.sqrt(values[good])), np.ones(len(train))))
    target = np.array([[float(l == n) for n in model.languages] for l, _ in train])
    penalty = np.diag([language.RIDGE * len(train)] * (features.shape[1] - 1) + [0.0])
    weights = np.linalg.solve(features.T @ features + penalty + 1e-9 * np.eye(len(penalty)), features.T @ target)
    assert np.abs(model.outputs([w for _, w in train]) - features @ weights).max() < 1e-3
    assert model.predict([w for _, w in train])[0] == [l for l, _ in train]


def test_many_languages_and_repeated_rows(spark, monkeypatch):
    rows = [(i, f"{'abcdefgh'[i % 8] * 5} w{i}", f"l{i % 8}") for i in range(400)] + [(5, "same row", "l0")] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(language, "ALL_ROWS", 80)
    model = language.fit(df)
    assert len(model.languages) == 8 and len(model.landmarks) <= 80
    monkeypatch.setattr(language, "ALL_LANDMARKS", 7)
    with pytest.raises(ValueError):
        language.fit(df)


def test_very_long_texts_of_row_operators(spark):
    long = " ".join(f"w{i % 7000} and" for i in range(30_000))
    df = spark.createDataFrame([(1, long), (2, "the of and " * 20_000), (3, "ok"), (3, "ok")], SCHEMA)
    got = {r["doc_id"]: r for r in repetition.repetition_rules(df).collect()}
    assert (got[1]["n_words"], got[1]["word_chars"], got[1]["n_symbols"], got[1]["n_dup_lines"], got[1]["n_repeat_words"], got[1]["base_failed"]) == brute(long)
    model = language.fit(spark.createDataFrame([(i, w * 5, l) for i, (w, l) in enumerate([("the and of ", "en"), ("und der die ", "de")] * 20)], "doc_id long, text string, lang string"))
    assert {r["doc_id"]: r["lang_pred"] for r in language.predict(df, model).collect()}[2] == "en"
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    assert discriminant.quality_scores(df, labels).count() == 4
