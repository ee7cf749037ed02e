"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessergraph.llm import bpe, collocations, cover_tree, discriminant, importance, language, main_text, media, near_dedup, packing, phrase_dedup, repetition, token_shards
from tessergraph.llm.common import crc_fold, prepare

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe.encode_decode(table(spark, sf_dir, "documents"), WORD_BPE)
    return rows.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text is the medium of a page of its own, which the operator parses and resolves."""
    stored = media.store(table(spark, sf_dir, "documents"))
    page = F.concat(F.lit(f'<figure><img src="{media.SCHEME}'), "digest", F.lit('"><figcaption>document '), F.coalesce(F.col("key").cast("string"), F.lit("?")), F.lit("</figcaption></figure>"))
    pages = stored.select(F.struct("key", "n_bytes").alias("row"), page.alias("page"))
    rows = media.resolve(media.sequences(pages, "row", "page"), media.features(stored))
    medium = F.filter("items", lambda i: i["kind"] == "media")[0]["payload"]
    return rows.select(
        F.col("key.key").alias("doc_id"), F.col("key.n_bytes").alias("n_bytes"),
        *(medium[n].alias(n) for n in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")),
    )


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest, _ = token_shards.write_shards(table(spark, sf_dir, "documents"), BYTE_BPE, end_id=2)
    return token_shards.read_shards(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), WORD_BPE, capacity=2048, end_id=0)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = phrase_dedup.without_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discriminant.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repetition.repetition_rules(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = language.predict(docs, language.fit(docs))
    return rows.select("doc_id", F.coalesce(crc_fold() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op11_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_main_text, op2_bpe, op3_near_dedup, op4_phrase_dedup, op5_quality, op6_media, op7_token_shards, op8_packing, op9_repetition, op10_language, op11_top_k, op12_resampling, op13_collocations, pipeline)}


#: Words of a text: what lies between ASCII white space.
WORDS = "list_filter(regexp_split_to_array(coalesce({text}, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DEDUP_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(text=_LOWER)} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN ws ELSE ws[i:i + 4] END AS gram FROM w, LATERAL unnest(range(1, greatest(len(ws) - 4, 1) + 1)) t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other)
SELECT r.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.other) AS component_id, min(r.other) = r.doc_id AS kept FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id"""

PHRASE_DEDUP_SQL = f"""WITH w AS (SELECT doc_id, {WORDS.format(text="text")} AS ws FROM documents),
g AS (SELECT doc_id, i, ws[i:i + 12] AS gram FROM w, LATERAL unnest(range(1, greatest(len(ws) - 11, 1))) t(i)),
f AS (SELECT gram, min(doc_id) AS first FROM g GROUP BY 1),
c AS (SELECT DISTINCT g.doc_id, i + k AS place FROM g JOIN f ON f.gram = g.gram AND f.first < g.doc_id, LATERAL unnest(range(13)) t(k)),
gone AS (SELECT doc_id, list(place) AS places FROM c GROUP BY 1),
left_over AS (SELECT w.doc_id, len(ws) AS n, CASE WHEN places IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(places, i)) END AS kept FROM w LEFT JOIN gone ON gone.doc_id = w.doc_id)
SELECT doc_id, n::BIGINT AS n_words, (n - len(kept))::BIGINT AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM left_over"""


def _repetition_sql() -> str:
    grams, joins, tests = [], [], []
    for n, limit in repetition.LIMITS.items():
        grams.append(f"""g{n} AS (SELECT doc_id, unnest(list(i)) AS i FROM (SELECT doc_id, i, array_to_string(ws[i:i + {n - 1}], ' ') AS gram FROM w, LATERAL unnest(range(1, greatest(len(ws) - {n - 2}, 1))) t(i)) GROUP BY doc_id, gram HAVING count(*) > 1),
c{n} AS (SELECT q.doc_id, count(*) AS words, sum(length(w.ws[q.place])) AS chars FROM (SELECT DISTINCT doc_id, i + k AS place FROM g{n}, LATERAL unnest(range({n})) t(k)) q JOIN w ON w.doc_id = q.doc_id GROUP BY 1)""")
        joins.append(f"LEFT JOIN c{n} ON c{n}.doc_id = w.doc_id")
        tests.append(f"coalesce(c{n}.chars, 0) / chars <= {limit}::DOUBLE")
    base = repetition.BASE_N
    return f"""WITH w AS (SELECT doc_id, text, {WORDS.format(text="text")} AS ws FROM documents), {", ".join(grams)},
t AS (SELECT doc_id, i, x.line, row_number() OVER (PARTITION BY doc_id, x.line ORDER BY i) AS turn FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) x),
d AS (SELECT doc_id, count(*) AS lines, sum(length(array_to_string({WORDS.format(text="line")}, ''))) AS chars FROM t WHERE turn > 1 AND len({WORDS.format(text="line")}) > 0 GROUP BY 1),
v AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS chars, length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, ws FROM w)
SELECT w.doc_id, w.n_words, w.chars AS word_chars, w.n_symbols, coalesce(d.lines, 0)::BIGINT AS n_dup_lines, coalesce(c{base}.words, 0)::BIGINT AS n_repeat_words,
  w.n_words < {repetition.MIN_WORDS} OR 100 * coalesce(c{base}.words, 0) > {repetition.BASE_PERCENT} * w.n_words AS base_failed,
  NOT (w.n_words < {repetition.MIN_WORDS} OR 100 * coalesce(c{base}.words, 0) > {repetition.BASE_PERCENT} * w.n_words) AND coalesce(d.chars, 0) / chars <= {repetition.LINE_LIMIT}::DOUBLE AND {" AND ".join(tests)} AS kept
FROM v w LEFT JOIN d ON d.doc_id = w.doc_id {" ".join(joins)}""".replace("coalesce(d.chars, 0) / chars", "coalesce(d.chars, 0) / greatest(w.chars, 1)").replace(") / chars <=", ") / greatest(w.chars, 1) <=")


TOP_K_SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM p QUALIFY rank <= 5"""

#: The crc32 of the UTF-8 bytes of w, a byte at a time by a table of 256 that k holds.
_CRC = "xor(list_reduce(list_transform(range(1, octet_length(encode(w)) + 1), lambda i: ('0x' || substr(hex(encode(w)), 2 * i - 1, 2))::BIGINT), lambda c, b: xor(c >> 8, k[xor(c & 255, b) + 1]), 4294967295::BIGINT), 4294967295)"
_TABLE = "list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b::BIGINT))"
_FEATURES = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
RESAMPLING_SQL = f"""WITH d AS (SELECT doc_id, {_FEATURES} AS ws FROM documents), e AS (SELECT {_FEATURES} AS ws FROM benchmark),
h AS (SELECT w, {_CRC} % 10000 AS bucket FROM (SELECT DISTINCT unnest(ws) AS w FROM d UNION SELECT unnest(ws) FROM e), (SELECT {_TABLE} AS k)),
s AS (SELECT bucket, count(*)::DOUBLE AS n FROM (SELECT unnest(ws) AS w FROM d) JOIN h USING (w) GROUP BY 1),
t AS (SELECT bucket, count(*)::DOUBLE AS n FROM (SELECT unnest(ws) AS w FROM e) JOIN h USING (w) GROUP BY 1),
z AS (SELECT coalesce((SELECT sum(n) FROM s), 0) AS s, coalesce((SELECT sum(n) FROM t), 0) AS t),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1) * (z.s + 10000) / ((coalesce(s.n, 0) + 1) * (z.t + 10000))))::BIGINT AS gain FROM s FULL JOIN t USING (bucket), z),
m AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM (SELECT doc_id, unnest(ws) AS w FROM d) JOIN h USING (w) JOIN g USING (bucket) GROUP BY 1),
c AS (SELECT d.doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN m ON m.doc_id = d.doc_id),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM c WHERE n_features >= 20)
SELECT c.*, CASE WHEN place <= 10 * (SELECT count(*) FROM r) // 100 THEN place END::BIGINT AS rank FROM c LEFT JOIN r ON r.doc_id = c.doc_id"""

COLLOCATIONS_SQL = f"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS (SELECT lang, ws[i:i + k - 1] AS ws, k FROM w, LATERAL unnest(range(1, 6)) a(k), LATERAL unnest(range(1, len(ws) - k + 2)) b(i)),
f AS (SELECT lang, array_to_string(ws, ' ') AS phrase, any_value(ws) AS ws, k, count(*) AS a FROM g GROUP BY lang, array_to_string(ws, ' '), k HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY 1),
c AS (SELECT f.lang, f.phrase, f.k, f.ws, f.a, x.a AS l, y.a AS r, n.n, (1000::HUGEINT * f.a * n.n) // (x.a::HUGEINT * y.a) AS score, j
  FROM f, LATERAL unnest(range(1, f.k)) t(j) JOIN n ON n.lang = f.lang JOIN f x ON x.lang = f.lang AND x.phrase = array_to_string(f.ws[1:j], ' ') JOIN f y ON y.lang = f.lang AND y.phrase = array_to_string(f.ws[j + 1:], ' ') WHERE f.k > 1),
m AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
o AS (SELECT m.* FROM m WHERE NOT EXISTS (SELECT 1 FROM m z WHERE z.lang = m.lang AND z.k > m.k AND z.a >= m.a AND contains(' ' || z.phrase || ' ', ' ' || m.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM o QUALIFY rank <= 2000"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can say the same; the other queries are tested against brute-force versions."""
    return {"op3_near_dedup": NEAR_DEDUP_SQL, "op4_phrase_dedup": PHRASE_DEDUP_SQL, "op9_repetition": _repetition_sql(), "op11_top_k": TOP_K_SQL, "op12_resampling": RESAMPLING_SQL, "op13_collocations": COLLOCATIONS_SQL}
