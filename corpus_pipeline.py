"""The corpus pipeline: five stages, each a written table that the next one reads.

Language identification and quality rules drop what they reject, near-dedup
keeps one document of each group, substring dedup shortens texts, and packing
places the tokens of what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessergraph.llm import language, near_dedup, packing, phrase_dedup, repetition
from tessergraph.llm.common import prepare, written
from tessergraph.llm.queries import WORD_BPE

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Language scores below this are rejected; a plain text of one language has 0.9 or more.
LEAST_LANGUAGE_SCORE = 0.30


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: texts without a letter, or of no learned language's letters, go.

    Null, empty and letterless texts go; so does every text if no row has a
    language to learn from. Each row is judged by itself: rows that share an
    id, equal rows too, stay or go each by their own text.
    """
    prepare(spark)
    rows = language.predict(docs, language.fit(docs), carry=COLUMNS)
    return rows.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(*COLUMNS)


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the repetition limits.

    Null and empty texts, and those of fewer than ten words, go. Each row is
    judged by its own text, so repeated ids and rows don't matter.
    """
    prepare(spark)
    return repetition.repetition_rules(docs, carry=COLUMNS).where("kept").select(*COLUMNS)


def by_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id.

    Rows that share an id are one document: they stay or go together, all of
    them, if any of their texts is near one of a smaller id. Texts without a
    word and null ids are near nothing and stay.
    """
    prepare(spark)
    gone = near_dedup.near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def by_substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of earlier documents; documents of which no word is left go.

    Untouched texts stay as they are, white space too; null and empty texts
    have nothing to lose and stay. Rows that share an id are cut each by its
    own text. n_chars follows the text.
    """
    prepare(spark)
    rows = phrase_dedup.without_repeats(docs, carry=COLUMNS).where("kept_text IS NULL OR kept_text != ''")
    text = F.coalesce("kept_text", "text")
    return rows.select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("n_removed") > 0, F.length(text)).otherwise(F.col("n_chars")).cast("long").alias("n_chars"))


def by_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in packed sequences.

    Null and empty texts are one piece of the end id; repeated rows are packed
    each. Equally long pieces are exchangeable: which of them takes which place
    is open.
    """
    prepare(spark)
    return packing.pack_documents(docs, WORD_BPE, capacity=2048, end_id=0)


STAGES = [
    ("language", by_language),
    ("quality", by_quality),
    ("near_dedup", by_near_dedup),
    ("substring_dedup", by_substring_dedup),
    ("packing", by_packing),
]

#: Languages, similarities and tokens are beyond SQL; tests/llm/test_pipeline.py compares each stage and run() with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again; columns other than a document's are left out at once."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs, _ = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
