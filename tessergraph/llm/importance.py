"""Importance resampling toward a target corpus: hashed n-gram features, log ratios of two bags, a Gumbel top-k draw.

Words and features are found by a byte automaton over the UTF-8 buffer of an
Arrow column: a lookup table classes all bytes at once, word boundaries are
the differences of classes, and the CRCs of all features advance together, one
byte of each a step. Two passes over the corpus: counts by bucket, then
scores; what passes between them is one number a bucket, whatever the input.

Texts that are null or without a word have no feature and weigh 0. Repeated
rows each count and each may be drawn. A null id is hashed as the empty text
and stands last among equal scores. Columns beside id and text are ignored,
so they may clash with those of the result. Empty corpora or targets give
counts of zero, for which the gain is still defined.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessergraph.llm.common import drop, map_rows, written

BUCKETS, NGRAM, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: Bytes of text that a task classes at once.
GATHER_BYTES = 4 << 20
#: Steps in which all CRCs advance together; the few features that are longer are finished one by one.
STEPS = 256

#: For each byte its lower case, or 0 where no word has it: words are ASCII letters and digits and all bytes of other characters.
LOWER = np.zeros(256, np.uint8)
LOWER[0x30:0x3A] = np.arange(0x30, 0x3A)
LOWER[0x41:0x5B] = LOWER[0x61:0x7B] = np.arange(0x61, 0x7B)
LOWER[0x80:] = np.arange(0x80, 0x100)


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


CRC = _crc_table()


def crcs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """crc32 of each stretch of ``data``; all advance by a byte a step, the longest first, so that those still running are a prefix."""
    order = np.argsort(-lengths, kind="stable")
    at, left = starts[order], lengths[order]
    state = np.full(len(order), 0xFFFFFFFF, np.uint32)
    running = len(order)
    for step in range(min(STEPS, int(left[0]) if len(left) else 0)):
        running = int(np.searchsorted(-left[:running], -step, "left"))
        state[:running] = CRC[(state[:running] ^ data[at[:running] + step]) & 0xFF] ^ (state[:running] >> 8)
    out = np.empty(len(order), np.uint32)
    out[order] = ~state
    for i in np.flatnonzero(lengths > STEPS).tolist():
        out[i] = zlib.crc32(data[starts[i] + STEPS : starts[i] + lengths[i]].tobytes(), int(out[i]))
    return out


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes, and where each row begins and the last ends; null rows are empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def features(column: pa.Array, ngram: int = NGRAM, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and bucket of each feature, every run of 1 to ``ngram`` words of a row; and the number of words of each row."""
    data, offsets = utf8(column)
    lower = LOWER[data]
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = lower != 0
    turns = np.diff(inside)
    first, last = turns[:-1] == 1, turns[1:] == -1
    # A row's edge ends words, too, where bytes of words stand on both of its sides.
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    edges = edges[(lower[edges] != 0) & (lower[edges - 1] != 0)] if len(edges) else edges
    first[edges], last[edges - 1] = True, True
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(offsets, starts, "right") - 1
    n_words = np.bincount(row, minlength=len(column))
    if ngram > 1:  # words closed up to one space, so that a run of words is a stretch of bytes
        size = ends - starts
        begins = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
        packed = np.full(int((size + 1).sum()), 0x20, np.uint8)
        mask = np.ones(len(packed), bool)
        mask[begins + size] = False
        packed[mask] = lower[lower != 0]
        lower, starts, ends = packed, begins, begins + size
    rows, hashes = [row], [crcs(lower, starts, ends - starts)]
    for n in range(2, ngram + 1):
        if len(row) >= n:
            same = row[n - 1 :] == row[: 1 - n]
            rows.append(row[: 1 - n][same])
            hashes.append(crcs(lower, starts[: 1 - n][same], (ends[n - 1 :] - starts[: 1 - n])[same]))
    return np.concatenate(rows), np.concatenate(hashes).astype(np.int64) % buckets, n_words


def bucket_counts(texts: DataFrame, text_column: str = "text", ngram: int = NGRAM, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket over all texts; at most ``buckets`` rows leave a task or reach the driver."""

    def make():
        def count(batch: pa.RecordBatch) -> dict[str, list]:
            found = np.bincount(features(batch.column(0), ngram, buckets)[1], minlength=buckets)
            held = np.flatnonzero(found)
            return {"bucket": held, "n": found[held]}

        return count

    rows = map_rows(texts.select(F.col(text_column).alias("text")), "bucket long, n long", make, GATHER_BYTES)
    out = np.zeros(buckets, np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of both smoothed shares, for each bucket."""
    n = float(len(source))
    s, t = float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + n) / ((a + 1.0) * (t + n)))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(id_column: Column, seed: int = SEED) -> Column:
    """floor(1000 x) of a Gumbel number that the id fixes."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit(""))), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def weighed(docs: DataFrame, gain: np.ndarray, id_column: str = "doc_id", text_column: str = "text", ngram: int = NGRAM, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of each document."""

    def make():
        def weigh(batch: pa.RecordBatch) -> dict[str, list]:
            row, bucket, n_words = features(batch.column(1), ngram, len(gain))
            n = batch.num_rows
            # Sums of whole numbers, exact below 2^53.
            weight = np.bincount(row, gain[bucket].astype(float), n)
            return {"doc_id": batch.column(0), "n_words": n_words, "n_features": np.bincount(row, minlength=n), "weight": weight.astype(np.int64)}

        return weigh

    kind = docs.schema[id_column].dataType.simpleString()
    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    rows = map_rows(source, f"doc_id {kind}, n_words long, n_features long, weight long", make, GATHER_BYTES)
    return rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def drawn(scored: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """``scored`` (doc_id, n_words, score) with ``rank``: 1, 2, 3... by falling score for the share drawn of all documents long enough, else null.

    Ranks come from one sort by ranges and the sizes of its partitions, so no
    task sees all rows. Repeated rows are parted by their place in the input.
    """
    spark = scored.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fit = F.col("n_words") >= least_words
    order = [F.when(fit, 0).otherwise(1), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("_row")]
    held, path = written(scored, "scored")  # ranges are drawn from a first pass over the rows
    dealt = held.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    table, _ = written(dealt.drop("_row").withColumn("_place", F.monotonically_increasing_id()), "sorted")
    drop(spark, path)
    part, inside = F.shiftright("_place", 33), F.col("_place").bitwiseAND((1 << 33) - 1)
    sizes = table.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.count_if(fit).alias("fit")).orderBy("part").collect()  # a row a partition
    limit, before, starts = percent * sum(r["fit"] for r in sizes) // 100, 0, {}
    for r in sizes:
        starts[r["part"]] = before
        before += r["n"]
    first = F.element_at(F.create_map(*(F.lit(x) for kv in starts.items() for x in kv)), part) if starts else F.lit(0)
    place = (first + inside + 1).cast("long")
    return table.withColumn("rank", F.when(place <= limit, place)).drop("_place")


def resample(
    docs: DataFrame, target: DataFrame, id_column: str = "doc_id", text_column: str = "text", target_column: str = "text", ngram: int = NGRAM,
    buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED,
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every document: the drawn ones, by rank, resemble the target's texts."""
    gain = gains(bucket_counts(docs, text_column, ngram, buckets), bucket_counts(target, target_column, ngram, buckets))
    return drawn(weighed(docs, gain, id_column, text_column, ngram, seed), least_words, percent)
