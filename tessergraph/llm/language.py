"""Language identification by string kernels.

The kernel of two texts is the number of character 1-, 2- and 3-grams present
in both, over the root of the product of the numbers in each (a blended
spectrum of presence). Grams are hashed into DIMENSIONS places. A few texts of
each language are landmarks: with the Nyström approximation a text is seen
through its kernel values with the landmarks alone, and one ridge regression
per language (one against the rest) is fitted there. Scoring a batch is two
matrix products.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessergraph.llm.common import crc_fold, map_rows, map_texts

DIMENSIONS = 8192
#: Bounds of the training sample, per language: rows fitted on, and those that are landmarks.
SAMPLE_ROWS, LANDMARKS = 400, 40
#: Bounds of all of them together; with many languages each has fewer. More languages than landmarks are an error.
ALL_ROWS, ALL_LANDMARKS = 8000, 800
RIDGE = 1e-3
UNKNOWN = "und"
#: Texts in one matrix product.
BLOCK = 256

_FOLD = np.arange(128, dtype=np.uint32)
_FOLD[[i for i in range(128) if not chr(i).isalpha()]] = 32
_M = np.uint32(0x9E3779B1)
_SHIFT = np.uint32(32 - DIMENSIONS.bit_length() + 1)


def presence(text: str, into: np.ndarray) -> None:
    """Sets ``into`` (DIMENSIONS of zeros) to 1 at each gram's place. ASCII other than letters counts as space."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    low = points < 128
    points = np.where(low, _FOLD[np.where(low, points, 0)], points)
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 32) | (points[:-1] != 32)
    gram = points[keep] * _M
    single = gram
    for n in (1, 2, 3):
        if n > 1:
            gram = (gram[:-1] ^ (gram[:-1] >> np.uint32(15))) * _M + single[n - 1 :]
        if len(gram):
            into[((gram ^ (gram >> np.uint32(13))) * _M) >> _SHIFT] = 1


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def rows_of(texts: list[str]) -> np.ndarray:
    """Presence rows scaled to length 1, so that a product of two is their kernel."""
    rows = np.zeros((len(texts), DIMENSIONS), np.float32)
    for text, row in zip(texts, rows):
        presence(text, row)
    return rows / np.sqrt(np.maximum(rows.sum(1, keepdims=True), 1))


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray  # m x DIMENSIONS
    weights: np.ndarray  # (m + 1) x languages

    def outputs(self, texts: list[str]) -> np.ndarray:
        kernel = rows_of(texts) @ self.landmarks.T
        return kernel @ self.weights[:-1] + self.weights[-1]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language and a score from 0 to 1; UNKNOWN and 0 where there is no letter."""
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        at = [i for i, t in enumerate(texts) if self.languages and has_letter(t)]
        for a in range(0, len(at), BLOCK):
            part = at[a : a + BLOCK]
            out = self.outputs([texts[i] for i in part])
            likely = np.clip(out, 1e-6, None)
            best = out.argmax(1)
            share = likely[np.arange(len(part)), best] / likely.sum(1)
            for i, k, s in zip(part, best, share):
                names[i], scores[i] = self.languages[k], float(s)
        return names, scores


def scaled(bits: np.ndarray) -> np.ndarray:
    """Packed presence rows as rows of length 1."""
    rows = np.unpackbits(bits, axis=1).astype(np.float32)
    return rows / np.sqrt(np.maximum(rows.sum(1, keepdims=True), 1))


def fit_sample(languages: list[str], bits: np.ndarray) -> Model:
    """Kernel ridge regression in the landmarks' space; languages[i] is that of bits[i] (packed presence), landmarks of each come first."""
    names = sorted(set(languages))
    each = max(1, min(LANDMARKS, ALL_LANDMARKS // len(names)))
    seen = dict.fromkeys(names, 0)
    marks = []
    for i, name in enumerate(languages):
        if seen[name] < each:
            marks.append(i)
        seen[name] += 1
    landmarks = scaled(bits[marks])
    values, vectors = np.linalg.eigh((landmarks @ landmarks.T).astype(float))
    good = values > 1e-6 * max(values.max(), 1e-9)
    root = vectors[:, good] / np.sqrt(values[good])
    kernel = np.concatenate([scaled(bits[a : a + BLOCK]) @ landmarks.T for a in range(0, len(bits), BLOCK)])
    features = np.column_stack((kernel.astype(float) @ root, np.ones(len(bits))))
    target = (np.array(languages)[:, None] == np.array(names)).astype(float)
    size = (target / target.sum(0)).sum(1) * len(languages) / len(names)  # languages weigh the same
    gram = features.T @ (features * size[:, None])
    gram[np.diag_indices(len(gram) - 1)] += RIDGE * len(bits)
    solved = np.linalg.solve(gram + 1e-9 * np.eye(len(gram)), features.T @ (target * size[:, None]))
    return Model(names, landmarks, np.vstack((root @ solved[:-1], solved[-1:])).astype(np.float32))


def fit(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "lang") -> Model:
    """Learns from SAMPLE_ROWS distinct rows of each language, in the order of a hash of id and text.

    Rows without label or letter, and those of the held-out fold, are left out.
    A threshold on the hash, from the language's count, leaves about twice as
    many rows as are wanted, before anything is dealt by language; what comes
    to the driver is ALL_ROWS presence rows at most. Labels beyond
    ALL_LANDMARKS raise an error.
    """
    spark = docs.sparkSession
    usable = (
        docs.select(docs[id_column].alias("key"), docs[label_column].cast("string").alias("label"), docs[text_column].alias("text"))
        .where(F.col("label").isNotNull() & F.col("key").isNotNull() & (crc_fold("key") != 2) & F.col("text").rlike(r"\p{L}"))
    )
    counts = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count("*").alias("n")).limit(ALL_LANDMARKS + 1).collect()}
    if len(counts) > ALL_LANDMARKS:
        raise ValueError(f"more than {ALL_LANDMARKS} languages")
    if not counts:
        return Model([], np.zeros((0, DIMENSIONS), np.float32), np.zeros((1, 0), np.float32))
    wanted = min(SAMPLE_ROWS, ALL_ROWS // len(counts))
    steps = spark.createDataFrame([(name, max(1, n // (2 * wanted))) for name, n in sorted(counts.items())], "label string, one_in long")
    drawn = usable.withColumn("draw", F.xxhash64("key", "text")).join(F.broadcast(steps), "label")  # at most ALL_LANDMARKS rows
    drawn = drawn.where(F.pmod("draw", "one_in") == 0).select("label", "draw", "text")

    def make():
        def one(batch):
            texts = batch.column(2).to_pylist()
            kept = [i for i, t in enumerate(texts) if has_letter(t)]
            rows = np.zeros((len(kept), DIMENSIONS), np.uint8)
            for row, i in zip(rows, kept):
                presence(texts[i], row)
            return {"label": batch.column(0).take(kept), "draw": batch.column(1).take(kept), "bits": [np.packbits(r).tobytes() for r in rows]}

        return one

    sample = map_rows(drawn, "label string, draw long, bits binary", make).groupBy("label", "draw").agg(F.first("bits").alias("bits"))
    place = F.row_number().over(Window.partitionBy("label").orderBy("draw"))
    found = sample.withColumn("place", place).where(F.col("place") <= wanted).collect()
    found.sort(key=lambda r: (r["place"], r["label"]))
    if not found:
        return Model([], np.zeros((0, DIMENSIONS), np.float32), np.zeros((1, 0), np.float32))
    return fit_sample([r["label"] for r in found], np.frombuffer(b"".join(bytes(r["bits"]) for r in found), np.uint8).reshape(len(found), -1))


def predict(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: its id, the ``carry`` columns, ``lang_pred`` and ``score``.

    Null texts and texts without a letter are ``und`` with score 0, and so is
    every text if there was nothing to learn from. Each row is judged by
    itself, so repeated rows don't matter; of equal outputs the first language
    by name is taken; only the columns named are read, so others can't clash.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def one(texts):
            names, scores = shared.value.predict(texts.to_pylist())
            return {"lang_pred": names, "score": scores}

        return one

    return map_texts(docs, id_column, text_column, "lang_pred string, score double", make, carry)
