"""Quality by regularised quadratic discriminant analysis.

Each document becomes a short vector of transformed statistics. Per class a
mean and a covariance are formed from sums over all labelled training rows;
the covariance is shrunk towards its diagonal and the mean variance. The score
is the posterior of class 1 from the difference of log densities, with
Mahalanobis distances by cached Cholesky factors.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessergraph.llm.common import as_bytes, crc_fold, map_rows, map_texts, prepare, written

#: Shares of the covariance replaced by its diagonal, and by the mean variance.
TO_DIAGONAL, TO_SCALE = 0.10, 0.02
THRESHOLD = 0.7

NAMES = (
    "word_length", "upper", "symbols", "digits", "exclaims", "distinct", "top_word", "same_next",
    "repeated_lines", "repeated_triples", "bare_words", "mark_tails", "mark_runs", "word_entropy", "byte_entropy",
)
#: A share is seen beside so many more characters or words of usual prose, so that a short text says little.
USUAL_CHARS, USUAL_WORDS, USUAL_LENGTH, USUAL_UPPER = 200, 20, 6.0, 0.03
#: Entropies of usual prose, which a short text is drawn to: of words relative to the most there can be, and of bytes.
USUAL_WORD_ENTROPY, USUAL_BYTE_ENTROPY = 0.97, 4.2
_DIGITS = b"0123456789"
#: ASCII marks that prose has between its words, and all others.
_PROSE = b".,;:!?'\"()-"
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_SYMBOLS = _MARKS.translate(None, _PROSE)
_IS_MARK = np.zeros(256, bool)
_IS_MARK[list(_MARKS)] = True


def _root(share: float) -> float:
    """Spreads shares near 0 and near 1 alike."""
    return float(np.arcsin(np.sqrt(min(max(share, 0.0), 1.0))))


def _entropy(counts: np.ndarray) -> float:
    """In bits."""
    shares = counts[counts > 0] / counts.sum()
    return float(-(shares * np.log2(shares)).sum())


def _capitals(text: str) -> int:
    """Characters that have a lower case other than themselves."""
    low = text.lower()
    if len(low) != len(text):
        return sum(c != c.lower() for c in text)
    a, b = (np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in (text, low))
    return int((a != b).sum())


def statistics(data: bytes) -> list[float]:
    """The vector of one text, of any language and script; an empty text is like usual prose."""
    words = data.split()
    n = len(words)
    some = n + USUAL_WORDS
    counts = Counter(words)
    triples = Counter(zip(words, words[1:], words[2:]))
    lines = [x for x in data.split(b"\n") if x.strip()]
    raw = np.frombuffer(data, np.uint8)
    marks = _IS_MARK[raw]
    text = data.decode("utf-8", "replace")
    letters = len(text) - int(marks.sum()) - (len(data) - len(data.translate(None, b" \t\n\r\v\f0123456789")))

    def share(chars: bytes) -> float:
        return _root((len(data) - len(data.translate(None, chars))) / (len(data) + USUAL_CHARS))

    def drawn(value: float, usual: float, size: int, weight: int) -> float:
        return (size * value + weight * usual) / (size + weight)

    word_entropy = _entropy(np.fromiter(counts.values(), float, len(counts))) / np.log2(max(n, 2)) if n > 1 else USUAL_WORD_ENTROPY
    byte_entropy = _entropy(np.bincount(raw, minlength=256)) if len(raw) else USUAL_BYTE_ENTROPY
    return [
        float(np.log((sum(map(len, words)) + USUAL_WORDS * USUAL_LENGTH) / some)),
        _root((_capitals(text) + USUAL_CHARS * USUAL_UPPER) / (letters + USUAL_CHARS)),
        share(_SYMBOLS),
        share(_DIGITS),
        share(b"!?"),
        float(np.log(len(counts) + USUAL_WORDS) / np.log(some)),
        _root(max(counts.values(), default=0) / some),
        _root(sum(map(bytes.__eq__, words, words[1:])) / some),
        _root((len(lines) - len(set(lines))) / (len(lines) + 5)),
        _root(sum(c for c in triples.values() if c > 1) / some),
        _root(sum(c for w, c in counts.items() if not w.translate(None, _MARKS)) / some),
        _root(sum(c for w, c in counts.items() if len(w) - len(w.rstrip(_MARKS)) > 1) / some),
        _root(int((marks[1:] & marks[:-1]).sum()) / (len(data) + USUAL_CHARS)),
        drawn(word_entropy, USUAL_WORD_ENTROPY, n, USUAL_WORDS),
        drawn(byte_entropy, USUAL_BYTE_ENTROPY, len(data), USUAL_CHARS),
    ]


def vectors(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: its id and ``x``, the statistics of the whole text (null: of an empty one)."""
    prepare(docs.sparkSession)

    def make():
        return lambda texts: {"x": [statistics(d or b"") for d in as_bytes(texts)]}

    return map_texts(docs, id_column, text_column, "x array<double>", make)


@dataclass
class Discriminant:
    means: np.ndarray  # 2 x p
    factors: list[np.ndarray]  # lower Cholesky factor of each class's covariance, inverted
    offsets: np.ndarray  # log prior less half the log determinant

    def score(self, x: np.ndarray) -> np.ndarray:
        """Posterior of class 1 for each row."""
        log = [o - 0.5 * np.square((x - m) @ f.T).sum(1) for m, f, o in zip(self.means, self.factors, self.offsets)]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))


def from_moments(count: np.ndarray, total: np.ndarray, square: np.ndarray) -> Discriminant | None:
    """count: 2; total: 2 x p; square: 2 x p x p, sums of outer products. None without rows of both classes."""
    if (count < 2).any():
        return None
    p = total.shape[1]
    means = total / count[:, None]
    scatter = [square[k] - count[k] * np.outer(means[k], means[k]) for k in (0, 1)]
    pooled = np.diag((scatter[0] + scatter[1]) / count.sum()).clip(1e-6)
    factors, offsets = [], []
    for k in (0, 1):
        # In units of the pooled deviations, so that shrinking treats all statistics alike.
        unit = np.sqrt(pooled)
        c = scatter[k] / (count[k] - 1) / np.outer(unit, unit)
        c = (1 - TO_DIAGONAL - TO_SCALE) * c + TO_DIAGONAL * np.diag(np.diag(c)) + TO_SCALE * max(np.trace(c) / p, 0.1) * np.eye(p)
        low = np.linalg.cholesky(c)
        factors.append(np.linalg.inv(low) / unit)
        offsets.append(np.log(count[k] / count.sum()) - np.log(np.diag(low)).sum())
    return Discriminant(means, factors, np.array(offsets))


def fit(labelled: DataFrame) -> Discriminant | None:
    """From all rows of (x, label): sums by class and task in numpy, then one sum by class and place."""
    p = len(NAMES)

    def make():
        def one(batch):
            x = np.array(batch.column(0).to_pylist(), float).reshape(-1, p)
            y = batch.column(1).to_numpy(zero_copy_only=False)
            return {
                "label": [0, 1],
                "sums": [np.concatenate(([len(r)], r.sum(0), (r.T @ r).ravel())) for r in (x[y == 0], x[y == 1])],
            }

        return one

    parts = map_rows(labelled.select("x", F.col("label").cast("int")).where("label in (0, 1)"), "label int, sums array<double>", make, gather=1 << 20)
    sums = parts.select("label", F.posexplode("sums").alias("place", "v")).groupBy("label", "place").agg(F.sum("v").alias("v"))
    held = np.zeros((2, 1 + p + p * p))
    for r in sums.collect():
        held[r["label"], r["place"]] = r["v"]
    return from_moments(held[:, 0], held[:, 1 : 1 + p], held[:, 1 + p :].reshape(2, p, p))


def quality_scores(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: its id, held_out, ``score`` and ``predicted``.

    labels: doc_id and quality (0 or 1; others are left out). Statistics are
    computed once and written; labels meet them, not the texts. A null text
    counts as empty; a null id is in no fold and learns nothing. Repeated rows
    are scored each, and learnt from each. Without two rows of both classes
    every score is 0.5; an empty table gives an empty one. Only the columns
    named are read, so other names can't clash.
    """
    spark = docs.sparkSession
    x, _ = written(vectors(docs, id_column, text_column), "statistics")
    known = labels.select(F.col("doc_id").alias("_id"), F.col("quality").alias("label"))
    known = known.where(crc_fold("_id") != 2)
    model = fit(x.join(known, x[id_column] == known["_id"]).select("x", "label"))
    shared = spark.sparkContext.broadcast(model)
    key = x.schema[id_column].dataType.simpleString()

    def make():
        def one(batch):
            x = np.array(batch.column(1).to_pylist(), float)
            m = shared.value
            return {"key": batch.column(0), "score": m.score(x) if m else np.full(len(x), 0.5)}

        return one

    rows = map_rows(x.select(id_column, "x"), f"key {key}, score double", make)
    return rows.select(
        F.col("key").alias(id_column),
        F.coalesce(crc_fold("key") == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
