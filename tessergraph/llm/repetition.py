"""Quality rules by repetition coverage.

Words are hashed, n-gram hashes of several lengths are rolled over them in
numpy, and every character that lies in a word of an n-gram found twice or
more counts as covered. Lines are treated alike. A text goes if it fails the
base rules, or if more of it is covered than a length's limit allows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from tessergraph.llm.common import as_bytes, map_texts, prepare, word_hashes

#: Share of a text's word characters that may lie in repeated n-grams, by n, and in repeated lines.
LIMITS = {3: 0.50, 4: 0.40, 5: 0.30, 7: 0.25, 10: 0.20}
LINE_LIMIT = 0.30
MIN_WORDS, BASE_N, BASE_PERCENT = 10, 5, 20
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"

_B = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True


def covered(grams: np.ndarray, n: int, words: int) -> np.ndarray:
    """Which words lie in an n-gram that is found twice or more; the first one counts too."""
    order = np.argsort(grams)
    ordered = grams[order]
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return np.zeros(words, bool)
    twice = np.zeros(len(grams), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    steps = np.zeros(words + 1, np.int64)
    at = np.flatnonzero(twice)
    steps[:words] += np.bincount(at, minlength=words)[:words]
    steps -= np.bincount(at + n, minlength=words + 1)[: words + 1]
    return np.cumsum(steps[:words]) > 0


def measure(data: bytes) -> dict:
    """The statistics of one text."""
    raw = np.frombuffer(data, np.uint8)
    words = data.split()
    n = len(words)
    space = _SPACE[raw]
    points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    edges = np.flatnonzero(np.diff(np.concatenate(([True], space, [True]))))
    sizes = points[edges[1::2]] - points[edges[::2]]
    chars = int(sizes.sum())

    lines = data.split(b"\n")
    dup_lines = dup_line_chars = 0
    if len(lines) > 1:
        seen: set[bytes] = set()
        for line in lines:
            if line in seen:
                if line.strip(SPACES):
                    dup_lines += 1
                    dup_line_chars += sum(len(w.decode()) for w in line.split())
            else:
                seen.add(line)

    out = {
        "n_words": n,
        "word_chars": chars,
        "n_symbols": len(data) - len(data.translate(None, SYMBOLS)),
        "n_dup_lines": dup_lines,
        "n_repeat_words": 0,
        "line_share": dup_line_chars / chars if chars else 0.0,
        "gram_shares": [0.0] * len(LIMITS),
    }
    grams = hashes = word_hashes(words)
    for k in range(2, max(LIMITS) + 1):
        if n < k:
            break
        grams = grams[:-1] * _B + hashes[k - 1 :]
        if k in LIMITS:
            inside = covered(grams, k, n)
            out["gram_shares"][list(LIMITS).index(k)] = float(sizes[inside].sum() / chars)
            if k == BASE_N:
                out["n_repeat_words"] = int(inside.sum())
    failed = n < MIN_WORDS or 100 * out["n_repeat_words"] > BASE_PERCENT * n
    out["base_failed"] = failed
    out["kept"] = not failed and out["line_share"] <= LINE_LIMIT and all(s <= m for s, m in zip(out["gram_shares"], LIMITS.values()))
    return out


FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, line_share double, gram_shares array<double>, base_failed boolean, kept boolean"


def repetition_rules(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: its id, the ``carry`` columns and the statistics of `measure`.

    Null and empty texts have no words, fail the base rules and are not kept.
    Each row is judged by itself, so ties and repeated rows don't matter; only
    the columns named are read, so other names can't clash.
    """
    prepare(df.sparkSession)
    names = [f.split()[0] for f in FIELDS.split(", ")]

    def make():
        def one(texts):
            rows = [measure(x or b"") for x in as_bytes(texts)]
            return {n: [r[n] for r in rows] for n in names}

        return one

    return map_texts(df, id_column, text_column, FIELDS, make, carry)
