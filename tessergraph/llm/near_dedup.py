"""Near-duplicate groups by b-bit MinHash, confirmed on full shingle sets.

1. Every document's set of word shingles gets a digest and HASHES minima.
   Documents of equal sets are one class from here on, so copies cost nothing.
2. Minima, ROWS at a time, are band keys. A pair at the threshold shares a
   band with all but about 5 in a million.
3. The low BITS of the minima are packed; counting equal ones and correcting
   for chance estimates a candidate's similarity. Only pairs six standard
   deviations below the threshold are let go.
4. What is left is confirmed on full sets.

Within a bucket the first and the last member are compared with all others.
That alone would lose a link between two others, so in buckets that still span
several components, members outside the first one's component ask all others.
They meet in blocks of bounded size, where intersections are counted in numpy
and only links are given out. Members that are linked already are not
compared, so a bucket of n like copies costs about 2n comparisons, and nothing
is capped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessergraph.llm.common import as_bytes, drop, is_empty, map_rows, mixed, prepare, window_hashes, word_hashes, written
from tessergraph.operators.traverse import components

WORDS, PERCENT = 5, 75
BANDS, ROWS, BITS = 32, 4, 2
HASHES = BANDS * ROWS
#: Candidates whose estimate is below this are let go: 0.75 less six standard deviations of the estimate.
LEAST_ESTIMATE = 0.47
#: Shingles in a block of members that ask, and of those that are asked.
ASK_SHINGLES, ALL_SHINGLES = 64_000, 500_000

_draw = np.random.default_rng(20240501)
_MULTIPLY = _draw.integers(0, 2**32, HASHES, np.uint32) | np.uint32(1)
_FLIP = _draw.integers(0, 2**32, HASHES, np.uint32)
_PLACE = np.arange(0, 64, BITS, dtype=np.uint64)
_BAND = _draw.integers(0, 2**63, (ROWS, 1), np.uint64) | np.uint64(1)
SIGNATURE = [f"s{i}" for i in range(HASHES * BITS // 64)]


def shingle_set(data: bytes) -> np.ndarray:
    """Sorted distinct shingle hashes: of 5 words, or of the whole text if it has fewer; ASCII letters in lower case."""
    words = data.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(window_hashes(word_hashes(words), min(WORDS, len(words))))


def minima(shingles: np.ndarray) -> np.ndarray:
    short = (mixed(shingles) >> np.uint64(32)).astype(np.uint32)
    low = np.full(HASHES, 2**32 - 1, np.uint32)
    for a in range(0, len(short), 1024):
        np.minimum(low, ((short[a : a + 1024, None] * _MULTIPLY) ^ _FLIP).min(0), out=low)
    return low


def packed(low: np.ndarray) -> np.ndarray:
    """The last BITS of each (scrambled) minimum, side by side in 64-bit words."""
    bits = (low * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    return (bits.astype(np.uint64).reshape(len(SIGNATURE), -1) << _PLACE).sum(1, dtype=np.uint64).view(np.int64)


def band_keys(low: np.ndarray) -> np.ndarray:
    rows = low.astype(np.uint64).reshape(BANDS, ROWS).T
    return mixed((rows * _BAND).sum(0, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def marks(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """key, n (set size), digest d0 and d1, the packed signature, and band keys (none for an empty set)."""

    def make():
        def one(batch):
            out: dict[str, list] = {k: [] for k in ("n", "d0", "d1", *SIGNATURE, "bands")}
            for data in as_bytes(batch.column(1)):
                s = shingle_set(data or b"")
                low = minima(s)
                digest = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64).tolist()
                for name, value in zip(out, (len(s), *digest, *packed(low).tolist(), band_keys(low) if len(s) else [])):
                    out[name].append(value)
            return {"key": batch.column(0)} | out

        return one

    longs = ", ".join(f"{c} long" for c in ("n", "d0", "d1", *SIGNATURE))
    return map_rows(docs.select(docs[id_column].cast("long"), docs[text_column]), f"key long, {longs}, bands array<long>", make)


def estimate(a: str, b: str):
    """Similarity from equal signature places, corrected for places that are equal by chance (SQL expression)."""
    low = "6148914691236517205"  # every other bit
    differ = " + ".join(
        f"bit_count((({a}.{s} ^ {b}.{s}) | shiftrightunsigned({a}.{s} ^ {b}.{s}, 1)) & {low})" for s in SIGNATURE
    )
    chance = 2.0**-BITS
    return f"(1.0D - ({differ}) / {HASHES}.0D - {chance}D) / {1 - chance}D"


def likely(a: str, b: str) -> str:
    return f"100 * least({a}.n, {b}.n) >= {PERCENT} * greatest({a}.n, {b}.n) AND {estimate(a, b)} >= {LEAST_ESTIMATE}D"


def _sets(docs: DataFrame, wanted: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(node, shingles) of the documents in ``wanted`` (rep)."""
    named = docs.select(docs[id_column].cast("long").alias("node"), docs[text_column].alias("text"))
    found = named.join(wanted, F.col("node") == F.col("rep"), "left_semi")

    def make():
        def one(batch):
            return {"node": batch.column(0), "shingles": [shingle_set(x or b"").tobytes() for x in as_bytes(batch.column(1))]}

        return one

    return map_rows(found, "node long, shingles binary", make)


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets meet the threshold."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))

    def make():
        def one(batch):
            a, b = [], []
            for i, j, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.intersect1d(x, y, assume_unique=True).size
                if 100 * both >= PERCENT * (len(x) + len(y) - both):
                    a.append(i)
                    b.append(j)
            return {"a": a, "b": b}

        return one

    return map_rows(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y"), "a long, b long", make)


def crossed(rows: list[tuple[int, int, int, bytes]]) -> list[tuple[int, int]]:
    """Links between askers and others of other components: (asks, rep, component, shingles). One for each asker and component.

    Askers' shingles are looked up in the others' sorted shingles, and
    intersections are counted by owner, so no pair is ever listed.
    """
    others = [r for r in rows if not r[0]]
    sets = [np.frombuffer(r[3], np.uint64) for r in others]
    if not sets:
        return []
    sizes = np.array([len(s) for s in sets])
    tokens = np.concatenate(sets)
    order = np.argsort(tokens, kind="stable")
    tokens, owners = tokens[order], np.repeat(np.arange(len(sets)), sizes)[order]
    reps, labels = np.array([r[1] for r in others]), np.array([r[2] for r in others])
    links = []
    for _, rep, component, held in (r for r in rows if r[0]):
        own = np.frombuffer(held, np.uint64)
        low, high = np.searchsorted(tokens, own, "left"), np.searchsorted(tokens, own, "right")
        n = high - low
        at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.bincount(owners[at], minlength=len(sets))
        good = np.flatnonzero((100 * both >= PERCENT * (sizes + len(own) - both)) & (labels != component))
        _, firsts = np.unique(labels[good], return_index=True)
        links += [(rep, int(reps[k])) for k in good[firsts]]
    return links


def _components(links: DataFrame) -> DataFrame:
    return components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))


def unmet(members: DataFrame, found: DataFrame, sets: DataFrame) -> DataFrame:
    """The links (a, b) within buckets that comparing with the first and last member has not joined.

    In each bucket that spans several components, members outside the first
    one's ask all members. Both are dealt into blocks of a bounded number of
    shingles, and each pair of blocks is one group.
    """
    label = found.select(F.col("node").alias("rep"), "component")
    named = members.where("size > 3").join(label, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    # By band and component first, so that a hot band is a few rows when bands meet; written, so that its members can be split in the join.
    parts = named.groupBy("band", "component").agg(F.sum("n").alias("n"), F.max(F.col("rep") == F.col("lo")).alias("is_main"))
    bands = parts.groupBy("band").agg(
        F.sum("n").alias("all_n"), F.sum(F.when(~F.col("is_main"), F.col("n"))).alias("ask_n"), F.max(F.when(F.col("is_main"), F.col("component"))).alias("main")
    )
    bands, _ = written(bands.where("ask_n > 0"), "open_bands")
    waiting = named.join(bands, "band").withColumn("asks", F.col("component") != F.col("main"))
    waiting = waiting.withColumn("ask_blocks", F.expr(f"CAST(1 + ask_n div {ASK_SHINGLES} AS INT)")).withColumn("all_blocks", F.expr(f"CAST(1 + all_n div {ALL_SHINGLES} AS INT)"))
    draw = F.xxhash64("rep")
    asking = waiting.where("asks").select("band", F.pmod(draw, "ask_blocks").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("all_blocks") - 1)).alias("j"), F.lit(True).alias("asks"), "rep", "component")
    all_of = waiting.select("band", F.explode(F.sequence(F.lit(0), F.col("ask_blocks") - 1)).alias("i"), F.pmod(draw, "all_blocks").cast("int").alias("j"), F.lit(False).alias("asks"), "rep", "component")
    rows = asking.union(all_of).join(sets.withColumnRenamed("node", "rep"), "rep").select("band", "i", "j", "asks", "rep", "component", "shingles")

    def meet(group: pa.Table) -> pa.Table:
        links = crossed(list(zip(*(group.column(c).to_pylist() for c in ("asks", "rep", "component", "shingles")))))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return rows.groupBy("band", "i", "j").applyInArrow(meet, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: its id, n_shingles, component_id and kept.

    Ids are integers. Documents without a word have an empty set and are
    linked with nothing. Rows of one id are one node. A null id is linked with
    nothing, has a null component and is kept. An empty table gives an empty
    one. Only the columns named are read, so other names can't clash.
    """
    spark = docs.sparkSession
    prepare(spark)
    seen, seen_path = written(marks(docs, id_column, text_column), "marks")

    # Equal sets are one class, named by its smallest id.
    usable = seen.where("n > 0 AND key IS NOT NULL")
    firsts = [F.first(c).alias(c) for c in ("n", *SIGNATURE, "bands")]
    classes, classes_path = written(usable.groupBy("d0", "d1").agg(F.min("key").alias("rep"), *firsts), "classes")
    drawn = classes.select("rep", "n", *SIGNATURE)

    # Buckets of two and more.
    placed = classes.select("rep", "n", F.explode("bands").alias("band"))
    shared = placed.groupBy("band").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.count("*").alias("size")).where("lo < hi")
    shared, shared_path = written(shared, "shared")  # so that the join is of two dealt sides and a hot band's members can be split
    members, members_path = written(placed.join(shared, "band").select("band", "rep", "n", "lo", "hi", "size"), "members")
    sets, sets_path = written(_sets(docs, members.select("rep").distinct(), id_column, text_column), "sets")

    def drawn_as(side: str, on: str) -> DataFrame:
        return drawn.withColumnRenamed("rep", on).alias(side)

    first = members.where("rep != lo").select(F.col("lo").alias("a"), F.col("rep").alias("b"))
    last = members.where("rep != lo AND rep != hi").select(F.col("rep").alias("a"), F.col("hi").alias("b"))
    stars = first.union(last).distinct()
    pairs = stars.join(drawn_as("p", "a"), "a").join(drawn_as("q", "b"), "b").where(likely("p", "q")).select("a", "b")
    links, links_path = written(confirmed(pairs, sets), "confirmed")
    found, found_path = written(_components(links), "components")
    rest, rest_path = written(unmet(members, found, sets), "rest")
    paths = [seen_path, classes_path, shared_path, members_path, sets_path, links_path, rest_path]
    if not is_empty(rest):
        paths.append(found_path)
        found, found_path = written(_components(links.union(rest)), "components")

    named = seen.join(classes.select("d0", "d1", "rep"), ["d0", "d1"], "left")
    result = named.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select(
        F.col("key").alias(id_column),
        F.col("n").alias("n_shingles"),
        F.when(F.col("key").isNotNull() & (F.col("n") > 0), F.coalesce("component", "rep")).otherwise(F.col("key")).alias("component_id"),
    )
    result = result.withColumn("kept", F.coalesce(F.col(id_column) == F.col("component_id"), F.lit(True)))
    result, _ = written(result, "groups")
    drop(spark, *paths, found_path)
    return result
