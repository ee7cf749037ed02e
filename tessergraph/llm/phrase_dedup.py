"""Substring dedup with repeated-phrase automata.

A word goes if a window of WINDOW words over it also starts in a document of
smaller id. All such windows are found, without comparing documents:

1. Of each window the ANCHOR-gram of the smallest hash is its anchor, so equal
   windows have equal anchors, and a text has few. Anchors found in two
   documents may lie in recurring passages; windows of other anchors cannot
   recur.
2. The stretches of text around such anchors, words and all, are routed to the
   anchor's shard. Equal stretches are one there, however many documents hold
   them.
3. In each shard the words themselves are numbered, so that equal numbers are
   equal words. Recurring windows are confirmed, compiled into an Aho-Corasick
   automaton over the numbers, and all stretches are streamed through it; each
   match gives the first document that has the phrase. Hashes only propose.
4. Matches go back to the documents, which drop the covered words.

An anchor of very many documents is routed window by window, so neither common
phrases nor common beginnings make a large shard. Documents whose words are
the same throughout (by a 128-bit digest) count once; of copies with at least
one window everything goes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessergraph.llm.common import as_bytes, drop, map_rows, prepare, window_hashes, word_hashes, written

WINDOW, ANCHOR = 13, 5
#: Documents of an anchor above which its windows are routed one by one.
COMMON = 1000
#: Distinct stretches of an automaton, about: its root is searched in line, so many small automata beat a large one.
SHARD_ROWS = 300


def anchors_of(words: np.ndarray) -> np.ndarray:
    """The anchor of each window."""
    low, width, wanted = window_hashes(words, ANCHOR), 1, WINDOW - ANCHOR + 1
    while width < wanted:  # least of ever wider windows
        step = min(width, wanted - width)
        low, width = np.minimum(low[:-step], low[step:]), width + step
    return low


def text_digest(text: Column) -> Column:
    """Tells the texts of rows that share an id apart; of null it is that of an empty text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def outline(docs: DataFrame) -> DataFrame:
    """key, t0 (see `text_digest`), digest (d0, d1) of the words, their number, and the distinct anchors."""

    def make():
        def one(batch):
            out: dict[str, list] = {k: [] for k in ("d0", "d1", "n_words", "anchors")}
            for data in as_bytes(batch.column(2)):
                words = (data or b"").split()
                d0, d1 = np.frombuffer(xxhash.xxh3_128_digest(b" ".join(words)), np.int64).tolist()
                anchors = np.unique(anchors_of(word_hashes(words))).view(np.int64) if len(words) >= WINDOW else []
                for name, value in zip(out, (d0, d1, len(words), anchors)):
                    out[name].append(value)
            return {"key": batch.column(0), "t0": batch.column(1)} | out

        return one

    return map_rows(docs, "key long, t0 long, d0 long, d1 long, n_words long, anchors array<long>", make)


def stretches(docs: DataFrame, flagged: DataFrame) -> DataFrame:
    """shard, content, key, t0, start and words (single spaces between) around the flagged anchors of each document."""

    def make():
        def one(batch):
            out: dict[str, list] = {k: [] for k in ("shard", "content", "key", "t0", "start", "words")}
            for key, t0, data, anchors, common in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2)), batch.column(3), batch.column(4)):
                words = (data or b"").split()
                if len(words) < WINDOW:
                    continue
                each = anchors_of(word_hashes(words)).view(np.int64)
                begins = np.flatnonzero(np.concatenate(([True], each[1:] != each[:-1])))
                ends = np.append(begins[1:], len(each))
                common_at = dict(zip(anchors.values.to_pylist(), common.values.to_pylist()))
                wanted = np.flatnonzero(np.isin(each[begins], anchors.values.to_numpy()))
                for i in wanted.tolist():
                    a, b, anchor = int(begins[i]), int(ends[i]), int(each[begins[i]])
                    parts = [(a, b)] if not common_at[anchor] else [(k, k + 1) for k in range(a, b)]
                    for x, y in parts:
                        held = b" ".join(words[x : y + WINDOW - 1])
                        content, other = np.frombuffer(xxhash.xxh3_128_digest(held), np.int64).tolist()
                        shard = other if common_at[anchor] else anchor
                        for name, value in zip(out, (shard, content, key, t0, x, held)):
                            out[name].append(value)
            return out if out["key"] else None

        return one

    met = docs.join(flagged, "key").select("key", "t0", "text", "anchors", "common")
    return map_rows(met, "shard long, content long, key long, t0 long, start int, words binary", make)


def _groups(numbers: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order in which equal windows (WINDOW numbers from each place of ``at``) stand together, and where each group begins."""
    hashes = window_hashes(numbers.astype(np.uint64), WINDOW)[at]
    order = np.argsort(hashes, kind="stable")
    begins = np.flatnonzero(np.concatenate(([True], np.diff(hashes[order]) != 0)))
    windows = numbers[at[order, None] + np.arange(WINDOW)]
    if (windows == np.repeat(windows[begins], np.diff(np.append(begins, len(at))), axis=0)).all():
        return order, begins
    _, group = np.unique(numbers[at[:, None] + np.arange(WINDOW)], axis=0, return_inverse=True)  # two windows share a hash
    order = np.argsort(group.ravel(), kind="stable")
    return order, np.flatnonzero(np.concatenate(([True], np.diff(group.ravel()[order]) != 0)))


def locate(rows: list[tuple[int, int, bytes, int, int]]) -> Iterator[tuple[int, int, list[int], list[int]]]:
    """(shard, content, words, first document, last document) of one shard -> shard, content, places of recurring windows and their first documents."""
    number: dict[bytes, int] = {}
    texts = [r[2].split(b" ") for r in rows]
    flat = [number.setdefault(w, len(number)) for words in texts for w in words]
    lengths = np.array(list(map(len, texts)))
    starts = np.cumsum(lengths) - lengths
    sizes = lengths - WINDOW + 1
    row = np.repeat(np.arange(len(rows)), sizes)
    at = starts[row] + np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)  # windows over two texts are left out
    order, begins = _groups(np.array(flat, np.uint32), at)
    first, last = np.array([r[3] for r in rows])[row], np.array([r[4] for r in rows])[row]
    owner = np.minimum.reduceat(first[order], begins)
    again = owner < np.maximum.reduceat(last[order], begins)
    if not again.any():
        return
    phrases = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    owners = owner[again].tolist()
    for k, x in enumerate(at[order[begins[again]]].tolist()):
        phrases.add_word(tuple(flat[x : x + WINDOW]), k)
    phrases.make_automaton()
    recurs = np.repeat(again, np.diff(np.append(begins, len(order))))
    for j in np.unique(row[order[recurs]]).tolist():
        found = list(phrases.iter(tuple(flat[starts[j] : starts[j] + lengths[j]])))
        if found:
            yield rows[j][0], rows[j][1], [end - WINDOW + 1 for end, _ in found], [owners[k] for _, k in found]


def located(contents: DataFrame, shards: int) -> DataFrame:
    """Distinct stretches (shard, content, words, first, last) through the automaton of their shard."""
    schema = pa.schema([("shard", pa.int64()), ("content", pa.int64()), ("places", pa.list_(pa.int32())), ("owners", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finish(rows):
            done = list(locate(rows))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)

        now, held = None, []
        for batch in batches:
            for bucket, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != now:
                    if held:
                        yield from finish(held)
                    now, held = bucket, []
                held.append(row)
        if held:
            yield from finish(held)

    dealt = contents.withColumn("bucket", F.pmod(F.xxhash64("shard"), F.lit(shards))).repartition("bucket").sortWithinPartitions("bucket")
    return dealt.select("bucket", "shard", "content", "words", "first", "last").mapInArrow(run, "shard long, content long, places array<int>, owners array<long>")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """docs: key, t0 and text. Written table of key, t0, ``starts`` of the windows that begin in a document of smaller id, and ``whole``.

    whole: all words of the row are those of a document of smaller id. Rows
    that lose nothing are left out.
    """
    prepare(docs.sparkSession)
    seen, seen_path = written(outline(docs), "outline")
    usable = seen.where(f"key IS NOT NULL AND n_words >= {WINDOW}")
    # Only groups of copies are written, so the joins with them are of two dealt sides and a hot group's rows can be split.
    firsts = usable.groupBy("d0", "d1").agg(F.min("key").alias("first"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    firsts, firsts_path = written(firsts, "firsts")
    live = usable.join(firsts, ["d0", "d1"], "left").where("key = coalesce(first, key)").select("key", F.explode("anchors").alias("anchor"))
    live, live_path = written(live, "anchors")

    repeated = live.groupBy("anchor").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("*").alias("docs")).where("lo < hi")
    flagged = live.join(repeated, "anchor").select("key", "anchor", (F.col("docs") > COMMON).alias("is_common"))
    flagged = flagged.groupBy("key").agg(F.collect_list(F.struct("anchor", "is_common")).alias("x"))
    flagged, flagged_path = written(flagged.select("key", F.col("x.anchor").alias("anchors"), F.col("x.is_common").alias("common")), "flagged")
    drop(docs.sparkSession, live_path)

    parts, parts_path = written(stretches(docs, flagged), "stretches")
    contents = parts.groupBy("shard", "content").agg(F.first("words").alias("words"), F.min("key").alias("first"), F.max("key").alias("last"))
    shards = parts.count() // SHARD_ROWS + 1
    places, places_path = written(located(contents, shards), "located")
    hits = parts.select("shard", "content", "key", "t0", "start").join(places, ["shard", "content"])
    starts = F.expr("transform(filter(arrays_zip(places, owners), x -> x.owners < key), x -> start + x.places)")
    hits = hits.select("key", "t0", starts.alias("starts"), F.lit(False).alias("whole")).where("size(starts) > 0")
    copies = usable.select("key", "t0", "d0", "d1").join(firsts, ["d0", "d1"]).where("key > first")
    lost = hits.union(copies.select("key", "t0", F.array().cast("array<int>"), F.lit(True)).distinct())
    lost, _ = written(lost.groupBy("key", "t0").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.max("whole").alias("whole")), "lost")
    drop(docs.sparkSession, seen_path, firsts_path, flagged_path, parts_path, places_path)
    return lost


FIELDS = "n_words long, n_removed long, kept_sha256 string, kept_text string"


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: its id, the ``carry`` columns, n_words, n_removed, kept_sha256 and, where words were removed, ``kept_text``.

    Ids are integers. Null and empty texts have no words; texts shorter than a
    window keep all; a null id loses nothing. Rows of one id are judged each by
    its own text and lose nothing to each other. kept_text is null where
    nothing was removed. Only the columns named are read, so others can't
    clash; an empty table gives an empty one.
    """
    names = [id_column, *(c for c in carry if c != id_column)]
    named = docs.select(docs[id_column].cast("long").alias("key"), text_digest(docs[text_column]).alias("t0"), docs[text_column].alias("text"), *(docs[c].alias(f"c{i}") for i, c in enumerate(names)))
    lost = repeated_passages(named.select("key", "t0", "text")).withColumnsRenamed({"key": "_key", "t0": "_t0"})
    met = named.join(lost, (named["key"] == lost["_key"]) & (named["t0"] == lost["_t0"]), "left").drop("key", "t0", "_key", "_t0")
    held = [f"c{i}" for i in range(len(names))]

    def make():
        def one(batch):
            column = dict(zip(batch.schema.names, batch.columns))
            out: dict[str, list] = {k: [] for k in ("n_words", "n_removed", "kept_sha256", "kept_text")}
            for data, starts, whole in zip(as_bytes(column["text"]), column["starts"], column["whole"].to_pylist()):
                words = left = (data or b"").split()
                if whole:
                    left = []
                elif starts.is_valid:
                    at = starts.values.to_numpy()
                    steps = np.bincount(at, minlength=len(words) + 1) - np.bincount(at + WINDOW, minlength=len(words) + 1)
                    left = [words[i] for i in np.flatnonzero(np.cumsum(steps)[:-1] == 0).tolist()]
                text = b" ".join(left)
                gone = len(words) - len(left)
                for name, value in zip(out, (len(words), gone, hashlib.sha256(text).hexdigest(), text.decode() if gone else None)):
                    out[name].append(value)
            return {c: column[c] for c in held} | out

        return one

    kinds = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(names))
    rows = map_rows(met.select(*held, "text", "starts", "whole"), f"{kinds}, {FIELDS}", make)
    return rows.withColumnsRenamed({f"c{i}": c for i, c in enumerate(names)})
