"""Collocations by contiguous pattern growth: frequent phrases and the cut that binds each least.

A frequent prefix is grown to the right, depth first, over pointers to its
occurrences (what PrefixSpan calls projection). Words are counted first, then
pairs of frequent words and triples of frequent pairs, both by a hash of 32
bits; an occurrence of a triple whose hash is frequent is then a pointer to up
to five words, cut off where a triple isn't frequent, since no longer phrase
can be. Equal pointers are summed in each task before they move, so copies
cost little, and move by the hundred, as numbers beside the words that they
share. A prefix's pointers go to one task and are summed there, sorted, where
a phrase is a run of them and its growth a run within that run. Prefixes are
three words long there: pairs are counted beside them, and a common pair
spreads over its next words.

A phrase must occur a fixed number of times, so in a larger corpus a larger
share of the words begins a frequent one, up to all of them: pointers grow
faster than the text until then, but are two for a word at most.

Which words, pairs and triples may be frequent reaches the tasks as bits of
tables of fixed size, at most 2 MB each. A wrong bit lets a rare phrase be
counted in vain; none is lost, whatever the vocabulary's size, and all counts
are of words.

Null and empty texts have no word; repeated rows count each time; a null
language is ``und``, and one with no word has no row. Words are all that lies
between spaces and tabs, NUL included. Texts are read in stretches, so their
length is no bound. Columns beside those named are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessergraph.llm.common import as_bytes, drop, joined, map_rows, prepare, written

LONGEST, LEAST, FIRST, PERCENT = 5, 100, 2000, 100
#: Bits that tell frequent words, pairs or triples from others.
FILTER_BITS = 1 << 24
#: Bytes of text that a task counts at once, and that it cuts into words at once.
GATHER_BYTES, STRETCH = 16 << 20, 1 << 20

#: Hashes of pairs and triples have 32 bits; those with the same upper 8 are counted together.
SLOT_BITS = 24
#: Pointers that a task holds before it gives them out, or sums those that it has got.
HELD_POINTERS = 1 << 19

_SPACE, _END = b" ", b"\n"


def _translation() -> bytes:
    table = bytearray(range(256))
    for c in range(0x41, 0x5B):
        table[c] = c + 32
    table[0x09] = 0x20
    for c in b".,;:!?\n\x0b\x0c\r":
        table[c] = 0x0A
    return bytes(table)


TRANSLATION = _translation()


class _Numbers(dict):
    """The number of each word, in the order in which they come; the end of a piece is 0, the empty word -1."""

    def __init__(self):
        super().__init__({_END: 0, b"": -1})
        self.words: list[bytes] = [b""]

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.words)
        self.words.append(word)
        return number


def _numbered(text: bytes, numbers: _Numbers) -> Iterator[np.ndarray]:
    """The numbers of a text's words, with 0 between pieces."""
    text = text.translate(TRANSLATION)
    at = 0
    while at < len(text):
        end = at + STRETCH
        if end < len(text):  # to the end of a word
            ends = [x for x in (text.find(_SPACE, end), text.find(_END, end)) if x >= 0]
            end = min(ends, default=len(text))
        words = text[at:end].replace(_END, b" \n ").split(_SPACE)
        found = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
        yield found[found >= 0]
        at = end


def _per_language(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, list[bytes]]]:
    """For each language of a batch: the numbers of all its words, 0 around each piece, and the words by number."""
    texts: dict[str, list[bytes]] = {}
    for lang, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
        texts.setdefault(lang, []).append(text)
    for lang, held in texts.items():
        numbers = _Numbers()
        gap = np.zeros(1, np.int64)
        parts = [gap]
        for text in held:
            parts += _numbered(text, numbers)
            parts.append(gap)
        yield lang, np.concatenate(parts), numbers.words


def _spoken(docs: DataFrame, lang_column: str, text_column: str) -> DataFrame:
    lang = F.coalesce(F.col(lang_column).cast("string"), F.lit("und"))
    return docs.select(lang.alias("lang"), F.col(text_column).alias("text")).where("text IS NOT NULL AND text != ''")


def _place_column(columns: list[Column], bits: int) -> Column:
    value = F.lit(0).cast("long")
    for c in columns:
        value = value * 31 + F.crc32(c.cast("binary"))
    return value % bits


def _filter(places: DataFrame, bits: int) -> np.ndarray:
    """A bit for each place (p); at most ``bits`` / 64 numbers reach the driver."""
    masks = places.groupBy(F.shiftright("p", 6).alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 AS int))")).alias("mask"))
    out = np.zeros(max(bits // 64, 1), np.int64)
    table = masks.toArrow()
    out[table.column("slot").to_numpy()] = table.column("mask").to_numpy()
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def _word_counts(docs: DataFrame) -> DataFrame:
    """(lang, phrase, f) of all words."""

    def make():
        def count(batch: pa.RecordBatch) -> dict[str, list]:
            langs, words, counts = [], [], []
            for lang, numbers, names in _per_language(batch):
                found = np.bincount(numbers, minlength=len(names))[1:]
                langs += [lang] * len(found)
                words += names[1:]
                counts.append(found)
            return {"lang": langs, "phrase": pa.array(words, pa.binary()).cast(pa.string()), "f": np.concatenate(counts)}

        return count

    rows = map_rows(docs, "lang string, phrase string, f long", make, GATHER_BYTES)
    return rows.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _bits(packed: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The bits at some places of a packed table."""
    places = places % (8 * len(packed))
    return (packed[places >> 3] >> (7 - (places & 7)).astype(np.uint8) & 1).astype(bool)


def _hashes(before, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Of 32 bits, of what is before and two words."""
    mixed = ((before * 31 + first) * 31 + second).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(32)).astype(np.int64)


def _runs(lang: str, numbers: np.ndarray, names: list[bytes], filters: list) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Whether a word, a pair, ... at each place may be frequent, as far as there are filters; and where one word more follows that may be, with its hash.

    filters: bits of words, of pairs, of triples, packed and broadcast.
    """
    base, codes = zlib.crc32(lang.encode()), np.fromiter(map(zlib.crc32, names), np.int64, len(names))
    fit = _bits(filters[0].value, base * 31 + codes)
    fit[0] = False  # the end of a piece
    code, found = codes[numbers], [fit[numbers]]
    hashes: np.ndarray | int = base
    for held in [*filters[1:], None]:
        last = found[-1]
        n = len(found) - 1  # words that are known to follow
        open_ = last[:-1] & last[1:]
        hashes = _hashes(hashes if n == 0 else hashes[:-1], code[n : len(code) - 1], code[n + 1 :])
        if held is None:
            return found, open_, hashes
        open_[open_] = _bits(held.value, hashes[open_])
        found.append(open_)
    raise AssertionError


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers of 32 bits as four planes of bytes, of which the upper ones compress to nothing."""
    return numbers.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view(np.uint32).ravel().astype(np.int64)


def _frequent(docs: DataFrame, filters: list, least: int) -> DataFrame:
    """(hash) of all hashes that occur ``least`` times, of pairs of frequent words or of what is a word longer than ``filters`` tell.

    A task gives out a few bytes for each hash that it met: sorted, as
    differences, packed. They are added up in tables of fixed size.
    """

    def make():
        pack = zstandard.ZstdCompressor().compress

        def count(batch: pa.RecordBatch) -> dict[str, list]:
            found = [np.empty(0, np.int64)]
            for lang, numbers, names in _per_language(batch):
                _, open_, hashes = _runs(lang, numbers, names, filters)
                found.append(hashes[open_])
            hashes, counts = np.unique(np.concatenate(found), return_counts=True)
            slots, begins = np.unique(hashes >> SLOT_BITS, return_index=True)
            out = []
            for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(hashes)], strict=True):
                steps = np.diff(hashes[a:b] & ((1 << SLOT_BITS) - 1), prepend=0)
                out.append(pack(_planes(np.concatenate([steps, np.minimum(counts[a:b], least)]))))
            return {"slot": slots, "packed": out}

        return count

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        slot, sums = None, np.zeros(1 << SLOT_BITS, np.uint32)

        def frequent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(sums >= least) + ((slot or 0) << SLOT_BITS), pa.int64())], names=["hash"])

        for batch in batches:
            for s, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if s != slot:
                    if slot is not None:
                        yield frequent()
                    slot = s
                    sums[:] = 0
                steps, counts = np.split(_from_planes(unpack(packed)), 2)
                at = np.cumsum(steps)
                sums[at] = np.minimum(sums[at] + counts, least)  # enough to tell
        if slot is not None:
            yield frequent()

    rows = map_rows(docs, "slot long, packed binary", make, GATHER_BYTES)
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, "slot").sortWithinPartitions("slot").mapInArrow(add, "hash long")


def _summed(rows: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of numbers below ``size``, sorted, and the sums of their counts."""
    group, bound = rows[:, 0], size
    for j in range(1, rows.shape[1]):  # equal rows get equal numbers
        if bound * size >= 1 << 63:
            group, bound = np.unique(group, return_inverse=True)[1], len(group)
        group, bound = group * size + rows[:, j], bound * size
    _, first, group = np.unique(group, return_index=True, return_inverse=True)
    sums = np.zeros(len(first), np.int64)
    np.add.at(sums, group, counts)
    return rows[first], sums


def _ahead(numbers: np.ndarray, both: np.ndarray, three: np.ndarray, longest: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs, and the distinct rows of words from each triple on, 0 beyond a pointer's end; and how often each comes."""
    at = np.flatnonzero(three)
    ahead = np.zeros((len(at), longest), np.int64)
    open_ = np.ones(len(at), bool)
    for j in range(longest):
        if j > 2:
            open_ &= three[np.minimum(at + j - 2, len(three) - 1)] & (at + j < len(numbers))
        ahead[open_, j] = numbers[at[open_] + j]
    ahead, counts = _summed(ahead, np.ones(len(at), np.int64), size)
    pairs = np.flatnonzero(both)
    keys, times = np.unique(numbers[pairs] * size + numbers[pairs + 1], return_counts=True)
    alone = np.zeros((len(keys), longest), np.int64)
    alone[:, 0], alone[:, 1] = keys // size, keys % size
    return np.concatenate([ahead, alone]), np.concatenate([counts, times])


class _Pointers:
    """Pointers of one language; equal ones are summed whenever twice as many are held as were left the last time."""

    def __init__(self, longest: int):
        self.numbers = _Numbers()
        self.rows, self.counts = [np.empty((0, longest), np.int64)], [np.empty(0, np.int64)]
        self.held, self.bound = 0, HELD_POINTERS

    def add(self, rows: np.ndarray, counts: np.ndarray, words: list[bytes]) -> None:
        """rows: places in ``words``, of which the first is the end."""
        number = np.fromiter(map(self.numbers.__getitem__, words[1:]), np.int64, len(words) - 1)
        self.rows.append(np.concatenate([[0], number])[rows])
        self.counts.append(counts)
        self.held += len(rows)
        if self.held > self.bound:
            self.summed()
            self.bound = max(2 * self.held, HELD_POINTERS)

    def summed(self) -> tuple[np.ndarray, np.ndarray]:
        rows, counts = _summed(np.concatenate(self.rows), np.concatenate(self.counts), len(self.numbers.words))
        self.rows, self.counts, self.held = [rows], [counts], len(rows)
        return rows, counts


def _used(rows: np.ndarray, words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """The same rows by places in a list of their own words only, after the end."""
    used = np.zeros(len(words), bool)
    used[rows] = used[0] = True
    return (np.cumsum(used) - 1)[rows], [words[i] for i in np.flatnonzero(used).tolist()]


def _packed(rows: np.ndarray, counts: np.ndarray, words: list[bytes]) -> bytes:
    """Pointers as their number, their words' places, their counts and the words."""
    rows, words = _used(rows, words)
    return b"".join([len(rows).to_bytes(4, "little"), _planes(rows.T.ravel()), _planes(counts), _END.join(words[1:])])


def _unpacked(data: bytes, longest: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    n = int.from_bytes(data[:4], "little")
    middle, end = 4 + 4 * n * longest, 4 + 4 * n * (longest + 1)
    return _from_planes(data[4:middle]).reshape(longest, n).T, _from_planes(data[middle:end]), [b"", *data[end:].split(_END)]


def _pointers(docs: DataFrame, filters: list, longest: int) -> DataFrame:
    """(slot, lang, packed): each pair that may be frequent, and the words from each triple on, as far as each triple may be.

    Equal pointers of a task are summed. Those of a language with the same
    first three words are in the same slot; a row holds all of a task's for a
    slot, unless it had to give some out before.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor().compress
        held: dict[str, _Pointers] = {}

        def given() -> pa.RecordBatch:
            slots, langs, out = [], [], []
            for lang, pointers in held.items():
                rows, counts = pointers.summed()
                words = pointers.numbers.words
                codes = np.fromiter(map(zlib.crc32, words), np.int64, len(words))[rows[:, :3]]
                slot = _hashes(_hashes(zlib.crc32(lang.encode()), codes[:, 0], codes[:, 1]), codes[:, 1], codes[:, 2]) >> SLOT_BITS
                order = np.argsort(slot, kind="stable")
                found, begins = np.unique(slot[order], return_index=True)
                slots += found.tolist()
                langs += [lang] * len(found)
                out += [pack(_packed(rows[part], counts[part], words)) for part in np.split(order, begins[1:]) if len(part)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array(langs, pa.string()), pa.array(out, pa.binary())], names=["slot", "lang", "packed"])

        for batch in joined(batches, GATHER_BYTES):
            for lang, numbers, names in _per_language(batch):
                (_, both, three), _, _ = _runs(lang, numbers, names, filters)
                rows, counts = _ahead(numbers, both, three, longest, len(names))
                if len(rows):
                    rows, words = _used(rows, names)
                    held.setdefault(lang, _Pointers(longest)).add(rows, counts, words)
            if sum(x.held for x in held.values()) > HELD_POINTERS:
                yield given()
        yield given()
        pa.default_memory_pool().release_unused()  # workers are used again, by other stages

    return docs.mapInArrow(run, "slot long, lang string, packed binary")


class _Growth:
    """Grows the phrases of sorted pointers to the right, depth first; phrases that go on in the next batch are held open."""

    def __init__(self, longest: int, least: int):
        self.longest, self.least = longest, least
        self.path: list = []  # (words, count) of the open phrase of each length, 3 words and more

    def _close(self, depth: int, out: list) -> None:
        """Gives out the open phrases of ``depth`` words and more."""
        for words, count in self.path[max(depth - 3, 0) :]:
            if count >= self.least:
                out.append((words, count))
        del self.path[max(depth - 3, 0) :]

    def rows(self, rows: list[np.ndarray], n: np.ndarray, out: list) -> None:
        """rows: the columns lang, w0, w1..., as arrays of objects with None beyond a pointer's end."""
        size = len(n)
        new = np.zeros(size, bool)
        new[0] = True
        starts: list[np.ndarray] = []
        for j, column in enumerate(rows):
            new[1:] |= column[1:] != column[:-1]
            if j >= 3:
                starts.append(np.flatnonzero(new))
        self._grow(rows, np.concatenate([[0], np.cumsum(n)]), starts, 0, size, 3, out)

    def _grow(self, rows, sums, starts, lo: int, hi: int, depth: int, out: list) -> None:
        """Extends the prefix whose pointers are lo to hi by each word that follows it."""
        if depth > self.longest:
            return
        at = depth - 3
        runs = starts[at]
        runs = runs[np.searchsorted(runs, lo) : np.searchsorted(runs, hi)].tolist()
        for a, b in zip(runs, [*runs[1:], hi], strict=True):
            if rows[depth][a] is None:  # pointers that end here
                continue
            count, last = int(sums[b] - sums[a]), b == len(sums) - 1
            words = tuple(c[a] for c in rows[: depth + 1])
            begun = self.path[at][1] if len(self.path) > at and self.path[at][0] == words else None
            if begun is None:
                self._close(depth, out)
            if begun is None and not last:
                if count >= self.least:
                    out.append((words, count))
                    self._grow(rows, sums, starts, a, b, depth + 1, out)
                continue
            self.path[at : at + 1] = [(words, count + (begun or 0))]
            self._grow(rows, sums, starts, a, b, depth + 1, out)
            if not last:
                self._close(depth, out)

    def finish(self, out: list) -> None:
        self._close(3, out)


def _grown(pointers: DataFrame, longest: int, least: int) -> DataFrame:
    """(lang, phrase, k, f) of the frequent phrases of two words and more."""
    tasks = int(pointers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fields = [pa.field("lang", pa.string()), pa.field("phrase", pa.string()), pa.field("k", pa.int32()), pa.field("f", pa.int64())]

    def phrases(lang: str, pointers: _Pointers, out: list) -> None:
        rows, n = pointers.summed()
        begins = np.flatnonzero(np.append(True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1)))
        often = np.repeat(np.add.reduceat(n, begins) >= least, np.diff(np.append(begins, len(n))))  # the pair or triple
        n, (rows, used) = n[often], _used(rows[often], pointers.numbers.words)
        words = np.array([None, *(w.decode() for w in used[1:])], object)
        pair = rows[:, 2] == 0
        for i in np.flatnonzero(pair).tolist():
            out.append(((lang, *words[rows[i, :2]]), int(n[i])))
        if not pair.all():
            growth = _Growth(longest, least)
            growth.rows([np.full(len(n), lang, object)[~pair], *words[rows[~pair].T]], n[~pair], out)
            growth.finish(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        place, held = None, _Pointers(longest)

        def batch_of(found: list) -> pa.RecordBatch:
            columns = [[w[0] for w, _ in found], [" ".join(w[1:]) for w, _ in found], [len(w) - 1 for w, _ in found], [c for _, c in found]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=pa.schema(fields))

        for batch in batches:
            found: list = []
            for slot, lang, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (slot, lang) != place:
                    if place is not None:
                        phrases(place[1], held, found)
                    place, held = (slot, lang), _Pointers(longest)
                held.add(*_unpacked(unpack(packed), longest))
            yield batch_of(found)
        found = []
        if place is not None:
            phrases(place[1], held, found)
        yield batch_of(found)

    dealt = pointers.repartition(tasks, "slot", "lang").sortWithinPartitions("slot", "lang")
    return dealt.mapInArrow(run, "lang string, phrase string, k int, f long")


def frequent_phrases(docs: DataFrame, lang_column: str = "lang", text_column: str = "text", longest: int = LONGEST, least: int = LEAST, filter_bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, f) of all phrases of up to ``longest`` words that occur ``least`` times in a language; and (lang, n), its words.

    Both are written tables.
    """
    if longest < 3:
        raise ValueError("longest must be 3 at least")
    spark = docs.sparkSession
    spoken = _spoken(docs, lang_column, text_column)
    counts, all_words = written(_word_counts(spoken), "words")
    sizes, _ = written(counts.groupBy("lang").agg(F.sum("f").alias("n")), "sizes")
    words, word_path = written(counts.where(F.col("f") >= least), "frequent-words")
    drop(spark, all_words)
    filters: list = []

    def more(places: DataFrame) -> None:
        filters.append(spark.sparkContext.broadcast(np.packbits(_filter(places, filter_bits))))

    more(words.select(_place_column([F.col("lang"), F.col("phrase")], filter_bits).alias("p")))
    for _ in ("pairs", "triples"):
        more(_frequent(spoken, list(filters), least).select((F.col("hash") % filter_bits).alias("p")))
    longer = _grown(_pointers(spoken, filters, longest), longest, least)
    found, _ = written(words.select("lang", "phrase", F.lit(1).alias("k"), "f").unionByName(longer), "phrases")
    drop(spark, word_path)
    return found, sizes


def _part(begin: Column, size: Column) -> Column:
    return F.array_join(F.slice("words", begin, size), " ")


def cuts(phrases: DataFrame, sizes: DataFrame) -> DataFrame:
    """lang, phrase, k, a, l, r, n and score of each candidate at its weakest cut; whole numbers of 38 digits throughout."""
    wide = "decimal(38,0)"
    words = phrases.where("k >= 2").select("lang", "phrase", "k", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    cut = words.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cut = cut.select("lang", "phrase", "k", "a", "cut", _part(F.lit(1), F.col("cut")).alias("head"), _part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("tail"))
    heads, tails = (phrases.select("lang", F.col("phrase").alias(x), F.col("f").alias(y)) for x, y in (("head", "l"), ("tail", "r")))
    met = cut.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).join(sizes, "lang")
    product = (F.col("a").cast("decimal(19,0)") * F.col("n").cast("decimal(18,0)")).cast(wide)
    rated = met.withColumns({"_up": (product * F.lit(1000).cast("decimal(4,0)")).cast(wide), "_down": (F.col("l").cast("decimal(18,0)") * F.col("r").cast("decimal(18,0)")).cast(wide)})
    rated = rated.withColumn("score", F.expr("_up div _down"))
    least = F.min(F.struct("score", "cut", "l", "r", "n"))
    return rated.groupBy("lang", "phrase", "k", "a").agg(least.alias("x")).select("lang", "phrase", "k", "a", "x.l", "x.r", "x.n", "x.score")


def covered(phrases: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(lang, phrase) of those inside a longer frequent phrase that has ``percent`` of their occurrences.

    A phrase between the two is frequent and has as many, so phrases of one word more tell.
    """
    longer = phrases.where("k >= 3").select("lang", "f", F.split("phrase", " ").alias("words"), "k")
    parts = longer.select("lang", "f", F.explode(F.array(_part(F.lit(1), F.col("k") - 1), _part(F.lit(2), F.col("k") - 1))).alias("phrase"))
    held = phrases.where("k >= 2").select("lang", "phrase", F.col("f").alias("a"))
    most = parts.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    return held.join(most, ["lang", "phrase"]).where(100 * F.col("most") >= percent * F.col("a")).select("lang", "phrase")


def collocations(
    docs: DataFrame, lang_column: str = "lang", text_column: str = "text", longest: int = LONGEST, least: int = LEAST, first: int | None = FIRST, percent: int = PERCENT,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's ``first`` phrases (all: None), those inside longer ones left out."""
    phrases, sizes = frequent_phrases(docs, lang_column, text_column, longest, least)
    kept = cuts(phrases, sizes).join(covered(phrases, percent), ["lang", "phrase"], "left_anti")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase")))
    ranked = kept.withColumn("rank", place)
    ranked = ranked if first is None else ranked.where(F.col("rank") <= first)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
