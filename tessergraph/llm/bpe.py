"""BPE encoding by forced boundaries, and decoding.

A merge can only join bytes that stand side by side inside some vocabulary
token. A byte pair found inside no token can therefore never be joined: the
place between its bytes is a certain cut. Texts are cut there (white space
always is such a place), each fragment is encoded alone, memoised, and the ids
are concatenated. Fragments repeat far more than documents do. Those that are
new to a batch are cut and encoded together, if they are one word of letters.

Null or empty texts give no ids and decode to an empty text. Strings of the
vocabulary's special tokens give their single id, as the library does.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from tokenizers import Tokenizer
from tokenizers.models import BPE
from tokenizers.pre_tokenizers import CharDelimiterSplit

from tessergraph.llm.common import Memo, map_texts

#: Fragments, and parts of words, that a worker remembers between batches; about 40 MB. Each executor has a worker a core.
FRAGMENT_MEMO, PART_MEMO = 240_000, 20_000
#: Bytes of text that are cut and looked up together.
GATHER = 2 << 20
#: Pieces of words that the library encodes in one call.
CALL = 300
#: Bytes that no UTF-8 text holds: the end of a word, and a cut inside one.
END, CUT = 255, 254


@cache
def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(hidden)) for b in range(256)]


#: Classes of bytes for the cut table: white space, letters, digits, marks, and the rest.
SPACE, LETTER, DIGIT, MARK, OTHER = range(5)


def _byte_classes() -> np.ndarray:
    kinds = np.full(256, OTHER, np.uint8)
    for b in range(128):
        c = chr(b)
        kinds[b] = SPACE if c in " \t\n\r\v\f" else LETTER if c.isalpha() else DIGIT if c.isdigit() else MARK
    return kinds


class FragmentCodec:
    """Encoder and decoder of one tokenizers file; get one per worker from `codec`."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a worker for each core
        self.tokenizer = Tokenizer.from_file(path)
        suffix = model.get("end_of_word_suffix") or ""
        self.by_word = bool(suffix)  # lower case, words end in the suffix, white space goes
        self.code = "H" if max(model["vocab"].values()) < 65_000 else "I"
        self.dtype = np.dtype("<u2" if self.code == "H" else "<u4")
        self.last = self.tokenizer.model
        self.inner = BPE(vocab=model["vocab"], merges=[tuple(m) for m in model["merges"]]) if suffix else self.last
        words = [t[: -len(suffix)] if suffix and t.endswith(suffix) else t for t in model["vocab"]]
        self.pairs = {p for w in words for p in zip(w, w[1:])}
        specials = [t["content"] for t in spec["added_tokens"]]
        self.special_ids = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        self.specials = b"(" + b"|".join(re.escape(t.encode()) for t in sorted(specials, key=len)[::-1]) + b")"
        self.pieces = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        self.kinds = _byte_classes()
        self._cut_tables()
        letters = rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+"
        self.plain = re.compile((rb"[ \t\n\r\v\f]*" if suffix else b" ?") + letters).fullmatch  # one word, whatever its letters
        self.blank = b" \t\n\r\v\f" if suffix else b""
        self.small = bytes(b + 32 if suffix and (65 <= b <= 90 or 0x80 <= b <= 0x9E) else b for b in range(256))  # of plain words
        self.shown = {b: " " if b == END else c for b, c in enumerate(byte_alphabet())}
        self.lengths = np.array([len(t) - len(suffix) * (bool(suffix) and t.endswith(suffix)) for t in self.pieces], np.int64)
        self.whole = all(c + x in model["vocab"] for c in byte_alphabet() for x in {"", suffix})  # else the library leaves bytes out
        self.splitters = [self._splitter(m) for m in ((self.inner, self.last) if suffix else (self.last,))]
        self.memo = Memo(self._chunk, FRAGMENT_MEMO)
        self.parts = Memo(self._part, PART_MEMO)

    def _cut_tables(self) -> None:
        """Where a cut is certain: no token holds the byte pair, and the pre-tokenizer parts its classes too."""
        shown = {c: b for b, c in enumerate(byte_alphabet())}
        inside = np.zeros((256, 256), bool)
        for a, b in self.pairs:
            inside[shown[a], shown[b]] = True
        if self.by_word:
            lower = np.arange(256)
            lower[65:91] += 32
            inside = inside[lower][:, lower]
        self.unjoined = ~inside.ravel()
        parted = np.zeros((5, 5), bool)
        for a in (LETTER, DIGIT, MARK):
            for b in (SPACE, LETTER, DIGIT, MARK):
                parted[a, b] = a != b
        parted[OTHER, SPACE] = True
        parted[DIGIT, DIGIT] = self.by_word
        self.parted = parted.ravel()

    # fragments

    def cuts(self, word: str) -> list[str]:
        """The fragments of one word, in byte-alphabet characters."""
        places = [i for i in range(1, len(word)) if (word[i - 1], word[i]) not in self.pairs]
        return [word[a:b] for a, b in zip([0, *places], [*places, len(word)])]

    def _ids(self, model, fragment: str) -> bytes:
        return array(self.code, [t.id for t in model.tokenize(fragment)]).tobytes()

    def _part(self, key: tuple[str, bool]) -> bytes:
        return self._ids(self.last if key[1] else self.inner, key[0])

    def _word(self, word: str) -> bytes:
        if self.pairs.issuperset(zip(word, word[1:])):
            return self._ids(self.last, word)
        parts = self.cuts(word)
        return b"".join(self.parts[p, i == len(parts) - 1] for i, p in enumerate(parts))

    def _chunk(self, chunk: bytes) -> bytes:
        """Ids of a stretch of text between certain cuts."""
        if self.by_word:
            text = chunk.strip(b" \t\n\r\v\f").decode()
            if text.isalpha() and max(text) < "\u0100":
                return self._word("".join(map(byte_alphabet().__getitem__, text.lower().encode())))
            text = self.tokenizer.normalizer.normalize_str(text)
        else:
            text = chunk.decode()
            if text.isascii() and text[:1] == " " and text[1:].isalpha():
                return self._word("\u0120" + text[1:])
        if not text:
            return b""
        return b"".join(self._word(w) for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text))

    @staticmethod
    def _splitter(model) -> Tokenizer:
        """The library with a model, on pieces of words in byte-alphabet characters with spaces between them."""
        out = Tokenizer(model)
        out.pre_tokenizer = CharDelimiterSplit(" ")
        return out

    def _pieces(self, splitter: Tokenizer, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces that each end in END, and how many each has."""
        text = data.tobytes().decode("latin-1").translate(self.shown)
        ends = np.flatnonzero(data == END)
        ids, at = [np.empty(0, self.dtype)], 0
        for to in [*ends[CALL - 1 : -1 : CALL].tolist(), *ends[-1:].tolist()]:
            (found,) = splitter.encode_batch_fast([text[at:to]], add_special_tokens=False)
            ids.append(np.array(found.ids, self.dtype))
            at = to + 1
        ids = np.concatenate(ids)
        after = np.searchsorted(np.cumsum(self.lengths[ids]), ends - np.arange(len(ends))) + 1  # tokens of all pieces up to each
        return ids, np.diff(after, prepend=0)

    def _plain_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of plain words: all are cut where no token goes on, and the pieces encoded together."""
        data = np.frombuffer((b"\xff".join(words) + b"\xff").translate(self.small, self.blank), np.uint8)
        inside = (data[:-1] != END) & (data[1:] != END)
        inside &= self.unjoined[(data[:-1].astype(np.uint16) << np.uint16(8)) | data[1:]]
        data = np.insert(data, np.flatnonzero(inside) + 1, CUT)
        ends = np.flatnonzero(data >= CUT)
        last = data[ends] == END
        if self.by_word:  # a word's last piece has the suffix
            of_last = np.repeat(last, np.diff(ends, prepend=-1))
            data = np.where(data == CUT, np.uint8(END), data)
            (inner_ids, inner_sizes), (last_ids, last_sizes) = map(self._pieces, self.splitters, (data[~of_last], data[of_last]))
            sizes = np.empty(len(ends), np.int64)
            sizes[~last], sizes[last] = inner_sizes, last_sizes
            ids, place = np.empty(len(inner_ids) + len(last_ids), self.dtype), np.repeat(last, sizes)
            ids[~place], ids[place] = inner_ids, last_ids
        else:
            ids, sizes = self._pieces(self.splitters[0], np.where(data == CUT, np.uint8(END), data))
        to = (np.cumsum(sizes)[last] * self.dtype.itemsize).tolist()
        held = ids.tobytes()
        return [held[a:b] for a, b in zip([0, *to], to)]

    def _chunks(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of many stretches of text between certain cuts."""
        words = [c for c in chunks if self.plain(c)] if self.whole else []
        if len(words) < 2:
            return [self._chunk(c) for c in chunks]
        found = dict(zip(words, self._plain_words(words)))
        return [found[c] if c in found else self._chunk(c) for c in chunks]

    # whole columns

    def encode_many(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a text column in one array, and the bounds of each row in it."""
        column = column.cast(pa.large_binary()).fill_null(b"")
        if self.special_ids and pc.any(pc.match_substring_regex(column, self.specials)).as_py():
            return self._with_specials(column)
        self.memo.trim()
        self.parts.trim()
        bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        if not len(data):
            return np.empty(0, self.dtype), np.zeros(len(bounds), np.int64)
        kinds = self.kinds[data]
        latin = np.flatnonzero(data[:-1] == 0xC3)  # U+00C0 to U+00FF: letters but for two signs
        latin = latin[(data[latin + 1] & 0xDF) != 0x97]
        kinds[latin] = kinds[latin + 1] = LETTER
        begins = np.empty(len(data), bool)
        begins[0] = True
        np.take(self.parted, kinds[:-1] * np.uint8(5) + kinds[1:], out=begins[1:])
        begins[1:] &= self.unjoined[(data[:-1].astype(np.uint16) << np.uint16(8)) | data[1:]]
        begins[bounds[:-1][bounds[:-1] < len(data)]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts, len(data)).astype(np.int64)
        fragments = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data)])
        coded = fragments.dictionary_encode()
        codes = coded.indices.to_numpy()
        known = self.memo.many(coded.dictionary.to_pylist(), self._chunks)
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // self.dtype.itemsize
        each = sizes[codes]
        after = np.concatenate(([0], np.cumsum(each)))
        place = np.repeat((np.cumsum(sizes) - sizes)[codes] - after[:-1], each) + np.arange(after[-1])
        ids = np.frombuffer(b"".join(known), self.dtype)[place]
        return ids, after[np.searchsorted(starts, bounds)]

    def _with_specials(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Special tokens' strings are cut out first; what lies between is encoded as other text."""
        split = [re.split(self.specials, x) for x in column.to_pylist()]
        plain, bounds = self.encode_many(pa.array([re.sub(self.specials, b" ", p) for s in split for p in s[::2]], pa.large_binary()))
        rows, k = [], 0
        for s in split:
            parts = []
            for i, p in enumerate(s):
                if i % 2:
                    parts.append(np.array([self.special_ids[p]], self.dtype))
                else:
                    parts.append(plain[bounds[k] : bounds[k + 1]])
                    k += 1
            rows.append(np.concatenate(parts))
        return np.concatenate(rows), np.concatenate(([0], np.cumsum([len(r) for r in rows])))

    def encode(self, text: str | None) -> list[int]:
        return self.encode_many(pa.array([text], pa.string()))[0].tolist()

    def decode(self, ids: np.ndarray) -> str:
        """As the library's ``decode(ids, skip_special_tokens=False)`` of a file without decoder: tokens and spaces."""
        return " ".join(map(self.pieces.__getitem__, ids.tolist()))


@cache
def codec(path: str) -> FragmentCodec:
    return FragmentCodec(path)


def encode_decode(df: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: its id, ``ids`` (little-endian uint32 bytes) and ``decoded``.

    Other columns of ``df`` are left out, so they can't clash. A null id stays
    null; repeated rows give repeated rows; an empty table gives an empty one.
    """

    def make():
        c = codec(path)

        def one(texts):
            ids, bounds = c.encode_many(texts)
            rows = [ids[a:b] for a, b in zip(bounds, bounds[1:])]
            return {"ids": [r.astype("<u4").tobytes() for r in rows], "decoded": [c.decode(r) for r in rows]}

        return one

    return map_texts(df, id_column, text_column, "ids binary, decoded string", make, gather=GATHER)
