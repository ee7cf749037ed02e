"""Interleaved documents: ordered text and media, payloads joined by digest.

`sequences` turns HTML into an array of items in page order: text, or a
reference to a medium with its caption. `store` keeps payloads as greyscale
PNG images of 8-bit samples in a table by digest; `features` reads them back.
`resolve` joins references and payloads by digest and puts each payload beside
its reference in the page's array, so positions and captions stay as they are.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessergraph.llm.common import as_bytes, map_rows, prepare, written
from tessergraph.llm.markup import BLOCKS, UNSEEN, VOID, attributes, tokens

WIDTH = 64
SCHEME = "sha256:"
LEVEL = 4
_PNG = b"\x89PNG\r\n\x1a\n"
MEDIA_TAGS = frozenset("img video audio source embed".split())
ITEM = "struct<position:int,kind:string,text:string,digest:string,caption:string>"


# payloads


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % WIDTH if data else WIDTH)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    """Samples, WIDTH in a row, as an 8-bit greyscale image; the length is a positive multiple of WIDTH."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def from_png(data: bytes) -> bytes:
    """The samples of an image that `to_png` made; checks every chunk's checksum."""
    if data[:8] != _PNG:
        raise ValueError("not a PNG image")
    at, packed, size = 8, [], None
    while at < len(data):
        (n,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError("damaged PNG image")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    if size is None or size[0] != WIDTH or size[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an image of this store")
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(size[1], WIDTH + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines are not of this store")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean, deviation and an 8-bin histogram of the samples, in thousandths."""
    samples = np.frombuffer(payload, np.uint8)
    bins = np.bincount(samples >> 5, minlength=8) * 1000 // len(samples)
    mean = int(samples.sum(dtype=np.int64)) * 1000 // len(samples)
    square = int((samples.astype(np.int64) ** 2).sum()) * 1000 // len(samples)
    return f"m{mean} q{square} h" + "-".join(map(str, bins.tolist()))


def store(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Written table: key, n_bytes, digest (of the payload) and ``media``, the stored form of each text.

    Null texts count as empty; an empty payload is WIDTH zeros. Repeated rows
    are stored each; an empty table gives an empty one. Only the columns named
    are read, so other names can't clash.
    """
    prepare(docs.sparkSession)
    kind = docs.schema[id_column].dataType.simpleString()

    def make():
        def one(batch):
            texts = [x or b"" for x in as_bytes(batch.column(1))]
            payloads = [padded(x) for x in texts]
            return {
                "key": batch.column(0),
                "n_bytes": [len(x) for x in texts],
                "digest": [hashlib.sha256(p).hexdigest() for p in payloads],
                "media": [to_png(p) for p in payloads],
            }

        return one

    table = map_rows(docs.select(docs[id_column], docs[text_column]), f"key {kind}, n_bytes long, digest string, media binary", make)
    return written(table, "media")[0]


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(media: DataFrame) -> DataFrame:
    """One row per digest: what is read back from the stored form."""

    def make():
        def one(batch):
            stored = batch.column(1).to_pylist()
            payloads = [from_png(x) for x in stored]
            return {
                "digest": batch.column(0),
                "payload_bytes": [len(p) for p in payloads],
                "payload_sha256": [hashlib.sha256(p).hexdigest() for p in payloads],
                "tail_crc32": [zlib.crc32(p[-WIDTH:]) for p in payloads],
                "media_bytes": [len(x) for x in stored],
                "media_sha256": [hashlib.sha256(x).hexdigest() for x in stored],
                "feature": [feature(p) for p in payloads],
            }

        return one

    rows = map_rows(media.select("digest", "media"), f"digest string, {FEATURES}", make)
    names = [f.split()[0] for f in FEATURES.split(", ")]
    return rows.groupBy("digest").agg(*(F.first(n).alias(n) for n in names))


# sequences


def items_of(page: str | None) -> list[tuple[int, str, str | None, str | None, str | None]]:
    """(position, kind, text, digest, caption) in page order.

    A medium's caption is its figure's, or else its alternative text. Media
    whose source is no digest keep a null digest.
    """
    items: list[list] = []
    held: list[str] = []
    opened: list[str] = []
    figure: int | None = None  # first item of the open figure
    in_caption = False

    def flush() -> None:
        text = " ".join("".join(held).split())
        held.clear()
        if text and in_caption and figure is not None:
            for item in items[figure:]:
                if item[0] == "media":
                    item[3] = text
        elif text:
            items.append(["text", text, None, None])

    for kind, value, source in tokens(page or ""):
        if kind == "text":
            if not UNSEEN.intersection(opened):
                held.append(value)
        elif kind == "open":
            if value in MEDIA_TAGS:
                flush()
                a = attributes(source)
                src = a.get("src", "")
                if src or value != "source":
                    items.append(["media", None, src.removeprefix(SCHEME) if src.startswith(SCHEME) else None, a.get("alt") or None])
            elif value in BLOCKS or value == "br":
                flush()
            if value == "figure":
                figure = len(items)
            elif value == "figcaption":
                in_caption = True
            if value not in VOID and not source.endswith("/"):
                opened.append(value)
        else:
            if value in BLOCKS:
                flush()
            if value == "figcaption":
                in_caption = False
            elif value == "figure":
                figure = None
            for i in range(len(opened) - 1, -1, -1):
                if opened[i] == value:
                    del opened[i:]
                    break
    flush()
    return [(i, *item) for i, item in enumerate(items)]


def sequences(pages: DataFrame, id_column: str, html_column: str) -> DataFrame:
    """key and ``items``, an array of ITEM in page order; null and empty pages have none."""
    prepare(pages.sparkSession)
    kind = pages.schema[id_column].dataType.simpleString()
    names = ("position", "kind", "text", "digest", "caption")

    def make():
        def one(batch):
            return {"key": batch.column(0), "items": [[dict(zip(names, i)) for i in items_of(x)] for x in batch.column(1).to_pylist()]}

        return one

    return map_rows(pages.select(pages[id_column], pages[html_column]), f"key {kind}, items array<{ITEM}>", make)


PAYLOAD = "struct<" + FEATURES.replace(" ", ":").replace(",:", ",") + ">"


def resolve(sequence: DataFrame, payloads: DataFrame) -> DataFrame:
    """``sequence`` with a ``payload`` in each of its ``items``: the columns of `features` where the digest is known, or null.

    payloads has one row per digest. Items stay in their order, and rows
    without items stay, too; repeated rows are resolved each. Only references
    are dealt by digest, against a written table, so those of one medium that
    many pages show can be split.
    """
    held, _ = written(sequence.withColumn("_row", F.monotonically_increasing_id()), "sequences")
    known, _ = written(payloads.select("digest", F.struct(*(f.split()[0] for f in FEATURES.split(", "))).alias("payload")), "payloads")
    each = held.select("_row", F.explode("items").alias("i")).where("i.digest IS NOT NULL").select("_row", "i.position", "i.digest")
    found = each.join(known, "digest").groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("position", "payload"))).alias("_found"))
    met = held.join(found, "_row", "left")
    item = F.transform("items", lambda i: F.struct(*(i[n].alias(n) for n in ("position", "kind", "text", "digest", "caption")), F.try_element_at("_found", i["position"]).alias("payload")))
    return met.withColumn("items", item).select(*sequence.columns)
