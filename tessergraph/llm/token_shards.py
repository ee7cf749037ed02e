"""Token ids as binary shards: one zstandard frame per document, one shared dictionary.

A shard file is, all integers little-endian:

    b"TSHARD01" | uint32 header length | header JSON | index | frames

The header names the dictionary's sha256, the width of an id in bytes, the
number of documents, and how many of the first ones have no id (null). The index has a row for each document: int64 doc_id,
int64 start (ids of this shard before it), int64 n_tokens, int64 place and
int64 size of its frame. A short document is read with one seek. The
dictionary lies beside the shards as ``ids.zdict``.

Shards hold ascending doc_id, and follow each other in that order. A shard
counts only if the manifest table has it: Spark commits the manifest rows of
successful tasks alone, so files of lost attempts are ignored.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessergraph.llm.bpe import GATHER, codec
from tessergraph.llm.common import joined, map_rows, new_path, prepare, written

MAGIC = b"TSHARD01"
INDEX = np.dtype([(n, "<i8") for n in ("doc_id", "start", "n_tokens", "place", "size")])
#: Bounds of the dictionary's training: distinct documents asked for, and bytes of their ids.
SAMPLE_DOCS, SAMPLE_BYTES = 2000, 8 << 20
DICTIONARY_BYTES = 64 << 10
#: Bytes of frames after which a task begins another shard.
SHARD_BYTES = 128 << 20
#: Tasks that read shards, at most, for each core.
READERS = 20


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def _encoded(path: str, end_id: int):
    """Batch -> the documents' ids with the end id, as bytes."""
    c = codec(path)
    end = np.array([end_id], c.dtype)

    def rows(column: pa.Array) -> Iterator[np.ndarray]:
        ids, bounds = c.encode_many(column)
        for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
            yield np.concatenate((ids[a:b], end))

    return rows


def train_dictionary(docs: DataFrame, path: str, end_id: int, id_column: str = "doc_id", text_column: str = "text") -> bytes:
    """A dictionary from whole documents' ids: about SAMPLE_DOCS distinct rows, SAMPLE_BYTES at most.

    Rows are drawn by a threshold on a hash of id and text, in the scan, and
    equal rows fall together before they are dealt, so what leaves the tasks is
    about SAMPLE_DOCS texts whatever the table's size. Without enough material
    (zstandard needs some), the dictionary is the raw sample.
    """
    draw = F.xxhash64(docs[id_column], docs[text_column])
    one_in = max(docs.select(id_column).count() // SAMPLE_DOCS, 1)
    drawn = docs.select(draw.alias("draw"), docs[text_column].alias("text")).where(F.pmod("draw", F.lit(one_in)) == 0)
    sample = drawn.groupBy("draw").agg(F.first("text").alias("text")).orderBy("draw").limit(2 * SAMPLE_DOCS).coalesce(1)

    def make():
        rows = _encoded(path, end_id)

        def one(batch):
            return {"ids": [r.tobytes() for r in rows(batch.column(1))]}

        return one

    held, size = [], 0
    for row in map_rows(sample, "ids binary", make).toLocalIterator():
        if size + len(row["ids"]) <= SAMPLE_BYTES:
            held.append(bytes(row["ids"]))
            size += len(row["ids"])
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, held).as_bytes()
    except zstandard.ZstdError:
        return b"".join(held)[:DICTIONARY_BYTES] or bytes(8)


def write_shards(docs: DataFrame, path: str, end_id: int, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, str]:
    """Encode and write all documents; the manifest and the folder.

    The manifest has a row for each shard: part, shard (their order), uri,
    n_docs, n_tokens and ``before``, the ids of all shards before it. Null or
    empty texts hold the end id alone; null ids come first; rows of one id
    follow each other in the order of a hash of their text; an empty table has
    no shard. Ids are integers. Only the columns named are read, so other
    names can't clash.
    """
    spark = docs.sparkSession
    prepare(spark)
    folder = new_path(spark, "shards")
    dictionary = train_dictionary(docs, path, end_id, id_column, text_column)
    digest = hashlib.sha256(dictionary).hexdigest()
    where, base = open_fs(folder)
    where.create_dir(base, recursive=True)
    with where.open_output_stream(f"{base}/ids.zdict") as f:
        f.write(dictionary)

    # Ranges are drawn over the texts, so that no document is encoded twice.
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = (
        docs.select(docs[id_column].alias("key"), docs[text_column].alias("text"))
        .withColumn("turn", F.xxhash64("text"))  # rows of one id can lie in several ranges
        .repartitionByRange(partitions, "key", "turn")
        .sortWithinPartitions("key", "turn", "text")
        .drop("turn")
    )

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, root = open_fs(folder)
        part = TaskContext.get().partitionId()
        rows, width = _encoded(path, end_id), codec(path).dtype.itemsize
        compressor = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary))
        held: list[tuple[int | None, int, bytes]] = []
        size = shard = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, shard
            index = np.zeros(len(held), INDEX)
            index["doc_id"] = [x[0] or 0 for x in held]
            index["n_tokens"] = [x[1] for x in held]
            index["size"] = [len(x[2]) for x in held]
            index["start"] = np.cumsum(index["n_tokens"]) - index["n_tokens"]
            head = json.dumps({"dictionary": digest, "width": width, "docs": len(held), "nulls": sum(x[0] is None for x in held)}).encode()
            index["place"] = len(MAGIC) + 4 + len(head) + index.nbytes + np.cumsum(index["size"]) - index["size"]
            uri = f"{part:06d}-{shard:04d}-{uuid.uuid4().hex}.tshard"
            with target.open_output_stream(f"{root}/{uri}") as f:
                f.write(MAGIC + struct.pack("<I", len(head)) + head + index.tobytes())
                for x in held:
                    f.write(x[2])
            row = {"part": [part], "shard": [shard], "uri": [f"{folder}/{uri}"], "n_docs": [len(held)], "n_tokens": [int(index["n_tokens"].sum())]}
            held, size, shard = [], 0, shard + 1
            return pa.RecordBatch.from_pydict(row, manifest_schema)

        for batch in joined(batches, GATHER):
            for key, ids in zip(batch.column(0).to_pylist(), rows(batch.column(1))):
                held.append((key, len(ids), compressor.compress(ids.tobytes())))
                size += len(held[-1][2])
                if size >= SHARD_BYTES:
                    yield flush()
        if held:
            yield flush()

    manifest_schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("uri", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
    manifest, _ = written(ordered.mapInArrow(store, "part int, shard int, uri string, n_docs long, n_tokens long"), "manifest")
    order = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("before", F.coalesce(F.sum("n_tokens").over(order), F.lit(0))), folder


@cache
def _decompressor(folder: str, digest: str) -> zstandard.ZstdDecompressor:
    where, base = open_fs(folder)
    with where.open_input_stream(f"{base}/ids.zdict") as f:
        dictionary = f.read()
    if hashlib.sha256(dictionary).hexdigest() != digest:
        raise ValueError(f"{folder}: the dictionary is not the shards'")
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))


class Shard:
    """Random access to a shard file."""

    def __init__(self, uri: str):
        where, at = open_fs(uri)
        self.file = where.open_input_file(at)
        if self.file.read(8) != MAGIC:
            raise ValueError(f"{uri}: not a shard")
        (size,) = struct.unpack("<I", self.file.read(4))
        self.header = json.loads(self.file.read(size))
        self.index = np.frombuffer(self.file.read(self.header["docs"] * INDEX.itemsize), INDEX)
        self.frames = _decompressor(uri.rpartition("/")[0], self.header["dictionary"])
        self.dtype = np.dtype(f"<u{self.header['width']}")

    def __len__(self) -> int:
        return len(self.index)

    def __getitem__(self, i: int) -> np.ndarray:
        self.file.seek(int(self.index["place"][i]))
        return np.frombuffer(self.frames.decompress(self.file.read(int(self.index["size"][i]))), self.dtype)


def read_shards(manifest: DataFrame) -> DataFrame:
    """One row per document, from the files: doc_id, start over all shards, n_tokens, ``ids`` (little-endian uint32 bytes)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = Shard(uri)
                for a in range(0, len(shard), 500):
                    part = shard.index[a : a + 500]
                    ids = [shard[a + i].astype("<u4").tobytes() for i in range(len(part))]
                    keys = [None if a + i < shard.header["nulls"] else k for i, k in enumerate(part["doc_id"].tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys, pa.int64()), pa.array(part["start"] + before), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )

    most = READERS * manifest.sparkSession.sparkContext.defaultParallelism
    spread = manifest.select("uri", "before").repartition(max(1, min(manifest.count(), most)))  # a count of its own, so that it isn't coalesced
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")
