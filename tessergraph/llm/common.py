"""Helpers shared by the corpus operators.

Intermediate tables are written as Parquet to the shared folder that the
cluster names in ``spark.checkpoint.dir``: a lost executor then costs only the
tasks that were running, and lineage is cut at each written table.
"""

from __future__ import annotations

import gc
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessergraph.sources.store import hadoop_path, shared_folder

#: Rows in one Arrow batch: bounds a Python worker's memory with long texts.
ARROW_ROWS = 500
#: Entries of a per-worker memo before its older half goes.
MEMO_ENTRIES = 100_000

#: Spark's own value of the batch size, which `prepare` replaces.
DEFAULT_ROWS = "10000"


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches, unless the session names a size of its own, and this package on the Python workers' path."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", DEFAULT_ROWS) == DEFAULT_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver ends."""
    path = f"{shared_folder(spark)}/tessergraph/{uuid.uuid4().hex}-{name}"
    fs, p = hadoop_path(spark, path)
    fs.deleteOnExit(p)
    return path


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` as a table in the shared folder, and its path for `drop`."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    # Spark deletes shuffle files once their plan is garbage; collect it, lest disks fill up.
    gc.collect()
    spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        fs, p = hadoop_path(spark, path)
        fs.delete(p, True)


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """A string column's values as UTF-8 bytes."""
    return column.cast(pa.binary()).to_pylist()


def joined(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The batches, joined until they hold ``least`` bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= least:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def map_rows(
    df: DataFrame,
    schema: str,
    make: Callable[[], Callable[[pa.RecordBatch], dict[str, list] | None]],
    gather: int = 0,
) -> DataFrame:
    """``mapInArrow`` where ``make`` builds, once a task, a function batch -> columns.

    gather: join batches until they hold so many bytes.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    prepare(df.sparkSession)
    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for batch in joined(batches, gather):
            if batch.num_rows:
                columns = one(batch)
                if columns is not None:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(columns[f.name], f.type) for f in target], schema=target
                    )
        pa.default_memory_pool().release_unused()  # workers are used again, by other stages

    return df.mapInArrow(run, schema)


def map_texts(
    df: DataFrame,
    id_column: str,
    text_column: str,
    fields: str,
    make: Callable[[], Callable[[pa.Array], dict[str, list]]],
    carry: tuple[str, ...] = (),
    gather: int = 0,
) -> DataFrame:
    """One row per document: its id, the ``carry`` columns and ``fields``, which ``make()`` gets from the column of texts."""
    kept = [id_column, *(c for c in carry if c != id_column)]
    source = df.select(*(df[c].alias(f"k{i}") for i, c in enumerate(kept)), df[text_column].alias("_text"))
    kinds = [df.schema[c].dataType.simpleString() for c in kept]
    schema = ", ".join([*(f"k{i} {k}" for i, k in enumerate(kinds)), fields])

    def make_rows():
        one = make()
        return lambda batch: {f"k{i}": batch.column(i) for i in range(len(kept))} | one(batch.column(len(kept)))

    rows = map_rows(source, schema, make_rows, gather)
    return rows.withColumnsRenamed({f"k{i}": c for i, c in enumerate(kept)})


class Memo(dict):
    """A bounded memo of ``compute``: beyond the bound, entries not used lately go."""

    def __init__(self, compute: Callable, entries: int = MEMO_ENTRIES):
        super().__init__()
        self.compute, self.half, self.old = compute, entries // 2, {}

    def __missing__(self, key):
        value = self.old.pop(key, None)  # held once
        if value is None:
            value = self.compute(key)
        self[key] = value
        return value

    def many(self, keys: list, compute: Callable[[list], list]) -> list:
        """The values of distinct keys; ``compute`` gives those of all that are missing at once."""
        new = [k for k in keys if k not in self and k not in self.old]
        self.update(zip(new, compute(new), strict=True))
        return [self[k] for k in keys]

    def trim(self) -> None:
        """Call between documents."""
        if len(self) > self.half:
            self.old = dict(self)
            self.clear()


_words = Memo(xxhash.xxh3_64_intdigest)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """The 64-bit hash of each word."""
    _words.trim()
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


_MIX = np.uint64(0xFF51AFD7ED558CCD)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * _MIX
    return x ^ (x >> np.uint64(29))


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive words; empty if there are fewer."""
    count = len(words) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    total = words[:count].copy()
    for i in range(1, n):
        total *= _STEP
        total += words[i : i + count]
        total ^= total >> np.uint64(31)
    return mixed(total)


def crc_fold(column: str = "doc_id"):
    """crc32 of the id's text, modulo 4; remainder 2 is held out of every training."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 4
