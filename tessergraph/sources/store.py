"""Snapshot tables: appends, upserts and whole versions on plain Parquet.

Parquet has no update, so an upsert is a join with the current version; an
append adds files. See `Store`.
"""

from __future__ import annotations

import gc
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_calls = [0]
_open = threading.local()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where it is unset, one of this machine, for a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="tessergraph-")
    return _own[app]


def hadoop_path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What `cut_lineage` writes inside, in this thread, goes at the end: no frame made of it may be read after that."""
    outer, _open.paths = getattr(_open, "paths", None), []
    try:
        yield
    finally:
        for path in _open.paths:
            fs, p = hadoop_path(spark, path)
            fs.delete(p, True)
            fs.cancelDeleteOnExit(p)
        _open.paths = outer


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows as a written table, so that loops don't grow their plans and lost executors cost little; it stays until the driver ends, or the `scratch` around it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tessergraph/{uuid.uuid4().hex}-lineage"
    fs, p = hadoop_path(spark, path)
    fs.deleteOnExit(p)
    if getattr(_open, "paths", None) is not None:
        _open.paths.append(path)
    df.write.parquet(path)
    _calls[0] += 1
    if _calls[0] % 32 == 0:  # Spark deletes shuffle files once their plan is garbage
        gc.collect()
    return spark.read.schema(df.schema).parquet(path)


class Store:
    """Versioned tables under one folder.

    A version is a small manifest file that names the table's parts. Parts are
    written first and never change; a manifest appears by one rename, so
    readers see the old table or the new one. Appending writes the new rows
    alone. One writer at a time: a version that exists already is an error.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def versions(self, name: str) -> list[int]:
        fs, p = hadoop_path(self.spark, f"{self.root}/{name}/versions")
        if not fs.exists(p):
            return []
        names = (s.getPath().getName() for s in fs.listStatus(p))
        return sorted(int(n[1:]) for n in names if n.startswith("v"))

    def parts(self, name: str, version: int | None = None) -> list[str]:
        """The folders of a version's parts; of the current version by default."""
        found = self.versions(name)
        if not found:
            raise ValueError(f"no table {name}")
        fs, p = hadoop_path(self.spark, f"{self.root}/{name}/versions/v{found[-1] if version is None else version:08d}")
        held = fs.open(p)
        try:
            text = bytes(held.readAllBytes()).decode()
        finally:
            held.close()
        return [f"{self.root}/{name}/{x}" for x in text.split()]

    def exists(self, name: str) -> bool:
        return bool(self.versions(name))

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(*self.parts(name, version))

    def _commit(self, name: str, parts: list[str]) -> int:
        version = (self.versions(name) or [0])[-1] + 1
        fs, final = hadoop_path(self.spark, f"{self.root}/{name}/versions/v{version:08d}")
        _, draft = hadoop_path(self.spark, f"{self.root}/{name}/versions/.draft-{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        out.write(bytearray("\n".join(p.rpartition("/")[2] for p in parts).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(draft, final):
            raise RuntimeError(f"{name}: another writer made version {version}")
        return version

    def _part(self, name: str, df: DataFrame, partition_by: tuple[str, ...] = ()) -> str:
        path = f"{self.root}/{name}/part-{uuid.uuid4().hex}"
        df.write.partitionBy(*partition_by).parquet(path)
        return path

    def write(self, name: str, df: DataFrame, partition_by: tuple[str, ...] = ()) -> int:
        """A new version of ``df`` alone; older ones stay readable until `vacuum`."""
        return self._commit(name, [self._part(name, df, partition_by)])

    def append(self, name: str, df: DataFrame) -> int:
        """The table with the rows of ``df``, which has the same columns; only these are written."""
        if not self.exists(name):
            return self.write(name, df)
        table = self.read(name)
        if set(table.columns) != set(df.columns):
            raise ValueError(f"{name} has columns {table.columns}, not {df.columns}")
        rows = df.select(*(F.col(f.name).cast(f.dataType) for f in table.schema))
        return self._commit(name, [*self.parts(name), self._part(name, rows)])

    def add(self, name: str, df: DataFrame) -> None:
        """Appends without looking at the rows that are there; no rows make no version. The caller sees to the columns."""
        seen = Observation()
        path = self._part(name, df.observe(seen, F.count(F.lit(1)).alias("n")))
        if seen.get["n"]:
            self._commit(name, [*(self.parts(name) if self.exists(name) else []), path])

    def compact(self, name: str) -> int:
        """The same rows in one part: after many appends."""
        return self.write(name, self.read(name))

    def vacuum(self, name: str, keep: int = 2) -> None:
        """Drops all but the last versions, and the parts that only they named."""
        found = self.versions(name)
        used = {p for v in found[-keep:] for p in self.parts(name, v)}
        for version in found[:-keep]:
            for path in (*set(self.parts(name, version)) - used, f"{self.root}/{name}/versions/v{version:08d}"):
                fs, p = hadoop_path(self.spark, path)
                fs.delete(p, True)

    def insert_new(self, name: str, df: DataFrame, keys: list[str], order: str) -> int:
        """Rows whose key the table lacks, the first of each key; returns how many there were."""
        new = first_rows(df, keys, order)
        if self.exists(name):
            new = new.join(self.read(name).select(*keys), keys, "left_anti")
        new = cut_lineage(new)
        count = new.count()
        if count:
            self.append(name, new)
        return count

    def insert(self, name: str, df: DataFrame, keys: list[str]) -> int:
        """All rows of ``df``; raises, and writes nothing, if a key is in the table or twice in ``df``."""
        rows = cut_lineage(df)
        held = rows.select(*keys).groupBy(*keys).count().where("count > 1").select(*keys)
        if self.exists(name):
            held = held.union(rows.select(*keys).join(self.read(name).select(*keys), keys, "left_semi"))
        first = held.take(1)
        if first:
            raise ValueError(f"{name} has or would have {first[0].asDict()} twice")
        return self.append(name, rows)

    def upsert(self, name: str, df: DataFrame, keys: list[str]) -> int:
        """Rows of ``df`` take the place of those with their key."""
        return self.write(name, upserted(self.read(name), df, keys) if self.exists(name) else df)


def first_rows(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def upserted(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(new.select(*keys), keys, "left_anti").unionByName(new)
