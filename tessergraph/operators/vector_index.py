"""A stored vector index with exact results: cells with radii, byte codes with error bounds.

Unit vectors are dealt to the nearest of some centers. By the triangle
inequality of angles no vector of a cell can be closer to a query than the
query's angle to the center less the cell's radius, so cells whose bound lies
under a query's k-th score are skipped. Inside a cell each vector is one byte a
dimension and the length of what rounding took away, which bounds the
similarity from both sides; only vectors whose upper bound reaches the k-th
lower bound are read whole. Close groups are skipped by cells; where vectors
are spread evenly cells can't help and the codes do the pruning.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_type

from tessergraph.functions.exprs import cosine
from tessergraph.sources.store import Store, cut_lineage

#: Rows that the centers are fitted on, centers at most, rows that a cell should have, rows of a cell that one task holds, queries that it multiplies with them.
FIT_ROWS, MAX_CELLS, CELL_ROWS, PART_ROWS, BLOCK = 16_384, 1_024, 8_192, 16_384, 256
#: Added to every bound, against rounding of sums; far above that of doubles and of the 32-bit ``off``.
SLACK = 1e-6
#: The cell of vectors without length, whose similarity is 0.
NOWHERE = -1


def unit_rows(column: pa.Array, n: int) -> np.ndarray:
    """Rows of a list column as unit vectors; null ones, those of another length, and those with null or endless parts have length 0."""
    out = np.zeros((len(column), n))
    sizes = np.diff(column.offsets.to_numpy())
    good = np.flatnonzero((sizes == n) & column.is_valid().to_numpy(zero_copy_only=False)) if n else np.zeros(0, int)
    if len(good):
        flat = column.take(pa.array(good)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(good), n)
        flat[~np.isfinite(flat).all(1)] = 0
        largest = np.abs(flat).max(1, keepdims=True)
        flat = np.divide(flat, largest, out=np.zeros_like(flat), where=largest > 0)
        length = np.sqrt((flat * flat).sum(1, keepdims=True))
        out[good] = np.divide(flat, length, out=np.zeros_like(flat), where=length > 0)
    return out


def fitted(sample: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Unit centers of about ``cells`` groups of unit vectors; the first ones are spread over the sample."""
    centers = np.unique(sample[np.linspace(0, len(sample) - 1, cells).astype(int)], axis=0)
    for _ in range(rounds):
        nearest = (sample @ centers.T).argmax(1)
        sums = np.zeros_like(centers)
        np.add.at(sums, nearest, sample)
        length = np.sqrt((sums * sums).sum(1, keepdims=True))
        centers = np.where(length > 1e-9, sums / np.maximum(length, 1e-9), centers)
    return centers


def coded(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One byte a dimension for each unit vector, and the distance between the vector and its code made unit."""
    largest = np.abs(units).max(1, keepdims=True, initial=0)
    codes = np.rint(np.divide(units * 127, largest, out=np.zeros_like(units), where=largest > 0)).astype(np.int8)
    return codes, np.sqrt(((units - decoded(codes)) ** 2).sum(1))


def decoded(codes: np.ndarray) -> np.ndarray:
    values = codes.astype(float)
    length = np.sqrt((values * values).sum(1, keepdims=True))
    return np.divide(values, length, out=np.zeros_like(values), where=length > 0)


def cell_bounds(units: np.ndarray, centers: np.ndarray, cells: list[int], radii: np.ndarray) -> np.ndarray:
    """The largest similarity that each query (row) could have in each cell (column)."""
    held = np.array(cells)
    to_center = np.arccos(np.clip(units @ centers[np.maximum(held, 0)].T, -1, 1)) if len(centers) else np.zeros((len(units), len(held)))
    best = np.cos(np.maximum(to_center - radii - SLACK, 0)) + SLACK
    best[:, held == NOWHERE] = 0
    best[~units.any(1)] = 0
    return best


def between(close: np.ndarray, off: np.ndarray, real: bool) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the similarities of unit vectors x with a query q, from q's with their unit codes c and the distances ``off`` of x and c.

    q(x - c) is at most off, and, as x and c have length 1, it is
    (q - c)(x - c) less half the square of off: the tighter for a c close to q.
    """
    if not real:
        return np.zeros_like(close), np.zeros_like(close)
    far = off * np.sqrt(np.maximum(2 - 2 * close, 0) + SLACK)
    middle = close - off * off / 2
    return np.maximum(close - off, middle - far) - SLACK, np.minimum(close + off, middle + far) + SLACK


def survivors(lower: np.ndarray, upper: np.ndarray, same: np.ndarray, ids: np.ndarray, least: float, k: int) -> np.ndarray:
    """Places of the rows that can be among the k best; of equal vectors the k smallest ids."""
    if len(lower) > k:
        least = max(least, np.partition(lower, len(lower) - k)[len(lower) - k])
    at = np.flatnonzero(upper >= least)
    if len(at) <= k:
        return at
    at = at[np.lexsort((ids[at], lower[at], same[at]))]
    begins = np.flatnonzero(np.concatenate(([True], (same[at][1:] != same[at][:-1]) | (lower[at][1:] != lower[at][:-1]))))
    place = np.arange(len(at)) - np.repeat(begins, np.diff(np.append(begins, len(at))))
    return at[place < k]


class VectorIndex:
    """An index in a `Store`: ``create`` it from vectors, ``add`` more, search with ``topk`` and ``topk_many``.

    vectors: event_id (string) and embedding. Null ids are left out; of rows of
    one id one is kept. Vectors that are null, of another length than most of
    the sample, without length, or with null or non-finite parts have
    similarity 0 with all. Other columns aren't read. One writer at a time; a
    search sees what was there when the index was opened.
    """

    def __init__(self, store: Store, name: str = "vector_index"):
        self.store, self.name = store, name
        held = store.read(f"{name}_centers").orderBy("cell").collect()  # MAX_CELLS rows at most
        self.centers = np.array([r["center"] for r in held], float) if held else np.zeros((0, 0))
        self._open()

    def _open(self) -> None:
        cells = self.store.read(f"{self.name}_cells").groupBy("cell").agg(F.max("radius").alias("radius"), F.sum("rows").alias("rows")).orderBy("cell").collect()
        self.cells = {r["cell"]: (r["radius"], r["rows"]) for r in cells}  # a row a cell
        self.rows = self.store.read(f"{self.name}_rows") if self.store.exists(f"{self.name}_rows") else None

    @classmethod
    def create(cls, store: Store, vectors: DataFrame, name: str = "vector_index", cell_rows: int = CELL_ROWS) -> VectorIndex:
        """Centers are fitted on FIT_ROWS vectors at most, drawn by a hash of the id; every vector is indexed. An index of that name is an error."""
        if store.exists(f"{name}_centers"):
            raise ValueError(f"there is an index {name}")
        spark = vectors.sparkSession
        usable = vectors.where("event_id IS NOT NULL")
        total = usable.count()
        one_in = max(total // FIT_ROWS, 1)
        sample = usable.where(F.pmod(F.xxhash64("event_id"), F.lit(one_in)) == 0).select("embedding").limit(FIT_ROWS).toArrow()["embedding"].combine_chunks()
        sizes = np.diff(sample.offsets.to_numpy())
        n = int(np.bincount(sizes).argmax()) if len(sizes) else 0
        units = unit_rows(sample, n)
        units = units[units.any(1)]
        cells = min(MAX_CELLS, max(total // cell_rows, 1), len(units))
        centers = fitted(units, cells) if cells else np.zeros((0, n))
        store.write(f"{name}_cells", spark.createDataFrame([], "cell int, radius double, rows long"))
        store.write(f"{name}_centers", spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "cell int, center array<double>"))
        found = cls(store, name)
        found._put(usable.dropDuplicates(["event_id"]))
        return found

    def add(self, vectors: DataFrame) -> None:
        """Indexes the vectors of ids that the index lacks, in the cells that are there; the radii grow with them. May be repeated after a crash."""
        new = vectors.where("event_id IS NOT NULL").dropDuplicates(["event_id"])
        self._open()
        self._put(new if self.rows is None else new.join(self.rows.select("event_id"), "event_id", "left_anti"))

    def _put(self, vectors: DataFrame) -> None:
        centers = self.centers
        schema = pa.schema([("cell", pa.int32()), ("angle", pa.float64()), ("event_id", pa.string()), ("code", pa.binary()), ("off", pa.float32()), ("same", pa.int64()), ("embedding", to_arrow_type(vectors.schema["embedding"].dataType))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                units = unit_rows(batch.column(1), centers.shape[1])
                codes, off = coded(units)
                close = np.clip(units @ centers.T, -1, 1) if len(centers) else np.zeros((len(units), 1))
                real = units.any(1)
                cell = np.where(real, close.argmax(1), NOWHERE).astype(np.int32)
                angle = np.where(real, np.arccos(close.max(1)), 0)
                same = np.where(real, batch.column(2).to_numpy(), 0)
                columns = (cell, angle, batch.column(0), [c.tobytes() for c in codes], np.nextafter(off.astype(np.float32), np.float32(np.inf)), same)
                yield pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(columns, schema)), batch.column(1)], schema=schema)

        rows = vectors.select("event_id", "embedding", F.xxhash64("embedding").alias("same")).mapInArrow(run, from_arrow_schema(schema))
        rows = cut_lineage(rows)
        # First the radii: those of rows that then aren't written only make bounds wider.
        self.store.append(f"{self.name}_cells", rows.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("rows")))
        # By cell, so that a filter on cells skips row groups; a cell of many rows, or of many copies, is split.
        self.store.append(f"{self.name}_rows", rows.drop("angle").repartitionByRange("cell", F.xxhash64("event_id")).sortWithinPartitions("cell"))
        self._open()

    def _visits(self, queries: DataFrame, k: int, first: bool) -> DataFrame:
        """(cell, query_id, unit, least): cells to be searched for each query: the best ones that hold k rows, or the others whose bound reaches ``least``."""
        centers, cells = self.centers, sorted(self.cells)
        radii, sizes = (np.array([self.cells[c][i] for c in cells], float) for i in (0, 1))
        schema = pa.schema([("cell", pa.int32()), ("query_id", to_arrow_type(queries.schema["query_id"].dataType)), ("unit", pa.binary()), ("least", pa.float64())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                units = unit_rows(batch.column(1), centers.shape[1])
                best = cell_bounds(units, centers, cells, radii)
                order = np.argsort(-best, axis=1, kind="stable")
                before = np.cumsum(sizes[order], axis=1) - sizes[order]
                begun = np.zeros(best.shape, bool)
                np.put_along_axis(begun, order, before < k, axis=1)
                least = np.array([-2.0 if x is None else x for x in batch.column(2).to_pylist()], float)
                q, c = np.nonzero(begun if first else ~begun & (best >= least[:, None]))
                data = [u.tobytes() for u in units]
                yield pa.RecordBatch.from_arrays([pa.array(np.array(cells, np.int32)[c]), batch.column(0).take(pa.array(q)), pa.array([data[i] for i in q.tolist()], pa.binary()), pa.array(least[q])], schema=schema)

        return queries.select("query_id", "embedding", "least").mapInArrow(run, from_arrow_schema(schema))

    def _bounded(self, visits: DataFrame, k: int) -> DataFrame:
        """(query_id, event_id, lower, upper) of rows that can be among the k best of their query, as far as one part of a cell tells."""
        spark = visits.sparkSession
        visits = cut_lineage(visits)
        wanted = [r[0] for r in visits.select("cell").distinct().collect()]  # MAX_CELLS + 1 at most
        parts = spark.createDataFrame([(c, -(-self.cells[c][1] // PART_ROWS)) for c in wanted], "cell int, parts long")
        codes = self.rows.where(F.col("cell").isin(wanted)).join(F.broadcast(parts), "cell")
        held = codes.select("cell", F.pmod(F.xxhash64("event_id"), "parts").alias("part"), F.lit(0).alias("kind"), "event_id", F.lit(None).cast(visits.schema["query_id"].dataType).alias("query_id"), F.col("code").alias("data"), F.col("off").cast("double").alias("x"), "same")
        asked = visits.join(F.broadcast(parts), "cell").select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("event_id"), "query_id", F.col("unit").alias("data"), F.col("least").alias("x"), F.lit(0).cast("long").alias("same"))
        rows = held.unionByName(asked).repartition("cell", "part").sortWithinPartitions("cell", "part", "kind")
        schema = pa.schema([("query_id", to_arrow_type(visits.schema["query_id"].dataType)), ("event_id", pa.string()), ("lower", pa.float64()), ("upper", pa.float64())])
        n = self.centers.shape[1]

        def compared(held: list[tuple], asked: list[tuple]) -> pa.RecordBatch:
            ids, data, off, same = held
            queries = np.frombuffer(b"".join(a[1] for a in asked)).reshape(len(asked), n)
            close, real = queries @ data.T, queries.any(1)
            out: tuple[list, ...] = ([], [], [], [])
            for i, (query_id, _, least) in enumerate(asked):
                lower, upper = between(close[i], off, real[i])
                at = survivors(lower, upper, same if real[i] else np.zeros_like(same), ids, least, k)
                for values, more in zip(out, ([query_id] * len(at), ids[at].tolist(), lower[at].tolist(), upper[at].tolist()), strict=True):
                    values += more
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, rows, held, asked = None, [], None, []
            for batch in batches:
                for cell, part, kind, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if (cell, part) != key or len(asked) == BLOCK:
                        if asked and held:
                            yield compared(held, asked)
                        asked = []
                    if (cell, part) != key:
                        key, rows, held = (cell, part), [], None
                    if kind == 0:
                        rows.append(row)
                        continue
                    if held is None and rows:
                        data = np.frombuffer(b"".join(r[2] for r in rows), np.int8).reshape(len(rows), n)
                        held = (np.array([r[0] for r in rows], object), decoded(data), np.array([r[3] for r in rows]), np.array([r[4] for r in rows]))
                        rows = []
                    asked.append((row[1], row[2], row[3]))
            if asked and held:
                yield compared(held, asked)

        return rows.select("cell", "part", "kind", "event_id", "query_id", "data", "x", "same").mapInArrow(run, from_arrow_schema(schema))

    def candidates(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, event_id): written; every row that the bounds can't keep out of a query's k best, ties by the smallest ids among them."""
        if self.rows is None or not self.cells:
            return cut_lineage(queries.select("query_id", F.lit("").alias("event_id")).limit(0))
        place = Window.partitionBy("query_id").orderBy(F.desc("lower"))
        kth = lambda found: found.withColumn("_n", F.row_number().over(place)).where(F.col("_n") == k).select("query_id", F.col("lower").alias("least"))
        begun = cut_lineage(self._bounded(self._visits(queries.withColumn("least", F.lit(None).cast("double")), k, True), k))
        rest = self._bounded(self._visits(queries.join(kth(begun), "query_id", "left"), k, False), k)
        found = cut_lineage(begun.unionByName(rest))
        return cut_lineage(found.join(kth(found), "query_id", "left").where("upper >= coalesce(least, -2)").select("query_id", "event_id"))

    def topk_many(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, event_id, similarity): the k nearest of each query, ties to the smaller id; the same rows as a comparison with all vectors.

        queries: query_id, each once and not null, and embedding. Vectors are
        read whole for `candidates` alone.
        """
        if k < 1:
            raise ValueError("k must be 1 or more")
        asked = queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
        met = self.candidates(asked, k)
        if self.rows is None:
            return met.withColumn("similarity", F.lit(0.0))
        met = met.join(self.rows.select("event_id", "embedding"), "event_id")
        met = met.join(asked.select("query_id", F.col("embedding").alias("_asked")), "query_id")
        score = self._similarity(F.col("embedding").cast("array<double>"), F.col("_asked"))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "event_id"))
        return met.select("query_id", "event_id", score.alias("similarity")).withColumn("_n", place).where(F.col("_n") <= k).drop("_n")

    def topk(self, query: list[float], k: int) -> DataFrame:
        """event_id and similarity of the k nearest of one query; cells that can't hold them aren't read."""
        spark = self.store.spark
        asked = spark.createDataFrame([(0, list(map(float, query)))], "query_id int, embedding array<double>")
        return self.topk_many(asked, k).select("event_id", "similarity").orderBy(F.desc("similarity"), "event_id").limit(k)

    def _similarity(self, a, b):
        n = self.centers.shape[1]
        usable = lambda x: x.isNotNull() & (F.size(x) == n) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < math.inf))
        return F.when(usable(a) & usable(b), F.coalesce(cosine(a, b), F.lit(0.0))).otherwise(0.0)
