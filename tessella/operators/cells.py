"""The vector index: vectors stored by cell, so that a question reads the row groups of the cells that can hold its nearest.

Cells are the Voronoi cells of centroids on the unit sphere.  Of each the index
knows how far its vectors lie from the centroid, at most; by the triangle
inequality of angles that bounds the cosine of a question with anything in the
cell.  A search reads the most promising cells, and then, in one more job, those
of the others whose bound reaches the last score that it has: so its result is
that of a scan of all vectors.  With ``probes`` it stops after so many cells.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Cells, at most; below that the root of the number of vectors.
CELLS = 1024
#: Vectors that centroids are fitted on, at most, per cell.
SAMPLE_PER_CELL = 32
#: Bytes of vectors in a partition of the store, about.
PART_BYTES = 256 << 20
#: Fewer vectors than this are read in one job rather than two.
AT_ONCE = 1 << 17
#: What no cell bounds: vectors of another width, without length, or null.
LOOSE = -1


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the vectors that have this width and a length, in doubles; their positions)."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    fits = np.flatnonzero(np.nan_to_num(np.asarray(sizes, float)) == width) if width else np.zeros(0, np.int64)
    rows = column.take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(fits), width)
    good = np.isfinite(rows).all(axis=1) & (rows != 0).any(axis=1)
    return rows[good], fits[good]


def _lowest(vectors: DataFrame, n: int, most: int, seed: int) -> tuple[DataFrame, Column]:
    """(about twice most of n vectors, those of the lowest hashes; the hash): what one task orders does not grow with the input."""
    hashed = F.xxhash64(F.lit(seed), "embedding")
    share = 2 * most / max(n, 1)
    return (vectors.where(hashed < int((share - 0.5) * 2**64)) if share < 1 else vectors), hashed


def _centroids(vectors: DataFrame, width: int, cells: int, seed: int, n: int) -> np.ndarray:
    """Unit centroids by k-means under cosines, on a sample by hash of at most SAMPLE_PER_CELL vectors a cell."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    length = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    usable = vectors.where((F.size("embedding") == width) & (length > 0) & (length < F.lit(float("inf")))).select("embedding")
    low, hashed = _lowest(usable, n, cells * SAMPLE_PER_CELL, seed)
    few = low.orderBy(hashed).limit(cells * SAMPLE_PER_CELL)
    points = few.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    if points.isEmpty():
        return np.zeros((0, width))
    found = np.array(KMeans(k=max(2, cells), maxIter=6, seed=seed, distanceMeasure="cosine").fit(points).clusterCenters())
    return found / np.linalg.norm(found, axis=1, keepdims=True)


def _assigned(vectors: DataFrame, centroids: np.ndarray, width: int) -> DataFrame:
    """vectors with cell, cos (with its centroid) and norm."""
    schema = T.StructType([f for f in vectors.schema.fields if f.name not in ("cell", "cos", "norm")] + T.StructType.fromDDL("cell int, cos double, norm double").fields)
    kept = [f.name for f in schema.fields][:-3]
    at = kept.index("embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, where = _matrix(b.column(at), width)
            cell, cos, norm = np.full(b.num_rows, LOOSE, np.int32), np.zeros(b.num_rows), np.zeros(b.num_rows)
            if len(rows) and len(centroids):
                norm[where] = np.sqrt(np.einsum("ij,ij->i", rows, rows))
                near = rows @ centroids.T / norm[where][:, None]
                cell[where] = near.argmax(axis=1)
                cos[where] = near.max(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(cos), pa.array(norm)], names=schema.names)

    return vectors.select(*kept).mapInArrow(run, schema)


@dataclass(frozen=True)
class VectorIndex:
    """vectors: the columns given, cell, cos, norm, sorted by cell; cells, centroids, widest (angles), counts: a row per cell, CELLS at most."""

    vectors: DataFrame
    cells: np.ndarray
    centroids: np.ndarray
    widest: np.ndarray
    counts: np.ndarray

    @staticmethod
    def build(vectors: DataFrame, path: str, cells: int | None = None, key: str = "chunk_id", seed: int = 7) -> VectorIndex:
        """The index of vectors (key, embedding and what searches filter on), stored under path.

        All vectors are stored; those that have no direction or another width
        than most come into a cell of their own.  Columns named cell, cos and
        norm are replaced.
        """
        spark = vectors.sparkSession
        widths = vectors.where("embedding IS NOT NULL").groupBy(F.size("embedding").alias("w")).count().orderBy(F.desc("count"), "w").limit(1).collect()
        width, n = (widths[0]["w"], widths[0]["count"]) if widths else (0, 0)
        k = cells or min(CELLS, max(1, math.isqrt(n)))
        centroids = _centroids(vectors, width, k, seed, n) if width else np.zeros((0, 0))
        rows = _assigned(vectors, centroids, width)
        parts = max(1, -(-n * width * 4 // PART_BYTES), min(k, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        rows.repartitionByRange(parts, "cell", key).sortWithinPartitions("cell", key).write.parquet(f"{path}/vectors")
        stored = spark.read.parquet(f"{path}/vectors")
        told = stored.groupBy("cell").agg(F.min("cos").alias("cos"), F.count("*").alias("n")).collect()  # a row a cell
        fields = [(r["cell"], [float(x) for x in centroids[r["cell"]]] if r["cell"] != LOOSE else [], math.acos(max(-1.0, min(1.0, r["cos"]))), r["n"]) for r in told]
        spark.createDataFrame(fields, "cell int, centroid array<double>, widest double, n long").coalesce(1).write.parquet(f"{path}/cells")
        return VectorIndex.open(spark, path)

    @staticmethod
    def open(spark: SparkSession, path: str) -> VectorIndex:
        rows = sorted(spark.read.parquet(f"{path}/cells").collect())  # CELLS rows at most
        bound = [r for r in rows if r["cell"] != LOOSE]
        width = len(bound[0]["centroid"]) if bound else 0
        return VectorIndex(
            spark.read.parquet(f"{path}/vectors"), np.array([r["cell"] for r in bound], np.int64), np.array([r["centroid"] for r in bound]).reshape(len(bound), width),
            np.array([r["widest"] for r in bound]), np.array([r["n"] for r in bound], np.int64),
        )

    def bounds(self, query: list[float]) -> np.ndarray:
        """The highest cosine that anything in each cell can have with the query."""
        q = np.array(query, float)
        size = np.linalg.norm(q)
        if len(q) != self.centroids.shape[1] or not size or not np.isfinite(size):
            return np.zeros(len(self.cells))
        angle = np.arccos(np.clip(self.centroids @ q / size, -1, 1))
        return np.cos(np.maximum(0.0, angle - self.widest - 1e-9))

    def near(
        self, query: list[float], limit: int, floor: float = 0.2, key: str = "chunk_id", narrow: Callable[[DataFrame], DataFrame] | None = None, probes: int | None = None, at_once: int = AT_ONCE
    ) -> DataFrame:
        """The limit best vectors above the floor, with score (cosine), best first, ties by key; a local table.

        narrow filters the vectors before they are scored.  Without probes the
        result is that of a scan; with probes only so many cells are read.  Where
        all that is able to match is at_once vectors or fewer, one job reads them.
        A floor below 0 would let vectors without a direction in, so 0 is the
        lowest.
        """
        floor = max(floor, 0.0)
        bound = self.bounds(query)
        able = np.flatnonzero(bound > floor)
        order = able[np.argsort(-bound[able], kind="stable")]
        few = probes
        if probes is None:
            few = int(np.searchsorted(np.cumsum(self.counts[order]), 4 * limit)) + 1 if self.counts[order].sum() > at_once else len(order)
        plan = self._best(order[:few], query, limit, floor, key, narrow)
        found = plan.collect()  # limit rows
        full = len(found) == limit
        bar = found[-1]["score"] if full else floor
        rest = order[few:][bound[order[few:]] >= bar - 1e-6] if probes is None else order[:0]
        if len(rest):
            found += self._best(rest, query, limit, bar - 2e-6 if full else floor, key, narrow).collect()
            found = sorted(found, key=lambda r: (-r["score"], r[key]))[:limit]
        return self.vectors.sparkSession.createDataFrame(found, plan.schema)

    def _best(self, cells: np.ndarray, query: list[float], limit: int, floor: float, key: str, narrow: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
        ids = sorted(self.cells[cells].tolist())
        rows = self.vectors.where(F.col("cell").isin(ids)) if len(ids) < len(self.cells) else self.vectors.where(F.col("cell") != LOOSE)
        rows = narrow(rows) if narrow else rows
        kept = [c for c in rows.columns if c not in ("embedding", "cell", "cos", "norm")]
        schema = T.StructType([rows.schema[c] for c in kept] + [T.StructField("score", T.DoubleType())])
        q, n = np.array(query, float), len(kept)
        q = q / (np.linalg.norm(q) or 1.0)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                vectors, where = _matrix(b.column(n), len(q))
                score = np.round(vectors @ q / b.column(n + 1).to_numpy()[where], 6)
                good = score > floor
                yield pa.RecordBatch.from_arrays([*[c.take(pa.array(where[good])) for c in b.columns[:n]], pa.array(score[good])], names=schema.names)

        return rows.select(*kept, "embedding", "norm").mapInArrow(run, schema).orderBy(F.desc("score"), key).limit(limit)
