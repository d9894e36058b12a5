"""Approximate nearest neighbours: a forest of random-projection trees.

The trees are fitted on a bounded sample; every vector is indexed: it goes down
every tree to a leaf.  A query walks all trees through one priority queue that
holds the smallest margin on the way to each branch, and visits leaves in that
order.  Its candidates are the vectors of the visited leaves.  How many leaves a
query visits is set on the sample, against brute force, so that the wanted
recall is met.

Leaves hold unit vectors in half precision, whose products are off by at most
``ROUGH``; what lies within twice that of a query's kth best is then ranked by
exact cosine of the original vectors, so the halves cost no result.  Visits are
ids only: the vectors of the queries are broadcast where their size allows, and
else travel with the visits.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from .common import BROADCAST_BYTES, Scratch, partitions_for
from .exact_topk import ranked
from .vectors import blocks, distinct_vectors, usable


#: The error of a product of unit vectors, one of them in half precision: 2 ** -11 of the vector, and what halves cannot tell from zero.
ROUGH = 5.1e-4
#: Candidates that a task holds before it drops those that cannot be among its best.
HELD = 1 << 20


@dataclass(frozen=True)
class Settings:
    """sample: distinct vectors the trees are fitted on, at most; leaf: sampled vectors per leaf, at most."""

    sample: int = 8192
    trees: int = 8
    leaf: int = 64
    recall: float = 0.985
    probes: int = 200
    block: int = 2048
    queries: int = 512
    seed: int = 11


class Tree:
    """normals[i] splits node i; children[i] are nodes, or ~leaf for leaves."""

    def __init__(self, x: np.ndarray, leaf: int, rng: np.random.Generator):
        self.normals: list[np.ndarray] = []
        self.offsets: list[float] = []
        self.children: list[list[int]] = []
        self.leaves = 0
        self.root = self._grow(x, np.arange(len(x)), leaf, rng)
        self.matrix = np.array(self.normals).reshape(len(self.normals), x.shape[1])

    def _grow(self, x: np.ndarray, rows: np.ndarray, leaf: int, rng: np.random.Generator) -> int:
        split = self._split(x, rows, rng) if len(rows) > leaf else None
        if split is None:
            self.leaves += 1
            return ~(self.leaves - 1)
        normal, offset, right = split
        node = len(self.normals)
        self.normals.append(normal), self.offsets.append(offset), self.children.append([0, 0])
        self.children[node] = [self._grow(x, rows[~right], leaf, rng), self._grow(x, rows[right], leaf, rng)]
        return node

    def _split(self, x: np.ndarray, rows: np.ndarray, rng: np.random.Generator):
        for attempt in range(8):
            if attempt < 4:  # between two random points, then any direction
                a, b = x[rng.choice(rows, 2, replace=False)]
                normal = a - b
            else:
                normal = rng.normal(size=x.shape[1])
            size = np.linalg.norm(normal)
            if size < 1e-12:
                continue
            normal = normal / size
            m = x[rows] @ normal
            offset = float(np.median(m))
            right = m > offset
            if 0.1 < right.mean() < 0.9:
                return normal, offset, right
        return None

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(x), np.int64), [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = ~node
            elif len(rows):
                right = x[rows] @ self.matrix[node] > self.offsets[node]
                todo += [(self.children[node][0], rows[~right]), (self.children[node][1], rows[right])]
        return out


class Forest:
    def __init__(self, x: np.ndarray, s: Settings):
        rng = np.random.default_rng(s.seed)
        self.trees = [Tree(x, s.leaf, rng) for _ in range(s.trees)] if len(x) else []
        self.visits = self._tune(x, s, rng) if len(x) else 0

    def leaves(self) -> int:
        return sum(t.leaves for t in self.trees)

    def visited(self, v: np.ndarray, most: int) -> list[tuple[int, int]]:
        """The (tree, leaf) pairs that a query visits, nearest margins first."""
        margins = [(t.matrix @ v - t.offsets).tolist() if len(t.offsets) else [] for t in self.trees]
        queue, out = [(0.0, k, t.root) for k, t in enumerate(self.trees)], []
        heapq.heapify(queue)
        while queue and len(out) < most:
            far, k, node = heapq.heappop(queue)
            while node >= 0:  # the near side has the margin of the way here
                m = margins[k][node]
                near, other = (1, 0) if m > 0 else (0, 1)
                heapq.heappush(queue, (max(far, abs(m)), k, self.trees[k].children[node][other]))
                node = self.trees[k].children[node][near]
            out.append((k, ~node))
        return out

    def _tune(self, x: np.ndarray, s: Settings, rng: np.random.Generator) -> int:
        """Leaves to visit for the wanted recall at 5, against brute force over the sample."""
        probes = rng.choice(len(x), min(s.probes, len(x)), replace=False)
        members = [t.leaf_of(x) for t in self.trees]
        needed = []
        for p in probes.tolist():
            near = x @ x[p]
            near[p] = -np.inf
            best = np.argpartition(-near, min(5, len(x) - 1) - 1)[:5] if len(x) > 5 else np.flatnonzero(np.arange(len(x)) != p)
            turn = {leaf: n for n, leaf in enumerate(self.visited(x[p], self.leaves()), 1)}
            needed += [min(turn[(k, int(m[b]))] for k, m in enumerate(members)) for b in best.tolist()]
        return int(np.quantile(needed, s.recall, method="higher")) if needed else self.leaves()


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _routes(one: DataFrame, forest, asked: bool, payload: str | None) -> DataFrame:
    """width, tree, leaf, rid of each leaf that a vector lies in, or as a query visits; and its unit vector as bytes of the payload's type."""
    kinds = {"width": pa.int32(), "tree": pa.int32(), "leaf": pa.int32(), "rid": pa.int64()} | ({"vec": pa.binary()} if payload else {})
    schema = pa.schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 512):
                b = big.slice(at, 512)
                widths = b.column(0).to_numpy()
                for width in np.unique(widths).tolist():
                    f = forest.value[width]
                    part = b.filter(pa.array(widths == width))
                    x = unit(part.column(2).flatten().to_numpy().reshape(-1, width))
                    if asked:
                        ways = [f.visited(v, f.visits) for v in x]
                        row = np.repeat(np.arange(len(x)), [len(w) for w in ways])
                        tree, leaf = np.array([p for w in ways for p in w]).reshape(-1, 2).T
                    else:
                        row = np.tile(np.arange(len(x)), len(f.trees))
                        tree = np.repeat(np.arange(len(f.trees)), len(x))
                        leaf = np.concatenate([t.leaf_of(x) for t in f.trees])
                    own = pa.array([v.tobytes() for v in x.astype(payload)], pa.binary()) if payload else None
                    for s in range(0, len(row), 8192):
                        take = pa.array(row[s : s + 8192])
                        cells = [np.full(len(take), width), tree[s : s + 8192], leaf[s : s + 8192]]
                        cells = [*[pa.array(c, pa.int32()) for c in cells], part.column(1).take(take), *([own.take(take)] if payload else [])]
                        yield pa.RecordBatch.from_arrays(cells, schema=schema)

    return one.select("width", "rid", "vec").mapInArrow(run, from_arrow_schema(schema))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in doubles: equal rows give equal values wherever they stand."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def near_best(qid: np.ndarray, rid: np.ndarray, rough: np.ndarray, keep: int) -> np.ndarray:
    """Places of each query's distinct candidates that may be among its keep best, by products that are off by ROUGH."""
    order = np.lexsort((-rough, rid, qid))
    q, r = qid[order], rid[order]
    order = order[np.append(True, (q[1:] != q[:-1]) | (r[1:] != r[:-1]))] if len(order) else order  # a vector met in several trees counts once
    order = order[np.lexsort((-rough[order], qid[order]))]
    q, v = qid[order], rough[order]
    first = np.searchsorted(q, q, side="left")
    last = np.minimum(first + keep, np.searchsorted(q, q, side="right")) - 1
    return order[v >= np.where(last - first == keep - 1, v[last], -np.inf) - 2 * ROUGH]


def _scored(pairs: DataFrame, keep: int, asking) -> DataFrame:
    """qid, rid, rough: of each task's candidates those that may be among a query's keep best.

    pairs: width, rids, vec, qids and, without asking (the queries' vectors by width), qvecs.
    """
    schema = pa.schema({"qid": pa.int64(), "rid": pa.int64(), "rough": pa.float64()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = kept = 0

        def best() -> list[np.ndarray]:
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            at = near_best(*columns, keep)
            return [c[at] for c in columns]

        for b in batches:
            names = {n: b.column(b.schema.get_field_index(n)) for n in b.schema.names}
            for k in range(b.num_rows):
                width, rids, qids = names["width"][k].as_py(), names["rids"][k].values.to_numpy(), names["qids"][k].values.to_numpy()
                x = np.frombuffer(b"".join(names["vec"][k].as_py()), np.float16).reshape(-1, width).astype(np.float64)
                if asking is None:
                    q = np.frombuffer(b"".join(names["qvecs"][k].as_py()), np.float64).reshape(-1, width)
                else:
                    known, vectors = asking.value[width]
                    q = vectors[np.searchsorted(known, qids)]
                rough = q @ x.T
                most = min(keep, len(x))
                cut = np.partition(rough, len(x) - most, axis=1)[:, len(x) - most] - 2 * ROUGH
                at, which = np.nonzero(rough >= cut[:, None])
                held.append([qids[at], rids[which], rough[at, which]])
                size += len(at)
                if size > 2 * max(kept, HELD):
                    held = [best()]
                    size = kept = len(held[0][0])
        if held:
            found = best()
            for s in range(0, len(found[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[s : s + (1 << 16)]) for c in found], schema=schema)

    return pairs.mapInArrow(run, from_arrow_schema(schema))


def _exact(found: DataFrame) -> DataFrame:
    """qid, rid, ids, score from qid, rid, ids, vec, qvec."""
    out = T.StructType([*found.schema.fields[:3], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 2048):
                b = big.slice(at, 2048)
                score = np.zeros(b.num_rows)
                widths = np.array([len(v) for v in b.column(3)])
                for width in np.unique(widths).tolist():
                    rows = pa.array(np.flatnonzero(widths == width))
                    x, q = (b.column(c).take(rows).flatten().to_numpy().reshape(-1, width) for c in (3, 4))
                    score[rows.to_numpy()] = cosines(q, x)
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(score)], names=out.names)

    return found.mapInArrow(run, out)


def search(spark: SparkSession, rows: DataFrame, k: int = 5, s: Settings = Settings()) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found by cosine, nearest first.

    rows: vec_id long, vec array<double>, query boolean.  Null ids, null or zero
    vectors and vectors with null or non-finite components take no part; vectors
    of different widths do not meet; equal rows count once; ties go to the
    smaller id; fewer than k candidates are all returned; no rows give no rows;
    other columns are not read.
    """
    scratch, keep = Scratch(spark, "forest"), k + 1
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vec")) & F.exists("vec", lambda x: x != 0)).select("vec_id", "vec", "query")
    one = distinct_vectors(scratch, rows, k)
    forests = {}
    for r in one.groupBy("width").count().collect():
        few = one.where(F.col("width") == r["width"]).select("vec", F.xxhash64(F.lit(s.seed), "vec").alias("_h")).orderBy("_h").limit(s.sample).collect()
        forests[r["width"]] = Forest(unit(np.array([v["vec"] for v in few], np.float64)), s)
    held = spark.sparkContext.broadcast(forests)  # its size is bounded by sample and trees
    queries = one.where("asked").select("width", "rid", "vec")
    small = (queries.agg(F.sum(8 * F.col("width") + 16)).first()[0] or 0) <= BROADCAST_BYTES
    asking = spark.sparkContext.broadcast(_by_width(queries)) if small else None
    key = ["width", "tree", "leaf"]
    routed = scratch.write(_routes(one, held, False, "<f2"), "routed")
    sizes = scratch.write(routed.groupBy(*key).agg(F.ceil(F.count("*") / s.block).cast("int").alias("_parts")), "sizes")
    parts = partitions_for(spark, routed.count(), 1_000_000)
    there = blocks(
        routed.join(F.broadcast(sizes), key).withColumn("_part", F.pmod(F.xxhash64("rid"), F.col("_parts")).cast("int")).repartition(parts, *key, "_part"),  # leaves: bounded by the trees
        [*key, "_part"], ["rid", "vec"], 2 * s.block,
    ).withColumnRenamed("rid", "rids")
    visits = scratch.write(_routes(one.where("asked"), held, True, None if small else "<f8"), "visits")
    loads = visits.groupBy(*key).agg(F.ceil(F.count("*") / s.queries).cast("int").alias("_loads"))
    asked = blocks(
        visits.join(F.broadcast(loads), key).withColumn("_load", F.pmod(F.xxhash64("rid"), F.col("_loads")).cast("int")).repartition(*key, "_load"),
        [*key, "_load"], ["rid"] if small else ["rid", "vec"], 2 * s.queries,
    ).select(*key, F.col("rid").alias("qids"), *([] if small else [F.col("vec").alias("qvecs")]))
    pairs = there.join(asked, key).select("width", "rids", "vec", "qids", *([] if small else ["qvecs"]))
    found = scratch.write(_scored(pairs, keep, asking).groupBy("qid", "rid").agg(F.max("rough").alias("rough")), "found")
    best = Window.partitionBy("qid").orderBy(F.desc("rough"), "rid")
    floor = found.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= keep).groupBy("qid").agg(F.min("rough").alias("_least"), F.count("*").alias("_c"))
    floor = floor.select(F.col("qid").alias("_q"), F.when(F.col("_c") == keep, F.col("_least") - 2 * ROUGH).alias("_floor"))
    close = found.join(floor, F.col("qid") == F.col("_q")).where(F.col("_floor").isNull() | (F.col("rough") >= F.col("_floor")))
    close = close.select("qid", "rid").join(one.select("rid", "ids", "vec"), "rid").join(queries.select(F.col("rid").alias("qid"), F.col("vec").alias("qvec")), "qid")
    return ranked(_exact(close.select("qid", "rid", "ids", "vec", "qvec")), one, rows, k, F.desc("score"))


def _by_width(queries: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each width the queries' ids, ascending, and their unit vectors.  Only for what a check has found small."""
    out: dict[int, list[tuple]] = {}
    for r in queries.collect():
        out.setdefault(r["width"], []).append((r["rid"], r["vec"]))
    made = {}
    for width, some in out.items():
        some.sort()
        made[width] = (np.array([i for i, _ in some], np.int64), unit(np.array([v for _, v in some], np.float64)))
    return made


def from_embeddings(table: DataFrame) -> DataFrame:
    return table.select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("vec"), F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False)).alias("query")
    )
