"""Exact top-k by integer inner product over a vector-approximation file.

Every vector becomes a row of small cell numbers in its block (a grid between
the block's smallest and largest component per dimension).  A scan of the cells
gives a lower and an upper bound of each score; the kth largest lower bound
rules out all candidates with a smaller upper bound.  Exact vectors are then
read in the order of their bounds: the best few first, which settles a kth
score, then only those whose bound still reaches it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch
from .vectors import blocks, distinct_vectors, usable

SCALE = 256
#: Cells per dimension; vectors per block; queries per block of queries.
CELLS, BLOCK, QUERIES = 64, 4096, 256


def quantised(v: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component x, as double."""
    return F.transform(v, lambda x: F.floor(x.cast("double") * float(scale)).cast("long"))


def _cells(parts: DataFrame, cells: int) -> DataFrame:
    """The approximation file: per block its rids, low corner and step per dimension, and a byte of cell number per component."""
    out = T.StructType.fromDDL("width int, block int, rids array<long>, low binary, step binary, cells binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for width, block, rids, vecs in zip(*[c.to_pylist() for c in b.columns], strict=True):
                x = np.array(vecs, np.int64).reshape(len(rids), width)
                low = x.min(axis=0) if len(x) else np.zeros(width, np.int64)
                step = (x.max(axis=0) - low) // cells + 1
                cell = ((x - low) // step).astype(np.uint8)
                arrays = [[width], [block], [rids], [low.tobytes()], [step.tobytes()], [cell.tobytes()]]
                kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(a, k) for a, k in zip(arrays, kinds, strict=True)], names=out.names)

    return parts.mapInArrow(run, out)


def _bounded(pairs: DataFrame, most: int) -> DataFrame:
    """(query rid, rid, low, high) of all that the bounds within their block leave in: every one of the most best is among them."""
    out = T.StructType.fromDDL("qid long, rid long, lower long, upper long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                d, n = r["width"], len(r["rids"])
                low, step = np.frombuffer(r["low"], np.int64), np.frombuffer(r["step"], np.int64)
                corner = np.frombuffer(r["cells"], np.uint8).reshape(n, d).astype(np.int64) * step + low
                q = np.array(r["qvecs"], np.int64).reshape(-1, d)
                # doubles are exact below 2**53; larger numbers take integer products
                exact = float(np.abs(q).max(initial=0)) * float(np.abs(corner).max(initial=0)) * d < 2**52
                base = (q.astype(float) @ corner.T.astype(float)).astype(np.int64) if exact else q @ corner.T
                up = (np.maximum(q, 0) * (step - 1)).sum(axis=1)
                down = (np.minimum(q, 0) * (step - 1)).sum(axis=1)
                lower, upper = base + down[:, None], base + up[:, None]
                cut = np.partition(lower, n - most, axis=1)[:, n - most] if n > most else np.full(len(q), np.iinfo(np.int64).min)
                at, which = np.nonzero(upper >= cut[:, None])
                rids, qids = np.array(r["rids"], np.int64), np.array(r["qids"], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (qids[at], rids[which], lower[at, which], upper[at, which])], names=out.names
                )

    return pairs.mapInArrow(run, out)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)


def search(spark: SparkSession, rows: DataFrame, k: int = 5, cells: int = CELLS, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of every query with all other ids.

    rows: vec_id long, vec array<long>, query boolean.  Null ids, null vectors
    and vectors with null components take no part; vectors of different widths
    do not meet; equal rows count once; ties go to the smaller id; a query with
    fewer candidates gets them all; no rows give no rows.  Scores must fit a long.
    """
    scratch, keep = Scratch(spark, "topk"), k + 1
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull()))
    rows = rows.select("vec_id", "vec", "query")
    one = distinct_vectors(scratch, rows, k)
    sizes = one.groupBy("width").agg(F.count("*").alias("n")).withColumn("_blocks", F.ceil(F.col("n") / block).cast("int"))
    packed = blocks(
        one.join(sizes, "width").withColumn("block", F.pmod(F.xxhash64("rid"), F.col("_blocks")).cast("int")).repartition("width", "block"),
        ["width", "block"], ["rid", "vec"], 2 * block,
    )
    file = scratch.write(_cells(packed, cells), "cells")
    parts = max(1, one.where("asked").count() // QUERIES)
    asked = one.where("asked").withColumn("_part", F.pmod(F.xxhash64("rid"), F.lit(parts)).cast("int"))
    questions = blocks(asked.repartition("width", "_part"), ["width", "_part"], ["rid", "vec"], QUERIES)
    questions = questions.join(sizes, "width").select(
        F.col("width").alias("_w"), F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_b"), F.col("rid").alias("qids"), F.col("vec").alias("qvecs")
    )
    pairs = file.join(questions, (F.col("width") == F.col("_w")) & (F.col("block") == F.col("_b")))
    left = scratch.write(_bounded(pairs.select("width", "rids", "low", "step", "cells", "qids", "qvecs"), keep), "bounded")
    best = Window.partitionBy("qid").orderBy(F.desc("lower"), "rid")
    floor = left.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= keep).groupBy("qid").agg(F.min("lower").alias("_floor"), F.count("*").alias("_c"))
    floor = floor.select(F.col("qid").alias("_q"), F.when(F.col("_c") == keep, F.col("_floor")).alias("_floor"))
    still = left.join(floor, F.col("qid") == F.col("_q")).where(F.col("_floor").isNull() | (F.col("upper") >= F.col("_floor")))
    order = Window.partitionBy("qid").orderBy(F.desc("upper"), "rid")
    still = scratch.write(still.withColumn("_turn", F.row_number().over(order)).select("qid", "rid", "upper", "_turn"), "ordered")

    def read(some: DataFrame) -> DataFrame:
        return (
            some.join(one.select("rid", "vec", "ids"), "rid")
            .join(one.where("asked").select(F.col("rid").alias("qid"), F.col("vec").alias("_qv")), "qid")
            .select("qid", "rid", "ids", dot(F.col("vec"), F.col("_qv")).alias("score"))
        )

    first = scratch.write(read(still.where(F.col("_turn") <= keep)), "first")
    sure = first.groupBy("qid").agg(F.min("score").alias("_sure")).withColumnRenamed("qid", "_q")
    rest = still.where(F.col("_turn") > keep).join(sure, F.col("qid") == F.col("_q")).where(F.col("upper") >= F.col("_sure"))
    found = first.unionByName(read(rest.select("qid", "rid")))
    return ranked(found, one, rows, k, F.desc("score"))


def ranked(found: DataFrame, one: DataFrame, rows: DataFrame, k: int, order: Column) -> DataFrame:
    """The k best of every query from what was found for its vector: qid, ids, score."""
    top = Window.partitionBy("qid").orderBy(order, "vec_id")
    best = (
        found.select("qid", "score", F.explode("ids").alias("vec_id")).withColumn("_n", F.row_number().over(top)).where(F.col("_n") <= k + 1)
        .select(F.col("qid").alias("_q"), "vec_id", "score")
    )
    asked = rows.where("query").select(F.col("vec_id").alias("query_id"), F.col("vec").alias("_v")).distinct()
    names = one.where("asked").select(F.col("rid").alias("_rid"), F.col("vec").alias("_qv"))
    own = Window.partitionBy("query_id", "_q").orderBy(order, "vec_id")
    return (
        asked.join(names, F.col("_v") == F.col("_qv"))
        .join(best, F.col("_rid") == F.col("_q"))
        .where(F.col("query_id") != F.col("vec_id"))
        .withColumn("rank", F.row_number().over(own))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def from_embeddings(table: DataFrame) -> DataFrame:
    """The rows of embeddings as the contract reads them: floor(256 x), queries every id divisible by 50."""
    good = table.where(usable(F.col("embedding")))
    return good.select("vec_id", quantised(F.col("embedding")).alias("vec"), (F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False))).alias("query"))
