"""Compression of vectors to product codes: each part of a vector is named by its nearest codebook entry.

Vectors are stored once as columnar NumPy blocks (a row of the block per
dimension).  A round is one ``treeAggregate`` over the blocks: distances to all
entries accumulate dimension by dimension, ``np.add.at`` adds the parts of each
entry into int64 sums and counts, and these tensors (parts x entries x width)
merge through a reduction tree, so the driver gets one of them.  All sums are
of integers, so neither the order of the blocks nor a repeated task changes
anything.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, keyed
from .vectors import usable

#: Rows of a block, about.
BLOCK_ROWS = 8192
#: Components beyond this would overflow sums of squares in 64 bits.
LARGEST = 1 << 28


@dataclass(frozen=True)
class Settings:
    scale: int = 4096
    parts: int = 8
    entries: int = 16
    rounds: int = 6
    #: Levels of the reduction tree.
    depth: int = 2


def from_embeddings(embeddings: DataFrame) -> DataFrame:
    """vec_id, vec, label of rows whose vector is not null and has neither null nor non-finite components."""
    return embeddings.where(usable(F.col("embedding"))).select("vec_id", F.col("embedding").alias("vec"), "label")


def _integers(vec: pa.Array, scale: int, dims: int) -> np.ndarray:
    """floor(scale * x) as dims x rows; shorter vectors are filled with zeros."""
    flat = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.array(vec.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    out = np.zeros((len(vec), dims))
    at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(np.arange(len(vec)), size), at] = flat
    out = np.floor(out * scale)
    if out.size and np.abs(out).max() >= LARGEST:
        raise ValueError(f"a component is beyond {LARGEST // scale}: its codes cannot be exact in 64 bits")
    return np.ascontiguousarray(out.astype(np.int32).T)


def part_blocks(rows: DataFrame, dims: int, s: Settings = Settings()) -> DataFrame:
    """vec_ids, labels, block: blocks of int32 components, dimension after dimension."""
    ids, labels = rows.schema["vec_id"].dataType.simpleString(), rows.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, BLOCK_ROWS):
                b = big.slice(at, BLOCK_ROWS)
                ends = pa.array([0, b.num_rows], pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.concat_arrays([b.column(k)])) for k in (0, 2)]
                block = pa.array([_integers(b.column(1), s.scale, dims).tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays([*lists, block], names=["vec_ids", "labels", "block"])

    return rows.select("vec_id", "vec", "label").mapInArrow(run, f"vec_ids array<{ids}>, labels array<{labels}>, block binary")


def assigned(block: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, squared distances), both parts x rows; block: dims x rows, book: parts x entries x width.  Ties go to the lower entry."""
    parts, entries, width = book.shape
    codes, error = np.zeros((parts, block.shape[1]), np.int64), np.zeros((parts, block.shape[1]), np.int64)
    for p in range(parts):
        total = np.zeros((entries, block.shape[1]), np.int64)
        for j in range(width):
            off = block[p * width + j].astype(np.int64)[None, :] - book[p, :, j][:, None]
            total += off * off
        codes[p] = total.argmin(axis=0)
        error[p] = np.take_along_axis(total, codes[p][None, :], 0)[0]
    return codes, error


def trained(blocks: DataFrame, book: np.ndarray, s: Settings = Settings()) -> np.ndarray:
    """The codebooks after all rounds; book: those of the start."""
    parts, entries, width = book.shape
    dims, rdd = parts * width, blocks.select("block").rdd

    def add(held: tuple[np.ndarray, np.ndarray], row) -> tuple[np.ndarray, np.ndarray]:
        block = np.frombuffer(row[0], np.int32).reshape(dims, -1)
        codes, _ = assigned(block, shared.value)
        part = np.repeat(np.arange(parts)[:, None], block.shape[1], 1)
        np.add.at(held[0], (part, codes), block.reshape(parts, width, -1).transpose(0, 2, 1).astype(np.int64))
        np.add.at(held[1], (part, codes), 1)
        return held

    def merge(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return a[0] + b[0], a[1] + b[1]

    for _ in range(s.rounds):
        shared = rdd.context.broadcast(book)  # parts x entries x width numbers
        zero = (np.zeros(book.shape, np.int64), np.zeros((parts, entries), np.int64))
        sums, counts = rdd.treeAggregate(zero, add, merge, s.depth)
        book = np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], book)
        shared.destroy()
    return book


def _coded(blocks: DataFrame, rows: DataFrame, book: np.ndarray) -> DataFrame:
    dims = book.shape[0] * book.shape[2]
    digits = np.array([f"{k:02x}" for k in range(256)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                ids, labels = b.column(0).slice(k, 1).flatten(), b.column(1).slice(k, 1).flatten()
                codes, error = assigned(np.frombuffer(b.column(2)[k].as_py(), np.int32).reshape(dims, -1) if dims else np.zeros((0, len(ids)), np.int32), book)
                code = ["".join(c) for c in digits[codes.T].tolist()]
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(code, pa.string()), pa.array(error.sum(axis=0))], names=["vec_id", "label", "code", "error"])

    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, label {rows.schema['label'].dataType.simpleString()}, code string, error long"
    return blocks.mapInArrow(run, schema)


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def first_book(rows: DataFrame, dims: int, s: Settings = Settings()) -> np.ndarray:
    """The parts of the vectors of the smallest ids; of several vectors of one id the smallest."""
    ids = rows.select(F.col("vec_id").alias("_id")).distinct().orderBy(F.asc_nulls_last("_id")).limit(s.entries)
    found = rows.join(F.broadcast(ids), _same(F.col("vec_id"), F.col("_id")), "left_semi").groupBy("vec_id").agg(F.min("vec").alias("vec"))
    vectors = [r[0] for r in found.orderBy(F.asc_nulls_last("vec_id")).select("vec").collect()]  # at most entries rows
    whole = _integers(pa.array(vectors, pa.list_(pa.float64())), s.scale, dims).astype(np.int64)
    return np.ascontiguousarray(whole.reshape(s.parts, dims // s.parts, len(vectors)).transpose(0, 2, 1))


def compress(spark: SparkSession, rows: DataFrame, s: Settings = Settings()) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of rows of vec_id, vec (usable ones), label.

    Vectors have the width of the longest one, rounded up to a multiple of the
    parts; shorter ones are filled with zeros.  A null id is the largest,
    repeated rows count each (as the start of a codebook entry an id counts
    once), null labels are one label.  Ties of distance go to the lower entry.
    Fewer ids than entries give as many entries as ids; an empty table gives no
    rows.  Components of 65,536 or more raise an error.  Other columns of rows
    are not read.
    """
    scratch = Scratch(spark, "codes")
    longest = rows.agg(F.max(F.size("vec"))).first()[0] or 0
    dims = -(-longest // s.parts) * s.parts
    blocks = scratch.write(part_blocks(rows, dims, s), "blocks", "lz4")
    book = first_book(rows, dims, s)
    book = trained(blocks, book, s) if book.size else book
    digest = hashlib.sha256(",".join(map(str, book.reshape(-1).tolist())).encode()).hexdigest()
    coded = scratch.write(_coded(blocks, rows, book), "coded")
    key = F.struct(F.col("label"))  # a struct is never null, so nulls meet
    sums = scratch.write(coded.groupBy(key.alias("_label")).agg(F.sum("error").alias("label_error"), F.count("*").alias("_n")), "sums")
    joined = keyed(coded.withColumn("_label", key), sums, ["_label"], "_n")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
