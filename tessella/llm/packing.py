"""Best-fit decreasing packing of token sequences, exact over the whole corpus.

Bins that have the same room left are alike, and so are pieces of one length.
So the packing needs the number of pieces per length only: at most ``capacity``
numbers, whatever the corpus has.  The driver runs best-fit decreasing on those
groups; a segment tree over remaining capacities finds the tightest open room.
The plan says, per length, which ranks go to which bins.

Pieces are ranked without moving them: the task that cuts them numbers those of
each length as it goes, and the small table of how many each task has of a
length gives every task the rank of its first.  So a piece's place comes from a
join with a table of (task, length) runs; token ids are never sorted, and cross
a shuffle only where that table is too large to broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, small_batches, small_side, tidy

CAPACITY = 2048
#: Bytes of token ids that leave a Python worker at a time, about.
BATCH_BYTES = 4 << 20
#: The columns that packing makes; columns of the documents with these names are left out.
MADE = ("piece", "start", "length", "ids", "ids_crc32", "sequence_id", "offset")


class RoomTree:
    """A segment tree over remaining capacities: which of them some open bin has."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.size)

    def put(self, room: int, there: bool) -> None:
        at = room + self.size
        self.any[at] = there
        while at > 1:
            at >>= 1
            self.any[at] = self.any[2 * at] or self.any[2 * at + 1]

    def tightest(self, need: int) -> int:
        """The smallest remaining capacity of at least need that a bin has, or -1."""
        at = need + self.size
        if self.any[at]:
            return need
        while at > 1:
            if at % 2 == 0 and self.any[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return -1


def best_fit_plan(counts: dict[int, int], capacity: int) -> dict[str, np.ndarray]:
    """Best-fit decreasing over counts[length] pieces of each length.

    Rows (length, rank): pieces of that length from that rank on go to bins
    from ``bin`` on, ``each`` to a bin, the first of a bin at ``offset``.  Once
    a piece is in the tightest bin, that bin is the tightest for the next piece
    of the length as long as it has room, so whole bins fill at a time.
    """
    tree, open_bins, bins, rows = RoomTree(capacity), {}, 0, []

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            if not open_bins.get(room):
                open_bins[room] = []
                tree.put(room, True)
            open_bins[room].append((first, n))

    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        rank, total = 0, counts[length]
        while rank < total:
            room = tree.tightest(length)
            if room < 0:
                room, new = capacity, -(-(total - rank) // (capacity // length))
                put(room, bins, new)
                bins += new
            each = room // length
            first, n = open_bins[room].pop()
            if not open_bins[room]:
                tree.put(room, False)
            full = min(n, (total - rank) // each)
            if full:
                rows.append((length, rank, first, each, capacity - room))
                put(room - each * length, first, full)
                rank += full * each
            last = min(total - rank, each) if full < n else 0
            if last:
                rows.append((length, rank, first + full, last, capacity - room))
                put(room - last * length, first + full, 1)
                rank += last
            put(room, first + full + bool(last), n - full - bool(last))
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 5).T
    return {"key": (columns[0] << 40) | columns[1], "rank": columns[1], "bin": columns[2], "each": columns[3], "offset": columns[4]}


def pieces(docs: DataFrame, tokenizer: str, keep: list[str], capacity: int = CAPACITY, text: str = "text") -> DataFrame:
    """kept (a struct of keep), piece, start, length, ids, task, turn: each document's ids and a final 0, cut into pieces of at most capacity.

    ids is binary, little-endian uint32; turn numbers the pieces of one length
    that one task makes.  A null text counts as empty, so every document has at
    least the piece of its final 0.  Executors open the tokenizer's file at the
    given path, which is installed with the library.
    """
    rows = docs.select(F.struct(F.lit(None).cast("int").alias("_"), *keep).alias("kept"), F.col(text).alias("text"))
    schema = T.StructType.fromDDL("piece int, start long, length long, ids binary, task long, turn long")
    schema = T.StructType([rows.schema["kept"], *schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from .tokens import word_tokenizer

        words, task, seen = word_tokenizer(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)

        def out(b: pa.RecordBatch, row: list, piece: list, start: list, ids: list) -> pa.RecordBatch:
            length = np.array([len(x) // 4 for x in ids], np.int64)
            order = np.argsort(length, kind="stable")
            turn, first = np.empty_like(length), np.searchsorted(length[order], length[order])
            turn[order] = np.arange(len(order)) - first + seen[length[order]]
            np.add.at(seen, length, 1)
            cells = [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length), pa.array(ids, pa.binary()), pa.array(np.full(len(row), task)), pa.array(turn)]
            return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), *cells], names=schema.names)

        for big in batches:
            for at in range(0, big.num_rows, 256):
                b = big.slice(at, 256)
                row, piece, start, ids, size = [], [], [], [], 0
                for k, found in enumerate(words.ids([x or "" for x in b.column(1).to_pylist()])):
                    found = np.append(found, np.uint32(0)).astype("<u4")
                    for n, s in enumerate(range(0, len(found), capacity)):
                        row.append(k), piece.append(n), start.append(s), ids.append(found[s : s + capacity].tobytes())
                    size += found.nbytes
                    if size > BATCH_BYTES:
                        yield out(b, row, piece, start, ids)
                        row, piece, start, ids, size = [], [], [], [], 0
                if row:
                    yield out(b, row, piece, start, ids)

    return rows.mapInArrow(tidy(run), schema)


def place(scratch: Scratch, parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """parts with sequence_id and offset: best-fit decreasing by length; bins are gapless from 0.

    parts is a stored table (it is read twice) with length (1 to capacity), task
    and turn (0, 1, ... within a task and length).  Pieces of one length are
    interchangeable: those of earlier tasks come first.
    """
    spark = parts.sparkSession
    runs = scratch.write(parts.groupBy("task", "length").agg(F.count("*").alias("n")), "runs")
    counts = {r[0]: r[1] for r in runs.groupBy("length").agg(F.sum("n")).collect()}  # at most capacity rows
    plan = best_fit_plan(counts, capacity)
    length = plan["key"] >> 40
    upto = np.where(np.append(length[1:] == length[:-1], False), np.append(plan["rank"][1:], 0), [counts[n] for n in length.tolist()]) if len(length) else length
    cells = [length, plan["rank"], upto, plan["bin"], plan["each"], plan["offset"]]
    rows = list(zip(*[c.tolist() for c in cells], strict=True))  # their number depends on capacity alone
    spots = spark.createDataFrame(rows, "_length long, rank long, upto long, bin long, each long, place long")
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    based = runs.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    met = (F.col("length") == F.col("_length")) & (F.col("rank") < F.col("base") + F.col("n")) & (F.col("upto") > F.col("base"))
    runs = based.join(F.broadcast(spots), met).select(
        F.col("task").alias("_task"), "_length", (F.greatest("rank", "base") - F.col("base")).alias("low"),
        (F.least("upto", F.col("base") + F.col("n")) - F.col("base")).alias("high"), (F.col("base") - F.col("rank")).alias("shift"), "bin", "each", "place",
    )
    here = (F.col("task") == F.col("_task")) & (F.col("length") == F.col("_length")) & (F.col("turn") >= F.col("low")) & (F.col("turn") < F.col("high"))
    inside = F.col("turn") + F.col("shift")
    return parts.join(small_side(scratch.write(runs, "spots")), here).select(
        *parts.columns, (F.col("bin") + F.floor(inside / F.col("each"))).alias("sequence_id"), (F.col("place") + inside % F.col("each") * F.col("length")).alias("offset")
    )


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, keep: list[str], capacity: int = CAPACITY, payload: bool = True) -> DataFrame:
    """keep + piece, start, length, ids_crc32, sequence_id, offset, and with payload the ids of each piece.

    Null texts are empty, so they are the piece of their final 0; texts of any
    length are cut; repeated rows are documents of their own; an empty table
    gives no rows; columns of docs outside keep are not read, and columns of
    keep that are named like a new one are left out.
    """
    keep = [c for c in keep if c not in MADE]
    scratch = Scratch(spark, "pack")
    cut = pieces(docs, tokenizer, keep, capacity).withColumn("ids_crc32", F.crc32("ids"))
    with small_batches(spark):
        stored = scratch.write(cut if payload else cut.drop("ids"), "pieces")
    placed = place(scratch, stored, capacity)
    return placed.select(*[F.col("kept")[c].alias(c) for c in keep], "piece", "start", "length", *(["ids"] if payload else []), "ids_crc32", "sequence_id", "offset")
