"""Packing of related documents: a sharded BM25 inverted index fills the window of each seed with its neighbours.

The index is over token ids, so its statistics (how many documents have a term,
the average length) are a table no larger than the vocabulary, counted over all
documents.  Documents are sorted by their heaviest terms, so that documents
alike stand together, and the sorted rows are cut into shards of bounded size;
each shard has an inverted index of its own, with the corpus-wide weights.

In a shard, a seed's window is filled with the unused documents that the index
returns for the whole seed, best first.  Documents may be cut, so windows are
full: the neighbour that a window cuts is the next seed.  What a shard leaves
goes on to the next one of the same range; what the last one leaves is cut into
sequences of powers of two, which take no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, partitions_for, small_batches, tidy

#: The columns that packing makes; columns of the documents with these names are left out.
MADE = ("start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset")
#: Token ids that leave or pass a step at a time, about.
BATCH_IDS = 1 << 20


@dataclass(frozen=True)
class Settings:
    window: int = 4096
    end_id: int = 2
    #: A shard has so many tokens, about, and at most so many documents.
    shard_tokens: int = 1 << 20
    shard_docs: int = 1 << 15
    #: Tokens of a range of the sort, about; shards are cut inside.
    range_tokens: int = 1 << 24
    #: Heaviest terms that a document is sorted by.
    keys: int = 3
    k1: float = 1.2
    b: float = 0.75


def tokenised(docs: DataFrame, tokenizer: str, keep: list[str], text: str = "text", s: Settings = Settings()) -> DataFrame:
    """kept (a struct of keep), n, ids (binary, little-endian uint32, with the end id) of every document."""
    rows = docs.select(F.struct(F.lit(None).cast("int").alias("_"), *keep).alias("kept"), F.col(text).alias("text"))
    schema = T.StructType([rows.schema["kept"], *T.StructType.fromDDL("n long, ids binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import word_tokenizer

        words = word_tokenizer(tokenizer)
        for big in batches:
            for at in range(0, big.num_rows, 256):
                b = big.slice(at, 256)
                first, ids, size = 0, [], 0
                for k, found in enumerate(words.ids([x or "" for x in b.column(1).to_pylist()])):
                    ids.append(np.append(found, np.uint32(s.end_id)).astype("<u4").tobytes())
                    size += len(found) + 1
                    if size >= BATCH_IDS or k + 1 == b.num_rows:
                        n = pa.array([len(x) // 4 for x in ids], pa.int64())
                        yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(ids)), n, pa.array(ids, pa.binary())], names=schema.names)
                        first, ids, size = k + 1, [], 0

    return rows.mapInArrow(tidy(run), schema)


def _ids(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), "<u4") for x in column]


def frequencies(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, times) of every term of every document, by document and term."""
    if not ids:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    flat = np.concatenate(ids)
    bits = max(1, int(flat.max()).bit_length())
    kind = np.uint32 if bits + len(ids).bit_length() <= 32 else np.uint64  # narrow keys sort faster
    keys = np.repeat(np.arange(len(ids), dtype=kind) << kind(bits), [len(x) for x in ids])
    keys |= flat.astype(kind)
    keys.sort()
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    found = keys[at]
    return (found >> kind(bits)).astype(np.int64), (found & kind((1 << bits) - 1)).astype(np.int64), np.diff(np.append(at, len(keys)))


def _some(batches: Iterator[pa.RecordBatch], ids: int, n: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of about BATCH_IDS token ids, with them."""
    for b in batches:
        if b.num_rows:
            group = np.cumsum(b.column(n).to_numpy()) // BATCH_IDS
            cuts = np.append(np.flatnonzero(np.diff(group, prepend=-1)), b.num_rows)
            for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                yield b.slice(a, z - a), _ids(b.column(ids).slice(a, z - a))


@dataclass(frozen=True)
class Weights:
    """BM25: idf per token id, and the average length of documents."""

    idf: np.ndarray
    average: float
    k1: float
    b: float

    @staticmethod
    def counted(stored: DataFrame, s: Settings = Settings()) -> Weights:
        """From all documents; what reaches the driver is at most a row per token id."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = np.zeros(0, np.int64)
            for _, ids in _some(batches, 0, 1):
                found = np.bincount(frequencies(ids)[1])
                held = np.pad(held, (0, max(0, len(found) - len(held))))
                held[: len(found)] += found
            there = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(held[there])], names=["term", "n"])

        rows = stored.select("ids", "n").mapInArrow(tidy(run), "term int, n long").groupBy("term").agg(F.sum("n")).collect()
        docs, average = stored.agg(F.count("*"), F.avg("n")).first()
        df = np.zeros(max([r[0] for r in rows], default=-1) + 1)
        for term, n in rows:
            df[term] = n
        return Weights(np.log(1 + (docs - df + 0.5) / (df + 0.5)), average or 1.0, s.k1, s.b)

    def of(self, term: np.ndarray, times: np.ndarray, length: np.ndarray) -> np.ndarray:
        return self.idf[term] * times * (self.k1 + 1) / (times + self.k1 * (1 - self.b + self.b * length / self.average))


#: Documents that tell where ranges begin, at most, and per range.
SAMPLE, PER_RANGE = 1 << 20, 64


def with_keys(stored: DataFrame, weights: Weights, s: Settings = Settings(), bounds: list[tuple[int, ...]] | None = None) -> DataFrame:
    """stored with key_0, key_1, ...: the heaviest terms of each document, heaviest first (-1: it has no more).

    With bounds (keys and rid of the first document of every range but the
    first, ascending) also the range that each document falls into.
    """
    names = [*[f"key_{k}" for k in range(s.keys)], *(["range"] if bounds is not None else [])]
    schema = T.StructType([*stored.schema.fields, *[T.StructField(c, T.IntegerType()) for c in names]])
    at_ids, at_n, at_rid = (stored.columns.index(c) for c in ("ids", "n", "rid"))
    edges = [np.array([b[k] for b in bounds or []], np.int64) for k in range(s.keys + 1)]

    def ranges(keys: np.ndarray) -> np.ndarray:
        """How many bounds are at or below each row of keys (columns: documents), compared column after column."""
        low, high = np.zeros(keys.shape[1], np.int64), np.full(keys.shape[1], len(bounds or []))
        while (open_ := np.flatnonzero(low < high)).size:  # all documents halve their own stretch of bounds at once
            middle = (low[open_] + high[open_]) // 2
            above, same = np.zeros(len(open_), bool), np.ones(len(open_), bool)
            for edge, key in zip(edges, keys, strict=True):
                e, k = edge[middle], key[open_]
                above |= same & (e > k)
                same &= e == k
            high[open_] = np.where(above, middle, high[open_])
            low[open_] = np.where(above, low[open_], middle + 1)
        return low

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, ids in _some(batches, at_ids, at_n):
            doc, term, times = frequencies(ids)
            weight = weights.of(term, times, np.array([len(x) for x in ids])[doc])
            order = np.lexsort((term, -weight, doc))
            turn = np.arange(len(doc)) - np.searchsorted(doc, doc)
            keys = np.full((s.keys, len(ids)), -1, np.int32)
            few = turn < s.keys
            keys[turn[few], doc[few]] = term[order][few]
            cells = [*keys, *([ranges(np.vstack([keys, b.column(at_rid).to_numpy()])).astype(np.int32)] if bounds is not None else [])]
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(k) for k in cells]], names=schema.names)

    return stored.mapInArrow(tidy(run), schema)


def range_bounds(stored: DataFrame, weights: Weights, n: int, docs: int, s: Settings = Settings()) -> list[tuple[int, ...]]:
    """Where n ranges of about as many documents begin, by a sample by hash of about PER_RANGE documents a range, SAMPLE at most.

    The sample decides where ranges begin and nothing else: every document is
    in the range of its own keys.
    """
    share = max(1, docs // min(SAMPLE, PER_RANGE * n))
    some = with_keys(stored.where(F.pmod(F.xxhash64("rid"), F.lit(share)) == 0), weights, s)
    told = sorted(tuple(r) for r in some.select(*[f"key_{k}" for k in range(s.keys)], "rid").collect())
    return sorted({told[k * len(told) // n] for k in range(1, n)}) if told else []


class InvertedIndex:
    """BM25 postings of a shard's documents: per term the documents that have it and what it adds to their scores."""

    def __init__(self, ids: list[np.ndarray], weights: Weights):
        doc, term, times = frequencies(ids)
        weight = weights.of(term, times, np.array([len(x) for x in ids])[doc])
        order = np.argsort(term, kind="stable")
        known, first = np.unique(term[order], return_index=True)
        self.docs, self.weights, self.first = doc[order], weight[order], np.append(first, len(term))
        self.row, self.own, self.size = np.searchsorted(known, term), np.searchsorted(doc, np.arange(len(ids) + 1)), len(ids)

    def neighbours(self, seed: int, unused: np.ndarray) -> Iterator[int]:
        """Unused documents that share a term with the whole seed, by falling score; ties to the earlier one."""
        rows = self.row[self.own[seed] : self.own[seed + 1]]
        n = self.first[rows + 1] - self.first[rows]
        at = np.repeat(self.first[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        scores = np.bincount(self.docs[at], weights=self.weights[at], minlength=self.size)
        left = np.flatnonzero(unused & (scores > 0))
        scores, most = scores[left], 64
        while len(left):  # usually the first few fill the window
            if most < len(left):
                bar = np.partition(scores, len(left) - most)[len(left) - most]
                top = scores >= bar
            else:
                top = np.ones(len(left), bool)
            yield from left[top][np.argsort(-scores[top], kind="stable")].tolist()
            left, scores, most = left[~top], scores[~top], 4 * most


def fill(ids: list[np.ndarray], start: np.ndarray, weights: Weights, last: bool, s: Settings = Settings()) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence from 0, offset) of a shard; start is moved to what stays uncut.

    Seeds are taken in order.  Unless it is the last shard, less than a window's
    tokens stay; of the last one all are placed, in sequences of powers of two
    at the end.
    """
    size = np.array([len(x) for x in ids], np.int64)
    index, unused, rest = InvertedIndex(ids, weights), start < size, int((size - start).sum())
    out, sequence, head, seed = [], 0, 0, -1
    while rest and (last or rest >= s.window):
        room = offset = 0
        room = s.window if rest >= s.window else 1 << (rest.bit_length() - 1)
        rest -= room
        queue: Iterator[int] = iter(())
        while room:
            doc = seed if seed >= 0 else next((d for d in queue if unused[d]), -1)
            if doc < 0:  # no neighbour is left (or the window is new): the next document in order is a seed
                while not unused[head]:
                    head += 1
                doc = seed = head
            n = min(int(size[doc] - start[doc]), room)
            out.append((doc, int(start[doc]), n, sequence, offset))
            start[doc] += n
            room, offset = room - n, offset + n
            unused[doc] = start[doc] < size[doc]
            if room and doc == seed:
                queue, seed = index.neighbours(doc, unused), -1
            elif not room:
                seed = doc if unused[doc] else -1
        sequence += 1
    return out


def place(rows: DataFrame, weights: Weights, payload: bool, s: Settings = Settings()) -> DataFrame:
    """Pieces of rows (kept, n, ids, sorted within its partitions), each partition cut into shards."""
    fields = [rows.schema["kept"], *T.StructType.fromDDL("start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary").fields]
    schema = T.StructType(fields if payload else fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sequence = TaskContext.get().partitionId() << 32
        kept, ids, start, tokens = [], [], [], 0

        def shard(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal sequence, kept, ids, start, tokens
            heads, begin = pa.concat_arrays(kept), np.array(start, np.int64)
            placed = fill(ids, begin, weights, last, s)
            for a in range(0, len(placed), 4096):
                part = placed[a : a + 4096]
                pieces = [ids[d][b : b + n].tobytes() for d, b, n, _, _ in part]
                doc, first, length, turn, offset = (np.array(x, np.int64) for x in zip(*part, strict=True))
                cells = [heads.take(pa.array(doc)), *map(pa.array, (first, length, np.array([zlib.crc32(x) for x in pieces], np.int64), np.array([len(ids[d]) for d in doc.tolist()], np.int64), sequence + turn, offset))]
                yield pa.RecordBatch.from_arrays([*cells, *([pa.array(pieces, pa.binary())] if payload else [])], names=schema.names)
            sequence += placed[-1][3] + 1 if placed else 0
            left = [d for d in range(len(ids)) if begin[d] < len(ids[d])]
            kept, ids, start = [heads.take(pa.array(left, pa.int64()))] if left else [], [ids[d] for d in left], [int(begin[d]) for d in left]
            tokens = sum(len(x) - b for x, b in zip(ids, start, strict=True))

        for b in batches:
            own = _ids(b.column(2))
            for k, x in enumerate(own):
                kept.append(b.column(0).slice(k, 1))
                ids.append(x)
                start.append(0)
                tokens += len(x)
                if tokens >= s.shard_tokens or len(ids) >= s.shard_docs and tokens >= s.window:
                    yield from shard(False)
        if ids:
            yield from shard(True)

    return rows.select("kept", "n", "ids").mapInArrow(tidy(run), schema)


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, keep: list[str], payload: bool = True, text: str = "text", s: Settings = Settings(), ranges: int | None = None) -> DataFrame:
    """keep + start, length, ids_crc32, doc_tokens, sequence_id, offset, and with payload the ids of each piece.

    A null text is empty: a document of the end id alone.  Texts of any length
    are taken whole (a long one fills windows of its own first), repeated rows
    are documents of their own, equal documents stand together; ties of score
    go to the document that is earlier in the shard, and the order of a shard
    is that of the keys, then of the rows.  An empty table gives no rows.
    Columns of docs outside keep are not read, and columns of keep that are
    named like a new one are left out.
    """
    keep = [c for c in keep if c not in MADE]
    scratch = Scratch(spark, "related")
    numbered = tokenised(docs, tokenizer, keep, text, s).withColumn("rid", F.monotonically_increasing_id())
    with small_batches(spark):
        stored = scratch.write(numbered, "ids")
    weights = Weights.counted(stored, s)
    tokens, many = stored.agg(F.sum("n"), F.count("*")).first()
    n = ranges or partitions_for(spark, tokens or 0, s.range_tokens)
    order = [*[f"key_{k}" for k in range(s.keys)], "rid"]
    keyed = with_keys(stored, weights, s, range_bounds(stored, weights, n, many, s))
    dealt = keyed.repartitionById(n, F.col("range")).sortWithinPartitions(*order)
    placed = place(dealt, weights, payload, s)
    return placed.select(*[F.col("kept")[c].alias(c) for c in keep], "start", "length", *(["ids"] if payload else []), "ids_crc32", "doc_tokens", "sequence_id", "offset")
