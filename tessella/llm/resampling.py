"""Importance resampling towards a target corpus, on hashed word n-grams whose CRCs are composed.

Every word's CRC is computed once.  CRCs are linear over GF(2): that of two
strings in a row is the first one's, moved by as many zero bytes as the second
has (a 32 x 32 bit matrix per length), combined by XOR with the second one's.
So the CRC of "a b c" comes from those of "a", " b" and " c", and no n-gram is
ever written out.

Two passes over the documents: the first counts the features of each bucket
(partial counts per task, then a sum per bucket), the second adds up the gains
of a document's buckets, which are a table of ``buckets`` numbers.  The draw
sorts narrow rows by range of the score; their places come from the sizes of
the ranges, so no task sees all of them.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, partitions_for

#: The columns that resampling makes; columns of the documents with these names are left out.
MADE = ("n_features", "weight", "score", "rank")
#: Bytes of text that are cut into words at a time; a longer word is not cut.
BLOCK = 1 << 20
#: Longer moves than this are made of powers of two.
NEAR = 64
#: Rows of the draw's sort to a partition.
RANGE_ROWS = 1_000_000


@dataclass(frozen=True)
class Settings:
    buckets: int = 10_000
    longest: int = 3
    #: How many of a hundred documents with enough words are drawn.
    percent: int = 5
    min_words: int = 20
    seed: str = "42"


@cache
def byte_table() -> np.ndarray:
    """The CRC register after one byte, per low byte (reflected polynomial EDB88320)."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = (t >> np.uint32(1)) ^ np.where(t & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return t


def _lookup(columns: np.ndarray) -> np.ndarray:
    """4 x 256 images of the bytes of a register, for a matrix given by the images of its 32 bits."""
    out = np.zeros((4, 256), np.uint32)
    byte = np.arange(256)
    for bit in range(32):
        out[bit // 8] ^= np.where((byte >> (bit % 8)) & 1, columns[bit], np.uint32(0))
    return out


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    mask = np.uint32(255)
    return table[0][crc & mask] ^ table[1][(crc >> np.uint32(8)) & mask] ^ table[2][(crc >> np.uint32(16)) & mask] ^ table[3][crc >> np.uint32(24)]


@cache
def _moves() -> tuple[np.ndarray, np.ndarray]:
    """Tables of the moves by 0 to NEAR - 1 bytes (flat, 1024 a length), and by 2**k bytes."""
    unit = np.uint32(1) << np.arange(32, dtype=np.uint32)
    one = byte_table()[unit & np.uint32(255)] ^ (unit >> np.uint32(8))
    near, columns = [], unit
    for _ in range(NEAR):
        near.append(_lookup(columns))
        columns = _apply(_lookup(one), columns)
    powers, columns = [], one
    for _ in range(40):
        powers.append(_lookup(columns))
        columns = _apply(powers[-1], columns)  # a matrix times itself
    return np.concatenate([t.reshape(-1) for t in near]), np.stack(powers)


def moved(crc: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Registers crc (uint32) moved by so many zero bytes each: multiplied by the matrix of that length."""
    near, powers = _moves()
    mask = np.uint32(255)
    at = np.minimum(by, NEAR - 1) << 10
    out = near[at + (crc & mask)]
    for k in (1, 2, 3):
        out ^= near[at + (k << 8) + ((crc >> np.uint32(8 * k)) & mask)]
    far = np.flatnonzero(by >= NEAR)
    if len(far):
        c, n = crc[far], by[far]
        for k in range(int(n.max()).bit_length()):
            on = np.flatnonzero((n >> k) & 1)
            c[on] = _apply(powers[k], c[on])
        out[far] = c
    return out


def combined(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs of two strings in a row, given those of both and the second one's length in bytes."""
    return moved(first, length) ^ second


@cache
def _byte_kinds() -> tuple[np.ndarray, np.ndarray]:
    """(lower-cased byte, whether it belongs to a word): digits, ASCII letters and every byte of other characters do."""
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    word = np.zeros(256, bool)
    word[48:58] = word[97:123] = word[128:] = True
    return low, word[low]


def word_crcs(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(crc, length, document) of every word; data: bytes of texts in a row, first: where each begins, and the end."""
    low, is_word = _byte_kinds()
    inside = is_word[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    heads = first[:-1][first[:-1] < first[1:]]
    start[heads] = inside[heads]
    stop = inside.copy()
    stop[:-1] &= start[1:] | ~inside[1:]
    at, end = np.flatnonzero(start), np.flatnonzero(stop) + 1
    length = end - at
    doc = np.searchsorted(first, at, side="right") - 1
    data, table = low[data], byte_table()
    order = np.argsort(-length, kind="stable")
    where, sizes = at[order], length[order]
    crc = np.full(len(at), 0xFFFFFFFF, np.uint32)
    for k in range(min(int(sizes[0]), NEAR) if len(sizes) else 0):
        n = np.searchsorted(-sizes, -k, side="left")  # so many are longer than k
        c = crc[:n]
        crc[:n] = table[(c ^ data[where[:n] + k]) & np.uint32(255)] ^ (c >> np.uint32(8))
    crc ^= np.uint32(0xFFFFFFFF)
    for i in range(np.searchsorted(-sizes, -NEAR, side="left")):  # the few longer than NEAR
        crc[i] = zlib.crc32(data[where[i] + NEAR : where[i] + sizes[i]], int(crc[i]))
    out = np.empty_like(crc)
    out[order] = crc
    return out, length, doc


def features(texts: pa.Array, s: Settings) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """([buckets of n-grams], [their documents]) per n from 1, and the number of words of each document."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    first = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[first[0] : first[-1]] if raw is not None else np.zeros(0, np.uint8)
    first = first - first[0]
    _, is_word = _byte_kinds()
    parts, at = [], 0
    while at < len(data):
        end = min(at + BLOCK, len(data))
        while end < len(data) and is_word[data[end]] and is_word[data[end - 1]]:  # no cut inside a word
            gap = np.flatnonzero(~is_word[data[end : end + BLOCK]])
            end = end + int(gap[0]) if len(gap) else min(end + BLOCK, len(data))
        inner = first[(first > at) & (first < end)]
        base = int(np.searchsorted(first, at, side="right")) - 1
        crc, length, doc = word_crcs(data[at:end], np.concatenate([[0], inner - at, [end - at]]))
        # documents without text share their place with the next; the last of them holds the words
        parts.append((crc, length, np.searchsorted(first, np.concatenate([[at], inner]), side="right")[doc] - 1 if len(doc) else doc + base))
        at = end
    crc, length, doc = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64))
    blank = np.full(len(crc), zlib.crc32(b" "), np.uint32)
    spaced = combined(blank, crc, length)  # " word"
    grams, docs, last = [crc % np.uint32(s.buckets)], [doc], crc
    for n in range(2, s.longest + 1):
        last = combined(last[:-1], spaced[n - 1 :], length[n - 1 :] + 1) if len(crc) >= n else last[:0]
        whole = doc[: len(last)] == doc[n - 1 :]
        grams.append(last[whole] % np.uint32(s.buckets))
        docs.append(doc[: len(last)][whole])
    return grams, docs, np.bincount(doc, minlength=len(texts))


def _slices(batches: Iterator[pa.RecordBatch], column: int, most: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Slices of about so many bytes of text (a longer text is one of its own)."""
    for b in batches:
        if not b.num_rows:
            continue
        sizes = np.nan_to_num(np.array(pc.binary_length(b.column(column)).to_numpy(zero_copy_only=False), float)).astype(np.int64)
        group = np.cumsum(sizes) // most
        cuts = np.append(np.flatnonzero(np.diff(group, prepend=-1)), b.num_rows)
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield b.slice(a, z - a)


def bucket_counts(texts: DataFrame, s: Settings = Settings()) -> np.ndarray:
    """How many features of all texts (a single string column; nulls have none) fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(s.buckets, np.int64)
        for b in _slices(batches, 0):
            for g in features(b.column(0), s)[0]:
                n += np.bincount(g, minlength=s.buckets)
        there = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(n[there])], names=["bucket", "n"])

    rows = texts.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect()  # at most one row a bucket
    out = np.zeros(s.buckets, np.int64)
    for bucket, n in rows:
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed bucket shares, target over corpus, rounded down."""
    n, most, least = len(corpus), int(target.sum()), int(corpus.sum())
    return np.array([math.floor(1000 * math.log((int(t) + 1) * (least + n) / ((int(c) + 1) * (most + n)))) for c, t in zip(corpus, target, strict=True)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, keep: list[str], text: str, s: Settings = Settings()) -> DataFrame:
    """kept (a struct of keep), n_words, n_features, weight of every document."""
    rows = docs.select(F.struct(F.lit(None).cast("int").alias("_"), *keep).alias("kept"), F.col(text).alias("text"))
    schema = T.StructType([rows.schema["kept"], *T.StructType.fromDDL("n_words long, n_features long, weight long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, 1):
            grams, of, words = features(b.column(1), s)
            found, weight = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for g, d in zip(grams, of, strict=True):  # documents ascend
                sums, ends = np.append(0, np.cumsum(gain[g])), np.searchsorted(d, np.arange(b.num_rows + 1))
                found += np.diff(ends)
                weight += np.diff(sums[ends])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words.astype(np.int64)), pa.array(found), pa.array(weight)], names=schema.names)

    return rows.mapInArrow(run, schema)


def places(scratch: Scratch, rows: DataFrame, order: list, n: int) -> DataFrame:
    """n rows with their place (1, 2, ...) in a total order: sorted by ranges, numbered within, moved by the sizes of the ranges before."""
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(partitions_for(spark, n, RANGE_ROWS), *order).sortWithinPartitions(*order)
    stored = scratch.write(dealt.withColumn("_at", F.monotonically_increasing_id()), "sorted")  # 33 bits hold the number within a partition
    sizes = sorted(stored.groupBy(F.shiftright("_at", 33)).count().collect())  # one row a partition
    bases = np.append(0, np.cumsum([x[1] for x in sizes]))[:-1].tolist()
    table = spark.createDataFrame([(x[0], base) for x, base in zip(sizes, bases, strict=True)], "_range long, _base long")
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    placed = stored.join(F.broadcast(table), F.shiftright("_at", 33) == F.col("_range"))
    return placed.withColumn("rank", F.col("_base") + inside + 1).drop("_at", "_range", "_base")


def resample(spark: SparkSession, docs: DataFrame, target: DataFrame, keep: list[str], text: str = "text", target_text: str = "text", s: Settings = Settings()) -> DataFrame:
    """keep + n_features, weight, score, rank of every document; those drawn have a rank, from 1 for the highest score.

    docs needs doc_id (any type; it seeds the noise of the draw) and text.
    Features of all documents and of all target texts are counted, whatever
    their length.  Null and empty texts and those without words have no
    features and weight 0; documents of fewer than min_words words are scored,
    but not drawn.  Ties of the score go to the smaller doc_id (null last),
    then to fewer features; repeated rows are documents of their own with the
    same score.  An empty table gives no rows; with an empty target all buckets
    of one count gain alike.  Columns of docs outside keep are not read, and
    columns of keep that are named like a new one are left out.
    """
    keep = [c for c in keep if c not in MADE]
    scratch = Scratch(spark, "resample")
    gain = gains(bucket_counts(docs.select(F.col(text)), s), bucket_counts(target.select(F.col(target_text)), s))
    fields = docs.select("doc_id", *[c for c in keep if c != "doc_id"], F.col(text).alias("_text"))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(s.seed + ":"), F.coalesce(F.col("kept.doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    weighed = weigh(fields, gain, [c for c in fields.columns if c != "_text"], "_text", s)
    scored = scratch.write(weighed.withColumn("score", (F.col("weight") + noise).cast("long")), "scored")
    enough = scored.where(F.col("n_words") >= s.min_words)
    n = enough.count()
    sorted_rows = places(scratch, enough, [F.desc("score"), F.col("kept.doc_id").asc_nulls_last(), F.col("n_features")], n)
    ranked = sorted_rows.withColumn("rank", F.when(F.col("rank") <= s.percent * n // 100, F.col("rank")))
    every = ranked.unionByName(scored.where(F.col("n_words") < s.min_words).withColumn("rank", F.lit(None).cast("long")))
    return every.select(*[F.col("kept")[c].alias(c) for c in keep], "n_features", "weight", "score", "rank")
