"""Removal of long repeated passages by a sparse suffix array.

A byte goes if a window of ``length`` bytes over it occurs at another place too.
Every window has a pivot: the smallest k-gram hash in it.  Equal windows have
equal pivots at equal offsets, so the windows of one pivot (a span) are only
compared with spans of the same leading k-gram:

* spans whose k-gram occurs once hold no repeat;
* spans that occur again as a whole are repeats throughout;
* of the rest, one span of each kind goes to a bucket.  Sampled splitters cut
  the range of leading bytes into buckets (``repartitionByRange``), so suffixes
  with the same leading bytes meet.  A bucket sorts the suffixes at all its
  window starts by multikey quicksort, eight bytes to a key, and compares
  neighbours.
* a k-gram with very many different spans would be one hot bucket.  Its spans
  are cut into blocks of a few windows.  Equal blocks are repeats; a block whose
  common middle stands alone holds none.  Only windows of the other blocks go,
  by their whole content, to range buckets that may split between equal windows;
  each is sorted alike, and the first and last windows of the buckets are
  compared across boundaries.

Only pivots and spans move; texts are read, not shuffled, except for one
compressed copy that is dealt by row once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, keyed, partitions_for, release, small_batches, tidy, width_for
from .tokens import mixed, powers


@dataclass(frozen=True)
class Settings:
    length: int = 200
    #: Bytes of a pivot's k-gram.
    gram: int = 32
    #: Different spans of one k-gram that one bucket may take.
    crowd: int = 1000
    #: Windows of a crowded k-gram that are looked at together first.
    block: int = 8
    #: Bytes of text that are looked at together.
    batch: int = 1 << 20


def _doc_ends(lengths: np.ndarray) -> np.ndarray:
    return np.cumsum(lengths)


def pivots(texts: list[bytes], s: Settings) -> tuple[np.ndarray, ...]:
    """Spans: (text, first window start, number of windows, pivot's offset from the first start, k-gram hash, span hash)."""
    import xxhash

    out = []
    held = [k for k, t in enumerate(texts) if len(t) >= s.length]
    at = 0
    while at < len(held):
        end, size = at, 0
        while end < len(held) and (end == at or size + len(texts[held[end]]) <= s.batch):
            size += len(texts[held[end]])
            end += 1
        which, at = held[at:end], end
        lengths = np.array([len(texts[k]) for k in which], np.int64)
        joined = b"".join(texts[k] for k in which)
        # a huge text is cut into overlapping pieces, so that memory stays bounded
        step = max(4 * s.batch, s.length)
        for cut in range(0, max(1, len(joined) - s.length + 1), step) if len(which) == 1 else [0]:
            part = joined[cut : cut + step + s.length - 1] if len(which) == 1 else joined
            found = _pivots(part, lengths if len(which) > 1 else np.array([len(part)]), s)
            doc, start, count, offset, gram = found
            first = (_doc_ends(lengths) - lengths)[doc] if len(which) > 1 else np.zeros(len(doc), np.int64)
            view = memoryview(part)
            spans = np.array([xxhash.xxh3_64_intdigest(view[a : a + n + s.length - 1]) for a, n in zip(start.tolist(), count.tolist(), strict=True)], np.uint64)
            out.append((np.array(which, np.int64)[doc], start - first + cut, count, offset, gram, spans))
    if not out:
        return tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _pivots(joined: bytes, lengths: np.ndarray, s: Settings) -> tuple[np.ndarray, ...]:
    data = np.frombuffer(joined, np.uint8)
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * down[:-1], out=sums[1:])
    h = mixed((sums[s.gram :] - sums[: -s.gram]) * up[: len(data) - s.gram + 1])
    low = np.uint64((1 << 24) - 1)  # positions in a batch fit in 24 bits
    least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    wide, width = s.length - s.gram + 1, 1
    while 2 * width <= wide:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if wide > width:
        least = np.minimum(least[: -(wide - width)], least[wide - width :])
    windows = lengths - s.length + 1
    ends = _doc_ends(lengths)
    doc = np.repeat(np.arange(len(lengths)), np.maximum(windows, 0))
    start = np.arange(len(doc)) - np.repeat(_doc_ends(np.maximum(windows, 0)) - np.maximum(windows, 0), np.maximum(windows, 0)) + (ends - lengths)[doc]
    chosen = least[start]
    change = np.flatnonzero((chosen[1:] != chosen[:-1]) | (doc[1:] != doc[:-1])) + 1
    first = np.append(0, change)
    place = (chosen[first] & low).astype(np.int64)
    return doc[first], start[first], np.diff(np.append(first, len(doc))), place - start[first], h[place]


def multikey_order(words: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of their first length bytes and, for each, whether it agrees in them with the one before.

    words[p] is the big-endian number of the eight bytes at p; length is 8 at
    least.  Suffixes tied on the keys so far are sorted by the next key, eight
    bytes further (the last key ends with the length); untied ones are left alone.
    """
    order = np.argsort(words[starts], kind="stable")
    tied = np.zeros(len(starts), bool)
    if not len(starts):
        return order, tied
    keys = words[starts[order]]
    tied[1:] = keys[1:] == keys[:-1]
    for d in [*range(8, length - 7, 8), *([length - 8] if length % 8 else [])]:
        member = tied.copy()
        member[:-1] |= tied[1:]
        at = np.flatnonzero(member)
        if not len(at):
            break
        group = np.cumsum(~tied[at])
        key = words[starts[order[at]] + d]
        inner = np.lexsort((key, group))
        order[at] = order[at][inner]
        key = key[inner]
        tied[at[1:]] &= (key[1:] == key[:-1]) | ~tied[at[1:]]
    return order, tied


def _eights(data: np.ndarray) -> np.ndarray:
    padded = np.append(data, np.zeros(8, np.uint8))
    view = np.lib.stride_tricks.as_strided(padded, (len(data), 8), (1, 1))
    return np.ascontiguousarray(view).view(">u8").ravel().astype(np.uint64)


def repeated(spans: list[bytes], counts: np.ndarray, s: Settings) -> list[np.ndarray]:
    """For each span (counts windows) which of its windows occur in another span of the bucket."""
    lengths = np.array([len(x) for x in spans], np.int64)
    data = np.frombuffer(b"".join(spans), np.uint8)
    begin = np.cumsum(lengths) - lengths
    starts = np.repeat(begin, counts) + (np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts))
    order, tied = multikey_order(_eights(data), starts, s.length)
    again = tied.copy()
    again[:-1] |= tied[1:]
    found = np.zeros(len(starts), bool)
    found[order] = again
    return np.split(found, np.cumsum(counts)[:-1])


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(flags.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


SPAN = "row long, start long, count int, offset int, gram long, span long"


def _spans(store: DataFrame, s: Settings) -> DataFrame:
    out = T.StructType.fromDDL(SPAN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for top in range(0, big.num_rows, 1024):
                b = big.slice(top, 1024)
                texts = [(x or "").encode() for x in b.column(1).to_pylist()]
                doc, start, count, offset, gram, span = pivots(texts, s)
                row = b.column(0).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays(
                    [row, pa.array(start), pa.array(count, pa.int32()), pa.array(offset, pa.int32()), pa.array(gram.view(np.int64)), pa.array(span.view(np.int64))], names=out.names
                )

    return store.select("row", "text").mapInArrow(tidy(run), out)


CUT = "row long, start long, count int, single boolean, hot boolean, lead binary, body binary, digests binary, whole binary, middle binary"


def _cut(texts: DataFrame, s: Settings) -> DataFrame:
    """The bytes of every wanted span from row, z and the list of its spans; for hot k-grams its blocks.

    A block has the windows whose offset from the pivot falls in one multiple
    of the block size: 16-byte digests of each window, of all bytes they cover
    (whole) and of the bytes that every window of such a block covers (middle).
    """
    out = T.StructType.fromDDL(CUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        import zstandard

        unpack, digest = zstandard.ZstdDecompressor(), xxhash.xxh3_128_digest
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), *[pa.binary()] * 5]
        for big in batches:
            for top in range(0, big.num_rows, 128):
                rows = []
                for r in big.slice(top, 128).to_pylist():
                    text = unpack.decompress(r["z"])
                    for w in r["wanted"]:
                        a, n, o = w["start"], w["count"], w["offset"]
                        body = text[a : a + n + s.length - 1]
                        if not w["hot"]:
                            rows.append((r["row"], a, n, w["single"], False, body[o : o + s.gram], body, None, None, None))
                            continue
                        k = 0
                        while k < n:
                            q = (o - k) // s.block
                            end = min(n, o - q * s.block + 1)  # windows k to end - 1 have their offsets in this block
                            windows = b"".join(digest(body[i : i + s.length]) for i in range(k, end))
                            tag = b"%d:%d" % (q, o - k)
                            far = o - q * s.block  # the start of the block's last window
                            whole = digest(tag + body[k : end - 1 + s.length])
                            middle = digest(b"%d:" % q + body[far : far - s.block + 1 + s.length])
                            rows.append((r["row"], a + k, end - k, w["single"], True, None, None, windows, whole, middle))
                            k = end
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=out.names)

    return texts.mapInArrow(tidy(run), out)


FOUND = "row long, start long, count int"


def _bucket_repeats(spans: DataFrame, s: Settings) -> DataFrame:
    """Runs of repeated windows (row, start, count) in spans that stand in order of their leading bytes."""
    out = T.StructType.fromDDL(FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            counts = np.array([r[2] for r in rows], np.int64)
            got = []
            for r, flags in zip(rows, repeated([r[5] for r in rows], counts, s), strict=True):
                if r[3]:
                    a, e = _runs(flags)
                    got += [(r[0], r[1] + int(x), int(y - x)) for x, y in zip(a, e, strict=True)]
            columns = list(zip(*got, strict=True)) or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32()), strict=True)], names=out.names)

        for b in batches:
            for r in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if size > s.batch and held[-1][4] != r[4]:  # equal leading bytes stay together
                    yield flush(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[5])
        if held:
            yield flush(held)

    return spans.select("row", "start", "count", "single", "lead", "body").mapInArrow(tidy(run), out)


def _windows(blocks: DataFrame) -> DataFrame:
    """A row for each window of blocks: its place, its digest and whether its block stands once."""
    out = T.StructType.fromDDL("row long, at long, single boolean, high long, low long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for top in range(0, big.num_rows, 256):
                b = big.slice(top, 256)
                count = b.column(2).to_numpy().astype(np.int64)
                pick = np.repeat(np.arange(b.num_rows), count)
                at = b.column(1).to_numpy()[pick] + np.arange(len(pick)) - np.repeat(np.cumsum(count) - count, count)
                digests = np.frombuffer(b"".join(b.column(4).to_pylist()), np.int64).reshape(-1, 2)
                take = pa.array(pick)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(take), pa.array(at), b.column(3).take(take), pa.array(digests[:, 0]), pa.array(digests[:, 1])], names=out.names
                )

    return blocks.select("row", "start", "count", "single", "digests").mapInArrow(tidy(run), out)


EDGE = "high long, low long, row long, at long, single boolean, sure boolean"


def _window_repeats(windows: DataFrame) -> DataFrame:
    """Sorted buckets of windows: those with an equal neighbour are sure; the first and last window of a bucket come along for the boundaries."""
    out = T.StructType.fromDDL(EDGE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        t = pa.Table.from_batches(parts).combine_chunks()
        high, low = t.column("high").to_numpy(), t.column("low").to_numpy()
        order = np.lexsort((low, high))  # both keys at once: two keys make a window
        tied = np.zeros(len(order), bool)
        tied[1:] = (high[order[1:]] == high[order[:-1]]) & (low[order[1:]] == low[order[:-1]])
        again = tied.copy()
        again[:-1] |= tied[1:]
        keep = again.copy()
        keep[[0, -1]] = True
        pick = pa.array(order[keep])
        rows = t.select(["high", "low", "row", "at", "single"]).take(pick).combine_chunks()
        yield pa.RecordBatch.from_arrays([*[c.chunk(0) for c in rows.columns], pa.array(again[keep])], names=out.names)

    return windows.select("high", "low", "row", "at", "single").mapInArrow(tidy(run), out)


def repeats(scratch: Scratch, spark: SparkSession, store: DataFrame, packed: DataFrame, s: Settings) -> DataFrame:
    """row and runs of repeated windows (start, count), from a stored (row, text) and its compressed copy (row, z)."""
    with small_batches(spark):
        spans = scratch.write(_spans(store, s), "spans")
    grams = spans.groupBy("gram").agg(F.count("*").alias("n"), F.min("span").alias("_least"), F.max("span").alias("_most")).where("n > 1")
    grams = scratch.write(grams, "grams")
    again = scratch.write(keyed(spans, grams, ["gram"], "n").withColumn("mixed", F.col("_least") != F.col("_most")).drop("_least", "_most"), "again")
    scratch.drop("spans")
    scratch.drop("grams")
    release(spark)
    kinds = (
        again.where("mixed").groupBy("gram", "span").agg(F.count("*").alias("copies"), F.min(F.struct("row", "start", "count", "offset")).alias("one"))
    )
    kinds = scratch.write(kinds, "kinds")
    crowds = scratch.write(kinds.groupBy("gram").agg(F.count("*").alias("n"), (F.count("*") > s.crowd).alias("hot")), "crowds")
    copied = kinds.where("copies > 1").select("gram", "span", "copies")
    whole = again.where("NOT mixed").select("row", "start", "count").unionByName(
        keyed(again.where("mixed"), copied, ["gram", "span"], "copies", "left_semi").select("row", "start", "count")
    )
    wanted = keyed(kinds, crowds, ["gram"], "n").select("one.*", (F.col("copies") == 1).alias("single"), "hot")
    wanted = wanted.groupBy("row").agg(F.collect_list(F.struct("start", "count", "offset", "single", "hot")).alias("wanted"))
    cut = scratch.write(_cut(packed.join(wanted, "row").select("row", "z", "wanted"), s), "cut")
    release(spark)
    buckets = cut.where("NOT hot").repartitionByRange(width_for(cut, 64 << 20), "lead").sortWithinPartitions("lead")
    sorted_out = _bucket_repeats(buckets, s)
    kept = ["middle", "whole"]
    blocks = cut.where("hot").groupBy(*kept).agg(F.count("*").alias("copies"), F.min(F.struct("row", "start", "count", "single", "digests")).alias("one"))
    blocks = scratch.write(blocks, "blocks")
    twins = keyed(cut.where("hot AND single"), blocks.where("copies > 1").select(*kept, "copies"), kept, "copies", "left_semi").select("row", "start", "count")
    apart = scratch.write(blocks.groupBy("middle").agg(F.count("*").alias("n")).where("n > 1"), "apart")
    unsure = keyed(blocks, apart, ["middle"], "n", "left_semi")
    unsure = unsure.select("one.row", "one.start", "one.count", (F.col("one.single") & (F.col("copies") == 1)).alias("single"), "one.digests")
    windows = scratch.write(_windows(unsure), "windows")
    most = partitions_for(spark, windows.count(), 1_000_000)
    salted = windows.withColumn("_salt", F.xxhash64("row", "at")).repartitionByRange(most, "high", "low", "_salt")
    edges = scratch.write(_window_repeats(salted), "edges")
    scratch.drop("windows")
    across = scratch.write(edges.groupBy("high", "low").agg(F.count("*").alias("n")).where("n > 1"), "across")  # at most what is repeated, and two per bucket
    hot = edges.where("sure AND single").select("row", F.col("at").alias("start"), F.lit(1).alias("count")).unionByName(
        keyed(edges.where("NOT sure AND single"), across, ["high", "low"], "n", "left_semi").select("row", F.col("at").alias("start"), F.lit(1).alias("count"))
    )
    return scratch.write(whole.unionByName(sorted_out).unionByName(twins).unionByName(hot), "runs")


def _pack(store: DataFrame) -> DataFrame:
    out = T.StructType.fromDDL("row long, z binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=3)
        for big in batches:
            for top in range(0, big.num_rows, 512):
                b = big.slice(top, 512)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([press.compress((x or "").encode()) for x in b.column(1).to_pylist()], pa.binary())], names=out.names)

    return store.select("row", "text").mapInArrow(tidy(run), out)


REMOVED = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string, removed array<long>"


def _remove(texts: DataFrame, s: Settings, payload: bool) -> DataFrame:
    """row + REMOVED from row, z and runs (list of (start, count) of repeated windows, or null)."""
    fields = [f for f in T.StructType.fromDDL(REMOVED).fields if payload or f.name not in ("kept", "removed")]
    out = T.StructType([texts.schema["row"], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for big in batches:
            for top in range(0, big.num_rows, 256):
                b = big.slice(top, 256)
                rows = []
                for z, runs in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    text = unpack.decompress(z)
                    merged: list[list[int]] = []
                    for a, e in sorted((r["start"], r["start"] + r["count"] - 1 + s.length) for r in runs or []):
                        if merged and a <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], e)
                        else:
                            merged.append([a, e])
                    cuts = [0, *[x for m in merged for x in m], len(text)]
                    kept = b"".join(text[x:y] for x, y in zip(cuts[::2], cuts[1::2], strict=True))
                    row = (len(text), len(text) - len(kept), len(merged), hashlib.sha256(kept).hexdigest())
                    rows.append((*row, kept.decode("utf-8", "ignore"), [x for m in merged for x in m]) if payload else row)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64())][: len(fields)]
                yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]], names=out.names)

    return texts.mapInArrow(tidy(run), out)


def remove_repeats(spark: SparkSession, docs: DataFrame, text: str = "text", s: Settings = Settings(), payload: bool = True) -> DataFrame:
    """docs without text, with n_bytes, n_removed, n_spans, kept_sha256, and with payload kept (text) and removed (flat starts and ends, in bytes).

    Whole texts as UTF-8 bytes; a null text counts as empty; texts shorter than
    the length keep all; repeated rows are documents of their own (so each
    loses what they share); an empty table gives no rows.  The digest is of the
    remaining bytes; where a cut falls inside a character, kept leaves out the
    rest of that character.  Columns of docs that are named like a new one are
    left out; all other names are free.
    """
    scratch = Scratch(spark, "suffixes")
    kept = [c for c in docs.columns if c not in (text, *REMOVED.replace(",", " ").split()[::2])]
    own = F.struct(F.lit(None).cast("int").alias("_"), *[F.col(c) for c in kept]).alias("kept_columns")
    store = scratch.write(docs.select(F.monotonically_increasing_id().alias("row"), own, F.col(text).alias("text")), "store")
    width = width_for(store, 64 << 20)
    with small_batches(spark):
        packed = scratch.bucketed(_pack(store).repartition(width, "row"), "packed", "row", width)
    release(spark)
    runs = repeats(scratch, spark, store, packed, s)
    release(spark)
    per_row = runs.groupBy("row").agg(F.collect_list(F.struct("start", "count")).alias("runs"))
    done = _remove(packed.join(per_row, "row", "left").select("row", "z", "runs"), s, payload)
    found = done.columns[1:]
    return done.join(store.select("row", "kept_columns"), "row").select(*[F.col("kept_columns")[c].alias(c) for c in kept], *found)
