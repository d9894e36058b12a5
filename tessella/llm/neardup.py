"""N-gram Jaccard self-join by MinHash banding, and its near-duplicate classes.

Texts are first merged when they are equal.  MinHash signatures are cut into
bands; band and row counts come from the recall wanted at the threshold.  Texts
that share a band of a signature meet in a bucket.  A bucket is dealt in square
blocks, so that no task sees more than two blocks of a hot one, and a pair is
looked at in the first of its common bands only.  Pairs whose signatures agree
well enough are verified on their whole n-gram sets; nobody writes the pairs:
each block adds up links per text and joins linked texts to their smallest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shingles
from .common import Scratch, release, small_side, tidy

#: The rows of a band: four 16-bit values make the 64 bits of a bucket's key.
ROWS = 4


def bands_for(threshold: float, recall: float, rows: int = ROWS) -> int:
    """The fewest bands that find a pair at the threshold with the wanted probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


@dataclass(frozen=True)
class Settings:
    words: int = shingles.WORDS
    threshold: float = 0.8
    recall: float = 0.99999
    #: Pairs whose signatures agree less are not verified: six deviations under the threshold.
    agree: float = 0.55
    #: Texts of a bucket that meet at once, on each side.
    block: int = 512
    seed: int = 5

    @property
    def bands(self) -> int:
        return bands_for(self.threshold, self.recall)


def text_key(text: Column) -> Column:
    """16 bytes that are equal for equal texts."""
    return F.unhex(F.md5(text))


def _signatures(docs: DataFrame, s: Settings) -> DataFrame:
    """docs' columns but the last, text, and sig: a long of four 16-bit minima per band; null for a text without words."""
    kept = docs.columns[:-1]
    out = T.StructType([*[docs.schema[c] for c in kept], T.StructField("sig", T.ArrayType(T.LongType()))])
    factors = np.random.default_rng(s.seed).integers(1, 1 << 63, s.bands * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for top in range(0, big.num_rows, 512):
                b = big.slice(top, 512)
                texts = [(x or "").encode() for x in b.column(len(kept)).to_pylist()]
                sigs = np.zeros((len(texts), s.bands), np.int64)
                some = np.zeros(len(texts), bool)
                for first, last in shingles.batches(texts):
                    flat, total = shingles.ngrams(texts[first:last], s.words)
                    full = np.flatnonzero(total)
                    if not len(full):
                        continue
                    starts = (np.cumsum(total) - total)[full]
                    minima = np.stack([np.minimum.reduceat(flat * f, starts) for f in factors], axis=1)
                    short = (minima * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(48)).astype(np.uint16)
                    sigs[first + full] = short.view(np.int64)
                    some[first + full] = True
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, sigs.size + 1, s.bands), pa.int32()), pa.array(sigs.ravel()))
                lists = pa.array([x if ok else None for x, ok in zip(lists.to_pylist(), some, strict=True)], pa.list_(pa.int64())) if not some.all() else lists
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], lists], names=out.names)

    return docs.mapInArrow(tidy(run), out)


def _sets(texts: DataFrame, s: Settings) -> DataFrame:
    """rid and grams (sorted distinct 64-bit n-gram hashes) from rid and text."""
    out = T.StructType.fromDDL("rid long, grams binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 512):
                b = big.slice(at, 512)
                found = shingles.sets([(x or "").encode() for x in b.column(1).to_pylist()], s.words)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f.tobytes() for f in found], pa.binary())], names=out.names)

    return texts.select("rid", "text").mapInArrow(tidy(run), out)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows with equal first columns, each run whole."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy() for k in range(keys)]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        edges = [0, *change.tolist(), b.num_rows]
        for a, e in zip(edges[:-1], edges[1:], strict=True):
            key = tuple(c[a] for c in cols)
            if key != last and held:
                yield _whole(held)
                held = []
            held.append(b.slice(a, e - a))
            last = key
    if held:
        yield _whole(held)


def _whole(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def _candidates(sig: np.ndarray, block: np.ndarray, low: int, high: int, band: int, agree: float) -> Iterator[tuple[int, np.ndarray]]:
    """(text, partners after it) of a block pair: this is their first common band and their signatures agree enough."""
    left = np.flatnonzero(block == low)
    right = left if low == high else np.flatnonzero(block == high)
    bits = sig.view(np.uint16).reshape(len(sig), -1)
    for n, i in enumerate(left.tolist()):
        others = right[n + 1 :] if low == high else right
        if band:
            others = others[~(sig[others, :band] == sig[i, :band]).any(axis=1)]
        others = others[(bits[others] == bits[i]).mean(axis=1) >= agree] if len(others) else others
        if len(others):
            yield i, others


def _rooted(n: int, pairs: list[tuple[int, np.ndarray]]) -> np.ndarray:
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, others in pairs:
        for j in others.tolist():
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
    return np.array([find(x) for x in range(n)])


def _sig_of(b: pa.RecordBatch, name: str) -> np.ndarray:
    c = b.column(b.schema.get_field_index(name))
    return c.flatten().to_numpy().reshape(len(c), -1)


KEYS = ("band", "bucket", "low", "high")


def _sift(members: DataFrame, s: Settings) -> DataFrame:
    """Of members (KEYS, block, rid, sig), those with a candidate partner in their block pair, without sig."""
    out = T.StructType([f for f in members.schema.fields if f.name != "sig"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, len(KEYS)):
            if g.num_rows < 2:
                continue
            band, low, high = (g.column(k)[0].as_py() for k in (0, 2, 3))
            seen = np.zeros(g.num_rows, bool)
            for i, others in _candidates(_sig_of(g, "sig"), g.column(4).to_numpy(), low, high, band, s.agree):
                seen[i] = True
                seen[others] = True
            if seen.any():
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(seen)) for c in g.columns[:-1]], names=out.names)

    return members.mapInArrow(tidy(run), out)


def _verify(members: DataFrame, s: Settings) -> DataFrame:
    """rid, root, links from members (KEYS, block, rid, copies, sig, grams): verified links, counted in rows of partners."""
    out = T.StructType.fromDDL("rid long, root long, links long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, len(KEYS)):
            if g.num_rows < 2:
                continue
            band, low, high = (g.column(k)[0].as_py() for k in (0, 2, 3))
            rid, copies = g.column(5).to_numpy(), g.column(6).to_numpy()
            grams = [np.frombuffer(x, np.uint64) for x in g.column(8).to_pylist()]
            size = np.array([len(x) for x in grams])
            _, number = np.unique(np.concatenate(grams), return_inverse=True)
            at = np.append(0, np.cumsum(size))
            mark = np.zeros(int(number.max(initial=-1)) + 1, bool)
            links, pairs = np.zeros(len(rid), np.int64), []
            for i, others in _candidates(_sig_of(g, "sig"), g.column(4).to_numpy(), low, high, band, s.agree):
                mine = number[at[i] : at[i + 1]]
                mark[mine] = True
                flat = np.concatenate([number[at[j] : at[j + 1]] for j in others.tolist()])
                begin = np.cumsum(size[others]) - size[others]
                common = np.add.reduceat(mark[flat], begin, dtype=np.int64)
                mark[mine] = False
                either = size[i] + size[others] - common
                linked = others[common >= s.threshold * either - 1e-9]
                if len(linked):
                    links[i] += copies[linked].sum()
                    links[linked] += copies[i]
                    pairs.append((i, linked))
            some = np.flatnonzero(links)
            if len(some):
                order = np.argsort(rid)
                back = np.empty_like(order)
                back[order] = np.arange(len(order))
                root = rid[order][_rooted(len(rid), [(int(back[i]), back[o]) for i, o in pairs])][back]
                yield pa.RecordBatch.from_arrays([pa.array(rid[some]), pa.array(root[some]), pa.array(links[some])], names=out.names)

    return members.mapInArrow(tidy(run), out)


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """rid and root (smallest id of its component) of every id in edges (rid, root), by alternating stars.

    Every round is a stored table; nothing of the graph comes to the driver but
    a count and a checksum that tell when a round changed nothing.
    """
    now = scratch.write(edges.where("rid <> root").select(F.greatest("rid", "root").alias("a"), F.least("rid", "root").alias("b")).distinct(), "edges-0")
    last, turn = None, 0
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("_a"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("_a")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "_a")
        small = large.join(least, F.col("a") == F.col("_a"))
        small = small.select("a", F.col("m").alias("b")).unionByName(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        turn += 1
        now = scratch.write(small, f"edges-{turn}")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 31))).first()
        scratch.drop(f"edges-{turn - 1}")
        if state == last:
            return now.select(F.col("a").alias("rid"), F.col("b").alias("root"))
        last = state


def _classes(spark: SparkSession, docs: DataFrame, doc_id: str, text: str, s: Settings) -> tuple[DataFrame, DataFrame]:
    """(doc_id and key of every row; per key: copies, links and the smallest doc_id of its class)."""
    scratch = Scratch(spark, "neardup")
    base = docs.select(F.col(doc_id).alias("doc_id"), text_key(F.col(text)).alias("key"), F.col(text).alias("text"))
    signed = scratch.write(_signatures(base, s), "signed")
    one = scratch.write(
        signed.where("sig IS NOT NULL").groupBy("key").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least"), F.first("sig").alias("sig"))
        .select(F.monotonically_increasing_id().alias("rid"), "*"), "texts",
    )
    keyed = one.select("rid", F.posexplode("sig").alias("band", "bucket"))
    # stored, so that a hot bucket's side of the join can be split
    shared = scratch.write(keyed.groupBy("band", "bucket").count().where("count > 1"), "shared")
    dealt = scratch.write(
        keyed.join(shared, ["band", "bucket"])
        .withColumn("_blocks", F.ceil(F.col("count") / s.block).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("rid"), F.col("_blocks")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .select("band", "bucket", F.least("block", "_other").alias("low"), F.greatest("block", "_other").alias("high"), "block", "rid"), "dealt",
    )

    def met(rows: DataFrame) -> DataFrame:
        return rows.repartition(*KEYS).sortWithinPartitions(*KEYS, "rid")

    left = scratch.write(_sift(met(dealt.join(one.select("rid", "sig"), "rid").select(*KEYS, "block", "rid", "sig")), s), "sifted")
    scratch.drop("dealt")
    release(spark)
    wanted = one.join(left.select("rid").distinct(), "rid").select("rid", "key")
    texts = base.select("key", "text").join(small_side(wanted), "key").groupBy("rid").agg(F.first("text").alias("text"))
    grams = scratch.write(_sets(texts, s), "grams")
    full = left.join(one.select("rid", "copies", "sig"), "rid").join(grams, "rid").select(*KEYS, "block", "rid", "copies", "sig", "grams")
    linked = scratch.write(_verify(met(full), s), "linked")
    scratch.drop("grams")
    release(spark)
    roots = components(scratch, linked.select("rid", "root"))
    links = linked.groupBy("rid").agg(F.sum("links").alias("links"))
    placed = one.select("rid", "key", "copies", "least").join(roots, "rid", "left").join(links, "rid", "left")
    placed = placed.withColumn("root", F.coalesce("root", "rid"))
    heads = placed.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("copies").alias("members"))
    info = placed.join(heads, "root").select("key", "class_id", "members", "root", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return signed.select("doc_id", "key", F.col("sig").isNotNull().alias("some")), scratch.write(info, "classes")


def near_duplicates(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", s: Settings = Settings()) -> DataFrame:
    """doc_id, class_id, n_links of every row.

    n_links counts the other rows whose n-gram sets have a Jaccard similarity of
    at least the threshold, equal texts among them.  class_id is the smallest
    doc_id that links lead to.  Null texts and texts without words link to
    nothing and are classes of their own; texts of fewer than five words are one
    n-gram; repeated rows are copies of each other; an empty table gives no
    rows.  Other columns are not read.
    """
    rows, info = _classes(spark, docs, doc_id, text, s)
    found = rows.join(info.withColumnRenamed("key", "_key"), F.col("some") & (F.col("key") == F.col("_key")), "left")
    return found.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", s: Settings = Settings()) -> DataFrame:
    """docs with one row of every class: that of the smallest doc_id (null last), then by the other columns; rows without words all stay.

    Repeated rows are copies, of which one stays; an empty table stays empty;
    the names of other columns are free.
    """
    _, info = _classes(spark, docs, doc_id, text, s)
    many = info.where("members > 1").select(F.col("key").alias("class_key"), "root")
    rows = docs.select(F.struct("*").alias("doc"), text_key(F.col(text)).alias("key"))
    marked = rows.join(small_side(many), F.col("key") == F.col("class_key"), "left")
    others = [F.col("doc")[c] for c in docs.columns if c not in (doc_id, text)]
    order = Window.partitionBy("root").orderBy(F.col("doc")[doc_id].asc_nulls_last(), *others)
    first = marked.where("root IS NOT NULL").withColumn("n", F.row_number().over(order)).where("n = 1")
    return marked.where("root IS NULL").select("doc").unionByName(first.select("doc")).select("doc.*")
