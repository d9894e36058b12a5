"""The keyword index: segments of postings sorted by term, so that a question reads the pages of its own terms.

An index is a list of segments.  Each holds, for the items that it was written
for, the postings of their chunks (in runs sorted by term, cut into
blocks in Arrow's format with their first and last terms), the chunks' texts (in runs sorted by item) and a row per item: how many chunks and words it has now, which may be
none.  An item counts in the last segment that names it; in all earlier ones it
is dead.  So an edit writes one segment of the items it touches, and corpus
statistics are sums that each edit corrects by what its items had before.
Segments of one size class are merged when there are enough of them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as fx
from ..storage import Scratch

#: What a posting carries of its chunk, so that a leg filters without a join.
OWN = ("item_id", "section_id", "kind", "status")
#: Segments of one size class that are merged into one; a class spans sizes up to so many times its smallest.
FAN = 4
#: Postings and texts of a partition, about.
PART_ROWS, PART_CHARS = 2_000_000, 128 << 20
#: Row groups of the text store: small, so that few are read for a page of hits.
TEXT_GROUP = 4 << 20
#: Items of later segments that are broadcast to tell what is dead in earlier ones; beyond that the join shuffles.
BROADCAST_ITEMS = 1_000_000


@dataclass(frozen=True)
class Segment:
    """number: later ones override earlier ones; folder: under the index; chunks, items: how many it was written with."""

    number: int
    folder: str
    chunks: int
    items: int

    @property
    def size_class(self) -> int:
        n, found = max(1, self.chunks), 0
        while n >= FAN:
            n, found = n // FAN, found + 1
        return found


#: The cells of a posting besides its term, in the order in which they are stored.
CELLS = ("chunk_id", *OWN, "length", "tf", "positions")
#: Postings of a block: a term is read with so many of its neighbours at most.  A row a posting takes Spark's writer most of a build.
BLOCK = 4096
#: The table of blocks.  Those without terms hold a batch's chunks.
BLOCKS = "first string, last string, data binary"
#: Texts that are folded and cut by their bytes have no other characters than these; of them the second half have two bytes, the first of which is TWO.
_PLAIN, TWO = r"[^\x00-\x7F\u00C0-\u00FF]", 0xC3


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes in lower case; which of them are letters or digits; by the second byte of a pair: the letter without its mark or 0, the second byte in lower case, whether it is a letter)."""
    lower, word = np.arange(256, dtype=np.uint8), np.zeros(256, bool)
    lower[65:91] += 32
    word[[*b"0123456789abcdefghijklmnopqrstuvwxyz"]] = True
    bare, second, letter = np.zeros(64, np.uint8), np.arange(0x80, 0xC0, dtype=np.uint8), np.zeros(64, bool)
    marks = dict(zip(fx.MARKED, fx.PLAIN, strict=True))
    for k in range(64):
        c = chr(0xC0 + k).lower()
        bare[k], second[k], letter[k] = ord(marks.get(c, "\0")), c.encode()[1], c.isalpha()
    return lower, word, bare, second, letter


_LOWER, _WORD, _BARE, _SECOND, _LETTER = _tables()


def _cut(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """(the folded words of plain texts, one after the other; the text that each is of)."""
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    chars = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    ends = ends.astype(np.int64) - ends[0]
    two = np.flatnonzero(chars == TWO)
    code = chars[two + 1] & 63
    chars = _LOWER[chars]
    word = _WORD[chars]
    bare, letter = _BARE[code] > 0, _LETTER[code]
    chars[two + 1] = _SECOND[code]
    word[two[letter]] = word[two[letter] + 1] = True
    if bare.any():
        chars[two[bare]] = _BARE[code[bare]]
        gone = two[bare] + 1
        chars, word, ends = np.delete(chars, gone), np.delete(word, gone), ends - np.searchsorted(gone, ends)
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = ends[1:-1]
    inner = inner[(inner > 0) & (inner < len(chars))]
    first[inner], last[inner - 1] = word[inner], word[inner - 1]  # a word ends with its text
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    sizes = np.concatenate([[0], np.cumsum(stop - start)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(sizes), pa.py_buffer(chars[word])), np.searchsorted(ends, start, "right") - 1


def _flat(own: T.StructType) -> T.StructType:
    """The schema of a row per posting: term and CELLS."""
    return T.StructType([T.StructField("term", T.StringType()), *[own[c] for c in ("chunk_id", *OWN)], *T.StructType.fromDDL("length int, tf int, positions array<int>").fields])


def _blocks(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Rows of BLOCKS from postings that are sorted by term."""
    options, found = pa.ipc.IpcWriteOptions(compression="zstd"), []
    for at in range(0, rows.num_rows, BLOCK):
        part, sink = rows.slice(at, BLOCK), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema, options=options) as out:
            out.write_batch(part)
        found.append((part.column(0)[0].as_py(), part.column(0)[-1].as_py(), sink.getvalue().to_pybytes()))
    kinds = (pa.string(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=["first", "last", "data"])


def _opened(blocks: DataFrame, flat: T.StructType, columns: tuple[str, ...], words: list[str] | None = None) -> DataFrame:
    """columns of the postings in blocks, of words or of all: a row a posting."""
    schema = T.StructType([flat[c] for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = None if words is None else pa.array(words, pa.string())
        for b in batches:
            for data in b.column(0):
                for rows in pa.ipc.open_stream(data.as_buffer()):
                    rows = rows if asked is None else rows.filter(pc.is_in(rows.column(0), asked))
                    if rows.num_rows:
                        cells = [rows.column(c) for c in columns]
                        yield pa.RecordBatch.from_arrays([c.dictionary_decode() if isinstance(c, pa.DictionaryArray) else c for c in cells], names=list(columns))

    return blocks.select("data").mapInArrow(run, schema)


def postings_of(chunks: DataFrame) -> DataFrame:
    """BLOCKS from chunk_id, OWN and content, without a shuffle: batch by batch sorted by term, within one by the chunk's place.

    Each batch also has blocks without terms that hold all of its chunks, those
    without words included: length and tf are how many words they have.  Plain
    texts are folded and cut by their bytes, the others by Spark.
    """
    names, k = _flat(chunks.schema).names, 1 + len(OWN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            own, text, words = [c.dictionary_encode() if pa.types.is_string(c.type) else c for c in b.columns[:k]], b.column(k), b.column(k + 1)
            wide = np.asarray(words.is_valid().to_numpy(zero_copy_only=False))
            plain, of = _cut(text.filter(pa.array(~wide)))
            size = np.asarray(words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
            row = np.concatenate([np.flatnonzero(~wide)[of], np.repeat(np.arange(len(size)), size)])
            size = np.bincount(row, minlength=b.num_rows).astype(np.int32)
            none = pa.ListArray.from_arrays(pa.array(np.zeros(b.num_rows + 1, np.int32)), pa.array([], pa.int32()))
            yield _blocks(pa.RecordBatch.from_arrays([pa.nulls(b.num_rows, pa.string()), *own, pa.array(size), pa.array(size), none], names=names))
            if not len(row):
                continue
            coded = pa.concat_arrays([plain, words.flatten()]).dictionary_encode()
            by_name = pc.sort_indices(coded.dictionary).to_numpy()
            place = np.empty(len(by_name), np.int64)
            place[by_name] = np.arange(len(by_name))
            begins = np.flatnonzero(np.diff(row, prepend=-1))  # the words of a chunk stand together
            at = np.arange(len(row)) - np.repeat(begins, np.diff(begins, append=len(row)))
            key = place[coded.indices.to_numpy()] * b.num_rows + row
            order = np.argsort(key, kind="stable")  # positions of a term stay in their order
            key = key[order]
            heads = np.flatnonzero(np.diff(key, prepend=-1))
            ends, at = np.append(heads, len(key)).astype(np.int32), at[order].astype(np.int32)
            name, which = np.divmod(key[heads], b.num_rows)
            rows = pa.array(which)
            cells = [*[c.take(rows) for c in own], pa.array(size[which]), pa.array(np.diff(ends)), pa.ListArray.from_arrays(pa.array(ends), pa.array(at))]
            yield _blocks(pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(by_name[name])), *cells], names=names))

    text = F.coalesce("content", F.lit(""))
    cut = F.when(text.rlike(_PLAIN), fx.words(fx.folded(text)))
    return chunks.select("chunk_id", *OWN, text.alias("_text"), cut.alias("_words")).mapInArrow(run, BLOCKS)


def _gathered(sorted_postings: DataFrame) -> DataFrame:
    """BLOCKS from rows (term, CELLS) whose partitions are sorted by term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield _blocks(b)

    return sorted_postings.select("term", *CELLS).mapInArrow(run, BLOCKS)


@dataclass(frozen=True)
class KeywordIndex:
    """An open index.  n and words: live chunks of every kind and their words, those without words included."""

    spark: SparkSession
    path: str
    version: int
    segments: tuple[Segment, ...]
    n: int
    words: int
    scratch: Scratch | None = field(default=None, compare=False, repr=False)

    @staticmethod
    def build(chunks: DataFrame, path: str) -> KeywordIndex:
        """The index of all chunks, stored under path: each is split into words once, and neither texts nor postings are shuffled."""
        empty = KeywordIndex(chunks.sparkSession, path, 0, (), 0, 0)
        segment, n, words = empty._written(chunks, None, 0)
        return empty._committed((segment,), n, words)

    @staticmethod
    def open(spark: SparkSession, path: str) -> KeywordIndex:
        """The last version under path."""
        told = spark.read.parquet(f"{path}/manifest")
        rows = told.join(told.agg(F.max("version").alias("version")), "version").orderBy("number").collect()  # a row a segment
        return KeywordIndex(spark, path, rows[0]["version"], tuple(Segment(r["number"], r["folder"], r["chunks"], r["items"]) for r in rows), rows[0]["n"], rows[0]["words"])

    def replaced(self, items: DataFrame, chunks: DataFrame, merge: bool = True) -> KeywordIndex:
        """The index after items (item_id) changed; chunks: all that they have now (none: an item is gone).

        One segment of these items is written, whatever the index holds.  Two
        writers of one version cannot both commit.
        """
        named = items.select("item_id").distinct()
        before = self._live_items(named).agg(F.sum("chunks"), F.sum("words")).first()
        segment, n, words = self._written(chunks.join(named, "item_id", "left_semi").select(*chunks.columns), named, self.segments[-1].number + 1)
        now = self._committed((*self.segments, segment), self.n - (before[0] or 0) + n, self.words - (before[1] or 0) + words)
        return now.merged() if merge else now

    def merged(self) -> KeywordIndex:
        """The index with its last FAN segments brought together, as long as the oldest of them is in no larger size class than the others."""
        now = self
        while len(now.segments) >= FAN and now.segments[-FAN].size_class <= max(s.size_class for s in now.segments[1 - FAN :]):
            now = now._merge(FAN)
        return now

    def _merge(self, most: int) -> KeywordIndex:
        last = self.segments[-most:]
        parts, whole = replace(self, segments=last), len(last) == len(self.segments)
        folder = f"segment-{uuid.uuid4().hex}"
        rows = parts._live_items(None)
        rows = rows.where("chunks > 0") if whole else rows  # with nothing older, no one needs to know what is gone
        rows.write.parquet(f"{self.path}/{folder}/items")
        told = self.spark.read.parquet(f"{self.path}/{folder}/items").agg(F.count("*"), F.coalesce(F.sum("chunks"), F.lit(0))).first()
        self._store(parts.postings, parts.texts, folder)
        return self._committed((*self.segments[:-most], Segment(last[-1].number, folder, told[1], told[0])), self.n, self.words)

    def _written(self, chunks: DataFrame, items: DataFrame | None, number: int) -> tuple[Segment, int, int]:
        """(segment, its chunks, their words); items (item_id): those that may have no chunks."""
        folder = f"segment-{uuid.uuid4().hex}"
        at = f"{self.path}/{folder}"
        own = chunks.select("chunk_id", *OWN, "content")
        # each partition by itself: an item's or a term's rows are found by the bounds of pages, wherever they stand
        own.sortWithinPartitions("item_id", "chunk_id").write.option("compression", "zstd").option("parquet.block.size", TEXT_GROUP).parquet(f"{at}/texts")
        texts = self.spark.read.schema(own.schema).parquet(f"{at}/texts")  # however dear chunks are to make, once
        found = postings_of(texts)
        self._put(found, folder)
        told = _opened(self.spark.read.schema(BLOCKS).parquet(f"{at}/postings").where("first IS NULL"), _flat(own.schema), ("item_id", "length"))
        counts = told.select("item_id", F.lit(1).alias("chunks"), F.col("length").alias("words"))
        counts = counts if items is None else counts.unionByName(items.select("item_id", F.lit(0).alias("chunks"), F.lit(0).alias("words")))
        counts.groupBy("item_id").agg(F.sum("chunks").alias("chunks"), F.sum("words").alias("words")).write.parquet(f"{at}/items")
        told = self.spark.read.parquet(f"{at}/items").agg(F.count("*"), F.coalesce(F.sum("chunks"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
        return Segment(number, folder, told[1], told[0]), told[1], told[2]

    def _put(self, postings: DataFrame, folder: str) -> None:
        # a page a block, so that the bounds of pages are those of blocks
        postings.write.option("compression", "none").option("parquet.page.row.count.limit", 1).parquet(f"{self.path}/{folder}/postings")

    def _store(self, postings: DataFrame, texts: DataFrame, folder: str) -> None:
        rows = postings.count()
        parts = max(-(-rows // PART_ROWS), min(int(self.spark.conf.get("spark.sql.shuffle.partitions")), rows * FAN // PART_ROWS + 1))
        by_term = postings.repartitionByRange(parts, "term", "chunk_id").sortWithinPartitions("term", "chunk_id")
        self._put(_gathered(by_term), folder)
        chars = texts.agg(F.sum(F.length("content"))).first()[0] or 0
        by_item = texts.repartitionByRange(max(1, -(-chars // PART_CHARS)), "item_id", "chunk_id").sortWithinPartitions("item_id", "chunk_id")
        by_item.write.option("compression", "zstd").option("parquet.block.size", TEXT_GROUP).parquet(f"{self.path}/{folder}/texts")

    def _committed(self, segments: tuple[Segment, ...], n: int, words: int) -> KeywordIndex:
        rows = [(s.number, s.folder, s.chunks, s.items, n, words) for s in segments]
        told = self.spark.createDataFrame(rows, "number int, folder string, chunks long, items long, n long, words long")
        told.coalesce(1).write.parquet(f"{self.path}/manifest/version={self.version + 1}")  # fails if another writer was first
        return KeywordIndex(self.spark, self.path, self.version + 1, segments, n, words)

    def _read(self, what: str, only: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
        """Live rows of all segments; only: a filter, which reaches the scans."""
        tables = [only(self.spark.read.parquet(f"{self.path}/{s.folder}/{what}")).withColumn("_number", F.lit(s.number)) for s in self.segments]
        rows = reduce(DataFrame.unionByName, tables)
        if len(self.segments) == 1:
            return rows.drop("_number")
        later = [self.spark.read.parquet(f"{self.path}/{s.folder}/items").select("item_id", F.lit(s.number).alias("_last")) for s in self.segments[1:]]
        last = reduce(DataFrame.unionByName, later).groupBy("item_id").agg(F.max("_last").alias("_last"))
        last = F.broadcast(last) if sum(s.items for s in self.segments[1:]) <= BROADCAST_ITEMS else last
        columns = [c for c in rows.columns if c != "_number"]
        return rows.join(last, "item_id", "left").where("_last IS NULL OR _number >= _last").select(*columns)

    def _postings(self, words: list[str] | None, cells: tuple[str, ...]) -> DataFrame:
        """term and cells (item_id among them) of the live postings of words, or of all: a row a posting."""
        flat = _flat(self._read("texts").schema)
        wanted = F.col("first").isNotNull() if words is None else reduce(lambda a, b: a | b, [(F.col("first") <= w) & (F.col("last") >= w) for w in words], F.lit(False))
        return self._read("postings", lambda rows: _opened(rows.where(wanted), flat, ("term", *cells), words))

    def _live_items(self, named: DataFrame | None) -> DataFrame:
        """item_id, chunks, words of the items as the segments have them last; those named, or all."""
        return self._read("items", (lambda rows: rows) if named is None else lambda rows: rows.join(named, "item_id", "left_semi").select(*rows.columns))

    @property
    def postings(self) -> DataFrame:
        """term, chunk_id, OWN, length, tf, positions of live chunks."""
        return self._postings(None, CELLS)

    @property
    def texts(self) -> DataFrame:
        """chunk_id, OWN, content of live chunks."""
        return self._read("texts")

    def texts_of(self, items: list[int], chunk_ids: list[int] | None = None) -> DataFrame:
        """The live chunks of a few items, or some of them: only row groups with these items are read."""
        found = self._read("texts", lambda rows: rows.where(F.col("item_id").isin(items)))
        return found if chunk_ids is None else found.where(F.col("chunk_id").isin(chunk_ids))

    @property
    def stats(self) -> DataFrame:
        """One row: n and average (words per chunk)."""
        return self.spark.createDataFrame([(self.n, self.words / self.n if self.n else None)], "n long, average double")

    def vacuum(self) -> None:
        """Delete the folders that this version does not name; readers of older versions must be done."""
        known = {s.folder for s in self.segments}
        told = self.spark.read.parquet(f"{self.path}/manifest").select("folder").distinct().collect()
        jvm = self.spark.sparkContext._jvm
        for folder in {r["folder"] for r in told} - known:
            at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def counted(self, phrases: list[tuple[str, ...]], narrow: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """chunk_id, OWN, _len, _tf: how often each phrase stands in a chunk with any of them; only the phrases' words are read.

        narrow filters postings before they are brought together.
        """
        words = sorted({w for p in phrases for w in p})
        met = self._postings(words, CELLS)
        met = narrow(met) if narrow else met
        loose = {w for p in phrases if len(p) > 1 for w in p}
        tf = [F.coalesce(F.max(F.when(F.col("term") == p[0], F.col("tf"))), F.lit(0)) if len(p) == 1 else F.lit(0) for p in phrases]
        at = {w: f"_at{k}" for k, w in enumerate(sorted(loose))}
        one = met.groupBy("chunk_id", *OWN, F.col("length").alias("_len")).agg(
            F.array(*tf).alias("_tf"), *[F.max(F.when(F.col("term") == w, F.col("positions"))).alias(c) for w, c in at.items()]
        )

        def often(phrase: tuple[str, ...]) -> Column:
            def follows(p: Column) -> Column:
                return reduce(lambda a, b: a & b, [F.array_contains(at[w], p + k) for k, w in enumerate(phrase[1:], 1)])

            found = F.size(F.filter(at[phrase[0]], follows))
            return F.when(reduce(lambda a, b: a & b, [F.col(at[w]).isNotNull() for w in phrase]), found).otherwise(0)

        if loose:
            one = one.withColumn("_tf", F.array(*[F.col("_tf")[k] if len(p) == 1 else often(p) for k, p in enumerate(phrases)]))
        return one.select("chunk_id", *OWN, "_len", "_tf").where(F.exists("_tf", lambda t: t > 0))

    def scored(self, words: list[str], part: Callable[[str], Column], narrow: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """chunk_id, OWN, score and terms of the chunks with any of the words: part says what one posting of a word adds (tf, length)."""
        met = self._postings(words, CELLS[:-1])
        met = narrow(met) if narrow else met
        of_word = F.coalesce(*[F.when(F.col("term") == w, part(w)) for w in words])
        return met.select("chunk_id", *OWN, of_word.alias("_part")).groupBy("chunk_id", *OWN).agg(F.sum("_part").alias("score"), F.count("*").cast("int").alias("terms"))

    def frequencies(self, phrases: list[tuple[str, ...]]) -> list[int]:
        """How many live chunks have each phrase."""
        single = {p[0] for p in phrases if len(p) == 1}
        plain = self._postings(sorted(single), ("item_id",)).groupBy("term").count().collect() if single else []  # a row a word
        found = {(r["term"],): r["count"] for r in plain}
        loose = [p for p in phrases if len(p) > 1]
        if loose:
            sums = self.counted(loose).agg(*[F.sum((F.col("_tf")[k] > 0).cast("long")) for k in range(len(loose))]).first()
            found |= {p: sums[k] or 0 for k, p in enumerate(loose)}
        return [found.get(p, 0) for p in phrases]
