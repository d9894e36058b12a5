"""Quality by interpolated modified Kneser-Ney models of trusted text: word pairs, and under them bytes.

Documents are stored in chunks of many.  A chunk asks for its distinct pairs and
words only, as sorted keys cut by shard and packed as the gaps between them; a
shard of the model answers each packet with a packed array in the same order.
So counts never come to one place, one key of a packet costs a few bytes, and
neither texts nor counts move: both are stored in buckets, packets and answers
travel between them.

1. Chunks send the pair counts of their trusted texts; the shards add them up
   and tell every chunk the whole count of its pairs and which of them it owns
   (one chunk owns a pair).
2. For the pairs it owns, a chunk sends what they add to their words: how many
   different words a word follows, and how many pairs of count one, two and more
   it begins.  The shards of words add that up.
3. Chunks ask for their words, and, in waves, for the pairs of other texts.
4. With its answers a chunk scores its documents on their whole texts.  A word
   with the white space after it has the probability of its pair, interpolated
   with that of the word over the words it follows, and that with its bytes,
   which have a Kneser-Ney model of their own (step 0: n-grams of a few bytes
   level off, so they are plain rows).  Most pairs of a document occur in it
   alone, so a trusted document is scored on the pair counts of the others.

A key has as many bits as the number of trusted words asks for, and ``doubt``
more: a pair that the model lacks is taken for another with a chance of at most
``2 ** -doubt``.  A packet has about ``chunk * shard / words`` keys, so shards
grow with the root of the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .common import Scratch, release, small_side, width_for
from .shingles import batches, word_counts, word_hashes
from .tokens import mixed


#: Bytes of an n-gram of the model under the words; a start of text counts as zero bytes.
ORDER = 4
#: Symbols that the uniform distribution under the single bytes spreads over.
SYMBOLS = 256


@dataclass(frozen=True)
class Settings:
    #: Bytes of text per chunk, about (a longer text is a chunk of its own).
    chunk: int = 32 << 20
    #: Trusted documents of a language that stay under the threshold.
    quantile: float = 0.99
    #: Bits of a key beyond those that number the trusted words.
    doubt: int = 12
    #: Words of all texts per shard of the model, about; more in a corpus of over 2 ** 38 words.
    shard: int = 1 << 21
    #: Parts of the corpus that ask for their pairs one after another.
    waves: int = 4


def pack(*columns: np.ndarray) -> bytes:
    """Arrays of one length, of non-negative numbers, byte plane by byte plane without the empty planes."""
    import zstandard

    parts = [np.uint32(len(columns[0])).tobytes()]
    for c in columns:
        wide = (int(c.max(initial=0)).bit_length() + 7) // 8
        parts += [bytes([wide]), np.ascontiguousarray(c.astype("<u8").view(np.uint8).reshape(-1, 8).T[:wide]).tobytes()]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def unpack(z: bytes) -> list[np.ndarray]:
    import zstandard

    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(z), np.uint8)
    n, at, out = int(data[:4].view("<u4")[0]), 4, []
    while at < len(data):
        wide = int(data[at])
        whole = np.zeros((n, 8), np.uint8)
        whole[:, :wide] = data[at + 1 : at + 1 + wide * n].reshape(wide, n).T
        out.append(whole.view("<u8").ravel())
        at += 1 + wide * n
    return out


def _gaps(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=keys.dtype.type(0))


@dataclass(frozen=True)
class Keys:
    """How words and pairs become keys of so many bits, and keys fall into 2 ** spread shards; words' shards come after the pairs'."""

    bits: int
    spread: int

    @staticmethod
    def of(words: int, trusted: int, s: Settings) -> Keys:
        spread = max(0, math.ceil(math.log2(max(1, words) / max(s.shard, 4 * math.isqrt(words)))))
        return Keys(min(64, max(spread, math.ceil(math.log2(trusted + 2)) + s.doubt)), spread)

    def pair(self, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        return mixed(before * np.uint64(0x9E3779B97F4A7C15) + word + np.uint64(1)) >> np.uint64(64 - self.bits)

    def pairs(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(pair, word before, word) of every word, and the number of words of each text; the word before the first is 0."""
        words, _, cuts = word_hashes(texts)
        word = words >> np.uint64(64 - self.bits)
        before = np.append(np.uint64(0), word)[:-1]
        before[cuts[:-1][np.diff(cuts) > 0]] = 0
        return self.pair(before, word), before, word, np.diff(cuts)

    def distinct(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The sorted distinct pairs of texts and how often each occurs."""
        found = [self.pairs(texts[i:j])[0] for i, j in batches(texts)]
        return np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)

    def spelled(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(word before, word) of the sorted distinct pairs of texts."""
        found = [self.pairs(texts[i:j])[:3] for i, j in batches(texts)]
        pair, before, word = (np.concatenate([np.zeros(0, np.uint64), *x]) for x in (zip(*found, strict=True) if found else [[]] * 3))
        at = np.unique(pair, return_index=True)[1]
        return before[at], word[at]

    def words(self, texts: list[bytes]) -> np.ndarray:
        """The sorted distinct words of texts and the 0 before the first."""
        found = [np.unique(word_hashes(texts[i:j])[0]) >> np.uint64(64 - self.bits) for i, j in batches(texts)]
        return np.unique(np.concatenate([np.zeros(1, np.uint64), *found]))

    def packets(self, keys: np.ndarray, *columns: np.ndarray, of_words: bool) -> Iterator[tuple[int, bytes]]:
        """(slot, packet) of the shards that sorted keys fall into."""
        edges = np.arange(1, 1 << self.spread, dtype=np.uint64) << np.uint64(self.bits - self.spread)
        cuts = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if b > a:
                yield (of_words << self.spread) + k, pack(_gaps(keys[a:b]), *[c[a:b] for c in columns])


_IDS = pa.list_(pa.int64())
CHUNK = pa.schema(
    {"chunk": pa.int64(), "wave": pa.int32(), "doc_ids": _IDS, "langs": pa.list_(pa.string()), "trusted": pa.list_(pa.bool_()), "sizes": _IDS, "words": pa.int64(), "trusted_words": pa.int64(), "z": pa.binary()}
)


def _chunks(docs: DataFrame, s: Settings) -> DataFrame:
    """Rows of many documents each, from doc_id, lang, trusted, text; -1 as the size of a null text."""
    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        press, task, number = zstandard.ZstdCompressor(level=9), TaskContext.get().partitionId(), 0
        rows, size = [], 0

        def one() -> pa.RecordBatch:
            ids, langs, trusted, texts = zip(*rows, strict=True)
            full = [t or b"" for t in texts]
            n = np.concatenate([word_counts(full[i:j]) for i, j in batches(full)])
            total, own = int(n.sum()), int(n[np.array(trusted)].sum())
            cells = [(task << 32) + number, (task + number) % s.waves, list(ids), list(langs), list(trusted), [-1 if t is None else len(t) for t in texts], total, own, press.compress(b"".join(full))]
            return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(cells, CHUNK, strict=True)], schema=CHUNK)

        for big in batches_:
            for top in range(0, big.num_rows, 256):
                for d, lang, trusted, text in zip(*[c.to_pylist() for c in big.slice(top, 256).columns], strict=True):
                    data = None if text is None else text.encode()
                    rows.append((d, lang, trusted, data))
                    size += len(data or b"")
                    if size >= s.chunk:
                        yield one()
                        rows, size, number = [], 0, number + 1
        if rows:
            yield one()

    return docs.mapInArrow(run, from_arrow_schema(CHUNK))


def _texts(z: bytes, sizes: list[int], of: list[bool] | None = None) -> list[bytes]:
    """The texts of a chunk, or those of the marked documents; null texts are empty."""
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(z)
    ends = np.cumsum(np.maximum(sizes, 0)).tolist()
    return [data[e - max(n, 0) : e] for k, (e, n) in enumerate(zip(ends, sizes, strict=True)) if of is None or of[k]]


PACKET = pa.schema({"slot": pa.int64(), "chunk": pa.int64(), "z": pa.binary()})


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


def _asked(chunks: DataFrame, packets: Callable[[list[bool], list[int], bytes], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """The packets that each chunk sends."""
    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_:
            for chunk, trusted, sizes, z in zip(*[c.to_pylist() for c in b.columns], strict=True):
                yield from _table([(slot, chunk, packet) for slot, packet in packets(trusted, sizes, z)], PACKET).to_batches()

    return chunks.select("chunk", "trusted", "sizes", "z").mapInArrow(run, from_arrow_schema(PACKET))


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(the n-gram that ends at each byte, text by text; bytes per text)."""
    pad = b"\0" * (ORDER - 1)
    data = np.frombuffer(b"".join(pad + t for t in texts), np.uint8).astype(np.uint32)
    lengths = np.array([len(t) for t in texts], np.int64)
    code = data.copy()
    for k in range(1, ORDER):
        code[k:] |= data[:-k] << np.uint32(8 * k)
    real = np.ones(len(data), bool)
    begin = np.cumsum(lengths + ORDER - 1) - (lengths + ORDER - 1)
    for k in range(ORDER - 1):
        real[begin + k] = False
    return code[real], lengths


def _grams_of(chunks: DataFrame, trusted_only: bool) -> DataFrame:
    """chunk, g, c: the n-grams of each chunk with how often they occur."""
    schema = pa.schema({"chunk": pa.int64(), "g": pa.int64(), "c": pa.int64()})

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_:
            for chunk, trusted, sizes, z in zip(*[c.to_pylist() for c in b.columns], strict=True):
                texts = _texts(z, sizes, trusted if trusted_only else None)
                found = [np.unique(grams(texts[i:j])[0], return_counts=True) for i, j in batches(texts)]
                if found:
                    g, back = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
                    c = np.bincount(back, np.concatenate([f[1] for f in found]), len(g)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), chunk)), pa.array(g.astype(np.int64)), pa.array(c)], schema=schema)

    return chunks.select("chunk", "trusted", "sizes", "z").mapInArrow(run, from_arrow_schema(schema))


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of 1, 2 and 3 or more, from how many occur once to four times; at least 0.01."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    wanted = (1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(d, 0.01), float(k)) for k, d in enumerate(wanted, 1))  # every order leaves something to the one below


def _discount(c: Column, d: tuple[float, float, float]) -> Column:
    return F.when(c == 1, d[0]).when(c == 2, d[1]).otherwise(d[2])


def probabilities(scratch: Scratch, counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """g and p for every wanted n-gram: interpolated modified Kneser-Ney over counts (g, c).

    Lower orders count the distinct n-grams one longer that end in theirs.  An
    n-gram after an unseen context has the probability of the order below; the
    order below unigrams is uniform.
    """
    tables = {ORDER: counts}
    for n in range(ORDER - 1, 0, -1):
        longer = tables[n + 1].select((F.col("g") % (1 << 8 * n)).alias("g"))
        tables[n] = scratch.write(longer.groupBy("g").agg(F.count("*").alias("c")), f"order-{n}")
    below: DataFrame | None = None
    for n in range(1, ORDER + 1):
        seen = {r["c"]: r["n"] for r in tables[n].where("c <= 4").groupBy("c").agg(F.count("*").alias("n")).collect()}
        d = discounts(*[seen.get(k, 0) for k in (1, 2, 3, 4)])
        context = (F.col("g") / 256).cast("long") if n > 1 else F.lit(0).cast("long")
        c = F.col("c")
        stats = tables[n].withColumn("u", context).groupBy("u").agg(F.sum("c").alias("total"), F.sum(_discount(c, d)).alias("spared"))
        asked = wanted.select((F.col("g") % (1 << 8 * n)).alias("g")).distinct().withColumn("u", context)
        joined = asked.join(tables[n], "g", "left").join(stats, "u", "left")
        if below is None:
            joined = joined.withColumn("q", F.lit(1.0 / SYMBOLS))
        else:
            joined = joined.withColumn("s", F.col("g") % (1 << 8 * (n - 1))).join(below, "s")
        own = (F.coalesce(c, F.lit(0)) - F.when(c.isNull(), 0.0).otherwise(_discount(c, d))) / F.col("total")
        p = F.when(F.col("total").isNull(), F.col("q")).otherwise(own + F.col("spared") / F.col("total") * F.col("q"))
        below = scratch.write(joined.select(F.col("g").alias("s"), p.alias("q")), f"p-{n}")
    return below.select(F.col("s").alias("g"), F.col("q").alias("p"))


def _byte_answers(requests: DataFrame, model: DataFrame) -> DataFrame:
    """Per chunk its n-grams and the bits of their probabilities."""

    def gather(group: pa.Table) -> pa.Table:
        g, p = group.column("g").to_numpy(), group.column("p").to_numpy()
        order = np.argsort(g)
        return _table([(0, group.column("chunk")[0].as_py(), pack(_gaps(g[order]), p[order].view(np.int64)))], PACKET)

    return requests.join(model, "g").groupBy("chunk").applyInArrow(gather, from_arrow_schema(PACKET))


#: A shard of the model (chunk is null) with how many of its counts are 1, 2, 3, 4, over 2, and their sum; or an answer to a chunk.
COUNTED = pa.schema([*PACKET, pa.field("n", _IDS)])


def _spectrum(c: np.ndarray) -> list[int]:
    return [*[int((c == k).sum()) for k in (1, 2, 3, 4)], int((c > 2).sum()), int(c.sum())]


def _pair_counts(packets: DataFrame) -> DataFrame:
    """The shards of pairs (keys, counts), and for each packet of counts (whole counts, whether owned)."""

    def add(group: pa.Table) -> pa.Table:
        slot, chunk, z = (group.column(c).to_pylist() for c in ("slot", "chunk", "z"))
        order = sorted(range(len(chunk)), key=chunk.__getitem__)
        parts = [unpack(z[k]) for k in order]
        keys = np.concatenate([np.cumsum(p[0]) for p in parts])
        keys, first, back = np.unique(keys, return_index=True, return_inverse=True)
        total = np.bincount(back, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)
        owned = np.zeros(len(back), np.int64)
        owned[first] = 1
        ends = np.cumsum([len(p[0]) for p in parts])
        rows = [(slot[0], None, pack(_gaps(keys), total), _spectrum(total))]
        for k, e, p in zip(order, ends.tolist(), parts, strict=True):
            a = e - len(p[0])
            rows.append((slot[0], chunk[k], pack(total[back[a:e]], owned[a:e]), None))
        return _table(rows, COUNTED)

    return packets.groupBy("slot").applyInArrow(add, from_arrow_schema(COUNTED))


def _rows(group: pa.Table) -> list[dict]:
    return sorted(group.to_pylist(), key=lambda r: r["slot"])


def _word_packets(chunks: DataFrame, answers: DataFrame, keys: Keys) -> DataFrame:
    """What the owned pairs of each chunk add to their words: (words, words followed, total, pairs of count 1, 2 and more begun)."""

    def meet(chunk: pa.Table, told: pa.Table) -> pa.Table:
        if not chunk.num_rows or not told.num_rows:
            return _table([], PACKET)
        r = chunk.to_pylist()[0]
        before, word = keys.spelled(_texts(r["z"], r["sizes"], r["trusted"]))
        total, owned = (np.concatenate(x) for x in zip(*[unpack(a["z"]) for a in _rows(told)], strict=True))
        own = owned > 0
        before, word, total = before[own], word[own], total[own]
        found, back = np.unique(np.concatenate([before, word]), return_inverse=True)
        b, w = back[: len(before)], back[len(before) :]
        add = lambda at, x: np.bincount(at, x, len(found)).astype(np.int64)
        columns = [add(w, np.ones(len(w))), add(b, total), *[add(b, x) for x in (total == 1, total == 2, total > 2)]]
        return _table([(slot, r["chunk"], z) for slot, z in keys.packets(found, *columns, of_words=True)], PACKET)

    return chunks.select("chunk", "trusted", "sizes", "z").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(meet, from_arrow_schema(PACKET))


def _word_counts(packets: DataFrame) -> DataFrame:
    """The shards of words: what the packets add up to."""

    def add(group: pa.Table) -> pa.Table:
        parts = [unpack(z) for z in group.column("z").to_pylist()]
        keys, back = np.unique(np.concatenate([np.cumsum(p[0]) for p in parts]), return_inverse=True)
        columns = [np.bincount(back, np.concatenate(c), len(keys)).astype(np.int64) for c in list(zip(*parts, strict=True))[1:]]
        return _table([(group.column("slot")[0].as_py(), None, pack(_gaps(keys), *columns), _spectrum(columns[0]))], COUNTED)

    return packets.groupBy("slot").applyInArrow(add, from_arrow_schema(COUNTED))


def _answers(packets: DataFrame, model: DataFrame, many: int) -> DataFrame:
    """For each packet of keys the model's columns (so many) in its order; zeros for unknown keys."""

    def meet(asked: pa.Table, known: pa.Table) -> pa.Table:
        keys, *columns = unpack(known.column("z")[0].as_py()) if known.num_rows else [np.zeros(0, np.uint64)] * (many + 1)
        keys, rows = np.cumsum(keys), []
        for slot, chunk, z in zip(*[asked.column(c).to_pylist() for c in ("slot", "chunk", "z")], strict=True):
            wanted = np.cumsum(unpack(z)[0])
            rows.append((slot, chunk, pack(*[looked_up(keys, c, wanted) for c in columns])))
        return _table(rows, PACKET)

    return packets.groupBy("slot").cogroup(model.select("slot", "z").groupBy("slot")).applyInArrow(meet, from_arrow_schema(PACKET))


def looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """values of the wanted keys, 0 where there is none; both are sorted."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0).astype(np.int64)


class Places:
    """Where keys stand among sorted keys of so many evenly spread bits: the first bits say where to look, and few steps remain."""

    def __init__(self, keys: np.ndarray, bits: int):
        top = min(bits, max(1, (2 * len(keys)).bit_length()))
        self.shift = keys.dtype.type(bits - top)
        self.first = np.searchsorted(keys, np.arange(1 << top, dtype=keys.dtype) << self.shift).astype(np.int32)
        self.keys = np.append(keys, keys.dtype.type(np.iinfo(keys.dtype).max))

    def of(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each wanted key; all of them must be there."""
        at = self.first[wanted >> self.shift]
        behind = np.flatnonzero(self.keys[at] < wanted)
        while len(behind):
            at[behind] += 1
            behind = behind[self.keys[at[behind]] < wanted[behind]]
        return at


@dataclass(frozen=True)
class Numbers:
    """Discounts of pairs and of words, the number of distinct pairs, and what words spare of it for their bytes."""

    pair: tuple[float, float, float]
    word: tuple[float, float, float]
    total: float
    spared: float


def _numbers(model: DataFrame, words: DataFrame) -> Numbers:
    def of(df: DataFrame) -> list[int]:
        return [x or 0 for x in df.agg(*[F.sum(F.col("n")[k]) for k in range(6)]).first()]

    pair, word = of(model), of(words)
    d = discounts(*word[:4])
    return Numbers(discounts(*pair[:4]), d, float(word[5]), d[0] * word[0] + d[1] * word[1] + d[2] * word[4])


def _off(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    """The discount of each count; none of 0."""
    return np.array([0.0, *d])[np.clip(c, 0, 3).astype(np.int64)]


def word_logs(c: np.ndarray, follows: np.ndarray, total: np.ndarray, spared: np.ndarray, base: np.ndarray, n: Numbers, own: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Logarithms of the probabilities of words.

    Per word: the count of its pair, the words it follows, the count of the word
    before, what its pairs spare, and the logarithm of its bytes.  own: pair,
    word before and word, of one text that is in the counts and is taken out of
    them.
    """
    words_total, words_spared = n.total, n.spared
    if own is not None:
        g, u, w = own
        _, at, back, mine = np.unique(g, return_index=True, return_inverse=True, return_counts=True)
        full, rest = c[at], c[at] - mine
        _, u_of = np.unique(u, return_inverse=True)
        _, one, w_of = np.unique(w, return_index=True, return_inverse=True)
        total = total - np.bincount(u_of)[u_of]
        spared = spared - np.bincount(u_of[at], _off(full, n.pair) - _off(rest, n.pair), u_of.max() + 1)[u_of]
        left = follows - np.bincount(w_of[at], rest <= 0, w_of.max() + 1)[w_of]
        words_total -= float((rest <= 0).sum())
        words_spared -= float((_off(follows[one], n.word) - _off(left[one], n.word)).sum())
        c, follows = rest[back], left
    with np.errstate(divide="ignore", invalid="ignore"):
        some = words_total > 0
        p = (follows - _off(follows, n.word)) / words_total if some else np.zeros(len(c))
        to_bytes = words_spared / words_total if some else 1.0
        seen = total > 0
        to_word = np.where(seen, spared / total, 1.0)
        return np.logaddexp(np.log(np.where(seen, (c - _off(c, n.pair)) / total, 0.0) + to_word * p), np.log(to_word * to_bytes) + base)


#: Spreads the numbers of n-grams evenly over 32 bits.
_SPREAD = np.uint32(0x9E3779B1)


@dataclass(frozen=True)
class Known:
    """What a chunk was told.  Places of its n-grams (spread), of the pairs of its other and its trusted texts and of its words, and

    the logarithms of n-grams, the counts of pairs, and of words: those followed, the total, pairs of 1, 2 and more begun.
    """

    grams: Places
    logs: np.ndarray
    pairs: tuple[Places, Places]
    counts: tuple[np.ndarray, np.ndarray]
    words: Places
    columns: list[np.ndarray]


def perplexities(texts: list[bytes], trusted: np.ndarray, keys: Keys, known: Known, n: Numbers) -> np.ndarray:
    """Per byte; nan for an empty text."""
    out = np.full(len(texts), np.nan)
    full = np.array([k for k, t in enumerate(texts) if t], np.int64)
    follows, total, *begun = known.columns
    spares = sum(d * b.astype(float) for d, b in zip(n.pair, begun, strict=True))
    for i, j in batches([texts[k] for k in full]):
        some, own = [texts[k] for k in full[i:j]], trusted[full[i:j]]
        code, sizes = grams(some)
        logs, ends = known.logs[known.grams.of(code * _SPREAD)], np.cumsum(sizes)
        g, u, w, length = keys.pairs(some)
        start = word_hashes(some)[1] - np.repeat(np.arange(len(some)), length)  # in the texts without separators
        bounds = np.union1d(start, ends - sizes)
        sums = np.add.reduceat(logs, bounds)
        is_word = np.isin(bounds, start, assume_unique=True)
        if len(g):
            mine, c = np.repeat(own, length), np.zeros(len(g), np.int64)
            for k, of in enumerate((~mine, mine)):
                c[of] = known.counts[k][known.pairs[k].of(g[of])]
            at = known.words.of(w)
            before = np.append(0, at[:-1])
            before[u == 0] = 0  # the sorted words begin with the 0 before the first
            cells = c, follows[at], total[before], spares[before], sums[is_word]
            scored, stops = word_logs(*cells, n), np.cumsum(length)
            for k in np.flatnonzero(own & (length > 0)).tolist():
                part = slice(int(stops[k] - length[k]), int(stops[k]))
                scored[part] = word_logs(*[x[part] for x in cells], n, (g[part], u[part], w[part]))
            sums[is_word] = scored
        out[full[i:j]] = np.exp(-np.add.reduceat(sums, np.searchsorted(bounds, ends - sizes)) / sizes)
    return out


SCORED = pa.schema({"doc_id": pa.int64(), "lang": pa.string(), "trusted": pa.bool_(), "perplexity": pa.float64()})
OTHERS, TRUSTED, WORDS, BYTES = 0, 1, 2, 3


def _score(chunks: DataFrame, answers: DataFrame, keys: Keys, n: Numbers) -> DataFrame:
    """A row per document of the chunks; answers: chunk, kind, slot, z."""

    def meet(chunk: pa.Table, told: pa.Table) -> pa.Table:
        rows, answered = [], _rows(told)

        def columns(kind: int, many: int) -> list[np.ndarray]:
            parts = [unpack(a["z"]) for a in answered if a["kind"] == kind]
            return [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * many

        for r in chunk.to_pylist():
            texts, trusted = _texts(r["z"], r["sizes"]), np.array(r["trusted"], bool)
            pairs = [keys.distinct([t for t, ok in zip(texts, trusted, strict=True) if ok == mine])[0] for mine in (False, True)]
            code, p = columns(BYTES, 2)
            code = np.cumsum(code.astype(np.uint64)).astype(np.uint32) * _SPREAD
            order = np.argsort(code)
            known = Known(
                Places(code[order], 32), np.log(p.view(np.float64))[order], tuple(Places(x, keys.bits) for x in pairs), (columns(OTHERS, 1)[0].astype(np.int64), columns(TRUSTED, 2)[0].astype(np.int64)),
                Places(keys.words(texts), keys.bits), [c.astype(np.int64) for c in columns(WORDS, 5)],
            )
            found = perplexities(texts, trusted, keys, known, n).tolist()
            rows += [(d, v, t, None if math.isnan(p) else p) for d, v, t, p in zip(r["doc_ids"], r["langs"], r["trusted"], found, strict=True)]
        return _table(rows, SCORED)

    wanted = chunks.select("chunk", "doc_ids", "langs", "trusted", "sizes", "z")
    return wanted.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(meet, from_arrow_schema(SCORED))


def perplexity(scratch: Scratch, docs: DataFrame, width: int, s: Settings) -> DataFrame:
    """doc_id, lang, trusted, perplexity of docs (doc_id, lang, trusted, text), stored; width: buckets of texts and of counts."""
    chunks = scratch.bucketed(_chunks(docs, s), "chunks", "chunk", width, "wave")
    size = chunks.agg(F.sum("words"), F.sum("trusted_words")).first()
    keys = Keys.of(size[0] or 0, size[1] or 0, s)

    def counts(trusted, sizes, z):
        return keys.packets(*keys.distinct(_texts(z, sizes, trusted)), of_words=False)

    def pairs(trusted, sizes, z):
        return keys.packets(keys.distinct(_texts(z, sizes, [not t for t in trusted]))[0], of_words=False)

    def words(trusted, sizes, z):
        return keys.packets(keys.words(_texts(z, sizes)), of_words=True)

    counts_of = _grams_of(chunks.where("trusted_words > 0"), True).groupBy("g").agg(F.sum("c").alias("c"))
    requests = scratch.write(_grams_of(chunks, False).select("chunk", "g"), "requests")
    spelling = scratch.write(_byte_answers(requests, probabilities(scratch, scratch.write(counts_of, "counts"), requests)), "spelling")
    release(docs.sparkSession)
    learned = scratch.bucketed(_pair_counts(_asked(chunks.where("trusted_words > 0"), counts)), "pairs", "slot", width)
    release(docs.sparkSession)
    model, told = learned.where("chunk IS NULL"), learned.where("chunk IS NOT NULL").select("slot", "chunk", "z")
    contexts = scratch.bucketed(_word_counts(_word_packets(chunks.where("trusted_words > 0"), told, keys)), "words", "slot", width)
    release(docs.sparkSession)
    answers = told.withColumn("kind", F.lit(TRUSTED))
    stored = scratch.write(_answers(_asked(chunks, words), contexts, 5), "word-answers")
    answers = answers.unionByName(stored.withColumn("kind", F.lit(WORDS))).unionByName(spelling.withColumn("kind", F.lit(BYTES)))
    for wave in range(s.waves):
        release(docs.sparkSession)
        part = scratch.write(_answers(_asked(chunks.where(F.col("wave") == wave), pairs), model, 1), f"answers-{wave}")
        answers = answers.unionByName(part.withColumn("kind", F.lit(OTHERS)))
    release(docs.sparkSession)
    return scratch.write(_score(chunks, answers, keys, _numbers(model, contexts)), "scored")


def classify(spark: SparkSession, docs: DataFrame, trusted_ids: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, lang, trusted, perplexity (per byte), threshold, keep: a row per document.

    docs: doc_id, lang, text; trusted_ids: doc_id.  The threshold is the
    quantile of the trusted documents' perplexity in the language (a null
    language is one of its own), or of all trusted ones where a language has
    none.  Null and empty texts have a null perplexity and are not kept; without
    trusted text all bytes are equally likely and thresholds are null, so
    nothing is kept; repeated rows are scored each;
    texts of any length are scored whole; no rows give no rows; other columns
    are not read.
    """
    scratch = Scratch(spark, "quality")
    ids = trusted_ids.select(F.col("doc_id").alias("_id")).where("_id IS NOT NULL").distinct()
    marked = docs.select("doc_id", "lang", "text").join(small_side(ids), F.col("doc_id") == F.col("_id"), "left")
    width = width_for(docs.select("doc_id", "lang", "text"), 64 << 20)
    scored = perplexity(scratch, marked.select("doc_id", "lang", F.col("_id").isNotNull().alias("trusted"), "text"), width, s)
    good = scored.where("trusted AND perplexity IS NOT NULL")
    quantile = F.percentile_approx("perplexity", F.lit(s.quantile), F.lit(10_000))
    per_lang = good.groupBy(F.col("lang").alias("_lang")).agg(quantile.alias("_own"))  # a row per language
    over_all = good.agg(quantile.alias("_all"))
    found = scored.join(per_lang, F.col("lang").eqNullSafe(F.col("_lang")), "left").join(F.broadcast(over_all))  # one row
    threshold = F.coalesce("_own", "_all")
    keep = F.coalesce(F.col("perplexity") <= threshold, F.lit(False))
    return found.select("doc_id", "lang", "trusted", "perplexity", threshold.alias("threshold"), keep.alias("keep"))
