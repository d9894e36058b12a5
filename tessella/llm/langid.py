"""Language identification: averaged hashed subword embeddings under a linear softmax.

Character n-grams of the lower-cased text (everything but letters is one blank)
hash into buckets; a text is the mean of its buckets' embeddings.  Embeddings
and softmax are trained by stochastic gradient descent in NumPy on a bounded
sample of labelled documents; a temperature and the score below which a text is
rejected come from a part of the sample that the training does not see.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import tidy

UNKNOWN = "und"
#: Texts that the driver looks at together when it fits.
FIT_BATCH = 64
#: How many times the wanted sample of a language is ranked to find it.
SPARE = 4


@dataclass(frozen=True)
class Settings:
    """sample: distinct labelled texts per language, at most; sample_chars: longer ones are sampled only where these are too few,

    long_chars characters of them per language at most (all documents are predicted whole).  total_chars: of all sampled texts together,
    shared alike by the languages.
    """

    sample: int = 600
    sample_chars: int = 20_000
    long_chars: int = 1_000_000
    total_chars: int = 64_000_000
    grams: tuple[int, ...] = (1, 2, 3)
    buckets: int = 1 << 15
    dim: int = 16
    epochs: int = 6
    rate: float = 4.0
    calibration: float = 0.25
    #: Share of well-predicted calibration texts that rejection may cost, at most.
    alpha: float = 0.001
    seed: int = 7


_LETTERS: np.ndarray | None = None


def letters() -> np.ndarray:
    """For every code point: whether it is a letter."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTERS


def grams(texts: list[str], s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of all n-grams, text by text; number of them per text; whether the text has a letter)."""
    lower = [t.lower() + "\n" for t in texts]
    lengths = np.array([len(t) for t in lower], np.int64)
    codes = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    known = letters()[codes]
    codes = np.where(known, codes, np.uint32(32))
    ends = np.cumsum(lengths)
    has = np.add.reduceat(known, ends - lengths).astype(bool) if len(texts) else np.zeros(0, bool)
    parts, counts = [], []
    h, mask = np.zeros(len(codes), np.uint32), np.zeros(len(codes), bool)
    for n in range(1, max(s.grams) + 1):
        m = len(codes) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint32(0x01000193) + codes[n - 1 :] * np.uint32(0x9E3779B1) + np.uint32(n)
        mask = mask[:m] | known[n - 1 :]
        if n in s.grams:
            whole = mask.copy()  # some letter in it, and no text's end inside it
            for e in range(n - 1):
                cut = ends[:-1] - 1 - e
                whole[cut[(cut >= 0) & (cut < m)]] = False
            at = np.flatnonzero(whole)
            b = h[at] ^ (h[at] >> np.uint32(15))
            parts.append((b * np.uint32(0x85EBCA6B) >> np.uint32(7)) % np.uint32(s.buckets))
            counts.append(np.diff(np.searchsorted(at, np.append(0, ends))))
    total = np.sum(counts, axis=0) if counts else np.zeros(len(texts), np.int64)
    if len(parts) < 2:
        return (parts[0] if parts else np.zeros(0, np.uint32)), total, has
    order = np.argsort(np.concatenate([np.repeat(np.arange(len(texts)), c) for c in counts]), kind="stable")
    return np.concatenate(parts)[order], total, has


def mean_scores(table: np.ndarray, texts: list[str], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """The mean row of table over each text's n-grams; whether it has a letter."""
    sums, total, has = np.zeros((len(texts), table.shape[1])), np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
    for n in s.grams:
        b, c, has = grams(texts, Settings(**{**s.__dict__, "grams": (n,)}))
        full = np.flatnonzero(c)
        if len(full):
            starts = (np.cumsum(c) - c)[full]
            sums[full] += np.add.reduceat(table[b], starts, axis=0)
        total += c
    return sums / np.maximum(total, 1)[:, None], has


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # buckets x languages: embedding times softmax weights
    bias: np.ndarray
    temperature: float
    threshold: float
    settings: Settings

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language or und, calibrated score, whether rejected) per text."""
        if not self.languages or not texts:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        mean, has = mean_scores(self.table, texts, self.settings)
        p = softmax((mean + self.bias) / self.temperature)
        best = p.argmax(axis=1)
        score = np.where(has, p[np.arange(len(p)), best], 0.0)
        names = [self.languages[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), has.tolist(), strict=True)]
        return names, score, ~has | (score < self.threshold)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(texts: list[str], labels: list[str], s: Settings) -> Model:
    languages = sorted(set(labels))
    rng = np.random.default_rng(s.seed)
    if not languages:
        return Model([], np.zeros((s.buckets, 0), np.float32), np.zeros(0), 1.0, 1.0, s)
    y = np.array([languages.index(v) for v in labels])
    bags, total = [], []
    for at in range(0, len(texts), FIT_BATCH):  # few texts at a time: the driver holds distinct buckets only
        flat, found, _ = grams(texts[at : at + FIT_BATCH], s)
        bags += [tuple(x.astype(np.uint32) for x in np.unique(r, return_counts=True)) for r in np.split(flat, np.cumsum(found)[:-1])]
        total += found.tolist()
    order = rng.permutation(len(texts))
    held = set(order[: int(len(texts) * s.calibration)].tolist()) if len(texts) >= 8 else set()
    train = [i for i in order.tolist() if i not in held and total[i]]
    emb = rng.normal(0, 1 / s.dim, (s.buckets, s.dim)).astype(np.float32)
    soft, bias = np.zeros((s.dim, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    steps, done = max(1, s.epochs * len(train)), 0
    for _ in range(s.epochs):
        for i in rng.permutation(train).tolist() if train else []:
            rate = s.rate * (1 - done / steps) + 1e-3
            done += 1
            ids, n = bags[i]
            w = (n / total[i]).astype(np.float32)
            mean = w @ emb[ids]
            p = softmax((mean @ soft + bias)[None])[0]
            p[y[i]] -= 1
            grad = soft @ p
            soft -= rate * 0.1 * np.outer(mean, p)
            bias -= rate * 0.1 * p
            emb[ids] -= rate * np.outer(w, grad)
    model = Model(languages, emb @ soft, bias.astype(np.float64), 1.0, 0.0, s)
    check = sorted(held) or train
    if check:
        parts = [mean_scores(model.table, [texts[i] for i in check[at : at + FIT_BATCH]], s) for at in range(0, len(check), FIT_BATCH)]
        mean, has = (np.concatenate(x) for x in zip(*parts, strict=True))
        z, truth = (mean + model.bias)[has], y[check][has]
        if len(z):
            at = np.arange(len(z))
            tries = np.geomspace(0.05, 20, 60)
            model.temperature = float(min(tries, key=lambda t: -np.log(softmax(z / t)[at, truth] + 1e-12).mean()))
            p = softmax(z / model.temperature)
            right = np.sort(p[at, truth][p.argmax(axis=1) == truth])
            # rejection costs at most alpha of the right ones, and never takes a text that is more likely right than not
            model.threshold = float(min(0.4, right[int(s.alpha * len(right))])) if len(right) else 0.0
    return model


def sample(docs: DataFrame, s: Settings) -> list[tuple[str, str]]:
    """(text, lang) of at most s.sample distinct labelled texts per language, by seeded hash; bounded, so the driver may hold it.

    A language with too few texts of at most s.sample_chars takes its shortest longer ones too, of s.long_chars together.
    Where even the only one is longer than that, its beginning is taken, so that no labelled language is left out.
    Equal texts count once; texts that tie in the hash are taken together; without labelled texts the sample is empty.
    """
    fit_rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    order, size = F.xxhash64(F.lit(s.seed), F.col("text")), F.length("text")
    longer = F.when(size > s.sample_chars, size).otherwise(0)  # 0 for those that come first
    hashed = fit_rows.select("lang", longer.alias("_long"), order.alias("_h"), size.alias("_size"))
    # hashes are spread evenly: where short texts abound, those under a hash that leaves SPARE times as many as wanted are enough
    short = hashed.groupBy("lang").agg(F.approx_count_distinct(F.when(F.col("_long") == 0, F.col("_h"))).alias("n")).collect()  # a row per language
    last = {r["lang"]: int(-(1 << 63) + (1 << 64) * SPARE * s.sample / r["n"]) for r in short if r["n"] > 2 * SPARE * s.sample}
    if last:
        cut = F.create_map(*[F.lit(x) for kv in last.items() for x in kv])[F.col("lang")]
        hashed = hashed.where(cut.isNull() | (F.col("_long") == 0) & (F.col("_h") <= cut))
    of_lang = Window.partitionBy("lang").orderBy("_long", "_h")
    ranked = hashed.distinct().withColumn("_n", F.row_number().over(of_lang)).where(F.col("_n") <= s.sample).select("lang", "_long", "_h", "_size", "_n").collect()
    limits: dict[str, tuple[int, int]] = {}
    long_left, left, ended = {}, {}, set()
    share = s.total_chars // max(1, len({r["lang"] for r in ranked}))
    for lang, n, h, chars, _ in sorted(ranked, key=lambda r: (r["lang"], r["_n"])):
        long_left[lang] = long_left.get(lang, min(s.long_chars, share)) - n
        left[lang] = left.get(lang, share) - min(chars, s.sample_chars)
        ended |= {lang} if long_left[lang] < 0 or left[lang] < 0 else set()
        if lang not in ended or lang not in limits:
            limits[lang] = (n, h)
    if not limits:
        return []
    wanted = [(F.col("lang") == F.lit(lang)) & ((longer < n) | (longer == n) & (order <= F.lit(h))) for lang, (n, h) in limits.items()]
    clause: Column = wanted[0]
    for w in wanted[1:]:
        clause = clause | w
    rows = fit_rows.where(clause).select(F.substring("text", 1, max(s.sample_chars, s.long_chars)).alias("text"), "lang").distinct().collect()
    return sorted((r["text"], r["lang"]) for r in rows)


def train(docs: DataFrame, s: Settings = Settings()) -> Model:
    rows = sample(docs, s)
    return fit([t for t, _ in rows], [v for _, v in rows], s)


def predict(spark: SparkSession, docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred, score and rejected.

    Whole texts, however long.  A null text, an empty one and one without a
    letter give und with score 0 and are rejected; repeated rows each get their
    prediction; an empty table stays empty.  Only the text column is read for a
    prediction.  Columns of docs named like the three new ones are replaced; all
    other names are free.
    """
    held = spark.sparkContext.broadcast(model)  # buckets x languages numbers
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    base = docs.select(F.struct(F.lit(None).cast("int").alias("_"), *[F.col(c) for c in kept if c != text]).alias("doc"), F.col(text).alias("text"))  # texts pass once
    out = T.StructType([*base.schema.fields, *T.StructType.fromDDL("lang_pred string, score double, rejected boolean").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 256):
                b = big.slice(at, 256)
                names, score, rejected = held.value.predict([x or "" for x in b.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names, pa.string()), pa.array(score), pa.array(rejected)], names=out.names)

    return base.mapInArrow(tidy(run), out).select(*[F.col("text").alias(c) if c == text else F.col("doc")[c].alias(c) for c in kept], "lang_pred", "score", "rejected")


def held_out(doc_id: Column) -> Column:
    """Documents whose crc32 of the id as text leaves 2 modulo 4: never trained on."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))
