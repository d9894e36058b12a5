import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tessella.llm import quality


def of_bytes(texts):
    """A plain interpolated modified Kneser-Ney model of four bytes."""
    n = quality.ORDER
    tables = {n: Counter()}
    for t in texts:
        t = b"\0" * (n - 1) + t
        for i in range(n - 1, len(t)):
            tables[n][t[i - n + 1 : i + 1]] += 1
    for k in range(n - 1, 0, -1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    disc, total, spared = {}, {}, {}
    for k, table in tables.items():
        disc[k] = Plain.discounts(Counter(table.values()))
        total[k], spared[k] = Counter(), Counter()
        for g, v in table.items():
            total[k][g[:-1]] += v
            spared[k][g[:-1]] += disc[k][min(v, 3)]

    def p(g):
        k = len(g)
        lower = p(g[1:]) if k > 1 else 1 / quality.SYMBOLS
        if not total[k][g[:-1]]:
            return lower
        v = tables[k][g]
        return (v - disc[k][min(v, 3)]) / total[k][g[:-1]] + spared[k][g[:-1]] / total[k][g[:-1]] * lower

    return p


class Plain:
    """A plain interpolated modified Kneser-Ney model of word pairs; held: the texts counted, of which one may be left out."""

    def __init__(self, texts):
        self.texts = [t.split() for t in texts]
        self.counts = self.count(self.texts)
        self.d = self.discounts(Counter(self.counts.values()))
        self.dw = self.discounts(Counter(Counter(w for _, w in self.counts).values()))
        self.byte = of_bytes([t.encode() for t in texts])

    @staticmethod
    def count(texts):
        return Counter((u, w) for t in texts for u, w in zip([None, *t], t))

    @staticmethod
    def discounts(c):
        n1, n2, n3, n4 = c[1], c[2], c[3], c[4]
        y = n1 / (n1 + 2 * n2) if n1 else 0
        d = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
        return [0.0] + [min(max(x, 0.01), i) for i, x in enumerate(d, 1)]

    def perplexity(self, text, own):
        words, held = text.split(), list(self.texts)
        if own:
            held.remove(words)
        counts = self.count(held)
        follows = Counter(w for _, w in counts)
        pairs, spared = sum(follows.values()), sum(self.dw[min(v, 3)] for v in follows.values())
        padded = b"\0\0\0" + text.encode()
        spelled = [self.byte(padded[i : i + 4]) for i in range(len(padded) - 3)]
        places = [m.start() for m in re.finditer(r"\S+", text)]
        logs = sum(map(math.log, spelled[: places[0]]))
        for u, w, a, e in zip([None, *words], words, places, [*places[1:], len(text)]):
            p = max(follows[w] - self.dw[min(follows[w], 3)], 0) / pairs if pairs else 0.0
            p += (spared / pairs if pairs else 1.0) * math.prod(spelled[a:e])
            of_u = [v for (a, _), v in counts.items() if a == u]
            if of_u:
                c = counts[u, w]
                p = (c - self.d[min(c, 3)]) / sum(of_u) + sum(self.d[min(v, 3)] for v in of_u) / sum(of_u) * p
            logs += math.log(p)
        return math.exp(-logs / len(text))


@pytest.mark.parametrize("s", [quality.Settings(chunk=40, shard=4, waves=3, doubt=30), quality.Settings(doubt=40)])
def test_against_a_plain_model(spark, s):
    rng = random.Random(3)
    good = ["the cat sat on the mat", "the dog sat on the log and the cat ran", "a cat and a dog", "un chat sur le tapis", "  a dog\n"]
    good += [" ".join(rng.choices("abcdefgh", k=rng.randint(1, 30))) for _ in range(40)]
    rows = [(i, t, "en", "x") for i, t in enumerate(good)]
    rows += [(100, "zzqq xxkk 123 zzqq", "en", "x"), (101, None, "en", "x"), (102, "", None, "x"), (103, "le chat", None, "x"), (104, " \t", "en", "x"), (105, "a b c a cat sat", "en", "x"), (0, good[0], "en", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, chunk string").repartition(3)
    trusted = spark.createDataFrame([(i,) for i in range(len(good))] + [(0,), (None,)], "doc_id long")
    got = quality.classify(spark, docs, trusted, s).collect()
    model = Plain([*good, good[0]])
    assert len(got) == len(rows)
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        if not texts[r.doc_id]:
            assert r.perplexity is None and not r.keep
            continue
        if not texts[r.doc_id].split():
            assert r.perplexity > 0
            continue
        want = model.perplexity(texts[r.doc_id], r.doc_id < 100)
        assert r.trusted == (r.doc_id < 100) and abs(want - r.perplexity) < 1e-9 * want
        assert r.keep == (r.perplexity <= r.threshold)


def test_no_documents_and_none_trusted(spark):
    docs = spark.createDataFrame([(1, "a b", "en"), (2, None, None)], "doc_id long, text string, lang string")
    assert quality.classify(spark, docs.limit(0), docs.select("doc_id")).count() == 0
    got = quality.classify(spark, docs, docs.select("doc_id").limit(0)).collect()
    assert {r.keep for r in got} == {False} and {r.threshold for r in got} == {None}


def test_scrambled_words_are_not_kept(spark):
    rng = random.Random(5)
    names = ["".join(rng.choices("abcdeimnorst", k=rng.randint(3, 7))) for _ in range(60)]
    after = {w: rng.sample(names, 2) for w in names}

    def walk():
        out = [rng.choice(names)]
        while len(out) < 80:
            out.append(rng.choice(after[out[-1]]))
        return out

    clean = [walk() for _ in range(160)]
    texts = [" ".join(w) for w in clean] + [" ".join(rng.sample(w, len(w))) for w in clean[120:]]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    trusted = spark.createDataFrame([(i,) for i in range(120)], "doc_id long")
    got = {r.doc_id: r for r in quality.classify(spark, docs, trusted, quality.Settings(chunk=4000)).collect()}
    assert len(got) == 200
    assert not any(got[i].keep for i in range(160, 200))
    assert sum(got[i].keep for i in range(120, 160)) >= 36


def test_packets_come_back_as_they_were():
    rng = np.random.default_rng(1)
    for n, most in ((0, 1), (1, 1), (1000, 1 << 63), (5000, 200)):
        columns = [rng.integers(0, most, n, dtype=np.uint64), np.zeros(n, np.int64), rng.integers(0, 3, n)]
        assert all((a == b).all() for a, b in zip(quality.unpack(quality.pack(*columns)), columns, strict=True))
