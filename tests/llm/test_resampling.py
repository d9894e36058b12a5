import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessella.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def buckets_of(text):
    words = WORD.findall((text or "").translate(LOWER))
    grams = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return [zlib.crc32(g.encode()) % 10_000 for g in grams], len(words)


def plain(docs, target):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(buckets_of(text)[0])
    for text in target:
        t.update(buckets_of(text)[0])
    big, small = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big + 10_000) / ((s[b] + 1) * (small + 10_000)))) for b in range(10_000)]
    rows = []
    for doc, text in docs:
        found, words = buckets_of(text)
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        rows.append([doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(able[: 5 * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def texts(seed, n):
    rng = random.Random(seed)
    made = ["".join(rng.choice("abzABZ0189  .,-é→字 \n") for _ in range(rng.choice([0, 1, 5, 200, 900]))) for _ in range(n)]
    return [None, "", " ", "one", "one two", "A" * 200 + " b " + "c" * 63 + " " + "d" * 64 + "é" * 300, *made]


@pytest.mark.parametrize("lengths", [(0, 1, 7, 63, 64, 65, 200, 5000)])
def test_crcs_of_strings_in_a_row(lengths):
    rng = random.Random(1)
    for m in lengths:
        for n in lengths:
            a, b = rng.randbytes(m), rng.randbytes(n)
            got = resampling.combined(np.array([zlib.crc32(a)], np.uint32), np.array([zlib.crc32(b)], np.uint32), np.array([n]))
            assert int(got[0]) == zlib.crc32(a + b)


@pytest.mark.parametrize("block", [7, 64, 1 << 20])
def test_features_equal_those_of_written_out_ngrams(block, monkeypatch):
    monkeypatch.setattr(resampling, "BLOCK", block)
    rows = texts(3, 40)
    grams, docs, words = resampling.features(pa.array(rows), resampling.Settings())
    for k, text in enumerate(rows):
        want, n = buckets_of(text)
        assert words[k] == n
        assert np.concatenate([g[d == k] for g, d in zip(grams, docs, strict=True)]).tolist() == want


def test_whole_result_equals_the_plain_version(spark):
    rows = [*enumerate(texts(5, 400)), (None, "x y z " * 20), (7, "again " * 30), (7, "again " * 30)]
    target = [None, "", *texts(6, 20)]
    docs = spark.createDataFrame([(a, b, 1, "c") for a, b in rows], "doc_id long, text string, weight int, rank string").repartition(3)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(spark, docs, wanted, ["doc_id", "weight", "rank"])
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    found = got.collect()
    want = plain(rows, target)
    assert sorted((tuple(r) for r in found), key=str) == want
    drawn = sorted((r.rank for r in found if r.rank is not None))
    assert drawn == list(range(1, len(drawn) + 1)) and len(drawn) > 5


def test_empty_tables_and_clashing_names(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([("a", "b c", 5, 6)], "doc_id string, text string, kept int, n_words int")
    assert resampling.resample(spark, none, some, ["doc_id"]).count() == 0
    row = resampling.resample(spark, some, none, ["doc_id", "kept", "n_words"]).collect()
    assert [(r.doc_id, r.kept, r.n_words, r.n_features, r["rank"]) for r in row] == [("a", 5, 6, 3, None)]
