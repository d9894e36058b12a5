import hashlib
import random

import numpy as np
import pytest

from tessella.llm import common, suffixes


def brute(texts, length):
    seen = {}
    for k, t in enumerate(texts):
        for i in range(len(t) - length + 1):
            seen.setdefault(t[i : i + length], []).append((k, i))
    gone = [np.zeros(len(t), bool) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for k, i in places:
                gone[k][i : i + length] = True
    out = []
    for t, g in zip(texts, gone):
        kept = bytes(np.frombuffer(t, np.uint8)[~g]) if t else b""
        runs = int((np.diff(g.astype(int), prepend=0) == 1).sum())
        out.append((len(t), int(g.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)

    def words(n):
        return " ".join("".join(rng.choices("abcdeé", k=rng.randint(1, 5))) for _ in range(n))

    shared = [words(rng.randint(2, 30)) for _ in range(6)]
    texts = []
    for _ in range(60):
        parts = [rng.choice(shared) if rng.random() < 0.4 else words(rng.randint(1, 20)) for _ in range(rng.randint(1, 6))]
        texts.append("".join(parts))
    return texts + [texts[0], texts[0], "", None, "a" * 300, shared[0] * 4, "é" * 15]


@pytest.mark.parametrize("length,gram,crowd,batch,heavy", [(20, 8, 256, 1 << 20, 10_000), (24, 6, 0, 300, 2), (21, 8, 2, 50, 3)])
def test_against_brute_force(spark, monkeypatch, length, gram, crowd, batch, heavy):
    monkeypatch.setattr(suffixes, "keyed", lambda *a: common.keyed(*a, *(["inner"] if len(a) == 4 else []), heavy))
    texts = corpus(length)
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(0, texts[0], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int")
    s = suffixes.Settings(length, gram, crowd=crowd, block=5, batch=batch)
    got = suffixes.remove_repeats(spark, docs, s=s).collect()
    want = brute([(t or "").encode() for _, t, _ in rows], length)
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted((r[0], *w) for r, w in zip(rows, want))
    assert suffixes.remove_repeats(spark, docs.limit(0), s=s).count() == 0


def test_multikey_order_is_suffix_order():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 500).astype(np.uint8)
    words = suffixes._eights(np.append(data, np.zeros(64, np.uint8)))
    starts = np.arange(500)
    order, tied = suffixes.multikey_order(words, starts, 64)
    text = data.tobytes() + b"\0" * 64
    keys = [text[i : i + 64] for i in order]
    assert keys == sorted(keys)
    assert tied.tolist() == [False] + [a == b for a, b in zip(keys, keys[1:])]


def test_names_of_other_columns_are_free_and_long_texts_are_cut_whole(spark):
    long = "".join(chr(97 + k * k % 23) + str(k) for k in range(700))
    rows = [(1, long, 1, "g", "z", 5, "old"), (2, "pre " + long[900:1400], 2, "g", "z", 6, "old"), (3, "free", 3, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int, gram string, runs string, kept_columns int, kept string")
    got = suffixes.remove_repeats(spark, docs, s=suffixes.Settings(batch=64)).orderBy("doc_id").collect()
    assert got[0].__fields__[:5] == ["doc_id", "row", "gram", "runs", "kept_columns"] and [r.row for r in got] == [1, 2, 3]
    assert got[0].kept == long[:900] + long[1400:] and got[1].kept == "pre " and got[2].kept == "free"
