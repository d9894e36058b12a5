import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tessella.llm import retrieval_packing as rp

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def plain_fill(docs, idf, average, window, last=True, k1=1.2, b=0.75):
    """docs: lists of ids in shard order; whole scores by dictionaries, every seed against every document."""
    counts = [Counter(d) for d in docs]

    def score(q, d):
        total = 0.0
        for t in sorted(counts[q]):
            if t in counts[d]:
                n = counts[d][t]
                total += idf[t] * n * (k1 + 1) / (n + k1 * (1 - b + b * len(docs[d]) / average))
        return total

    start, out, sequence, cut = [0] * len(docs), [], 0, None
    while (rest := sum(map(len, docs)) - sum(start)) and (last or rest >= window):
        size = window
        while size > rest:
            size //= 2
        at, queue = 0, []
        while at < size:
            is_seed = not queue
            if queue:
                doc = queue.pop(0)
            elif cut is not None:
                doc = cut
            else:
                doc = next(d for d in range(len(docs)) if start[d] < len(docs[d]))
            cut = None
            n = min(len(docs[doc]) - start[doc], size - at)
            out.append((doc, start[doc], n, sequence, at))
            start[doc] += n
            at += n
            if start[doc] < len(docs[doc]):
                cut = doc
            elif is_seed and at < size:
                found = sorted((-score(doc, d), d) for d in range(len(docs)) if start[d] < len(docs[d]))
                queue = [d for s, d in found if s < 0]
        sequence += 1
    return out


def random_docs(seed, n, vocabulary=40, longest=60):
    rng = random.Random(seed)
    made = [[rng.randrange(3, vocabulary) for _ in range(rng.choice([0, 3, 10, longest]))] + [2] for _ in range(n)]
    return made + [list(d) for d in made[: n // 4]]


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("last", [True, False])
def test_fill_equals_the_plain_version(seed, last):
    docs = random_docs(seed, 5 * seed + 1)
    df = np.bincount([t for d in docs for t in set(d)], minlength=40).astype(float)
    idf = np.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
    average = sum(map(len, docs)) / len(docs)
    ids, start = [np.array(d, np.uint32) for d in docs], np.zeros(len(docs), np.int64)
    got = rp.fill(ids, start, rp.Weights(idf, average, 1.2, 0.75), last, rp.Settings(window=32))
    assert got == plain_fill(docs, idf, average, 32, last)
    assert last == (int(start.sum()) == sum(map(len, docs))) or sum(map(len, docs)) % 32 == 0


def texts(seed=0, n=120):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeioubdgklmnprst") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    made = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 20, 200, 900]))) for _ in range(n)]
    return [None, "", " ", "a <|endoftext|> b", "→ 字 é", "word " * 9000, *made, *made[:30]]


@pytest.mark.parametrize(("shard_tokens", "ranges"), [(1 << 21, 1), (9000, 3), (1, 2)])
def test_every_id_is_in_one_piece_and_nothing_is_padded(spark, shard_tokens, ranges):
    from tokenizers import Tokenizer

    rows = [(i, t, "x") for i, t in enumerate(texts())]
    docs = spark.createDataFrame([*rows, (3, "a <|endoftext|> b", "x")], "doc_id long, text string, ids string").repartition(3)
    s = rp.Settings(shard_tokens=shard_tokens)
    got = rp.pack(spark, docs, PATH, ["doc_id", "ids"], s=s, ranges=ranges).collect()
    tokenizer = Tokenizer.from_file(PATH)
    by_doc, by_sequence = {}, {}
    for r in got:
        ids = np.frombuffer(bytes(r.ids), "<u4")
        assert len(ids) == r.length > 0 and zlib.crc32(bytes(r.ids)) == r.ids_crc32
        by_doc.setdefault(r.doc_id, []).append((r.start, ids.tolist(), r.doc_tokens))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, text, _ in rows:
        want = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        times = 2 if i == 3 else 1
        pieces = sorted(by_doc[i])
        assert {n for _, _, n in pieces} == {len(want)}
        if times == 1:
            assert [x for _, p, _ in pieces for x in p] == want and [a for a, _, _ in pieces] == np.cumsum([0] + [len(p) for _, p, _ in pieces])[:-1].tolist()
        else:
            assert sum(len(p) for _, p, _ in pieces) == 2 * len(want)
    for spans in by_sequence.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end == 4096 or end & (end - 1) == 0 and end < 4096
    short = [s for s in by_sequence.values() if sum(n for _, n in s) < 4096]
    assert len(short) <= 12 * ranges


def test_windows_hold_documents_alike(spark):
    rng = random.Random(4)
    topics = [["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(60)] for _ in range(20)]
    rows = [(k, " ".join(rng.choice(topics[k % 20]) for _ in range(300)), k % 20) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, topic int").repartition(4)
    got = rp.pack(spark, docs, PATH, ["doc_id", "topic"], payload=False, ranges=2).collect()
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.topic, r.length))
    same = sum(max(sum(n for t, n in s if t == u) for u in {t for t, _ in s}) for s in by.values())
    assert same > 0.8 * sum(r.length for r in got)


def test_empty_table(spark):
    assert rp.pack(spark, spark.createDataFrame([], "doc_id long, text string"), PATH, ["doc_id"]).count() == 0


def test_ranges_hold_all_documents_in_order(spark):
    rng = random.Random(2)
    rows = [(k, [rng.choice([3, 3, 3, 4, 9, 11]) for _ in range(rng.randint(0, 4))] + [2]) for k in range(300)]
    stored = spark.createDataFrame([(k, bytearray(np.array(ids, "<u4").tobytes()), len(ids)) for k, ids in rows], "rid long, ids binary, n long").repartition(3)
    weights = rp.Weights.counted(stored)
    keys = {r.rid: (r.key_0, r.key_1, r.key_2, r.rid) for r in rp.with_keys(stored, weights).collect()}
    bounds = rp.range_bounds(stored, weights, 7, 300)
    assert len(bounds) == 6 and bounds == sorted(bounds)
    got = {r.rid: r.range for r in rp.with_keys(stored, weights, bounds=bounds).collect()}
    assert got == {rid: sum(b <= key for b in bounds) for rid, key in keys.items()}
    assert max(sum(v == k for v in got.values()) for k in range(7)) < 80  # one key holds many documents, no range does
