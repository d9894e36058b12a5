import random
import zlib

import numpy as np
import pytest

from tessella.llm import packing
from tessella.llm.tokens import WordTokenizer

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def naive_best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in bins if r >= n]
        if fits:
            r = min(fits)
            bins.remove(r)
            bins.append(r - n)
        else:
            bins.append(capacity - n)
    return sorted(bins)


@pytest.mark.parametrize("seed", range(30))
def test_plan_equals_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 5, 16, 100])
    lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 300))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    plan = packing.best_fit_plan(counts, capacity)
    used = {}
    for length, n in counts.items():
        for rank in range(n):
            at = np.searchsorted(plan["key"], (length << 40) | rank, side="right") - 1
            inside = rank - plan["rank"][at]
            b, o = plan["bin"][at] + inside // plan["each"][at], plan["offset"][at] + inside % plan["each"][at] * length
            used.setdefault(int(b), []).append((int(o), length))
    left = []
    for spans in used.values():
        end = 0
        for o, n in sorted(spans):
            assert o == end
            end += n
        assert end <= capacity
        left.append(capacity - end)
    assert sorted(left) == naive_best_fit(lengths, capacity)


def test_word_ids_equal_the_tokenizers():
    words = WordTokenizer(PATH)
    texts = ["it's don't we're 'tis ''s \"'s 12a3 a1'll x've'd 'Str ß Ÿ ŒE Μ naïve—x “q” 5²", "", "   ", "İstanbul ΑΣ", "á b", "x_y__z 'll're", "'", "s'", "日本 x"]
    assert [x.tolist() for x in words.ids(texts)] == [e.ids for e in words.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_strings_of_special_tokens_give_the_ids_of_the_plain_call():
    from tokenizers import Tokenizer

    texts = ["a <|endoftext|> b", "<|startoftext|>x<|endoftext|>", "<|ENDOFTEXT|> <|endoftext", "plain", "é→<|endoftext|>"]
    assert [x.tolist() for x in WordTokenizer(PATH).ids(texts)] == [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


def test_pack_round_trip(spark):
    rows = [(1, "a b c " * 2000, "x"), (2, None, "x"), (3, "", None), (4, "word", "x"), (4, "word", "x"), (None, "other words", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string")
    got = packing.pack(spark, docs, PATH, ["doc_id"], capacity=64).collect()
    ids = WordTokenizer(PATH)
    by_doc = {}
    for r in got:
        part = np.frombuffer(r.ids, "<u4")
        assert len(part) == r.length and zlib.crc32(r.ids) == r.ids_crc32 and r.length <= 64
        by_doc.setdefault(r.doc_id, []).append((r.start, part.tolist()))
    joined = {k: [i for _, p in sorted(v) for i in p] for k, v in by_doc.items()}
    assert joined[1] == [*ids.ids(["a b c " * 2000])[0].tolist(), 0]
    assert joined[2] == [0] and joined[3] == [0] and len(by_doc[4]) == 2
    spans = {}
    for r in got:
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in spans.values():
        end = 0
        for o, n in sorted(s):
            assert o == end
            end += n
        assert end <= 64
    assert packing.pack(spark, docs.limit(0), PATH, ["doc_id"]).count() == 0


def test_columns_named_like_new_ones_are_left_out(spark):
    rows = [(1, "a b", 7, "x", b"y", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece int, length string, ids binary, task long, kept long")
    got = packing.pack(spark, docs, PATH, ["doc_id", "piece", "length", "ids", "task", "kept"])
    assert got.columns == ["doc_id", "task", "kept", "piece", "start", "length", "ids", "ids_crc32", "sequence_id", "offset"]
    r = got.first()
    assert (r.task, r.kept, r.piece, r.length, r.offset) == (1, 2, 0, 3, 0)


@pytest.mark.parametrize("limit", [0, 1 << 30])
def test_places_do_not_depend_on_the_join(spark, monkeypatch, limit):
    monkeypatch.setattr(packing, "small_side", lambda df: packing.F.broadcast(df) if limit else df.hint("merge"))
    docs = spark.range(300).selectExpr("id AS doc_id", "repeat('word ', int(id * 7 % 90)) AS text").repartition(5)
    spans = {}
    for r in packing.pack(spark, docs, PATH, ["doc_id"], capacity=64, payload=False).collect():
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    lengths = [n for s in spans.values() for _, n in s]
    assert sum(lengths) == sum(i * 7 % 90 + 1 for i in range(300))
    for s in spans.values():
        ends = [o + n for o, n in sorted(s)]
        assert [o for o, _ in sorted(s)] == [0, *ends[:-1]] and ends[-1] <= 64
    assert len(spans) == len(naive_best_fit(lengths, 64))
