import random
import re

from tessella.llm import neardup, shingles


def grams(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_ngrams_match_sets():
    texts = ["a b c d e f a b c d e f", "", "one two", "  \n", "é ü x y z w", "q " * 40, "one two"]
    got = shingles.sets([t.encode() for t in texts])
    assert [len(g) for g in got] == [len(grams(t)) for t in texts]
    assert got[2].tolist() == got[6].tolist()


def test_bands():
    assert neardup.bands_for(0.8, 0.99999) == 22


def test_against_brute_force(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=rng.randint(3, 120))) for _ in range(40)]
    base = rng.choices(words, k=150)
    for _ in range(60):  # a dense group of near copies
        t = list(base)
        for _ in range(rng.randint(0, 6)):
            t[rng.randrange(len(t))] = rng.choice(words)
        texts.append(" ".join(t))
    texts += [texts[0]] * 5 + [None, "", " \n ", "a b", "a  b", "a b"]
    rows = [(i * 3, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    sets = [grams(t) for _, t, _ in rows]
    link = [[i != j and bool(a) and bool(b) and len(a & b) >= 0.8 * len(a | b) - 1e-9 for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    label = list(range(len(rows)))
    for _ in rows:
        label = [min([label[i]] + [label[j] for j in range(len(rows)) if link[i][j]]) for i in range(len(rows))]
    least = [min(rows[j][0] for j in range(len(rows)) if label[j] == label[i]) for i in range(len(rows))]
    want = sorted((rows[i][0], least[i], sum(link[i])) for i in range(len(rows)))
    small = neardup.Settings(block=16)
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in neardup.near_duplicates(spark, docs, s=small).collect())
    assert got == want
    kept = neardup.keep_one(spark, docs, s=small)
    assert kept.columns == docs.columns
    blank = sum(not g for g in sets)
    assert kept.count() == len({v for v, g in zip(label, sets) if g}) + blank
    assert neardup.near_duplicates(spark, docs.limit(0)).count() == 0


def test_names_of_other_columns_are_free(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(2, text, "k", 1, 1, "d"), (1, text, "k", 2, 2, "d"), (3, "other words of no one", "k", 3, 3, "d"), (None, text, "k", 4, 4, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key string, _root int, n int, doc string")
    kept = neardup.keep_one(spark, docs)
    assert kept.columns == docs.columns and sorted((r.doc_id, r._root) for r in kept.collect()) == [(1, 2), (3, 3)]
