import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import langid


def made(rng, letters, n):
    return " ".join("".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        lang = ("aa", "bb", "cc")[i % 3]
        letters = {"aa": "abcdefg", "bb": "hijklmñ", "cc": "оптвекс"}[lang]
        rows.append((i, made(rng, letters, rng.randint(3, 60)), lang if i % 10 else None, "x"))
    rows += [(1000, None, "aa", "x"), (1001, "", "aa", "x"), (1002, "12 3! \n", "bb", "x"), (None, made(rng, "abcdefg", 5), None, "x"), (1003, made(rng, "hijklmñ", 60_000), None, "x"), (5, rows[5][1], "cc", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")


def test_held_out_accuracy_and_edges(spark, docs):
    s = langid.Settings(sample=100, buckets=1 << 12, epochs=4)
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))), s)
    got = langid.predict(spark, docs.withColumn("truth", F.element_at(F.array(F.lit("aa"), F.lit("bb"), F.lit("cc")), (F.col("doc_id") % 3 + 1).cast("int"))), model)
    assert got.columns.count("score") == 1
    rows = got.collect()
    assert len(rows) == docs.count()
    tested = [r for r in rows if r.doc_id is not None and r.doc_id < 1000]
    assert np.mean([r.lang_pred == r.truth for r in tested]) > 0.97
    for r in rows:
        assert 0 <= r.score <= 1
        if r.doc_id in (1000, 1001, 1002):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        if r.doc_id == 1003 or r.doc_id is None:
            assert r.lang_pred == ("bb" if r.doc_id else "aa") and not r.rejected
    assert langid.predict(spark, docs.limit(0), model).count() == 0


def test_without_labels(spark, docs):
    model = langid.train(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in langid.predict(spark, docs, model).collect()} == {"und"}


def test_a_text_alone_scores_as_in_a_batch():
    texts = ["abc déf 12", "", "x", "日本 語"]
    table = np.random.default_rng(0).normal(size=(langid.Settings().buckets, 3))
    together = langid.mean_scores(table, texts, langid.Settings())[0]
    alone = np.concatenate([langid.mean_scores(table, [t], langid.Settings())[0] for t in texts])
    assert np.allclose(together, alone)


def test_copies_and_long_texts_in_the_sample(spark):
    s = langid.Settings(sample=5, sample_chars=20, long_chars=100)
    rows = [(f"copy {i % 2}", "aa") for i in range(400)] + [(f"text {i}", "aa") for i in range(30)]
    rows += [("b" * n, "bb") for n in (10, 40, 50, 60, 70)] + [("c" * 500, "cc"), ("c" * 600, "cc")]
    got = langid.sample(spark.createDataFrame(rows, "text string, lang string"), s)
    assert len([t for t, v in got if v == "aa"]) == 5  # distinct, however often the copies come
    assert sorted(len(t) for t, v in got if v == "bb") == [10, 40, 50]
    assert [len(t) for t, v in got if v == "cc"] == [100]


def test_a_language_of_long_texts_only_is_learned(spark):
    rng = random.Random(3)
    rows = [(i, made(rng, "abcdefg" if i % 2 else "hijklmñ", 40 if i % 2 else 400), "aa" if i % 2 else "bb") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, langid.Settings(sample=30, sample_chars=500, buckets=1 << 12, epochs=4))
    assert all(r.lang_pred == r.lang for r in langid.predict(spark, docs, model).collect())


def test_scores_are_those_of_every_gram_by_itself():
    s = langid.Settings(buckets=1 << 9, epochs=2, grams=(1, 2, 3))
    rng = random.Random(7)
    texts = [made(rng, letters, 12) for letters in ("abcdef", "ghijkl") for _ in range(30)]
    model = langid.fit(texts, ["aa"] * 30 + ["gg"] * 30, s)
    for text in ["Ab, cd 12-ef", "g", "aé", "--", "", "gh" * 300]:
        flat = "".join(c if c.isalpha() else " " for c in text.lower() + "\n")
        rows = []
        for n in s.grams:
            for k in range(len(flat) - n + 1):
                gram = flat[k : k + n]
                if gram.strip():
                    h = 0
                    for place, c in enumerate(gram, 1):
                        h = (h * 0x01000193 + ord(c) * 0x9E3779B1 + place) % (1 << 32)
                    h ^= h >> 15
                    rows.append(model.table[((h * 0x85EBCA6B) % (1 << 32) >> 7) % s.buckets])
        names, score, rejected = model.predict([text])
        if not rows:
            assert (names[0], score[0], rejected[0]) == ("und", 0.0, True)
            continue
        z = (np.mean(rows, axis=0) + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert names[0] == model.languages[int(p.argmax())] and abs(p.max() - score[0]) < 1e-6


def test_a_step_follows_the_gradient():
    s = langid.Settings(buckets=1 << 8, dim=4, epochs=1, rate=1e-3, grams=(1,))
    loss = lambda m, t, y: -np.log(langid.softmax(((langid.mean_scores(m.table, [t], s)[0]) + m.bias))[0, y])
    before = langid.fit(["abab", "cdcd"], ["x", "y"], langid.Settings(**{**s.__dict__, "epochs": 0}))
    after = langid.fit(["abab", "cdcd"], ["x", "y"], langid.Settings(**{**s.__dict__, "epochs": 60, "rate": 1.0}))
    assert loss(after, "abab", 0) < loss(before, "abab", 0) and loss(after, "cdcd", 1) < loss(before, "cdcd", 1)


def test_the_sample_is_shared_by_languages_and_counts_equal_texts_once(spark):
    rows = [("same words here", "aa")] * 50 + [(f"text {i} " + "w" * 90, lang) for i in range(40) for lang in ("aa", "bb")] + [("z" * 500, "cc")]
    docs = spark.createDataFrame(rows, "text string, lang string")
    got = langid.sample(docs, langid.Settings(sample=1000, sample_chars=200, long_chars=300, total_chars=3000))
    by = {v: [t for t, w in got if w == v] for v in ("aa", "bb", "cc")}
    assert len(set(got)) == len(got) and all(sum(map(len, t)) <= 1000 for v, t in by.items() if v != "cc")
    assert len(by["aa"]) >= 9 and len(by["bb"]) >= 9 and by["cc"] == ["z" * 300]
    assert langid.sample(docs.where("lang IS NULL"), langid.Settings()) == []
    few = langid.Settings(sample=2, sample_chars=200)
    chosen = [sorted(t for t, v in langid.sample(docs, few) if v == lang) for lang in ("aa", "bb")]
    h = docs.where("length(text) <= 200").select("lang", "text", F.xxhash64(F.lit(few.seed), "text").alias("h")).distinct().orderBy("h").collect()
    assert chosen == [sorted([r.text for r in h if r.lang == lang][:2]) for lang in ("aa", "bb")]  # those of the lowest hashes, cut or not


def test_names_of_other_columns_are_free(spark):
    docs = spark.createDataFrame([(1, "abc", "aa", "q", 3), (2, None, None, "q", 4)], "doc_id long, text string, lang string, _text string, doc int")
    got = langid.predict(spark, docs, langid.train(docs))
    assert got.columns == [*docs.columns, "lang_pred", "score", "rejected"] and sorted(r.doc for r in got.collect()) == [3, 4]
