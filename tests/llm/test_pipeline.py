import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tessella.llm import mixing
from tessella.storage import Scratch

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(9)

    def made(letters, n):
        return " ".join("".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(n))

    passage = made("abcdefg", 60)
    rows = []
    for i in range(90):
        letters, lang = (("abcdefg", "aa"), ("hijklmn", "bb"))[i % 2]
        rows.append([i, made(letters, 80), lang, f"src{i % 3}"])
    for i in range(5):
        rows[i * 2][1] += " " + passage
    copy = rows[11][1].split()
    copy[3] = "hijk"
    rows += [[100, rows[7][1], "bb", "src0"], [101, " ".join(copy), "bb", None], [102, None, "aa", "src1"], [103, "123 !", "aa", "src1"], [104, "", None, "src2"], [7, rows[7][1], "bb", "src1"]]
    rows = [(*r, len(r[1] or "")) for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), passage


def test_stages(spark, docs, tmp_path):
    rows, passage = docs
    kept = rows
    seen = {}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, kept, "")
        if k < 4:
            assert out.columns == rows.columns
        out.write.parquet(f"{tmp_path}/{k}")
        kept = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = kept
    ids = lambda name: sorted(r.doc_id for r in seen[name].select("doc_id").collect())
    assert not {102, 103, 104} & set(ids("language_id")) and len(ids("language_id")) == 93
    assert ids("near_duplicates") == list(range(90))
    texts = {r.doc_id: r for r in seen["repeated_passages"].collect()}
    assert len(texts) == 90 and not any(passage in r.text for r in texts.values())
    assert all(r.n_chars == len(r.text) for r in texts.values())
    assert texts[1].text == next(r.text for r in rows.collect() if r.doc_id == 1)
    size = mixing.word_count(F.col("text"))
    before = {r.source: r.n for r in seen["repeated_passages"].groupBy("source").agg(F.sum(size).alias("n")).collect()}
    after = {r.source: r.n for r in seen["source_mix"].groupBy("source").agg(F.sum(size).alias("n")).collect()}
    total = sum(before.values())
    for source, weight in zip(sorted(before), (5, 2, 1)):
        assert abs(after[source] - total * weight / 8) <= 2
    pieces = seen["packed_sequences"].collect()
    used = {}
    for r in pieces:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert len(r.ids) == 4 * r.length
    for spans in used.values():
        end = 0
        for o, n in sorted(spans):
            assert o == end
            end += n
        assert end <= 2048


def test_run_on_an_empty_table(spark, docs, tmp_path):
    docs[0].limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_columns_named_like_what_the_stages_make_stay(spark, docs, tmp_path):
    rows, _ = docs
    names = ["score", "lang_pred", "rejected", "target", "size", "source_size", "taken", "_turn", "kept", "removed", "n_bytes", "n_removed", "key", "root", "doc", "row"]
    own = rows.where("doc_id < 40").select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in names])
    kept = own
    for k, (_, stage) in enumerate(pipeline.STAGES[:4]):
        out = stage(spark, kept, "")
        assert out.columns == own.columns
        out.write.parquet(f"{tmp_path}/{k}")
        kept = spark.read.parquet(f"{tmp_path}/{k}")
    left = kept.collect()
    assert left and all(r[c] == f"{c}{r.doc_id}" for r in left for c in names)


def test_a_run_drops_its_own_tables_only(spark):
    other = Scratch(spark, "other")
    table = other.write(spark.range(3).toDF("x"), "t")
    with Scratch.passing():
        mine = Scratch(spark, "mine")
        own = mine.write(spark.range(4).toDF("x"), "t")
        assert own.count() == 4
    assert table.count() == 3 and mine not in Scratch.made and other in Scratch.made
    with pytest.raises(Exception):
        spark.read.parquet(f"{mine.root}/t")
