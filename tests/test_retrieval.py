import math

import pytest
from pyspark.sql import functions as F

from tessella.functions import text as fx
from tessella.operators import relations as r
from tessella.operators import retrieval as rt


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [
        (1, 1, None, 10, "document", "the direct debit was cancelled", None),
        (2, 1, None, 11, "document", "debit direct order", "stale"),
        (3, 2, None, 20, "document", "Café reversal of err-90412 today", "disputed"),
        (4, 2, None, 20, "doc_summary", "reversal reversal", None),
        (5, 3, None, 30, "document", "nothing here", None),
    ]
    return spark.createDataFrame(rows, "chunk_id long, item_id long, entity_id long, section_id long, kind string, content string, status string")


def test_query_terms_and_synonyms():
    assert fx.query_terms("What is the DD err-90412, é?") == ["dd", "err-90412", "é"]
    assert fx.expanded(["dd"]) == ["dd", "direct-debit"]


def test_bm25_counts_phrases_and_all_kinds(spark, chunks):
    got = {x.chunk_id: x.score for x in rt.keyword_leg(chunks, "dd", 10).collect()}
    assert set(got) == {1}  # the phrase, not its loose words
    n, df, avg = 5, 1, (5 + 3 + 6 + 2 + 2) / 5
    want = math.log((n - df + 0.5) / (df + 0.5)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 5 / avg))
    assert abs(got[1] - want) < 1e-8
    assert [x.chunk_id for x in rt.keyword_leg(chunks, "err-90412", 10).collect()] == [3]
    assert [x.chunk_id for x in rt.keyword_leg(chunks, "cafe", 10).collect()] == [3]
    assert rt.keyword_leg(chunks, "the of", 10).count() == 0
    assert rt.keyword_leg(chunks.limit(0), "debit", 10).count() == 0


def test_exact_and_gates(spark, chunks):
    assert rt.exact_leg(chunks, "", 5).count() == 0
    assert [x.chunk_id for x in rt.exact_leg(chunks, "debit", 5).collect()] == [1, 2]
    assert rt.exact_leg(chunks, "Debit", 5).count() == 0
    assert {x.chunk_id for x in rt.status_filter(chunks, True).collect()} == {1, 4, 5}
    hits = spark.createDataFrame([(1, 0.1), (2, 0.6)], "chunk_id long, c double")
    assert rt.relevance_gate(hits, F.lit(False), F.col("c")).count() == 2
    assert rt.relevance_gate(hits.where("c < 0.5"), F.lit(False), F.col("c")).count() == 0


def test_cosine_edges(spark):
    rows = [([1.0, 0.0], [1.0, 0.0], 1.0), ([0.0, 0.0], [1.0, 0.0], 0.0), ([1.0], [1.0, 0.0], 0.0), ([], [], 0.0)]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>, want double")
    assert all(x.got == x.want for x in df.select("want", fx.cosine(F.col("a"), F.col("b")).alias("got")).collect())


def test_tiers(spark):
    cases = {"vendor/spec.md": 4, "x/api-lint.yml": 4, "adr/1.txt": 0, "docs/payments-spec.md": 0, "a/foo.spec.ts": 1, "spec/run.rb": 1, "c/flags.json": 2, "Makefile": 2, ".env": 2, "notes/run.md": 3, "a/b.min.js": 4, "latest/contest.md": 3}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "p string, want int")
    assert [(x.p, x.got) for x in df.select("p", "want", fx.authority_tier(F.col("p")).alias("got")).collect() if x.got != x.want] == []
    env = spark.createDataFrame([("a/tests/x", ""), ("latest/x", "a sandbox"), ("x", "sandbox and staging"), ("x", "mock data")], "p string, t string")
    assert [x.e for x in env.select(fx.env_class(F.col("p"), F.col("t")).alias("e")).collect()] == ["test", "live", "test", "test"]


def test_prefix_and_windows(spark):
    assert r.check_prefix("a\\b") == "a/b"
    for bad in ("a/../b", "~x", "a*b", "http://x", "C:x", "./a", "a\nb"):
        with pytest.raises(ValueError):
            r.check_prefix(bad)
    df = spark.createDataFrame([("l1\nl2\nl3",)], "t string")
    one = df.select(*[r.line_window(F.col("t"), w).alias(w) for w in ("2", "2-9", "2-", "9")]).first()
    assert tuple(one) == ("l2", "l2\nl3", "l2\nl3", None)


def test_merge_purge_and_snippets(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 5)], "k int, v string, t int")
    new = spark.createDataFrame([(1, "A", 6), (2, "B", 5), (3, "C", None)], "k int, v string, t int")
    assert sorted(tuple(x)[:2] for x in r.merge_last_writer(old, new, "k", "t").collect()) == [(1, "A"), (2, "b"), (3, "C")]
    stored = spark.createDataFrame([("a",), ("b",)], "external_id string")
    assert r.purge(stored, stored.limit(0), stored.limit(0), "folder").count() == 0
    assert r.purge(stored, stored.where("external_id = 'a'"), stored.limit(0), "folder").count() == 1
    assert r.purge(stored, stored.where("external_id = 'a'"), stored.limit(0), "rest").count() == 0
    text = spark.createDataFrame([("x" * 50 + " needle " + "y" * 50,)], "t string")
    got = text.select(fx.snippet(F.col("t"), ["needle"], 20).alias("s")).first().s
    assert got.startswith("…") and got.endswith("…") and "needle" in got and len(got) == 22
