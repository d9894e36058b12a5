import math
import random

import pytest
from pyspark.sql import functions as F

from tessella.engine import Engine
from tessella.functions import text as fx
from tessella.operators import relations as r
from tessella.operators import retrieval as rt
from tessella.operators import search as se
from tessella.operators import trees
from tessella.operators.index import KeywordIndex, postings_of

NOW = "2024-02-01"


def test_ways_up_deep_trees_cycles_and_orphans(spark):
    rows = [(i, i - 1 if i else None) for i in range(10)] + [(20, 21), (21, 20), (22, 20), (30, 99), (40, 40)]
    got = {}
    for r in trees.ancestors(spark.createDataFrame(rows, "section_id long, parent_id long")).collect():
        got.setdefault(r.section_id, {})[r.ancestor] = r.distance
    assert got[9] == {9 - d: d for d in range(10)} and got[0] == {0: 0}
    assert got[20] == {20: 0, 21: 1} and got[22] == {22: 0, 20: 1, 21: 2} and got[30] == {30: 0} and got[40] == {40: 0}


@pytest.mark.parametrize("seed", range(6))
def test_whole_trees_of_any_depth_with_rings(spark, seed):
    rng = random.Random(seed)
    n = [1, 30, 100, 400, 60, 200][seed]
    parents = {i: rng.choice([None, i, 10_000, i - 1, i - 1, i - 1, i - 1, rng.randrange(n)]) if seed % 2 else i - 1 for i in range(n)}
    parents[0] = n // 2 if seed > 2 else None  # a long ring
    got, sections = {}, spark.createDataFrame(list(parents.items()), "section_id long, parent_id long")
    for r in trees.ancestors(sections, None).collect():
        assert r.ancestor not in got.setdefault(r.section_id, {})
        got[r.section_id][r.ancestor] = r.distance
    for i in parents:
        way, at = {}, i
        while at is not None and at in parents and at not in way:
            way[at] = len(way)
            at = parents[at]
        assert got[i] == way
    chunks = spark.createDataFrame([(i, i % 3, "x" * (i % 7)) for i in range(n)], "section_id long, n int, content string")
    chunks = chunks.withColumn("kind", F.when(F.col("n") == 0, "section_summary").otherwise("document"))
    tree = trees.Tree.of(sections)
    sizes = {r.section_id: (r.chars, r.n_chunks) for r in trees.subtree_sizes(tree, chunks).collect()}
    for i in parents:
        own = [j % 7 for j in parents if i in got[j] and j % 3]
        assert sizes[i] == (sum(own) + 4 * max(0, len(own) - 1), len(own))
    for i in (0, n // 2, n - 1):
        assert sorted(r.section_id for r in tree.below(i).collect()) == [j for j in parents if i in got[j]]


def test_a_chain_of_five_thousand(spark):
    sections = spark.range(5000).selectExpr("id AS section_id", "nullif(id - 1, -1) AS parent_id")
    chunks = spark.range(5000).selectExpr("id AS section_id", "'document' AS kind", "'abc' AS content")
    sizes = {r.section_id: r.n_chunks for r in trees.subtree_sizes(sections, chunks).collect()}
    assert sizes == {i: 5000 - i for i in range(5000)}


def test_trees_take_no_table_through_the_driver(spark):
    n = 3000
    sections = spark.range(n).selectExpr("id AS section_id", "IF(id % 50 < 5, id - id % 50 + (id % 50 + 1) % 5, id - 1) AS parent_id")
    tree = trees.Tree.of(sections)
    chunks = sections.selectExpr("section_id", "section_id AS chunk_id", "'document' AS kind", "'abc' AS content")
    hits, sizes = chunks.select("chunk_id", "section_id"), trees.subtree_sizes(tree, chunks)
    for made in (sizes, tree.ways(), trees.ancestors(sections), trees.parent_return(hits, tree.ways(), sizes)):
        assert "BroadcastHashJoin" not in made._jdf.queryExecution().executedPlan().toString()


def test_idf_signal_deals_its_texts_once(spark):
    texts = {1: ["fee fee zeta", "zeta x", None], 2: ["Fee_1 fee_1 ab", ""], 3: ["one two three"], None: ["lost words"]}
    rows = [(10 * n + k, i, t) for n, (i, own) in enumerate(texts.items()) for k, t in enumerate(own)]
    chunks = spark.createDataFrame(rows, "chunk_id long, item_id long, content string")
    rated = r.idf_signal(chunks)
    plan = rated._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    a, b = math.log(4 / 3), math.log(4 / 3)  # fee and zeta stand twice each in three chunks
    want = {0: (a + b) / 2, 1: b, 2: 0.0, 10: 0.0, 11: 0.0, 20: 0.0, 30: 0.0}
    assert {x.chunk_id: x.signal for x in rated.collect()} == {k: round(v, 6) for k, v in want.items()}


def test_subtrees_and_the_nearest_section_that_fits(spark):
    sections = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 1)], "section_id long, parent_id long")
    texts = {10: (1, "a" * 50), 11: (2, "b" * 10), 12: (3, "c" * 100), 13: (3, "d" * 5), 14: (4, "e")}
    rows = [(c, 1, s, "document", t) for c, (s, t) in texts.items()] + [(15, 1, 4, "section_summary", "no leaf" * 99)]
    chunks = spark.createDataFrame(rows, "chunk_id long, item_id long, section_id long, kind string, content string")
    ways = trees.ancestors(sections)
    sizes = trees.subtree_sizes(sections, chunks)
    assert {r.section_id: (r.chars, r.n_chunks) for r in sizes.collect()} == {1: (166 + 16, 5), 2: (115 + 8, 3), 3: (109, 2), 4: (1, 1)}
    hits = spark.createDataFrame([(12, 3), (14, 4), (16, None)], "chunk_id long, section_id long")
    near = lambda limit: {r.chunk_id: r.parent_section for r in trees.parent_return(hits, ways, sizes, limit).collect()}
    assert near(120) == {12: 3, 14: 4, 16: None} and near(100) == {12: None, 14: 4, 16: None}
    whole = {r.section_id: r for r in trees.node_texts(ways, chunks, 70).collect()}
    body = "\n\n".join(t for _, t in texts.values())
    assert whole[1].body == body[:70] and whole[1].total == len(body) and whole[1].truncated
    assert whole[4].body == "e" and not whole[4].truncated


@pytest.mark.parametrize(("seed", "most"), [(0, 1), (1, 9), (2, 40), (3, 40), (4, 1000)])
def test_node_texts_of_any_tree_and_order_of_leaves(spark, monkeypatch, seed, most):
    rng = random.Random(seed)
    monkeypatch.setattr(trees, "TOGETHER", 7 * most)  # many sets
    n = 80
    parents = {i: rng.choice([None, i - 1, i - 1, i - 1, rng.randrange(n)]) if i else None for i in range(n)}
    numbers = list(range(3 * n)) if seed % 2 else rng.sample(range(10_000), 3 * n)  # of the tree's order, or of none
    rows = [(c, k // 3, rng.choice(["document", "caption", "document", "doc_summary"]), "".join(rng.choices("aé\n😀 ", k=rng.choice([0, 1, 3, 30])))) for k, c in enumerate(numbers) if k % 5]
    chunks = spark.createDataFrame(rows, "chunk_id long, section_id long, kind string, content string")
    ways = trees.ancestors(spark.createDataFrame(list(parents.items()), "section_id long, parent_id long"), None)
    under = {}
    for r in ways.collect():
        under.setdefault(r.ancestor, set()).add(r.section_id)
    want = {}
    for i, own in under.items():
        leaves = [t for _, s, kind, t in sorted(rows) if s in own and kind != "doc_summary"]
        if leaves:
            body = "\n\n".join(leaves)
            want[i] = (body[:most], len(body), len(body) > most)
    got = trees.node_texts(ways, chunks, most).collect()
    assert len(got) == len(want) and {r.section_id: (r.body, r.total, r.truncated) for r in got} == want


def test_node_texts_deals_a_text_once_and_not_once_a_section(spark):
    rng = random.Random(1)
    n, size = 1000, 2000
    sections = spark.range(n).selectExpr("id AS section_id", "IF(id % 50 > 0, id - 1, NULL) AS parent_id")
    rows = [(i, i, "document", "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+-", k=size))) for i in range(n)]
    chunks = spark.createDataFrame(rows, "section_id long, chunk_id long, kind string, content string")
    ways = trees.ancestors(sections, None)
    sc = spark.sparkContext._jsc.sc()

    def shuffled():
        sc.listenerBus().waitUntilEmpty()
        return sc.statusStore().executorList(True).head().totalShuffleWrite()

    before, threshold = shuffled(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as with more texts than a broadcast may have
    try:
        got = {r.section_id: r for r in trees.node_texts(ways, chunks).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert shuffled() - before < 4 * n * size  # by chunk and by set; each section has 16 texts
    assert len(got) == n and all(got[i].body == "\n\n".join(t for _, _, _, t in rows[i : i // 50 * 50 + 50])[:32_000] for i in range(n))


@pytest.fixture(scope="module")
def words(spark):
    rng = random.Random(4)
    rows = [(i, i // 4, None if i % 4 == 3 else i // 4 * 10, "doc_summary" if i % 4 == 3 else "document", [None, "stale"][i % 7 == 0], " ".join(rng.choices(["Direct", "debit", "fee", "Café", "x-1", "zeta"], k=rng.randint(0, 12)))) for i in range(80)]
    return spark.createDataFrame(rows, "chunk_id long, item_id long, section_id long, kind string, status string, content string")


@pytest.mark.parametrize("question", ["fee", "direct-debit fee zeta", "dd", "cafe x-1", "the of", "unknown"])
def test_an_index_scores_as_a_scan_does(spark, words, tmp_path, question):
    index = KeywordIndex.build(words, f"{tmp_path}/index")
    key = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert key(rt.keyword_scores(index, question)) == key(rt.keyword_scores(words, question))
    scope = spark.createDataFrame([(1,), (5,)], "item_id long")
    assert {r.item_id for r in rt.keyword_scores(index, question, scope=scope).collect()} <= {1, 5}


def test_an_index_is_built_without_a_shuffle_of_its_postings(spark, tmp_path):
    texts = ["Zeta fee", "", None, "fee", "-- x --", "Straße naïve ÉCOLE fee", "9z", "日本 fee_fee"]
    rows = [(i, i // 2, None, "document", None, t) for i, t in enumerate(texts)]
    chunks = spark.createDataFrame(rows, "chunk_id long, item_id long, section_id long, kind string, status string, content string")
    made = postings_of(chunks)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    index = KeywordIndex.build(chunks, f"{tmp_path}/a")
    want = {}
    for r in chunks.select("chunk_id", fx.tokens(F.col("content")).alias("w")).collect():
        for k, w in enumerate(r.w):
            want.setdefault((w, r.chunk_id), []).append(k)
    got = {(r.term, r.chunk_id): (r.positions, r.tf, r.length) for r in index.postings.collect()}
    sizes = {c: sum(len(at) for (_, k), at in want.items() if k == c) for c in range(len(texts))}
    assert got == {k: (at, len(at), sizes[k[1]]) for k, at in want.items()} and ("ecole", 5) in got
    assert (index.n, index.words) == (len(texts), sum(sizes.values()))


def test_an_index_stores_blocks_and_not_a_row_a_posting(spark, tmp_path):
    rng = random.Random(3)
    words = ["fee", "Größe", "ÉTÉ", "naïve", "x×y", "øre", "日本語", "ſoft", "a1", "Straße", "ÿ", "İz"]
    rows = [(i, i // 3, None, "document", None, rng.choice([" ", "-", ""]).join(rng.choices(words, k=rng.randint(0, 30)))) for i in range(600)]
    chunks = spark.createDataFrame(rows, "chunk_id long, item_id long, section_id long, kind string, status string, content string")
    index = KeywordIndex.build(chunks, f"{tmp_path}/a")
    stored = spark.read.parquet(f"{tmp_path}/a/{index.segments[0].folder}/postings").count()
    assert stored < index.postings.count() / 20
    told = chunks.select("chunk_id", fx.tokens(F.col("content")).alias("w")).collect()
    want = {(w, r.chunk_id): [k for k, x in enumerate(r.w) if x == w] for r in told for w in set(r.w)}
    assert {(r.term, r.chunk_id): r.positions for r in index.postings.collect()} == want
    for k in range(3):  # the third edit merges the segments
        index = index.replaced(chunks.where(F.col("item_id") == k).select("item_id"), chunks.where(F.col("item_id") == k))
    assert len(index.segments) == 1 or index.segments[-1].number == 3
    merged = index._merge(len(index.segments))
    assert {(r.term, r.chunk_id): r.positions for r in merged.postings.collect()} == want
    _same_scores(merged, chunks, "fee grosse ete strasse")


def test_legs_and_pages_read_the_stored_chunks(spark, tmp_path):
    from tessella import model as m
    from tessella.plans import ranked

    documents = [(i, "src1", "de", "".join(chr(97 + (i * k) % 26) if k % 7 else "é " for k in range(n)), n) for i, n in enumerate([0, 1, 800, 801, 1500, 11_300, 11_301, 23_000])] + [(9, "src1", "de", None, 0)]
    spark.createDataFrame(documents, "doc_id long, source string, lang string, text string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for i, _, _, text, _ in documents[:-1]:
        for k in range(max(0, -(-(len(text) - m.WINDOW) // m.STEP)) + 1):
            want[i * m.ITEM_SPAN + k] = text[k * m.STEP : k * m.STEP + m.WINDOW]
    leaves = m.chunks(spark, str(tmp_path)).where("kind <> 'doc_summary'").collect()
    assert len(leaves) == len(want) and {r.chunk_id: r.content for r in leaves} == want
    exact = ranked._legs(spark, str(tmp_path))[1][1]
    assert exact.inputFiles() and all("/texts/" in f for f in exact.inputFiles())


def _same_scores(index, chunks, question="brand fee zeta debit"):
    key = lambda df: sorted((r.chunk_id, r.score, r.terms, r.status) for r in df.collect())
    assert key(rt.keyword_scores(index, question)) == key(rt.keyword_scores(chunks, question))


def test_an_index_follows_its_items(spark, words, tmp_path):
    index = KeywordIndex.build(words, f"{tmp_path}/a")
    changed = words.where("item_id = 2").withColumn("content", F.lit("brand new fee"))
    _same_scores(index.replaced(changed.select("item_id"), changed), words.where("item_id <> 2").unionByName(changed))


def test_chunks_without_words_count(spark, tmp_path):
    rows = [(i, i // 2, None, "document", None, ["fee zeta", "", "debit fee", None][i % 4]) for i in range(8)]
    chunks = spark.createDataFrame(rows, "chunk_id long, item_id long, section_id long, kind string, status string, content string")
    index = KeywordIndex.build(chunks, f"{tmp_path}/a")
    assert index.n == 8
    edited = chunks.where("item_id = 1")
    _same_scores(index.replaced(edited.select("item_id"), edited), chunks, "fee")


def test_twenty_random_edits_equal_a_rebuild(spark, words, tmp_path):
    rng = random.Random(8)
    now = {}
    for r in words.collect():
        now.setdefault(r.item_id, []).append(tuple(r))
    index, next_chunk, written = KeywordIndex.build(words, f"{tmp_path}/a"), 1000, []
    for edit in range(20):
        touched = rng.sample(range(24), rng.choice([1, 1, 2]))
        fresh = []
        for item in touched:
            rows = []
            for _ in range(rng.choice([0, 1, 3])):
                text = " ".join(rng.choices(["direct", "debit", "fee", "zeta", "brand"], k=rng.choice([0, 0, 4, 9])))
                rows.append((next_chunk, item, item, rng.choice(["document", "doc_summary"]), rng.choice([None, "stale"]), text))
                next_chunk += 1
            now[item] = rows
            fresh += rows
        items, chunks = spark.createDataFrame([(i,) for i in touched], "item_id long"), spark.createDataFrame(fresh, words.schema)
        before = index
        index = index.replaced(items, chunks)
        written.append(len(index.segments))
        assert len(index.segments) <= len(before.segments) + 1
    whole = spark.createDataFrame([r for rows in now.values() for r in rows], words.schema)
    assert (index.n, index.words) == (whole.count(), sum(len((r.content or "").replace("-", " ").split()) for r in whole.collect()))
    for question in ("brand fee zeta debit", "direct-debit fee", "brand"):
        _same_scores(index, whole, question)
    _same_scores(KeywordIndex.open(spark, f"{tmp_path}/a"), whole)
    key = lambda df: sorted((r.chunk_id, r.content) for r in df.collect())
    assert key(index.texts) == key(whole) and key(index.texts_of([3, 5])) == key(whole.where("item_id IN (3, 5)"))
    assert max(written) < 10 and len(index.segments) < 10  # merged by size class
    index.vacuum()
    _same_scores(KeywordIndex.open(spark, f"{tmp_path}/a"), whole)


def test_two_writers_of_one_version(spark, words, tmp_path):
    index = KeywordIndex.build(words, f"{tmp_path}/a")
    one = words.where("item_id = 1")
    index.replaced(one.select("item_id"), one)
    with pytest.raises(Exception):
        index.replaced(one.select("item_id"), one)


@pytest.fixture(scope="module")
def engine(spark):
    items = [(1, 1, "docs/fees.md", "Fees", "2024-01-01", "prose"), (2, 1, "src/fees.py", "code", "2024-01-01", "code"), (3, 2, "tests/fees_test.py", "t", "2024-01-01", "code"), (4, 2, "notes/other.txt", "o", "2020-01-01", "note")]
    items = spark.createDataFrame(items, "item_id long, source_id int, external_id string, text string, created_at string, doc_type string")
    items = items.withColumns({"created_at": F.col("created_at").cast("timestamp"), "sensitive_override": F.lit(False)})
    sections = spark.createDataFrame([(10, 1, None, 0, "Fees"), (11, 1, 10, 1, "Fees > Refunds"), (20, 2, None, 0, "code"), (30, 3, None, 0, "test"), (40, 4, None, 0, "other")], "section_id long, item_id long, parent_id long, level int, path string")
    rows = [
        (100, 1, 10, "document", "intro of the fees", None), (101, 1, 11, "document", "refund fee rules apply to every refund", None), (102, 1, 11, "document", "more about nothing", None),
        (109, 1, None, "doc_summary", "fees and refund rules", None), (200, 2, 20, "document", "def refund(fee): pass", None), (209, 2, None, "doc_summary", "refund code", None),
        (300, 3, 30, "document", "refund fee rules test", None), (309, 3, None, "doc_summary", "refund tests", None), (400, 4, 40, "document", "refund long ago " + "x" * 9000, None), (401, 4, 40, "document", "tail of it", None),
        (402, 4, 40, "document", "refund dropped", "stale"),
    ]
    chunks = spark.createDataFrame([(a, b, None, c, d, e, f) for a, b, c, d, e, f in rows], "chunk_id long, item_id long, entity_id long, section_id long, kind string, content string, status string")
    sources = spark.createDataFrame([(1, "s1", "public"), (2, "s2", "internal")], "source_id int, name string, label string")
    entities = spark.createDataFrame([(1, 1, "accepted"), (2, 2, None), (3, 3, "stale")], "entity_id long, item_id long, status string")
    relations = spark.createDataFrame([(1, 2, "conflicts_with"), (1, 3, "conflicts_with")], "from_id long, to_id long, kind string")
    links = spark.createDataFrame([(101, "refunds"), (101, "fees")], "chunk_id long, name string")
    pairs = spark.createDataFrame([(1, "repayment", "refund", "manual", "active", None)], "id long, term string, expansion string, origin string, status string, source_id int")
    return Engine(spark, items, sources, chunks, sections, entities, entities.limit(0), rt.RetrievalConfig(top_k=4), relationships=relations, links=links, vocabulary=pairs)


def test_the_whole_search(spark, engine):
    hits = engine.search("refund fee rules", NOW, whole=True).orderBy("rank").collect()
    ids = [h.chunk_id for h in hits]
    assert ids[-1] == 300 and hits[-1].env == "test" and 402 not in ids  # tests go last, stale ones nowhere
    own = next(h for h in hits if h.chunk_id == 101)
    assert own.parent_section == 11 and own.content.startswith("[match 101]\nrefund fee rules") and "more about nothing" in own.content
    old = next(h for h in hits if h.chunk_id == 400)
    assert old.parent_section is None and old.content.startswith("refund long ago")
    assert {h.chunk_id for h in engine.search("repayment", NOW).collect()} >= {101, 200}  # by the vocabulary
    assert engine.search("nothing-like-this", NOW).count() == 0
    assert {h.item_id for h in engine.search("refund", NOW, public_only=True).collect()} == {1, 2}
    assert {h.item_id for h in engine.search("refund", NOW, env="test").collect()} == {3}
    assert [h.rank for h in engine.search("refund fee", NOW, mode="keyword_only").orderBy("rank").collect()][:1] == [1]


def test_a_named_file_comes_first(spark, engine):
    hits = engine.search("what is in other.txt", NOW, whole=True).collect()
    assert hits[0].item_id == 4 and hits[0].boosted and hits[0].rank == 1


def test_citations_and_context(spark, engine):
    found = engine.ask("refund fee rules", NOW)
    cited = {r.chunk_id: r for r in found["citations"].collect()}
    assert cited[101].tags == ["fees", "refunds"] and cited[101].conflicts_with == [2] and cited[101].breadcrumb == "Fees > Refunds"
    assert cited[200].conflicts_with == [1] and cited[300].conflicts_with == []
    windows = found["context"].orderBy("rank").collect()
    assert windows[0].mark == "[S1]" and not any("[match" in w.window for w in windows) and all(w.chars <= 2000 + 2 for w in windows)
    assert engine.node(10).first().total == len("intro of the fees") + len("refund fee rules apply to every refund") + len("more about nothing") + 4
    with pytest.raises(ValueError):
        engine.set_project(spark.createDataFrame([(1, 1)], "project_id int, source_id int"), 1, spark.createDataFrame([(9,)], "source_id int"))


def test_vectors_take_part(spark, engine):
    vectors = engine.chunks.where("kind <> 'caption'").select("chunk_id", "item_id", "section_id", "kind", "status", F.when(F.col("item_id") == 4, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))).alias("embedding"))
    lib = se.Library(engine.items, engine.chunks, engine.sections, engine.with_index().index, vectors)
    hits = se.search(lib, "zzz", F.lit(NOW).cast("timestamp"), engine.config, [1.0, 0.1], whole=False).collect()
    assert {h.item_id for h in hits} == {4} and all(h.cosine > 0.9 and not h.keyword for h in hits)
    assert se.search(lib, "zzz", F.lit(NOW).cast("timestamp"), engine.config, [-1.0, -1.0], whole=False).count() == 0


def test_torn_files_are_found_past_the_fence(spark, engine):
    lib = engine.library()
    far = [(500 + k, 5, None, 50, "document", f"refund {k}" + " of much else" * k, None) for k in range(3)]
    more = lib.chunks.unionByName(spark.createDataFrame(far, lib.chunks.schema))
    items = lib.items.unionByName(spark.createDataFrame([(5, 1, "scan.pdf", "torn", None, "prose", False)], lib.items.schema))
    index = KeywordIndex.build(more, f"{engine.with_index().index.path}-torn")
    run = lambda suspects: se.Search(se.Library(items, more, lib.sections, index, suspects=suspects), "refund", F.lit(NOW).cast("timestamp"), engine.config, None, None, False).sections_first()
    assert not {5} & {r.item_id for r in run(None).collect()}
    assert {5} <= {r.item_id for r in run(spark.createDataFrame([(5,)], "item_id long")).collect()}
