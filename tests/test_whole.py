from tessella.operators import library as lb
from tessella.plans import libraries, relational


def tables(spark, tmp_path, documents):
    """The folder of a table of documents: doc_id and text of each, four languages in turn."""
    rows = [(i, t, ("de", "en", "fr", "es")[i % 4], "src1", len(t)) for i, t in documents]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_the_section_list_is_whole_and_in_order(spark, tmp_path):
    d = tables(spark, tmp_path, [(i, "x") for i in range(250)])
    got = [(r.level, r.section_id) for r in relational.QUERIES["r41_section_list"](spark, d).collect()]
    assert len(got) == 750 and got == sorted(got) and {v for v, _ in got} == {0, 1}


def test_quality_flags_read_whole_texts_of_pdf_items_only(spark):
    torn = "word " * 4_001 + "a b cd " * 4_000
    split = "Cancellati ons and Correcti ons with noti fi cati ons for processi ng of subscripti ons"
    rows = [(1, "a/x.PDF", torn), (2, "a/x.md", torn), (3, "a/pdf", torn), (4, "x.pdf", split), (5, "x.pdf", "fine " * 50), (6, "x.md", "fine"), (7, "x.pdf", None)]
    items = spark.createDataFrame(rows, "item_id long, external_id string, text string")
    events = items.where("item_id >= 5")
    flags = lambda *a: {r.item_id: r.flag for r in lb.quality_flags(items, events, *a).collect()}
    assert flags() == {1: "suspect", 2: None, 3: None, 4: None, 5: "repaired", 6: None, 7: "repaired"}
    known = frozenset("a and with for of word fine b cd cancellations corrections processing subscriptions".split())
    assert flags(known) == {1: None, 2: None, 3: None, 4: "suspect", 5: "repaired", 6: None, 7: "repaired"}
    assert lb.split_suspects("sun day on line", frozenset("sun day sunday on line online".split())) == (0, 4)


def test_each_named_file_brings_its_best_match_else_its_first_leaf(spark):
    words = ["head", "one", "two", "fee table fee", "four"]
    rows = [(i * 100 + k, i, None, None, "document", w, None) for i in (1, 2, 3, 4) for k, w in enumerate(words if i < 3 else ["head", "nothing"])]
    chunks = spark.createDataFrame(rows, "chunk_id long, item_id long, entity_id long, section_id long, kind string, content string, status string")
    items = spark.createDataFrame([(1, "a/one.yml"), (2, "b/two.yml"), (3, "c/three.yml"), (4, "d/four.yml")], "item_id long, external_id string")
    hits = spark.createDataFrame([(400, 4, 2.0), (103, 1, 1.0)], "chunk_id long, item_id long, score double")
    question = "fee in one.yml, two.yml three.yml and four.yml"
    got = {r.chunk_id: (r.score, r.boosted) for r in lb.boosted(hits, lb.named_items(items, question), chunks, question).collect()}
    assert got == {103: (3.0, True), 203: (3.0, True), 300: (3.0, True), 400: (2.0, False)}
    only = lb.boosted(hits, lb.named_items(items, "one.yml"), chunks, "one.yml").where("boosted").collect()
    assert [r.chunk_id for r in only] == [100]
    assert lb.boosted(hits, lb.named_items(items, "fee"), chunks, "fee").where("boosted").count() == 0


def test_every_chunk_is_linked_to_its_tag(spark, tmp_path):
    d = tables(spark, tmp_path, [(i, "x" * 2_000) for i in range(8)])  # three leaves and a summary each
    run = lambda name: libraries.QUERIES[name](spark, d)
    assert {r.name: r.usage for r in run("a11_tag_recount").collect()} == dict.fromkeys(["de", "en", "fr", "es"], 8)
    assert [(r.name, r.usage) for r in run("r45_tag_list").collect()] == [(v, 8) for v in ("de", "en", "es", "fr")]
    assert run("j3_tag_chunks").count() == 8 and {r.name: r.usage for r in run("m12_tag_ensure").collect()}["de"] == 13
