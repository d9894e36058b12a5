"""Registered queries of tags, vocabulary, assets, named files and page slots."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import model as m
from ..functions import text as fx
from ..operators import library as lb
from ..operators import relations as r
from ..operators import retrieval as rt
from .ranked import bm25_sql
from .relational import LEAF, Query

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


_LINKS = "links AS (SELECT c.chunk_id, d.lang AS name FROM chunks c JOIN documents d ON d.doc_id = c.item_id)"


def _links(spark, d):
    lang = m.table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), F.col("lang").alias("name"))
    return m.chunks(spark, d).join(lang, "item_id").select("chunk_id", "name")


@query("j3_tag_chunks", m.with_tables("chunks") + _LINKS + ", x AS (SELECT chunk_id, kind FROM links JOIN chunks USING (chunk_id) WHERE name = 'de') SELECT * FROM x")
def j3(spark, d):
    links = _links(spark, d)
    return lb.chunks_of_tag(links.select("name").distinct(), links, m.chunks(spark, d), "de").select("chunk_id", "kind")


@query("a11_tag_recount", m.with_tables("chunks") + _LINKS + ", x AS (SELECT name, count(*) AS usage FROM links WHERE name IS NOT NULL GROUP BY 1) SELECT * FROM x")
def a11(spark, d):
    links = _links(spark, d)
    tags = links.where("name IS NOT NULL").select("name").distinct().unionByName(spark.createDataFrame([("unused",)], "name string"))
    return lb.recount_tags(tags, links)


@query("m12_tag_ensure", m.with_tables("chunks") + _LINKS + """, t(name, usage) AS (VALUES ('de', 5), ('zz', 2)), n AS (SELECT name, count(*) AS k FROM links WHERE name IS NOT NULL GROUP BY 1),
x AS (SELECT coalesce(t.name, n.name) AS name, (coalesce(usage, 0) + coalesce(k, 0))::BIGINT AS usage FROM t FULL JOIN n ON t.name = n.name) SELECT * FROM x""")
def m12(spark, d):
    return lb.ensure_tags(spark.createDataFrame([("de", 5), ("zz", 2)], "name string, usage long"), _links(spark, d).where("name IS NOT NULL"))


@query("r45_tag_list", m.with_tables("chunks") + _LINKS + ", x AS (SELECT name, count(*) AS usage FROM links WHERE name IS NOT NULL GROUP BY 1) SELECT * FROM x")
def r45(spark, d):
    return _links(spark, d).where("name IS NOT NULL").groupBy("name").agg(F.count("*").alias("usage")).orderBy(F.desc("usage"), "name")


@query(
    "j5_vocabulary_items",
    m.with_tables("items") + """v AS (SELECT lower(p_brand) AS term, p_partkey % 50 AS item_id FROM part), x AS (SELECT term, v.item_id, external_id FROM v LEFT JOIN items i ON i.item_id = v.item_id AND v.item_id % 2 = 0) SELECT * FROM x""",
)
def j5(spark, d):
    v = m.table(spark, d, "part").select(F.lower("p_brand").alias("term"), (F.col("p_partkey") % 50).alias("item_id"))
    return v.join(m.items(spark, d).where("item_id % 2 = 0").select("item_id", "external_id"), "item_id", "left")


@query("m5_glossary_replace", """WITH v AS (SELECT p_partkey % 20 AS item_id, lower(p_brand) AS term, lower(p_type) AS expansion FROM part),
f AS (SELECT DISTINCT item_id, term, 'new' AS expansion FROM v WHERE item_id % 4 = 0) SELECT * FROM v WHERE item_id % 4 <> 0 UNION ALL SELECT * FROM f""")
def m5(spark, d):
    v = m.table(spark, d, "part").select((F.col("p_partkey") % 20).alias("item_id"), F.lower("p_brand").alias("term"), F.lower("p_type").alias("expansion"))
    return r.replace_glossary(v, v.where("item_id % 4 = 0").withColumn("expansion", F.lit("new")))


@query("m6_project_sources", m.with_tables("sources") + "c(project_id, source_id) AS (VALUES (1, 0), (1, 1), (2, 5)), x AS (SELECT * FROM c WHERE project_id <> 1 UNION ALL SELECT 1, source_id FROM sources WHERE source_id IN (2, 3)) SELECT * FROM x")
def m6(spark, d):
    current = spark.createDataFrame([(1, 0), (1, 1), (2, 5)], "project_id int, source_id int")
    return lb.set_project_sources(current, 1, spark.createDataFrame([(2,), (3,), (3,), (9999,)], "source_id int"), m.sources(spark, d))


def _assets(spark, d):
    n = F.col("page_id")
    return m.table(spark, d, "pages").select(
        n.alias("asset_id"), (n % 40).alias("item_id"), F.concat(F.lit("img/"), (n % 30).cast("string"), F.lit(".png")).alias("path"), F.md5((n % 60).cast("string")).alias("hash"),
        F.when(n % 2 == 0, "embed").otherwise("file").alias("kind"), (n % 9).alias("words"), (n % 10 == 0).alias("by_person"), F.lit("person").alias("attribution"),
        F.when(n % 3 == 0, F.concat(F.lit(" Figure "), n.cast("string"))).otherwise("").alias("caption"), (n * 100_000 + 50_000).alias("chunk_id"), (n % 40 * 10).alias("section_id"),
    )


_ASSETS = """assets AS (SELECT page_id AS asset_id, page_id % 40 AS item_id, 'img/' || page_id % 30 || '.png' AS path, md5((page_id % 60)::VARCHAR) AS hash, CASE WHEN page_id % 2 = 0 THEN 'embed' ELSE 'file' END AS kind,
  page_id % 9 AS words, page_id % 10 = 0 AS by_person, CASE WHEN page_id % 3 = 0 THEN ' Figure ' || page_id ELSE '' END AS caption FROM pages)"""


@query("j9_assets_joined", m.with_tables("items", "sources") + _ASSETS + ", x AS (SELECT asset_id, external_id, label FROM assets JOIN items USING (item_id) JOIN sources USING (source_id)) SELECT * FROM x")
def j9(spark, d):
    base = _assets(spark, d).join(m.items(spark, d).select("item_id", "external_id", "source_id"), "item_id")
    return base.join(m.sources(spark, d).select("source_id", "label"), "source_id").select("asset_id", "external_id", "label")


@query("m9_blob_collection", "WITH " + _ASSETS + ", x AS (SELECT DISTINCT hash FROM assets WHERE asset_id % 60 < 45) SELECT * FROM x")
def m9(spark, d):
    assets = _assets(spark, d)
    return r.collect_blobs(assets.select("hash").distinct(), assets.where("asset_id % 60 < 45"))


@query("u5_stale_assets", "WITH " + _ASSETS + ", x AS (SELECT asset_id FROM assets WHERE path NOT IN (SELECT path FROM assets WHERE asset_id % 30 < 12)) SELECT * FROM x")
def u5(spark, d):
    assets = _assets(spark, d)
    return assets.join(assets.where("asset_id % 30 < 12").select("path"), "path", "left_anti").select("asset_id")


@query("c37_attribution", "WITH " + _ASSETS + """, x AS (SELECT asset_id, CASE WHEN by_person THEN 'person' WHEN kind = 'embed' AND words >= 5 THEN 'embedded' WHEN path IN (SELECT path FROM assets WHERE asset_id % 30 < 12) THEN 'referenced' ELSE 'none' END AS attribution FROM assets) SELECT * FROM x""")
def c37(spark, d):
    assets = _assets(spark, d)
    return lb.attribution(assets, assets.where("asset_id % 30 < 12").select("path")).select("asset_id", "attribution")


@query("c36_caption_chunks", "WITH " + _ASSETS + ", x AS (SELECT asset_id * 100000 + 50000 AS chunk_id, item_id, trim(caption) AS content FROM assets WHERE length(trim(caption)) > 0) SELECT * FROM x")
def c36(spark, d):
    return lb.caption_chunks(_assets(spark, d)).select("chunk_id", "item_id", "content")


@query("r25_named_item", m.with_tables("items") + """f AS (SELECT * FROM items WHERE contains(lower(external_id), 'readme_4') ORDER BY item_id LIMIT 25),
x AS (SELECT item_id, external_id, CASE WHEN string_split(lower(external_id), '/')[-1] = 'readme_4' THEN 0 WHEN ends_with(lower(external_id), 'readme_4') THEN 1 ELSE 2 END AS tier FROM f ORDER BY tier, length(external_id), item_id LIMIT 1) SELECT * FROM x""")
def r25(spark, d):
    return lb.named_item(m.items(spark, d), "README_4")


_NAMED = "theand in readme_4.rs, main_7.md and guide_8.py"
_BOOST = bm25_sql(fx.expanded(fx.query_terms(lb.without_file_names(_NAMED))), LEAF) + f""",
h AS (SELECT chunk_id, item_id, 0.5 AS score FROM chunks WHERE {LEAF} AND contains(content, 'theand') ORDER BY item_id, chunk_id LIMIT 50),
named AS (SELECT item_id, min(chunk_id) AS head FROM chunks WHERE {LEAF} AND item_id IN (4, 7, 8) GROUP BY 1),
best AS (SELECT item_id, first(chunk_id ORDER BY score DESC, chunk_id) AS best FROM leg GROUP BY 1),
b AS (SELECT coalesce(best, head) AS chunk_id, named.item_id, 1.5 AS score, true AS boosted FROM named LEFT JOIN best USING (item_id)),
x AS (SELECT * FROM b UNION ALL SELECT *, false FROM h WHERE chunk_id NOT IN (SELECT chunk_id FROM b)) SELECT * FROM x"""


@query("r26_r27_filename_boost", m.with_tables("chunks") + _BOOST)
def r26(spark, d):
    chunks = m.chunks(spark, d)
    hits = rt.exact_leg(chunks, "theand", 50).withColumn("score", F.lit(0.5))
    return lb.boosted(hits, lb.named_items(m.items(spark, d), _NAMED), chunks, _NAMED)


def _page(spark, d):
    n = F.col("doc_id")
    return m.table(spark, d, "documents").select((n + 1).cast("int").alias("rank"), n.alias("chunk_id"), F.when(n < 12, F.element_at(F.array(F.lit("prose"), F.lit("code")), (n % 2 + 1).cast("int"))).when(n % 5 == 0, "record").when(n % 5 == 1, "config").alias("doc_type"))


_PAGE = "page AS (SELECT (doc_id + 1)::INTEGER AS rank, doc_id AS chunk_id, CASE WHEN doc_id < 12 THEN ['prose', 'code'][doc_id % 2 + 1] WHEN doc_id % 5 = 0 THEN 'record' WHEN doc_id % 5 = 1 THEN 'config' END AS doc_type FROM documents)"


@query("r21_type_slots", f"WITH {_PAGE}, b AS (SELECT doc_type, min(rank) AS rank FROM page WHERE rank > 10 AND doc_type IS NOT NULL AND doc_type NOT IN (SELECT doc_type FROM page WHERE rank <= 10) GROUP BY 1), x AS (SELECT rank, chunk_id, page.doc_type FROM page JOIN b USING (rank) ORDER BY rank LIMIT 2) SELECT * FROM x")
def r21(spark, d):
    return rt.type_slots(_page(spark, d), 10).select("rank", "chunk_id", "doc_type")


@query("r23_slot_eviction", f"WITH {_PAGE}, s AS (SELECT *, doc_type IS NULL OR row_number() OVER (PARTITION BY doc_type ORDER BY rank) > 1 AS spare FROM page WHERE rank <= 20), n AS (SELECT *, row_number() OVER (ORDER BY spare DESC, rank DESC) AS n FROM s) SELECT rank, chunk_id, doc_type FROM n WHERE n > 2")
def r23(spark, d):
    return lb.evict(_page(spark, d).where("rank <= 20"), 2).select("rank", "chunk_id", "doc_type")


@query("r30_claimed_neighbours", m.with_tables("chunks") + f"""h AS (SELECT chunk_id, row_number() OVER (ORDER BY item_id, chunk_id)::INTEGER AS rank FROM (SELECT * FROM chunks WHERE {LEAF} AND contains(content, 'theand') ORDER BY item_id, chunk_id LIMIT 50)),
a AS (SELECT chunk_id, lag(chunk_id) OVER w AS b, lead(chunk_id) OVER w AS f FROM chunks WINDOW w AS (PARTITION BY item_id ORDER BY chunk_id)),
q AS (SELECT rank, chunk_id, unnest([b, f]) AS extra FROM h JOIN a USING (chunk_id)),
x AS (SELECT min(rank) AS rank, arg_min(chunk_id, rank) AS chunk_id, extra FROM q WHERE extra IS NOT NULL AND extra NOT IN (SELECT chunk_id FROM h) GROUP BY extra) SELECT * FROM x""")
def r30(spark, d):
    from pyspark.sql import Window

    chunks = m.chunks(spark, d)
    hits = rt.exact_leg(chunks, "theand", 50).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("item_id", "chunk_id")))
    return lb.claimed_neighbours(hits, rt.neighbours(chunks))


@query("r47_quality_flag", """WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(CASE WHEN doc_id % 9 = 0 THEN repeat('a b cd ', 30) ELSE text END, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS ws FROM documents)
SELECT doc_id AS item_id, CASE WHEN len(ws) >= 40 AND len(list_filter(ws, lambda w: length(w) <= 2)) > 0.6 * len(ws) THEN 'suspect' WHEN doc_id % 4 = 0 THEN 'repaired' END AS flag FROM w""")
def r47(spark, d):
    n = F.col("item_id")
    items = m.items(spark, d).withColumn("text", F.when(n % 9 == 0, "a b cd " * 30).otherwise(F.col("text")))
    items = items.withColumn("external_id", F.concat("external_id", F.lit(".pdf")))  # the tables have no PDF files
    return lb.quality_flags(items, items.where(n % 4 == 0))


@query("c31_embed_input", """SELECT event_id, 'Doc > ' || event_type || chr(10) || 'see ' || event_type || ' and img ' AS text FROM events""")
def c31(spark, d):
    e = m.table(spark, d, "events")
    content = F.concat(F.lit("see ["), F.col("event_type"), F.lit("](http://x/(a)) and ![img](p.png) "))
    return e.select("event_id", lb.embed_input(F.concat(F.lit("Doc > "), F.col("event_type")), content).alias("text"))


@query("w3_near_copy_drop", m.with_tables("chunks") + f"""s AS (SELECT chunk_id, item_id, substr(regexp_replace(lower(trim(regexp_replace(content, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))), '^[0-9]{{1,4}} +', ''), 1, 160) AS sg FROM chunks WHERE {LEAF}),
x AS (SELECT min(chunk_id) AS chunk_id FROM s GROUP BY item_id, sg) SELECT * FROM x""")
def w3(spark, d):
    leaves = m.chunks(spark, d).where(F.col("kind").isin(*m.LEAF_KINDS)).withColumn("score", F.lit(1.0))
    return rt.drop_near_copies(leaves, rt.signature(F.col("content"))).select("chunk_id")


@query("w10_event_page", "SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n BETWEEN 51 AND 100")
def w10(spark, d):
    return m.table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).offset(50).limit(50).select("event_id")


@query("c22_tag_links", f"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower('Item ' || doc_id || ' ' || text), '[\\p{{L}}\\p{{N}}]{{4,}}')) AS tag FROM documents),
c AS (SELECT doc_id, tag, count(*) AS n FROM w WHERE NOT list_contains({fx.TAG_STOPWORDS}, tag) GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, tag)::INTEGER AS place FROM c) SELECT doc_id, tag, place FROM p WHERE place <= 4""")
def c22(spark, d):
    titled = m.table(spark, d, "documents").select("doc_id", F.concat(F.lit("Item "), F.col("doc_id").cast("string"), F.lit(" "), F.col("text")).alias("text"))
    return lb.propose_tags(titled, "doc_id", "text")


@query("c22_tag_reuse", """WITH k AS (SELECT DISTINCT lower(p_name) AS tag FROM part WHERE p_partkey % 3 = 0), w AS (SELECT DISTINCT lower(p_name || ' ' || p_brand) AS name FROM part WHERE p_partkey % 3 = 1),
kb AS (SELECT tag, word, count(*) AS n FROM (SELECT tag, unnest(regexp_extract_all(tag, '[\\p{L}\\p{N}]+')) AS word FROM k) GROUP BY ALL),
wb AS (SELECT name, word, count(*) AS n FROM (SELECT name, unnest(regexp_extract_all(name, '[\\p{L}\\p{N}]+')) AS word FROM w) GROUP BY ALL),
ks AS (SELECT tag, sum(n * n) AS s FROM kb GROUP BY 1), ws AS (SELECT name, sum(n * n) AS s FROM wb GROUP BY 1),
d AS (SELECT name, tag, sum(wb.n * kb.n) AS dot FROM wb JOIN kb USING (word) GROUP BY ALL),
c AS (SELECT name, tag, round(dot / sqrt(ws.s * ks.s), 9) AS cosine FROM d JOIN ws USING (name) JOIN ks USING (tag)),
b AS (SELECT name, tag FROM c WHERE cosine > 0.82 AND name NOT IN (SELECT tag FROM k) QUALIFY row_number() OVER (PARTITION BY name ORDER BY cosine DESC, tag) = 1)
SELECT name, coalesce(tag, name) AS tag FROM w LEFT JOIN b USING (name)""")
def c22_reuse(spark, d):
    part = m.table(spark, d, "part")
    named = part.select("p_partkey", F.col("p_name").alias("name"), F.concat_ws(" ", "p_name", "p_brand").alias("longer"))
    return lb.reuse_tags(named.where("p_partkey % 3 = 1").select(F.col("longer").alias("name")), named.where("p_partkey % 3 = 0"))


#: Every fifth document as a PDF file, every tenth of them with its words torn.
_TORN = """p AS (SELECT doc_id AS item_id, doc_id % 5 = 0 AS pdf, CASE WHEN doc_id % 10 = 0 THEN regexp_replace(text, '([a-z]{3})([a-z]{3})', '\\1 \\2', 'g') ELSE text END AS text FROM documents)"""


@query("r16_torn_files", f"""WITH {_TORN},
lex AS (SELECT word FROM (SELECT DISTINCT item_id, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}]+')) AS word FROM p WHERE NOT pdf) WHERE regexp_full_match(word, '[a-z]{{2,40}}') GROUP BY word HAVING count(*) >= 3 ORDER BY count(*) DESC, word LIMIT 200000),
w0 AS (SELECT item_id, lower(regexp_replace(regexp_replace(unnest(regexp_split_to_array(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '\\s+')), '^[^\\p{{L}}\\p{{N}}]+', ''), '[^\\p{{L}}\\p{{N}}]+$', '')) AS w, generate_subscripts(regexp_split_to_array(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '\\s+'), 1) AS i FROM p WHERE pdf),
w1 AS (SELECT item_id, i, w, lag(w) OVER o AS before, lead(w) OVER o AS after FROM w0 WHERE w <> '' WINDOW o AS (PARTITION BY item_id ORDER BY i)),
w2 AS (SELECT *, w IN (SELECT word FROM lex) AS known, coalesce(after IN (SELECT word FROM lex), false) AS next, coalesce(w || after IN (SELECT word FROM lex), false) AS joined,
  regexp_full_match(w, '[a-z]+') AS plain, coalesce(regexp_full_match(after, '[a-z]+'), false) AS after_plain FROM w1),
f AS (SELECT item_id, count(*) AS n, sum((plain AND length(w) BETWEEN 2 AND 4 AND NOT known AND (coalesce(regexp_matches(before, '[a-z]$'), false) OR coalesce(regexp_matches(after, '^[a-z]'), false)))::INTEGER)
  + sum((plain AND after_plain AND length(w) >= 2 AND length(after) >= 2 AND length(w) + length(after) >= 5 AND joined AND NOT (known AND next))::INTEGER) AS k FROM w2 GROUP BY 1)
SELECT item_id FROM f WHERE k >= 6 AND k * 1000 >= n * 6""")
def r16(spark, d):
    n = F.col("item_id")
    items = m.items(spark, d).withColumn("text", F.when(n % 10 == 0, F.regexp_replace("text", "([a-z]{3})([a-z]{3})", "$1 $2")).otherwise(F.col("text")))
    items = items.withColumn("external_id", F.when(n % 5 == 0, F.concat("external_id", F.lit(".pdf"))).otherwise(F.col("external_id")))
    return lb.suspects(items, lb.lexicon(items))


_IGNORES = [(".gitignore", "*.lock\n!keep_*.lock\nbuild/\n/src1/docs/**/readme_*.md\n# note\n"), ("src2/.gitignore", "!*.lock\nspec_?[0-9].py\n"), ("src2/app/.gitignore", "main_*\n!main_*.rs\n")]


@query("s1_ignored_paths", m.with_tables("items") + """f AS (SELECT item_id, external_id AS rel, split_part(external_id, '/', 1) AS top, split_part(external_id, '/', 2) AS dir, split_part(external_id, '/', 3) AS name FROM items),
x AS (SELECT item_id, rel FROM f WHERE dir <> 'build' AND NOT (top = 'src1' AND dir = 'docs' AND regexp_matches(name, '^readme_.*\\.md$'))
  AND NOT (top <> 'src2' AND suffix(name, '.lock')) AND NOT (top = 'src2' AND regexp_matches(name, '^spec_.[0-9]\\.py$')) AND NOT (top = 'src2' AND dir = 'app' AND starts_with(name, 'main_') AND NOT suffix(name, '.rs'))) SELECT * FROM x""")
def s1(spark, d):
    from ..sources import extract

    files = m.items(spark, d).select("item_id", F.col("external_id").alias("rel"))
    return extract.not_ignored(files, spark.createDataFrame(_IGNORES, "rel string, text string"))
