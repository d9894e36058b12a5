"""Registered queries of the retrieval operators, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import model as m
from ..functions import text as fx
from ..operators import answers as an
from ..operators import relations as r
from ..operators import retrieval as rt
from ..operators import search as se
from ..operators import trees
from ..operators.cells import VectorIndex
from ..operators.index import KeywordIndex
from ..storage import Scratch, local
from .relational import _ENV_SQL, _TIER_SQL, LEAF, Query

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

QUESTION = "Der nicht que pour und cancellation of the"
TERMS = fx.expanded(fx.query_terms(QUESTION))
NEEDLE = "theand"
NOW = "2024-02-01"


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


_INDEXES: dict[tuple[str, str], KeywordIndex] = {}


def index_of(spark, d: str) -> KeywordIndex:
    """The keyword index of the chunks of a folder, built once per session."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _INDEXES:
        _INDEXES[key] = KeywordIndex.build(m.chunks(spark, d), f"{Scratch(spark, 'index').root}/keyword")
    return _INDEXES[key]


def bm25_sql(terms: list[str], kinds: str) -> str:
    """BM25 over chunks as common table expressions; the last is leg(chunk_id, item_id, section_id, kind, status, score, terms)."""
    return f"""tok AS (SELECT chunk_id, item_id, section_id, kind, status, regexp_extract_all(translate(lower(content), '{fx.MARKED}', '{fx.PLAIN}'), '[\\p{{L}}\\p{{N}}]+') AS words FROM chunks),
len AS (SELECT *, len(words) AS dl, avg(len(words)) OVER () AS avgdl, count(*) OVER () AS n FROM tok),
term(t) AS (SELECT unnest({terms})),
tf AS (SELECT chunk_id, item_id, section_id, kind, status, dl, avgdl, n, t, len(list_filter(words, lambda w: w = t)) AS tf FROM len, term),
df AS (SELECT t, count(*) AS df FROM tf WHERE tf > 0 GROUP BY t),
part AS (SELECT *, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS s FROM tf JOIN df USING (t) WHERE tf > 0),
leg AS (SELECT chunk_id, item_id, section_id, kind, status, round(sum(s), 9) AS score, count(*)::INTEGER AS terms FROM part WHERE {kinds} GROUP BY ALL)"""


@query("r5_query_terms", f"""WITH t AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_§\\-]+')) AS term FROM conversations)
SELECT conv_id, turn, count(*) AS n FROM t WHERE strlen(term) >= 2 AND NOT list_contains({fx.STOPWORDS}, term) GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY conv_id, turn"))
def r5(spark, d):
    t = m.table(spark, d, "conversations").select("conv_id", "turn", F.explode(fx.terms_column(F.col("text"))).alias("term"))
    return t.groupBy("conv_id", "turn").agg(F.count("*").alias("n"))


@query("r8_keyword_leg", m.with_tables("chunks") + bm25_sql(TERMS, LEAF) + " SELECT chunk_id, item_id, score, terms FROM leg ORDER BY score DESC, chunk_id LIMIT 100")
def r8(spark, d):
    return rt.keyword_leg(index_of(spark, d), QUESTION, 100).select("chunk_id", "item_id", "score", "terms")


@query("r9_rich_match", m.with_tables("chunks") + bm25_sql(TERMS, LEAF) + " SELECT chunk_id, terms >= 3 AND score >= 5.0 AS rich FROM leg ORDER BY score DESC, chunk_id LIMIT 100")
def r9(spark, d):
    c = rt.RetrievalConfig()
    leg = rt.keyword_leg(index_of(spark, d), QUESTION, 100)
    return leg.select("chunk_id", ((F.col("terms") >= c.pierce_terms) & (F.col("score") >= c.pierce_bm25)).alias("rich"))


@query("j2_postings", """WITH t AS (SELECT conv_id * 100 + turn AS chunk_id, unnest(regexp_extract_all(translate(lower(text), '%s', '%s'), '[\\p{L}\\p{N}]+')) AS term FROM conversations)
SELECT term, count(DISTINCT chunk_id) AS df, count(*) AS tf FROM t GROUP BY 1""" % (fx.MARKED, fx.PLAIN))
def j2(spark, d):
    own = [F.col("conv_id").alias("item_id"), F.lit(None).cast("long").alias("section_id"), F.lit("document").alias("kind"), F.lit(None).cast("string").alias("status")]
    chunks = m.table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("chunk_id"), *own, F.col("text").alias("content"))
    return KeywordIndex.build(chunks, f"{Scratch(spark, 'index').root}/keyword").postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


@query(
    "r10_vector_leg",
    """WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0),
s AS (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT v FROM q)::DOUBLE[]), 6) AS score FROM embeddings WHERE label <> 3)
SELECT vec_id, score FROM s WHERE score > 0.2 ORDER BY score DESC, vec_id LIMIT 100""",
)
def r10(spark, d):
    e = m.table(spark, d, "embeddings")
    asked = e.where("vec_id = 0").select("embedding").first()[0]  # the query vector, one row
    return rt.vector_leg(e.where("label <> 3"), asked, 100).select("vec_id", "score")


_CELLS: dict[tuple[str, str], VectorIndex] = {}


def cells_of(spark, d: str) -> VectorIndex:
    """The vector index of the embeddings of a folder, built once per session."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _CELLS:
        vectors = m.table(spark, d, "embeddings").select("vec_id", "label", "embedding", F.concat(F.lit("model"), F.col("label").cast("string"), F.lit(":64")).alias("fp"))
        _CELLS[key] = VectorIndex.build(vectors, f"{Scratch(spark, 'index').root}/cells", key="vec_id")
    return _CELLS[key]


def _asked(spark, d, vec_id: int) -> list[float]:
    return m.table(spark, d, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0]  # the query vector, one row


@query("r11_indexed_vector_leg", """WITH s AS (SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[]), 6) AS score FROM embeddings WHERE label <> 3)
SELECT vec_id, label, score FROM s WHERE score > 0.2 ORDER BY score DESC, vec_id LIMIT 100""")
def r11(spark, d):
    return cells_of(spark, d).near(_asked(spark, d, 0), 100, key="vec_id", narrow=lambda rows: rows.where("label <> 3")).select("vec_id", "label", "score")


@query("r11_indexed_family", """WITH s AS (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 7)::DOUBLE[]), 6) AS score FROM embeddings WHERE label = 2)
SELECT vec_id, score FROM s WHERE score > 0.2 ORDER BY score DESC, vec_id LIMIT 10""")
def r11_family(spark, d):
    return rt.vector_leg(cells_of(spark, d), _asked(spark, d, 7), 10, family_of="model2").select("vec_id", "score")


@query(
    "f5_vector_family",
    """SELECT vec_id, 'model' || label || ':64' AS fp FROM embeddings WHERE label IN (1, 2)""",
)
def f5(spark, d):
    stamped = m.table(spark, d, "embeddings").select("vec_id", F.concat(F.lit("model"), F.col("label").cast("string"), F.lit(":64")).alias("fp"))
    return stamped.where(rt.family(F.col("fp")).isin("model1", "model2"))


@query("r13_exact_leg", m.with_tables("chunks") + f"x AS (SELECT chunk_id, item_id FROM chunks WHERE {LEAF} AND contains(content, '{NEEDLE}') ORDER BY item_id, chunk_id LIMIT 200) SELECT * FROM x")
def r13(spark, d):
    return rt.exact_leg(m.chunks(spark, d), NEEDLE, 200).select("chunk_id", "item_id")


@query(
    "r14_tag_prune",
    m.with_tables("chunks") + """t AS (SELECT chunk_id, section_id, content FROM chunks WHERE section_id IS NOT NULL),
x AS (SELECT DISTINCT section_id FROM t WHERE list_contains(regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+'), 'nicht')) SELECT * FROM x""",
)
def r14(spark, d):
    words = F.regexp_extract_all(F.lower("content"), F.lit(r"[\p{L}\p{N}]+"), 0)
    tags = m.chunks(spark, d).where("section_id IS NOT NULL").select("section_id", F.explode(F.array_distinct(words)).alias("name"))
    return se.tagged_sections(tags, "Is it nicht?")


_LEGS = bm25_sql(TERMS, LEAF) + f""", kw AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS rk FROM (SELECT * FROM leg ORDER BY score DESC, chunk_id LIMIT 100)),
ex0 AS (SELECT chunk_id, item_id, status, 1.0 AS score FROM chunks WHERE {LEAF} AND contains(content, '{NEEDLE}') ORDER BY item_id, chunk_id LIMIT 100),
ex AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS rk FROM ex0),
alll AS (SELECT chunk_id, item_id, status, 1.0 / (60 + rk) AS s, 'keyword' AS leg, terms >= 3 AND score >= 5.0 AS rich FROM kw UNION ALL SELECT chunk_id, item_id, status, 0.5 / (60 + rk), 'exact', false FROM ex),
fused AS (SELECT chunk_id, item_id, any_value(status) AS status, round(sum(s), 9) AS score, bool_or(rich) AS rich, string_agg(DISTINCT leg, ',' ORDER BY leg) AS legs FROM alll GROUP BY chunk_id, item_id)"""


def _legs(spark, d):
    index = index_of(spark, d)  # its texts are the chunks, cut once
    return [("keyword", rt.keyword_leg(index, QUESTION, 100), 1.0), ("exact", rt.exact_leg(index.texts, NEEDLE, 100), 0.5)]


@query("r17_rrf_fusion", m.with_tables("chunks") + _LEGS + " SELECT chunk_id, item_id, score, legs FROM fused")
def r17(spark, d):
    return rt.fuse(_legs(spark, d)).select("chunk_id", "item_id", "score", "legs")


@query("r18_single_leg", m.with_tables("chunks") + bm25_sql(TERMS, LEAF) + " SELECT chunk_id, score, 'keyword' AS legs FROM leg ORDER BY score DESC, chunk_id LIMIT 100")
def r18(spark, d):
    return rt.fuse(_legs(spark, d)[:1]).select("chunk_id", "score", "legs")


@query("r19_age_decay", m.with_tables("items") + f"x AS (SELECT item_id, round(CASE WHEN created_at >= TIMESTAMP '{NOW}' THEN 1.0 ELSE greatest(pow(0.5, (epoch(TIMESTAMP '{NOW}') - epoch(created_at)) / 86400.0 / 365.0), 0.8) END, 9) AS decay FROM items) SELECT * FROM x")
def r19(spark, d):
    return m.items(spark, d).select("item_id", F.round(rt.age_decay(F.col("created_at"), F.lit(NOW).cast("timestamp")), 9).alias("decay"))


_RANK = _LEGS + f""", facts AS (SELECT item_id, created_at, CASE WHEN {_ENV_SQL} THEN 'test' ELSE 'live' END AS env, ({_TIER_SQL})::INTEGER AS tier FROM items),
h AS (SELECT f.chunk_id, f.item_id, f.status, f.legs, f.rich, env, tier, content,
  round(f.score * CASE WHEN created_at >= TIMESTAMP '{NOW}' THEN 1.0 ELSE greatest(pow(0.5, (epoch(TIMESTAMP '{NOW}') - epoch(created_at)) / 86400.0 / 365.0), 0.8) END, 9) AS score
  FROM fused f JOIN facts USING (item_id) JOIN chunks c ON c.chunk_id = f.chunk_id),
capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id) AS n, (SELECT count(DISTINCT item_id) FROM h) AS items FROM h) WHERE n <= CASE WHEN items >= 3 THEN 3 ELSE 10 END),
sig AS (SELECT *, substr(regexp_replace(lower(trim(regexp_replace(content, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))), '^[0-9]{{1,4}} +', ''), 1, 160) AS sg FROM capped),
uniq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id, sg ORDER BY score DESC, chunk_id) AS m FROM sig) WHERE m = 1),
kept AS (SELECT * FROM uniq WHERE status IS NULL OR status <> 'stale'),
page AS (SELECT *, row_number() OVER (ORDER BY env = 'test', NOT rich, tier, score DESC, chunk_id)::INTEGER AS rank FROM kept)"""


@query("r20_fuse_and_rank", m.with_tables("chunks", "items") + _RANK + " SELECT rank, chunk_id, item_id, score, env, tier, legs, status FROM page WHERE rank <= 10")
def r20(spark, d):
    legs = [(name, local(leg), weight) for name, leg, weight in _legs(spark, d)]  # a hundred rows each
    seen = {r["chunk_id"]: r["item_id"] for _, leg, _ in legs for r in leg.collect()}
    ids = sorted(set(seen.values()))
    hits = rt.fuse_and_rank(legs, index_of(spark, d).texts_of(ids, sorted(seen)), m.items(spark, d).where(F.col("item_id").isin(ids)), F.lit(NOW).cast("timestamp"))
    return hits.select("rank", "chunk_id", "item_id", "score", "env", "tier", "legs", "status")


@query("w2_item_cap", m.with_tables("chunks") + _LEGS + """, n AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id) AS n, (SELECT count(DISTINCT item_id) FROM fused) AS items FROM fused)
SELECT chunk_id, item_id, score FROM n WHERE n <= CASE WHEN items >= 3 THEN 3 ELSE 10 END""")
def w2(spark, d):
    return rt.per_item_cap(rt.fuse(_legs(spark, d))).select("chunk_id", "item_id", "score")


@query("r28_relevance_gate", m.with_tables("chunks") + _LEGS + " SELECT chunk_id, score FROM fused WHERE (SELECT bool_or(contains(legs, 'keyword')) FROM fused)")
def r28(spark, d):
    return rt.relevance_gate(rt.fuse(_legs(spark, d)), F.col("keyword"), F.lit(0.0)).select("chunk_id", "score")


@query("r22_keyword_slots", m.with_tables("chunks") + _LEGS + """, top AS (SELECT * FROM fused ORDER BY score DESC, chunk_id LIMIT 5),
miss AS (SELECT * FROM kw WHERE chunk_id NOT IN (SELECT chunk_id FROM top) ORDER BY rk LIMIT 2) SELECT chunk_id, item_id, round(0.5 / (60 + rk), 9) AS score FROM miss""")
def r22(spark, d):
    legs = _legs(spark, d)
    top = rt.fuse(legs).orderBy(F.desc("score"), "chunk_id").limit(5)
    return rt.keyword_slots(top, legs[0][1]).select("chunk_id", "item_id", "score")


@query("w4_section_admission", m.with_tables("sections", "chunks") + """h AS (SELECT item_id, section_id, (length(content) % 97)::DOUBLE AS score FROM chunks WHERE section_id IS NOT NULL),
s AS (SELECT item_id, section_id, max(score) AS score FROM h GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, section_id) AS n FROM s),
p AS (SELECT section_id, item_id, score, row_number() OVER (ORDER BY score DESC, section_id)::INTEGER AS place FROM n WHERE n <= 2) SELECT * FROM p WHERE place <= 10""")
def w4(spark, d):
    hits = m.chunks(spark, d).where("section_id IS NOT NULL").groupBy("item_id", "section_id").agg(F.max((F.length("content") % 97).cast("double")).alias("score"))
    return rt.admitted_sections(hits)


_TOC = m.with_tables("chunks", "sections") + bm25_sql(TERMS, "true") + f""", summ AS (SELECT * FROM leg WHERE kind IN ('section_summary', 'doc_summary') ORDER BY score DESC, chunk_id LIMIT 15),
cand AS (SELECT s.item_id, s.section_id, round(m.score - level * 1e-3, 9) AS score FROM summ m JOIN sections s ON s.item_id = m.item_id),
adm AS (SELECT section_id, row_number() OVER (ORDER BY score DESC, section_id) AS place FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, section_id) AS n FROM cand) WHERE n <= 2)
SELECT chunk_id, section_id, score FROM leg WHERE {LEAF} AND section_id IN (SELECT section_id FROM adm WHERE place <= 10) ORDER BY score DESC, chunk_id LIMIT 50"""


@query("r15_toc_search", _TOC)
def r15(spark, d):
    return rt.toc_search(index_of(spark, d), m.sections(spark, d), QUESTION).select("chunk_id", "section_id", "score")


@query(
    "r29_parent_return",
    m.with_tables("sections", "chunks") + f"""down(root, node) AS (SELECT section_id, section_id FROM sections UNION ALL SELECT root, s.section_id FROM down JOIN sections s ON s.parent_id = node),
sz AS (SELECT root, (coalesce(sum(length(content)), 0) + 4 * greatest(0, count(chunk_id) - 1))::BIGINT AS chars FROM down LEFT JOIN chunks c ON c.section_id = node GROUP BY 1),
hit AS (SELECT chunk_id, section_id FROM chunks WHERE {LEAF} AND contains(content, '{NEEDLE}') ORDER BY item_id, chunk_id LIMIT 200),
up(chunk_id, section_id, node, step) AS (SELECT chunk_id, section_id, section_id, 0 FROM hit UNION ALL SELECT up.chunk_id, up.section_id, s.parent_id, step + 1 FROM up JOIN sections s ON s.section_id = node WHERE s.parent_id IS NOT NULL),
x AS (SELECT chunk_id, up.section_id, arg_min(node, step) FILTER (chars <= 8000) AS parent_section, arg_min(chars, step) FILTER (chars <= 8000) AS chars FROM up JOIN sz ON root = node GROUP BY chunk_id, up.section_id) SELECT * FROM x""",
)
def r29(spark, d):
    chunks, sections = m.chunks(spark, d), m.sections(spark, d)
    hits = rt.exact_leg(chunks, NEEDLE, 200)
    own = sections.join(hits.select("section_id").distinct().join(sections.select("section_id", "item_id"), "section_id").select("item_id"), "item_id", "left_semi")  # sections of the hits' items
    return trees.parent_return(hits, trees.ancestors(own), trees.subtree_sizes(own, chunks))


#: Documents as the leaves of one chain of sections per 150, deeper than any way up to a result's parent may be.
_CHAIN = "chain AS (SELECT doc_id AS section_id, CASE WHEN doc_id % 150 > 0 THEN doc_id - 1 END AS parent_id, doc_id AS chunk_id, coalesce(text, '') AS content FROM documents)"


def _chain(spark, d):
    n = F.col("doc_id")
    return m.table(spark, d, "documents").select(n.alias("section_id"), F.when(n % 150 > 0, n - 1).alias("parent_id"), n.alias("chunk_id"), F.lit("document").alias("kind"), F.coalesce("text", F.lit("")).alias("content"))


@query("r29_deep_parent_return", f"""WITH RECURSIVE {_CHAIN}, down(root, node) AS (SELECT section_id, section_id FROM chain UNION ALL SELECT root, s.section_id FROM down JOIN chain s ON s.parent_id = node),
sz AS (SELECT root, (sum(length(content)) + 4 * (count(*) - 1))::BIGINT AS chars FROM down JOIN chain ON section_id = node GROUP BY 1),
up(chunk_id, section_id, node, step) AS (SELECT chunk_id, section_id, section_id, 0 FROM chain UNION ALL SELECT up.chunk_id, up.section_id, s.parent_id, step + 1 FROM up JOIN chain s ON s.section_id = node WHERE s.parent_id IS NOT NULL AND step < 63)
SELECT chunk_id, up.section_id, arg_min(node, step) FILTER (chars <= 8000) AS parent_section, arg_min(chars, step) FILTER (chars <= 8000) AS chars FROM up JOIN sz ON root = node GROUP BY chunk_id, up.section_id""")
def r29_deep(spark, d):
    chain = _chain(spark, d)
    return trees.parent_return(chain, trees.ancestors(chain), trees.subtree_sizes(chain, chain))


@query("r44_deep_node_text", f"""WITH RECURSIVE {_CHAIN}, down(root, node) AS (SELECT section_id, section_id FROM chain UNION ALL SELECT root, s.section_id FROM down JOIN chain s ON s.parent_id = node),
t AS (SELECT root, string_agg(content, chr(10) || chr(10) ORDER BY chunk_id) AS body FROM down JOIN chain c ON c.section_id = node GROUP BY 1)
SELECT root AS section_id, length(body) AS total, length(body) > 32000 AS truncated, md5(substr(body, 1, 32000)) AS digest FROM t""")
def r44_deep(spark, d):
    chain = _chain(spark, d)
    texts = trees.node_texts(trees.ancestors(chain, None), chain)
    return texts.select("section_id", "total", "truncated", F.md5("body").alias("digest"))


@query(
    "r31_match_snippet",
    """WITH b AS (SELECT doc_id, text, length(text) AS size, CASE WHEN strpos(lower(text), 'nicht') > 0 THEN strpos(lower(text), 'nicht') - 1 END AS p FROM documents),
e AS (SELECT *, least(greatest(0, p - 97) + 200, size) AS stop FROM b), s AS (SELECT *, CASE WHEN p IS NULL THEN 0 ELSE greatest(0, stop - 200) END AS start FROM e)
SELECT doc_id, CASE WHEN size <= 200 THEN text ELSE CASE WHEN start > 0 THEN '…' ELSE '' END || substr(text, start + 1, 200) || CASE WHEN p IS NOT NULL AND start + 200 < size THEN '…' ELSE '' END END AS snippet FROM s""",
)
def r31(spark, d):
    return m.table(spark, d, "documents").select("doc_id", fx.snippet(F.col("text"), fx.query_terms("nicht"), 200).alias("snippet"))


@query("r36_answer_context", m.with_tables("chunks") + _LEGS + """, top AS (SELECT row_number() OVER (ORDER BY f.score DESC, f.chunk_id)::INTEGER AS rank, f.chunk_id, substr(content, 1, 2000) AS w FROM fused f JOIN chunks c ON c.chunk_id = f.chunk_id),
run AS (SELECT *, sum(length(w)) OVER (ORDER BY rank) AS used FROM top) SELECT rank, chunk_id, '[S' || rank || ']' AS mark, length(w) AS chars FROM run WHERE used <= 24000""")
def r36(spark, d):
    from pyspark.sql import Window

    fused = local(rt.fuse(_legs(spark, d)))  # candidates are limited per leg
    told = fused.select("chunk_id", "item_id").collect()
    hits = fused.join(index_of(spark, d).texts_of(sorted({r["item_id"] for r in told}), [r["chunk_id"] for r in told]).select("chunk_id", "content"), "chunk_id")
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "chunk_id")))
    return an.answer_context(ranked).drop("window")


@query(
    "r37_followup_rewrite",
    f"""WITH u AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS last FROM conversations WHERE role = 'user')
SELECT conv_id, turn, substr(CASE WHEN last IS NOT NULL AND (list_has_any(regexp_split_to_array(lower(text), '\\s+'), {rt.FOLLOWUP_WORDS}) OR contains(lower(text), 'its ') OR contains(lower(text), ' for it')) THEN last || ' ' || text ELSE text END, 1, 500) AS question FROM u""",
)
def r37(spark, d):
    return rt.followups(m.table(spark, d, "conversations"))


@query(
    "r38_acronyms",
    f"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[^\\p{{L}}\\p{{N}}]+'), lambda w: regexp_full_match(w, '[A-Z][A-Z0-9]{{1,6}}') AND NOT list_contains({rt.NOT_ACRONYMS}, w)) AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM t), f AS (SELECT doc_id, w[i] AS a, min(i) AS i FROM p GROUP BY doc_id, w[i]),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM f) SELECT doc_id, string_agg(a, ',' ORDER BY i) AS acronyms FROM n WHERE n <= 4 GROUP BY doc_id""",
)
def r38(spark, d):
    found = m.table(spark, d, "documents").select("doc_id", F.array_join(rt.acronyms(F.col("text")), ",").alias("acronyms"))
    return found.where("acronyms <> ''")


@query("r46_item_list", m.with_tables("items", "sources") + """x AS (SELECT item_id, external_id, count(*) OVER () AS total FROM items JOIN sources USING (source_id) WHERE label = 'public' AND coalesce(sensitive_override, false) = false AND starts_with(lower(external_id), 'src3/')
  ORDER BY external_id, item_id LIMIT 25) SELECT * FROM x""")
def r46(spark, d):
    listed = r.path_prefix(r.public_items(m.items(spark, d), m.sources(spark, d)), "src3/").select("item_id", "external_id")
    return r.page(listed, [F.col("external_id"), F.col("item_id")], 25)


@query("r42_outline", m.with_tables("sections", "chunks") + "x AS (SELECT s.section_id, s.path, s.level, count(chunk_id) AS n_chunks, coalesce(sum(length(content)), 0)::BIGINT AS chars FROM sections s LEFT JOIN chunks c ON c.section_id = s.section_id WHERE s.level <= 1 GROUP BY ALL) SELECT * FROM x".replace("GROUP BY ALL", "GROUP BY s.section_id, s.path, s.level"))
def r42(spark, d):
    return r.section_sizes(m.sections(spark, d).where("level <= 1"), m.chunks(spark, d)).select("section_id", "path", "level", "n_chunks", "chars")


@query(
    "r35_conflict_warnings",
    m.with_tables("chunks", "entities") + """rel AS (SELECT a.entity_id AS f, b.entity_id AS t FROM entities a JOIN entities b ON b.entity_id = a.entity_id + 3 WHERE a.entity_id % 2 = 0),
bw AS (SELECT * FROM rel UNION ALL SELECT t, f FROM rel), cp AS (SELECT f AS entity_id, string_agg(DISTINCT record_id, ',' ORDER BY record_id) AS conflicts FROM bw JOIN entities e ON e.entity_id = t WHERE status IS NULL OR status <> 'stale' GROUP BY 1),
x AS (SELECT c.chunk_id, conflicts FROM chunks c JOIN entities e ON e.item_id = c.item_id AND (e.status IS NULL OR e.status <> 'stale') JOIN cp ON cp.entity_id = e.entity_id WHERE c.kind = 'doc_summary') SELECT * FROM x""",
)
def r35(spark, d):
    from .relational import _relationships

    e = m.entities(spark, d)
    live = e.where("status IS NULL OR status <> 'stale'").select("entity_id", "item_id")
    warned = live.join(r.conflict_pairs(_relationships(e), e), "entity_id")
    return m.chunks(spark, d).where("kind = 'doc_summary'").select("chunk_id", "item_id").join(warned, "item_id").select("chunk_id", "conflicts")


@query("r49_status_snapshot", m.with_tables("sources", "entities") + "x AS (SELECT (SELECT count(*) FROM embeddings WHERE label % 5 = 0) AS pending, (SELECT count(*) FROM sources WHERE enabled AND error_count > 0) AS failing, (SELECT count(*) FROM entities WHERE status = 'disputed') AS disputed) SELECT * FROM x")
def r49(spark, d):
    pending = m.table(spark, d, "embeddings").where("label % 5 = 0").agg(F.count("*").alias("pending"))
    failing = m.sources(spark, d).where("enabled AND error_count > 0").agg(F.count("*").alias("failing"))
    disputed = m.entities(spark, d).where("status = 'disputed'").agg(F.count("*").alias("disputed"))
    return pending.join(F.broadcast(failing)).join(F.broadcast(disputed))  # one row each


#: Vectors of the first leaves and of the summaries, as far as documents have one of their number.
_VECTORS_SQL = f"""vec AS (SELECT chunk_id, c.item_id, section_id, kind, status, embedding FROM chunks c JOIN embeddings e ON e.vec_id = c.item_id AND (c.chunk_id % {m.ITEM_SPAN} = 0 OR kind = 'doc_summary')),
asked AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0),
near AS (SELECT * EXCLUDE (embedding), round(list_cosine_similarity(embedding::DOUBLE[], (SELECT v FROM asked)::DOUBLE[]), 6) AS score FROM vec WHERE status IS NULL OR status <> 'stale')"""


def _vectors(spark, d):
    e = m.table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    own = m.chunks(spark, d).where((F.col("chunk_id") % m.ITEM_SPAN == 0) | (F.col("kind") == "doc_summary")).drop("content", "entity_id")
    return own.join(e, "item_id")


_DECAY = f"CASE WHEN created_at >= TIMESTAMP '{NOW}' THEN 1.0 ELSE greatest(pow(0.5, (epoch(TIMESTAMP '{NOW}') - epoch(created_at)) / 86400.0 / 365.0), 0.8) END"
_SEARCH_SQL = m.with_tables("chunks", "items", "sections") + bm25_sql(TERMS, "true") + f""", {_VECTORS_SQL},
facts AS (SELECT item_id, created_at, CASE WHEN {_ENV_SQL} THEN 'test' ELSE 'live' END AS env, ({_TIER_SQL})::INTEGER AS tier FROM items),
kw0 AS (SELECT *, terms >= 3 AND score >= 5.0 AS rich FROM leg WHERE {LEAF} AND (status IS NULL OR status <> 'stale')),
nv0 AS (SELECT * FROM near WHERE {LEAF} AND score > 0.2),
summ AS (SELECT * FROM near WHERE kind = 'doc_summary' AND score > 0.2 ORDER BY score DESC, chunk_id LIMIT 15),
cand AS (SELECT s.item_id, s.section_id, env = 'test' AS test, round(q.score - level * 1e-3, 9) AS score FROM summ q JOIN sections s ON s.item_id = q.item_id JOIN facts f ON f.item_id = q.item_id),
fence AS (SELECT section_id, row_number() OVER (ORDER BY test, score DESC, section_id) AS place FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, section_id) AS n FROM cand) WHERE n <= 2),
fkw AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS rk FROM kw0 WHERE section_id IN (SELECT section_id FROM fence WHERE place <= 10) ORDER BY rk LIMIT 100),
fnv AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS rk FROM nv0 WHERE section_id IN (SELECT section_id FROM fence WHERE place <= 10) ORDER BY rk LIMIT 100),
tl AS (SELECT chunk_id, item_id, status, rich, 1.0 / (60 + rk) AS s FROM fkw UNION ALL SELECT chunk_id, item_id, status, false, 1.0 / (60 + rk) FROM fnv),
toc0 AS (SELECT chunk_id, item_id, any_value(status) AS status, bool_or(rich) AS rich, round(sum(s), 9) AS score FROM tl GROUP BY chunk_id, item_id ORDER BY score DESC, chunk_id LIMIT 50),
kw AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS rk FROM kw0 ORDER BY rk LIMIT 100),
nv AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS rk FROM nv0 ORDER BY rk LIMIT 100),
al AS (SELECT chunk_id, item_id, status, rich, 1.0 / (60 + row_number() OVER (ORDER BY score DESC, chunk_id)) AS s FROM toc0
  UNION ALL SELECT chunk_id, item_id, status, rich, 0.5 / (60 + rk) FROM kw UNION ALL SELECT chunk_id, item_id, status, false, 0.5 / (60 + rk) FROM nv),
fused AS (SELECT chunk_id, item_id, any_value(status) AS status, bool_or(rich) AS rich, round(sum(s), 9) AS score FROM al GROUP BY chunk_id, item_id),
h AS (SELECT q.chunk_id, q.item_id, q.status, rich, env, tier, created_at, content, round(q.score * {_DECAY}, 9) AS score FROM fused q JOIN facts USING (item_id) JOIN chunks c ON c.chunk_id = q.chunk_id),
capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id) AS n, (SELECT count(DISTINCT item_id) FROM h) AS items FROM h) WHERE n <= CASE WHEN items >= 3 THEN 3 ELSE 10 END),
sig AS (SELECT *, substr(regexp_replace(lower(trim(regexp_replace(content, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))), '^[0-9]{{1,4}} +', ''), 1, 160) AS sg FROM capped),
uniq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id, sg ORDER BY score DESC, chunk_id) AS m FROM sig) WHERE m = 1),
page AS (SELECT chunk_id, item_id, score, rich, env, tier, row_number() OVER (ORDER BY env = 'test', NOT rich, tier, score DESC, chunk_id) AS rank FROM uniq QUALIFY rank <= 10),
miss AS (SELECT kw.chunk_id, kw.item_id, round(round(0.5 / (60 + rk), 9) * {_DECAY}, 9) AS score, rich, env, tier, 1000000 + rk AS rank FROM kw JOIN facts USING (item_id) WHERE chunk_id NOT IN (SELECT chunk_id FROM page) ORDER BY rk LIMIT 2),
kept AS (SELECT * FROM page ORDER BY rank LIMIT 10 - (SELECT greatest(0, (SELECT count(*) FROM page) + (SELECT count(*) FROM miss) - 10)))
SELECT row_number() OVER (ORDER BY env = 'test', NOT rich, tier, rank)::INTEGER AS rank, chunk_id, item_id, score, env, tier FROM (SELECT * FROM kept UNION ALL SELECT * FROM miss)"""


def library_of(spark, d: str) -> se.Library:
    key = (spark.sparkContext.applicationId, d)
    if key not in _STORES:  # built once per session, as the index
        root = Scratch(spark, "index").root
        _STORES[key] = (VectorIndex.build(_vectors(spark, d), f"{root}/chunk-cells"), se.item_store(m.items(spark, d), f"{root}/items"))
    vectors, facts = _STORES[key]
    return se.Library(m.items(spark, d), m.chunks(spark, d), m.sections(spark, d), index_of(spark, d), vectors, facts=facts)


_STORES: dict[tuple[str, str], tuple[VectorIndex, DataFrame]] = {}


@query("r33_hybrid_search", _SEARCH_SQL)
def r33(spark, d):
    asked = m.table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0]  # the query vector, one row
    hits = se.search(library_of(spark, d), QUESTION, F.lit(NOW).cast("timestamp"), vector=asked, whole=False)
    return hits.select("rank", "chunk_id", "item_id", "score", "env", "tier")


_CITED = f"""h AS (SELECT chunk_id, item_id, section_id, content, row_number() OVER (ORDER BY item_id, chunk_id)::INTEGER AS rank FROM chunks WHERE {LEAF} AND contains(content, '{NEEDLE}') ORDER BY item_id, chunk_id LIMIT 5),
rel AS (SELECT a.entity_id AS f, b.entity_id AS t FROM entities a JOIN entities b ON b.entity_id = a.entity_id + 3 WHERE a.entity_id % 2 = 0),
live AS (SELECT entity_id, item_id FROM entities WHERE status IS NULL OR status <> 'stale'),
bw AS (SELECT f, t FROM rel UNION SELECT t, f FROM rel),
cf AS (SELECT chunk_id, list_sort(list(DISTINCT t)) AS conflicts_with FROM h JOIN live USING (item_id) JOIN bw ON f = entity_id WHERE t IN (SELECT entity_id FROM live) GROUP BY 1),
x AS (SELECT rank, h.chunk_id, external_id AS item_path, s.path AS breadcrumb, s.path AS path, [lang] AS tags, coalesce(conflicts_with, []) AS conflicts_with
  FROM h JOIN items USING (item_id) JOIN sections s ON s.section_id = h.section_id LEFT JOIN cf ON cf.chunk_id = h.chunk_id) SELECT * FROM x"""


@query("r34_citations", m.with_tables("chunks", "items", "sections", "entities") + _CITED)
def r34(spark, d):
    from pyspark.sql import Window

    from .relational import _relationships

    chunks, e, items = m.chunks(spark, d), m.entities(spark, d), m.items(spark, d)
    found = rt.exact_leg(chunks, NEEDLE, 5).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("item_id", "chunk_id")))
    hits = found.join(chunks.select("chunk_id", "content"), "chunk_id")
    links = chunks.select("chunk_id", "item_id").join(items.select("item_id", F.col("lang").alias("name")), "item_id").select("chunk_id", "name")
    cited = an.citations(hits, NEEDLE, items, m.sections(spark, d), e, _relationships(e), links)
    return cited.select("rank", "chunk_id", "item_path", "breadcrumb", "path", "tags", "conflicts_with")
