"""Registered queries of the relational operators, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import model as m
from ..functions import text as fx
from ..operators import relations as r
from ..operators import trees

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

LEAF = "kind IN ('document', 'caption')"
PROJECTS = [(1, n) for n in (0, 1, 2, 3, 4)] + [(1, 3), (2, 5), (2, 8)]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


@query("f1_kind_filter", m.with_tables("chunks") + "x AS (SELECT kind, count(*) AS n FROM chunks WHERE kind IN ('document', 'caption') GROUP BY kind) SELECT * FROM x")
def f1(spark, d):
    return m.chunks(spark, d).where(F.col("kind").isin(*m.LEAF_KINDS)).groupBy("kind").agg(F.count("*").alias("n"))


@query("f2_source_scope", m.with_tables("items") + "x AS (SELECT item_id, source_id FROM items WHERE source_id IN (1, 4, 7)) SELECT * FROM x")
def f2(spark, d):
    scope = spark.createDataFrame([(1,), (4,), (7,)], "source_id int")
    return r.source_scope(m.items(spark, d).select("item_id", "source_id"), scope)


@query("f3_section_fence", m.with_tables("chunks") + "x AS (SELECT chunk_id, section_id FROM chunks WHERE section_id % 10 = 2) SELECT * FROM x")
def f3(spark, d):
    fence = m.sections(spark, d).where("section_id % 10 = 2")
    return r.section_fence(m.chunks(spark, d).select("chunk_id", "section_id"), fence, leaf=True).select("chunk_id", "section_id")


@query("f4_status_filter", m.with_tables("chunks") + "x AS (SELECT status, count(*) AS n FROM chunks WHERE status IS NULL OR status NOT IN ('stale', 'disputed') GROUP BY status) SELECT * FROM x")
def f4(spark, d):
    from ..operators.retrieval import status_filter

    return status_filter(m.chunks(spark, d), exclude_disputed=True).groupBy("status").agg(F.count("*").alias("n"))


@query(
    "f6_project_scope",
    m.with_tables("sources") + "p(project_id, source_id) AS (VALUES (1, 0), (1, 1), (1, 2), (1, 3), (1, 4), (1, 3), (2, 5), (2, 8)), "
    "x AS (SELECT source_id FROM p WHERE project_id = 1 INTERSECT SELECT source_id FROM sources WHERE label = 'public') SELECT * FROM x",
)
def f6(spark, d):
    projects = spark.createDataFrame(PROJECTS, "project_id int, source_id int")
    return r.project_scope(projects, m.sources(spark, d), 1, public_only=True)


@query(
    "f7_sensitive_gate",
    m.with_tables("items", "sources") + """x AS (SELECT CASE WHEN label IS NULL OR label = 'sensitive' THEN 'sensitive' WHEN sensitive_override THEN 'item_sensitive' END AS blocked_by,
  count(*) AS n FROM items LEFT JOIN sources USING (source_id) GROUP BY 1) SELECT * FROM x""",
)
def f7(spark, d):
    return r.sensitivity(m.items(spark, d), m.sources(spark, d)).groupBy("blocked_by").agg(F.count("*").alias("n"))


@query(
    "f8_public_items",
    m.with_tables("items", "sources") + "x AS (SELECT item_id FROM items JOIN sources USING (source_id) WHERE label = 'public' AND coalesce(sensitive_override, false) = false) SELECT * FROM x",
)
def f8(spark, d):
    return r.public_items(m.items(spark, d), m.sources(spark, d)).select("item_id")


@query(
    "f9_caller_gate_split",
    m.with_tables("items", "sources") + """g AS (SELECT item_id, label, label = 'sensitive' OR coalesce(sensitive_override, false) AS s FROM items JOIN sources USING (source_id)),
x AS (SELECT count(*) FILTER (NOT s) AS for_model, count(*) FILTER (NOT s AND label = 'public') AS for_caller FROM g) SELECT * FROM x""",
)
def f9(spark, d):
    gated = r.sensitivity(m.items(spark, d), m.sources(spark, d))
    free = F.col("blocked_by").isNull()
    return gated.agg(F.count_if(free).alias("for_model"), F.count_if(free & (F.col("label") == "public")).alias("for_caller"))


_ENV_SQL = """regexp_matches(external_id, '(?i)(^|[^\\p{L}\\p{N}])(test|tests|testdata|sandbox|staging|mock|mocks|fixture|fixtures|example|examples|sample|samples|dev)([^\\p{L}\\p{N}]|$)')
 OR regexp_matches(substr(coalesce(text, ''), 1, 1024), '(?i)(^|[^\\p{L}\\p{N}])(testdata|mock|mocks|fixture|fixtures)([^\\p{L}\\p{N}]|$)')
 OR (regexp_matches(substr(coalesce(text, ''), 1, 1024), '(?i)(^|[^\\p{L}\\p{N}])sandbox([^\\p{L}\\p{N}]|$)') AND regexp_matches(substr(coalesce(text, ''), 1, 1024), '(?i)(^|[^\\p{L}\\p{N}])staging([^\\p{L}\\p{N}]|$)'))"""
_TIER_SQL = """CASE WHEN regexp_matches(external_id, '(^|/)(vendor|build)/') OR regexp_matches(external_id, '(^|[^a-z0-9])(lint|lints|generated)([^a-z0-9/][^/]*)?$') OR external_id LIKE '%.min.%'
   OR regexp_matches(external_id, '\\.lock$') OR regexp_matches(external_id, '\\.min') AND external_id LIKE '%.min.%' THEN 4
 WHEN regexp_matches(external_id, '/adr/') OR regexp_matches(external_id, '/adr-[^/]*$') THEN 0
 WHEN regexp_matches(external_id, '\\.(md|txt)$') AND (regexp_matches(external_id, '/specs/') OR regexp_matches(external_id, '/spec_[^/]*$')) THEN 0
 WHEN regexp_matches(external_id, '\\.(py|rs)$') THEN 1
 WHEN regexp_matches(external_id, '\\.(yml|json)$') THEN 2 ELSE 3 END"""


@query("r1_env_class", m.with_tables("items") + f"x AS (SELECT item_id, CASE WHEN {_ENV_SQL} THEN 'test' ELSE 'live' END AS env FROM items) SELECT * FROM x")
def r1(spark, d):
    return m.items(spark, d).select("item_id", fx.env_class(F.col("external_id"), F.col("text")).alias("env"))


@query("r3_authority_tier", m.with_tables("items") + f"x AS (SELECT item_id, ({_TIER_SQL})::INTEGER AS tier FROM items) SELECT * FROM x")
def r3(spark, d):
    return m.items(spark, d).select("item_id", fx.authority_tier(F.col("external_id")).alias("tier"))


@query("f10_env_filter", m.with_tables("items") + f"x AS (SELECT item_id FROM items WHERE {_ENV_SQL}) SELECT * FROM x")
def f10(spark, d):
    return m.items(spark, d).where(fx.env_class(F.col("external_id"), F.col("text")) == "test").select("item_id")


@query("f11_kind_list", m.with_tables("chunks") + "x AS (SELECT kind, count(*) AS n FROM chunks WHERE kind IN ('caption', 'doc_summary') GROUP BY 1) SELECT * FROM x")
def f11(spark, d):
    known = (*m.LEAF_KINDS, *m.SUMMARY_KINDS)
    return r.kind_filter(m.chunks(spark, d), "caption, doc_summary, nonsense", known).groupBy("kind").agg(F.count("*").alias("n"))


@query("f12_path_prefix", m.with_tables("items") + "x AS (SELECT item_id, external_id FROM items WHERE starts_with(lower(external_id), 'src3/n')) SELECT * FROM x")
def f12(spark, d):
    return r.path_prefix(m.items(spark, d), "SRC3\\N").select("item_id", "external_id")


@query("f14_symbol_filter", m.with_tables("sections") + "x AS (SELECT section_id FROM sections WHERE contains(lower(title), 'art 2') OR contains(lower(path), 'art 2')) SELECT * FROM x")
def f14(spark, d):
    return r.symbol_filter(m.sections(spark, d), "ART 2").select("section_id")


@query("f15_post_rank_widen", m.with_tables("items") + "x AS (SELECT item_id, size FROM (SELECT * FROM items ORDER BY size DESC, item_id LIMIT 50) WHERE lang = 'de' ORDER BY size DESC, item_id LIMIT 10) SELECT * FROM x")
def f15(spark, d):
    k = 10
    wide = m.items(spark, d).orderBy(F.desc("size"), "item_id").limit(r.clamp(k * 5, k, 50, k))
    return wide.where("lang = 'de'").orderBy(F.desc("size"), "item_id").limit(k).select("item_id", "size")


@query("f16_like_escape", m.with_tables("items") + "x AS (SELECT item_id FROM items WHERE external_id ILIKE '%MAKEFILE\\_1%' ESCAPE '\\') SELECT * FROM x")
def f16(spark, d):
    return m.items(spark, d).where(r.like_escaped(F.col("external_id"), "MAKEFILE_1")).select("item_id")


@query("f17_overdue", m.with_tables("entities") + "x AS (SELECT entity_id, due FROM entities WHERE regexp_matches(due, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') AND substr(due, 1, 10) < '2024-02-01') SELECT * FROM x")
def f17(spark, d):
    return m.entities(spark, d).where(r.overdue(F.col("due"), "2024-02-01")).select("entity_id", "due")


@query(
    "f18_line_window",
    "SELECT doc_id, CASE WHEN len(string_split(text, chr(10))) >= 2 THEN array_to_string(string_split(text, chr(10))[2:4], chr(10)) END AS lines FROM documents",
)
def f18(spark, d):
    return m.table(spark, d, "documents").select("doc_id", r.line_window(F.col("text"), "2-4").alias("lines"))


@query("f19_field_selection", m.with_tables("items") + "x AS (SELECT item_id, external_id FROM items) SELECT * FROM x")
def f19(spark, d):
    return m.items(spark, d).select("item_id", "external_id")


@query("f20_score_rounding", "SELECT event_id, round(value / 7, 3) AS score FROM events")
def f20(spark, d):
    return m.table(spark, d, "events").select("event_id", fx.half_away(F.col("value") / 7, 3).alias("score"))


@query(
    "j1_effective_item",
    m.with_tables("chunks", "entities", "items") + """e AS (SELECT entity_id * 7 AS chunk_id, NULL::BIGINT AS item_id, entity_id FROM entities),
c AS (SELECT chunk_id, item_id, entity_id FROM chunks UNION ALL SELECT * FROM e),
x AS (SELECT c.chunk_id, coalesce(c.item_id, e2.item_id) AS effective_item, i.source_id FROM c LEFT JOIN entities e2 ON c.entity_id = e2.entity_id
  LEFT JOIN items i ON i.item_id = coalesce(c.item_id, e2.item_id)) SELECT * FROM x""",
)
def j1(spark, d):
    e = m.entities(spark, d)
    own = e.select((F.col("entity_id") * 7).alias("chunk_id"), F.lit(None).cast("long").alias("item_id"), "entity_id")
    all_chunks = m.chunks(spark, d).select("chunk_id", "item_id", "entity_id").unionByName(own)
    return r.effective_items(all_chunks, e, m.items(spark, d)).select("chunk_id", "effective_item", "source_id")


@query(
    "j4_records",
    m.with_tables("entities", "items", "sources") + "x AS (SELECT entity_id, record_id, name, label FROM entities JOIN items USING (item_id) JOIN sources USING (source_id)) SELECT * FROM x",
)
def j4(spark, d):
    return r.records(m.entities(spark, d), m.items(spark, d), m.sources(spark, d)).select("entity_id", "record_id", "name", "label")


@query("j6_items_per_source", m.with_tables("items", "sources") + "x AS (SELECT source_id, name, label, count(item_id) AS n_items FROM sources LEFT JOIN items USING (source_id) GROUP BY ALL) SELECT * FROM x")
def j6(spark, d):
    return r.items_per_source(m.sources(spark, d), m.items(spark, d))


@query(
    "j7_section_sizes",
    m.with_tables("sections", "chunks") + "x AS (SELECT s.section_id, count(chunk_id) AS n_chunks, coalesce(sum(length(content)), 0)::BIGINT AS chars FROM sections s LEFT JOIN chunks c ON c.section_id = s.section_id GROUP BY 1) SELECT * FROM x",
)
def j7(spark, d):
    return r.section_sizes(m.sections(spark, d), m.chunks(spark, d)).select("section_id", "n_chunks", "chars")


_REL = "rel AS (SELECT a.entity_id AS from_id, b.entity_id AS to_id FROM entities a JOIN entities b ON b.entity_id = a.entity_id + 3 WHERE a.entity_id % 2 = 0)"


def _relationships(entities: DataFrame) -> DataFrame:
    a, b = entities.select(F.col("entity_id").alias("from_id")), entities.select(F.col("entity_id").alias("to_id"))
    pairs = a.withColumn("_n", F.col("from_id") + 3).join(b, F.col("_n") == F.col("to_id")).where("from_id % 2 = 0")
    return pairs.select("from_id", "to_id", F.lit("conflicts_with").alias("kind"))


@query(
    "j8_conflicts",
    m.with_tables("entities") + _REL + """, both_ways AS (SELECT * FROM rel UNION ALL SELECT to_id, from_id FROM rel),
x AS (SELECT from_id AS entity_id, string_agg(DISTINCT record_id, ',' ORDER BY record_id) AS conflicts FROM both_ways JOIN entities e ON e.entity_id = to_id WHERE status IS NULL OR status <> 'stale' GROUP BY 1) SELECT * FROM x""",
)
def j8(spark, d):
    e = m.entities(spark, d)
    return r.conflict_pairs(_relationships(e), e)


@query("j10_exists", m.with_tables("items", "entities") + "x AS (SELECT item_id FROM items i WHERE EXISTS (SELECT 1 FROM entities e WHERE e.item_id = i.item_id AND kind = 'decision')) SELECT * FROM x")
def j10(spark, d):
    return m.items(spark, d).select("item_id").join(m.entities(spark, d).where("kind = 'decision'"), "item_id", "left_semi")


@query("j11_first_chunk", m.with_tables("entities", "chunks") + f"x AS (SELECT entity_id, (SELECT min(chunk_id) FROM chunks c WHERE c.item_id = e.item_id AND {LEAF}) AS first_chunk FROM entities e) SELECT * FROM x".replace("AND kind", "AND c.kind"))
def j11(spark, d):
    return r.first_chunk(m.entities(spark, d), m.chunks(spark, d))


@query("j13_missing_summaries", m.with_tables("items", "chunks") + "x AS (SELECT item_id FROM items WHERE item_id NOT IN (SELECT item_id FROM chunks WHERE kind = 'caption')) SELECT * FROM x")
def j13(spark, d):
    return m.items(spark, d).select("item_id").join(m.chunks(spark, d).where("kind = 'caption'"), "item_id", "left_anti")


@query(
    "j14_subtree",
    m.with_tables("sections", "chunks") + """down(root, node) AS (SELECT section_id, section_id FROM sections UNION ALL SELECT root, s.section_id FROM down JOIN sections s ON s.parent_id = node),
x AS (SELECT root AS section_id, (coalesce(sum(length(content)), 0) + 4 * greatest(0, count(chunk_id) - 1))::BIGINT AS chars, count(chunk_id) AS n_chunks
  FROM down LEFT JOIN chunks c ON c.section_id = node GROUP BY 1) SELECT * FROM x""",
)
def j14(spark, d):
    return trees.subtree_sizes(m.sections(spark, d), m.chunks(spark, d))


@query(
    "j15_ancestors",
    m.with_tables("sections") + """up(section_id, ancestor, distance) AS (SELECT section_id, section_id, 0 FROM sections
  UNION ALL SELECT up.section_id, s.parent_id, distance + 1 FROM up JOIN sections s ON s.section_id = ancestor WHERE s.parent_id IS NOT NULL AND distance < 64) SELECT * FROM up""",
)
def j15(spark, d):
    return trees.ancestors(m.sections(spark, d))


#: Documents as the sections of trees of 40 in a row, ten levels deep or more.
_DEEP = "deep AS (SELECT doc_id AS section_id, CASE WHEN doc_id % 40 > 0 THEN doc_id - 1 - doc_id % 4 % 3 * (doc_id % 40 > 3)::INTEGER END AS parent_id, coalesce(length(text), 0) AS chars FROM documents)"


def _deep(spark, d):
    n = F.col("doc_id")
    parent = F.when(n % 40 > 0, n - 1 - n % 4 % 3 * (n % 40 > 3).cast("int"))
    return m.table(spark, d, "documents").select(n.alias("section_id"), parent.alias("parent_id"), n.alias("chunk_id"), F.lit("document").alias("kind"), F.coalesce("text", F.lit("")).alias("content"))


@query("j15_deep_ancestors", f"""WITH RECURSIVE {_DEEP}, up(section_id, ancestor, distance) AS (SELECT section_id, section_id, 0 FROM deep
  UNION ALL SELECT up.section_id, s.parent_id, distance + 1 FROM up JOIN deep s ON s.section_id = ancestor WHERE s.parent_id IS NOT NULL) SELECT * FROM up""")
def j15_deep(spark, d):
    return trees.ancestors(_deep(spark, d))


@query("j14_deep_subtree", f"""WITH RECURSIVE {_DEEP}, down(root, node) AS (SELECT section_id, section_id FROM deep UNION ALL SELECT root, s.section_id FROM down JOIN deep s ON s.parent_id = node)
SELECT root AS section_id, (sum(chars) + 4 * (count(*) - 1))::BIGINT AS chars, count(*) AS n_chunks FROM down JOIN deep ON section_id = node GROUP BY 1""")
def j14_deep(spark, d):
    deep = _deep(spark, d)
    return trees.subtree_sizes(deep, deep)


#: Customers as the sections of one chain, as deep as there are customers.
_WHOLE = "whole AS (SELECT c_custkey AS section_id, CASE WHEN c_custkey > (SELECT min(c_custkey) FROM customer) THEN c_custkey - 1 END AS parent_id, c_nationkey AS weight FROM customer)"


@query("j14_chain_subtree", f"""WITH {_WHOLE} SELECT section_id, (sum(10 + weight) OVER later + 4 * (count(*) OVER later - 1))::BIGINT AS chars, count(*) OVER later AS n_chunks
FROM whole WINDOW later AS (ORDER BY section_id DESC ROWS UNBOUNDED PRECEDING)""")
def j14_chain(spark, d):
    c = m.table(spark, d, "customer")
    first = c.agg(F.min("c_custkey")).first()[0]
    n = F.col("c_custkey")
    rows = c.select(n.alias("section_id"), F.when(n > first, n - 1).alias("parent_id"), F.lit("document").alias("kind"), F.repeat(F.lit("x"), (10 + F.col("c_nationkey")).cast("int")).alias("content"))
    return trees.subtree_sizes(rows, rows)


@query("j14_ring_subtree", """SELECT doc_id AS section_id, (CASE WHEN doc_id % 50 < 5 THEN sum(length(coalesce(text, ''))) OVER g + 4 * (count(*) OVER g - 1) ELSE length(coalesce(text, '')) END)::BIGINT AS chars,
  CASE WHEN doc_id % 50 < 5 THEN count(*) OVER g ELSE 1 END AS n_chunks FROM documents WINDOW g AS (PARTITION BY doc_id // 50)""")
def j14_ring(spark, d):
    """Rings of five documents, from which the other 45 of fifty hang."""
    n = F.col("doc_id")
    parent = F.when(n % 50 < 5, n - n % 50 + (n % 50 + 1) % 5).otherwise(n - n % 50 + n % 5)
    rows = m.table(spark, d, "documents").select(n.alias("section_id"), parent.alias("parent_id"), F.lit("document").alias("kind"), F.coalesce("text", F.lit("")).alias("content"))
    return trees.subtree_sizes(rows, rows)


@query(
    "j16_supersession",
    m.with_tables("entities") + """l AS (SELECT entity_id, record_id AS by_id, trim(unnest(string_split(supersedes, ','))) AS record_id FROM entities WHERE supersedes IS NOT NULL),
f AS (SELECT record_id, arg_min(by_id, entity_id) AS superseded_by FROM l GROUP BY 1),
x AS (SELECT entity_id, record_id, superseded_by FROM entities LEFT JOIN f USING (record_id)) SELECT * FROM x""",
)
def j16(spark, d):
    return r.supersession(m.entities(spark, d))


@query(
    "a1_event_folding",
    m.with_tables("events") + """x AS (SELECT component, level, source_id, message, count(*) AS n, min(created_at) AS first_seen, max(created_at) AS last_seen, max(id) AS last_id,
  coalesce(arg_max(detail, id), '') AS detail, bool_and(dismissed_at IS NOT NULL) AS all_dismissed FROM sys GROUP BY ALL) SELECT * FROM x""",
)
def a1(spark, d):
    return r.folded_events(m.system_events(spark, d))


@query(
    "a2_facets",
    m.with_tables("events") + """x AS (SELECT 'component' AS facet, component AS value, count(*) AS n FROM sys WHERE level = 'error' GROUP BY 2
  UNION ALL SELECT 'level', level, count(*) FROM sys WHERE component = 'click' GROUP BY 2
  UNION ALL SELECT 'source_id', source_id::VARCHAR, count(*) FROM sys WHERE component = 'click' AND level = 'error' GROUP BY 2) SELECT * FROM x""",
)
def a2(spark, d):
    return r.facets(m.system_events(spark, d), {"component": "click", "level": "error"})


@query("a3_section_chars", m.with_tables("sections", "chunks") + "x AS (SELECT level, count(chunk_id) AS n, coalesce(sum(length(content)), 0)::BIGINT AS chars FROM sections s LEFT JOIN chunks c ON c.section_id = s.section_id GROUP BY 1) SELECT * FROM x")
def a3(spark, d):
    sized = r.section_sizes(m.sections(spark, d), m.chunks(spark, d))
    return sized.groupBy("level").agg(F.sum("n_chunks").alias("n"), F.sum("chars").alias("chars"))


@query(
    "a6_top_terms",
    f"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]{{4,}}')) AS term FROM documents),
c AS (SELECT doc_id, term, count(*) AS n FROM w WHERE NOT list_contains({fx.TAG_STOPWORDS}, term) GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term) AS place FROM c) SELECT doc_id, term, n, place::INTEGER AS place FROM p WHERE place <= 4""",
)
def a6(spark, d):
    return r.top_terms(m.table(spark, d, "documents"), "doc_id", "text")


@query(
    "a7_repeated_lines",
    """WITH l AS (SELECT doc_id, lower(trim(regexp_replace(unnest(string_split(text, chr(10))), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) AS line FROM documents),
c AS (SELECT doc_id, line, count(*) AS n FROM l WHERE length(line) BETWEEN 1 AND 120 GROUP BY ALL),
t AS (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS total FROM c)
SELECT doc_id, line, n FROM t WHERE n >= greatest(3, total // 100 + CASE WHEN total % 100 > 50 THEN 1 WHEN total % 100 < 50 THEN 0 ELSE (total // 100) % 2 END)""",
)
def a7(spark, d):
    return r.repeated_lines(m.table(spark, d, "documents"), "doc_id", "text")


@query(
    "a9_idf_signal",
    m.with_tables("chunks") + """w AS (SELECT item_id, chunk_id, unnest(regexp_extract_all(lower(content), '[a-z0-9_]{3,}')) AS w FROM chunks),
p AS (SELECT item_id, chunk_id, w, count(*) AS tf FROM w GROUP BY ALL), q AS (SELECT *, sum(tf) OVER (PARTITION BY item_id, w) AS df FROM p),
n AS (SELECT item_id, count(*) AS n FROM chunks GROUP BY 1),
s AS (SELECT chunk_id, round(avg(greatest(0.0, ln((n + 1.0) / (df + 1.0)))), 6) AS signal FROM q JOIN n USING (item_id) GROUP BY 1),
x AS (SELECT chunk_id, coalesce(signal, 0.0) AS signal FROM chunks LEFT JOIN s USING (chunk_id)) SELECT * FROM x""",
)
def a9(spark, d):
    return r.idf_signal(m.chunks(spark, d))


@query("a8_document_frequency", m.with_tables("chunks") + "w AS (SELECT item_id, unnest(regexp_extract_all(lower(content), '[a-z0-9_]{3,}')) AS w FROM chunks), x AS (SELECT item_id, w, count(*) AS df FROM w GROUP BY ALL HAVING count(*) >= 5) SELECT * FROM x")
def a8(spark, d):
    words = m.chunks(spark, d).select("item_id", F.explode(F.regexp_extract_all(F.lower("content"), F.lit("[a-z0-9_]{3,}"), 0)).alias("w"))
    return words.groupBy("item_id", "w").agg(F.count("*").alias("df")).where("df >= 5")


@query("a10_status_counts", m.with_tables("sources") + "x AS (SELECT count_if(enabled AND error_count > 0) AS failing, count_if(NOT enabled) AS disabled, count(*) AS sources FROM sources) SELECT * FROM x")
def a10(spark, d):
    failing = F.col("enabled") & (F.col("error_count") > 0)
    return m.sources(spark, d).agg(F.count_if(failing).alias("failing"), F.count_if(~F.col("enabled")).alias("disabled"), F.count("*").alias("sources"))


@query("a12_distinct", "SELECT DISTINCT lang, source FROM documents")
def a12(spark, d):
    return m.table(spark, d, "documents").select("lang", "source").distinct()


@query("a13_total_and_page", m.with_tables("items") + "x AS (SELECT item_id, external_id, count(*) OVER () AS total FROM items ORDER BY external_id, item_id LIMIT 25 OFFSET 50) SELECT * FROM x")
def a13(spark, d):
    return r.page(m.items(spark, d).select("item_id", "external_id"), [F.col("external_id"), F.col("item_id")], 25, 50)


@query("w6_neighbours", m.with_tables("chunks") + "x AS (SELECT chunk_id, item_id, lag(chunk_id) OVER w AS before_1, lead(chunk_id) OVER w AS after_1 FROM chunks WINDOW w AS (PARTITION BY item_id ORDER BY chunk_id)) SELECT * FROM x")
def w6(spark, d):
    from ..operators.retrieval import neighbours

    return neighbours(m.chunks(spark, d))


@query(
    "w7_running_page",
    m.with_tables("chunks") + """c AS (SELECT item_id, chunk_id, CASE WHEN chunk_id % 4 = 1 THEN '[page ' || (chunk_id % 100000 + 1) || '] ' || content ELSE content END AS content FROM chunks),
k AS (SELECT *, list_transform(regexp_extract_all(content, '\\[page (\\d+)\\]', 1), lambda x: x::INTEGER) AS marks FROM c),
b AS (SELECT *, list_max(marks) AS top, last_value(list_max(marks) IGNORE NULLS) OVER (PARTITION BY item_id ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM k),
x AS (SELECT chunk_id, coalesce(prev, list_min(marks)) AS first_page, coalesce(top, prev) AS last_page FROM b) SELECT * FROM x""",
)
def w7(spark, d):
    page = F.concat(F.lit("[page "), (F.col("chunk_id") % 100_000 + 1).cast("string"), F.lit("] "), F.col("content"))
    marked = m.chunks(spark, d).withColumn("content", F.when(F.col("chunk_id") % 4 == 1, page).otherwise(F.col("content")))
    return r.running_pages(marked)


@query(
    "w8_section_end",
    """WITH h AS (SELECT conv_id AS doc, turn * 10 + 1 AS line, (conv_id + turn) % 3 AS level, (max(turn) OVER (PARTITION BY conv_id) + 1) * 10 AS total FROM conversations)
SELECT doc, line, level, total, coalesce((SELECT min(b.line) - 1 FROM h b WHERE b.doc = a.doc AND b.line > a.line AND b.level <= a.level), total) AS "end" FROM h a""",
)
def w8(spark, d):
    total = (F.max("turn").over(Window.partitionBy("conv_id")) + 1) * 10
    heads = m.table(spark, d, "conversations").select(F.col("conv_id").alias("doc"), (F.col("turn") * 10 + 1).alias("line"), ((F.col("conv_id") + F.col("turn")) % 3).alias("level"), total.alias("total"))
    return r.section_ends(heads, "total")


@query(
    "w9_heading_parents",
    """WITH h AS (SELECT conv_id AS doc, turn * 10 + 1 AS line, (conv_id + turn) % 3 AS level FROM conversations)
SELECT doc, line, (SELECT max(b.line) FROM h b WHERE b.doc = a.doc AND b.line < a.line AND b.level < a.level) AS parent FROM h a""",
)
def w9(spark, d):
    heads = m.table(spark, d, "conversations").select(F.col("conv_id").alias("doc"), (F.col("turn") * 10 + 1).alias("line"), ((F.col("conv_id") + F.col("turn")) % 3).alias("level"))
    return r.heading_parents(heads)


@query("c19_chunk_numbering", m.with_tables("chunks") + f"x AS (SELECT chunk_id, 'item ' || item_id || CASE WHEN count(*) OVER (PARTITION BY item_id) > 1 THEN ' §' || row_number() OVER (PARTITION BY item_id ORDER BY chunk_id) ELSE '' END AS label FROM chunks WHERE {LEAF}) SELECT * FROM x")
def c19(spark, d):
    return r.numbered(m.chunks(spark, d))


@query(
    "k4_action_order",
    m.with_tables("entities") + """o AS (SELECT entity_id, due, coalesce(regexp_matches(due, '^[0-9]{4}-[0-9]{2}-[0-9]{2}'), false) AS dated FROM entities WHERE kind = 'action'),
x AS (SELECT entity_id, due, row_number() OVER (ORDER BY NOT dated, CASE WHEN dated THEN due END NULLS LAST, entity_id) AS place FROM o) SELECT entity_id, due, place::INTEGER AS place FROM x WHERE place <= 100""",
)
def k4(spark, d):
    actions = m.entities(spark, d).where("kind = 'action'")
    top = actions.orderBy(*r.action_order(actions)).limit(100)
    return top.select("entity_id", "due", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*r.action_order(actions))).alias("place"))


@query("k5_decision_order", m.with_tables("entities") + "x AS (SELECT entity_id, created_at FROM entities WHERE kind = 'decision' ORDER BY created_at DESC, entity_id DESC LIMIT 100) SELECT * FROM x")
def k5(spark, d):
    return m.entities(spark, d).where("kind = 'decision'").orderBy(F.desc("created_at"), F.desc("entity_id")).limit(100).select("entity_id", "created_at")


@query("k7_order_by_boolean", m.with_tables("entities") + "x AS (SELECT entity_id, status = 'accepted' AS accepted FROM entities ORDER BY status = 'accepted' DESC, entity_id LIMIT 50) SELECT * FROM x")
def k7(spark, d):
    return m.entities(spark, d).select("entity_id", (F.col("status") == "accepted").alias("accepted")).orderBy(F.desc("accepted"), "entity_id").limit(50)


@query("u2_union_distinct", m.with_tables("entities", "chunks") + "x AS (SELECT item_id FROM entities UNION SELECT item_id FROM chunks WHERE kind = 'caption') SELECT * FROM x")
def u2(spark, d):
    return m.entities(spark, d).select("item_id").union(m.chunks(spark, d).where("kind = 'caption'").select("item_id")).distinct()


@query("u3_intersection", m.with_tables("entities", "chunks") + "x AS (SELECT item_id FROM entities INTERSECT SELECT item_id FROM chunks WHERE kind = 'caption') SELECT * FROM x")
def u3(spark, d):
    return m.entities(spark, d).select("item_id").intersect(m.chunks(spark, d).where("kind = 'caption'").select("item_id"))


@query(
    "u4_append_once",
    m.with_tables("entities") + """a AS (SELECT item_id, 0 AS part, entity_id FROM entities WHERE kind = 'decision' UNION ALL SELECT item_id, 1, entity_id + 1000000 FROM entities),
x AS (SELECT item_id, arg_min(entity_id, part) AS entity_id FROM a GROUP BY 1) SELECT * FROM x""",
)
def u4(spark, d):
    e = m.entities(spark, d)
    both = e.where("kind = 'decision'").select("item_id", F.lit(0).alias("part"), "entity_id").unionByName(e.select("item_id", F.lit(1).alias("part"), (F.col("entity_id") + 1_000_000).alias("entity_id")))
    by = Window.partitionBy("item_id").orderBy("part")
    return both.withColumn("_n", F.row_number().over(by)).where("_n = 1").select("item_id", "entity_id")


_STORED = "stored AS (SELECT item_id, external_id, mtime_ms - (item_id % 5 = 0)::INTEGER AS mtime_ms, size, CASE WHEN item_id % 9 = 0 THEN 1 ELSE 2 END AS extractor, text FROM items WHERE item_id % 7 <> 0)"


def _stored(items: DataFrame) -> DataFrame:
    n = F.col("item_id")
    return items.where(n % 7 != 0).select("item_id", "external_id", (F.col("mtime_ms") - (n % 5 == 0).cast("int")).alias("mtime_ms"), "size", F.when(n % 9 == 0, 1).otherwise(2).alias("extractor"), "text")


@query(
    "i1_i8_stat_skip",
    m.with_tables("items") + _STORED + """, x AS (SELECT item_id, external_id FROM items i WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.external_id = i.external_id AND s.mtime_ms = i.mtime_ms AND s.size = i.size AND s.extractor >= 2)) SELECT * FROM x""",
)
def i1(spark, d):
    items = m.items(spark, d)
    return r.to_extract(items.select("item_id", "external_id", "mtime_ms", "size"), _stored(items), 2).select("item_id", "external_id")


@query(
    "i2_i3_hash_upsert",
    m.with_tables("items") + _STORED + """, x AS (SELECT i.item_id, sha256(coalesce(i.text, '')) AS content_hash,
  CASE WHEN s.item_id IS NULL THEN 'insert' WHEN i.item_id % 4 <> 0 AND i.item_id % 3 <> 0 AND s.text IS NOT NULL THEN 'skip' ELSE 'update' END AS action
  FROM items i LEFT JOIN stored s USING (external_id)) SELECT * FROM x""",
)
def i2(spark, d):
    items = m.items(spark, d)
    n = F.col("item_id")
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    stored = _stored(items).withColumn("content_hash", F.when(n % 4 == 0, "old").otherwise(digest)).withColumn("processed_hash", F.when(n % 3 != 0, digest))
    return r.upsert(items.select("item_id", "external_id", "text"), stored).select("item_id", "content_hash", "action")


@query("i4_purge_missing", m.with_tables("items") + "x AS (SELECT item_id FROM items WHERE item_id % 6 = 0 AND item_id % 4 <> 0) SELECT * FROM x")
def i4(spark, d):
    items = m.items(spark, d).select("item_id", "external_id")
    return r.purge(items, items.where("item_id % 6 <> 0"), items.where("item_id % 4 = 0"), "folder").select("item_id")


_WIN = "w AS (SELECT item_id, chunk_id % 100000 AS idx, sha256(content) AS hash, content FROM chunks WHERE kind <> 'doc_summary')"


@query("i5_window_skip", m.with_tables("chunks") + _WIN + ", x AS (SELECT item_id, idx FROM w WHERE item_id % 10 = 3 OR idx % 5 = 4) SELECT * FROM x")
def i5(spark, d):
    now = m.chunks(spark, d).where("kind <> 'doc_summary'").select("item_id", (F.col("chunk_id") % m.ITEM_SPAN).alias("idx"), F.sha2("content", 256).alias("hash"))
    before = now.where("item_id % 10 <> 3").withColumn("hash", F.when(F.col("idx") % 5 == 4, "changed").otherwise(F.col("hash")))
    return r.windows_to_classify(now, before).select("item_id", "idx")


@query(
    "i6_vector_reuse",
    m.with_tables("chunks") + """o AS (SELECT kind, 'p' || section_id AS path, content, arg_min(chunk_id, chunk_id) AS vector_id FROM chunks WHERE chunk_id % 3 <> 0 AND section_id IS NOT NULL GROUP BY ALL),
x AS (SELECT c.chunk_id, o.vector_id FROM chunks c LEFT JOIN o ON o.kind = c.kind AND o.path = 'p' || c.section_id AND o.content = c.content) SELECT * FROM x""",
)
def i6(spark, d):
    fresh = m.chunks(spark, d).select("chunk_id", "kind", F.concat(F.lit("p"), F.col("section_id").cast("string")).alias("path"), "content")
    old = fresh.where("chunk_id % 3 <> 0 AND path IS NOT NULL").withColumn("vector_id", F.col("chunk_id"))
    return r.reuse_vectors(fresh, old).select("chunk_id", "vector_id")


@query(
    "i9_backfill",
    m.with_tables("chunks", "items", "sources") + """x AS (SELECT chunk_id FROM chunks c JOIN items i ON i.item_id = c.item_id JOIN sources s USING (source_id)
  WHERE label <> 'sensitive' AND NOT coalesce(sensitive_override, false) AND (chunk_id % 4 IN (0, 1) OR chunk_id % 6 = 2)) SELECT * FROM x""",
)
def i9(spark, d):
    n = F.col("chunk_id")
    fp = F.when(n % 4 == 0, F.lit(None)).when(n % 6 == 2, "old:64").otherwise("new:64")
    chunks = m.chunks(spark, d).select("chunk_id", "item_id", fp.alias("embed_fp"), (n % 4 != 1).alias("has_vector"))
    return r.backfill(chunks, ["old:64"], m.items(spark, d), m.sources(spark, d)).select("chunk_id")


@query("m1_entity_patch", m.with_tables("entities") + "x AS (SELECT entity_id, CASE WHEN entity_id % 2 = 0 THEN 'New ' || entity_id ELSE title END AS title, CASE WHEN entity_id % 4 = 0 THEN 'accepted' ELSE status END AS status FROM entities) SELECT * FROM x")
def m1(spark, d):
    e = m.entities(spark, d).select("entity_id", "title", "status")
    n = F.col("entity_id")
    changes = e.where(n % 2 == 0).select("entity_id", F.concat(F.lit("New "), n.cast("string")).alias("title"), F.when(n % 4 == 0, "accepted").alias("status"))
    return r.patch(e, changes, "entity_id", ["title", "status"])


@query(
    "m2_dispute",
    m.with_tables("entities") + "x AS (SELECT entity_id, CASE WHEN entity_id % 3 = 0 THEN 'disputed' ELSE status END AS status, CASE WHEN entity_id % 3 <> 0 THEN 0 WHEN entity_id % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS dispute_count FROM entities) SELECT * FROM x",
)
def m2(spark, d):
    e = m.entities(spark, d).select("entity_id", "status")
    raised = e.where("entity_id % 3 = 0").select("entity_id").unionByName(e.where("entity_id % 6 = 0").select("entity_id"))
    return r.dispute(e, raised)


@query(
    "m3_conflict_links",
    m.with_tables("entities") + _REL + """, old AS (SELECT from_id AS a, to_id AS b, 'old' AS note FROM rel WHERE from_id % 4 = 0),
x AS (SELECT * FROM old UNION ALL SELECT from_id, to_id, 'new' FROM rel WHERE from_id % 4 <> 0) SELECT * FROM x""",
)
def m3(spark, d):
    rel = _relationships(m.entities(spark, d))
    old = rel.where("from_id % 4 = 0").select(F.col("from_id").alias("a"), F.col("to_id").alias("b"), F.lit("old").alias("note"))
    new = rel.select(F.col("to_id").alias("a"), F.col("from_id").alias("b"), F.lit("new").alias("note"))
    return r.link_conflicts(old, new.unionByName(rel.select(F.col("from_id").alias("a"), F.col("from_id").alias("b"), F.lit("self").alias("note"))))


@query("m4_event_dismiss", m.with_tables("events") + "x AS (SELECT id, CASE WHEN level = 'error' AND dismissed_at IS NULL THEN TIMESTAMP '2024-02-01' ELSE dismissed_at END AS dismissed_at FROM sys) SELECT * FROM x")
def m4(spark, d):
    return r.dismiss(m.system_events(spark, d), F.col("level") == "error", F.lit("2024-02-01").cast("timestamp")).select("id", "dismissed_at")


@query("m10_stale_entities", m.with_tables("entities") + "x AS (SELECT entity_id FROM entities WHERE item_id % 4 <> 1) SELECT * FROM x")
def m10(spark, d):
    gone = m.entities(spark, d).where("item_id % 4 = 1").select("entity_id")
    return m.entities(spark, d).select("entity_id").join(gone, "entity_id", "left_anti")


@query(
    "s26_import_merge",
    m.with_tables("items") + """old AS (SELECT item_id, external_id AS path, created_at AS stamp FROM items WHERE item_id % 5 <> 0),
new AS (SELECT item_id, 'new/' || item_id AS path, CASE WHEN item_id % 3 = 0 THEN NULL WHEN item_id % 3 = 1 THEN created_at + INTERVAL 1 DAY ELSE created_at END AS stamp FROM items WHERE item_id % 2 = 0),
x AS (SELECT coalesce(o.item_id, n.item_id) AS item_id, CASE WHEN o.item_id IS NULL OR n.stamp > o.stamp THEN n.path ELSE o.path END AS path FROM old o FULL JOIN new n ON o.item_id = n.item_id) SELECT * FROM x""",
)
def s26(spark, d):
    i = m.items(spark, d)
    n = F.col("item_id")
    old = i.where(n % 5 != 0).select("item_id", F.col("external_id").alias("path"), F.col("created_at").alias("stamp"))
    late = F.when(n % 3 == 1, F.col("created_at") + F.expr("INTERVAL 1 DAY")).when(n % 3 == 2, F.col("created_at"))
    new = i.where(n % 2 == 0).select("item_id", F.concat(F.lit("new/"), n.cast("string")).alias("path"), late.alias("stamp"))
    return r.merge_last_writer(old, new, "item_id", "stamp").select("item_id", "path")


@query(
    "s25_export_lines",
    m.with_tables("sources") + """x AS (SELECT 'source' AS type, count(*) AS n, sum(length('{"name":"' || name || '","label":"' || label || '"}'))::BIGINT AS chars FROM sources
  UNION ALL SELECT 'label', count(*), sum(length('{"doc_id":' || doc_id || ',"quality":' || quality || ',"toxic":' || toxic || '}'))::BIGINT FROM labels) SELECT * FROM x""",
)
def s25(spark, d):
    lines = r.export_lines({"source": m.sources(spark, d).select("name", "label"), "label": m.table(spark, d, "labels").select("doc_id", "quality", "toxic")})
    return lines.groupBy("type").agg(F.count("*").alias("n"), F.sum(F.length("record")).alias("chars"))


@query(
    "c39_pseudonyms",
    m.with_tables("items") + """f AS (SELECT source_id, row_number() OVER (ORDER BY min(item_id)) AS n FROM items GROUP BY 1),
x AS (SELECT item_id, 'source-' || n AS pseudonym, substr(sha256(external_id), 1, 16) AS title FROM items JOIN f USING (source_id)) SELECT * FROM x""",
)
def c39(spark, d):
    named = r.pseudonyms(m.items(spark, d), "source_id", "source-")
    return named.select("item_id", "pseudonym", F.substring(F.sha2("external_id", 256), 1, 16).alias("title"))


@query("r43_node_links", m.with_tables("sections") + """k AS (SELECT parent_id AS section_id, count(*) AS children FROM sections WHERE parent_id IS NOT NULL GROUP BY 1),
x AS (SELECT section_id, parent_id, count(*) OVER (PARTITION BY item_id, parent_id) - 1 AS siblings, coalesce(children, 0) AS children FROM sections LEFT JOIN k USING (section_id)) SELECT * FROM x""")
def r43(spark, d):
    return r.node_links(m.sections(spark, d))


@query("r41_section_list", m.with_tables("sections") + "x AS (SELECT section_id, level FROM sections WHERE level <= 1) SELECT * FROM x")
def r41(spark, d):
    return m.sections(spark, d).where("level <= 1").orderBy("level", "section_id").select("section_id", "level")


@query(
    "r44_node_text",
    m.with_tables("sections", "chunks") + f"""down(root, node) AS (SELECT section_id, section_id FROM sections UNION ALL SELECT root, s.section_id FROM down JOIN sections s ON s.parent_id = node),
t AS (SELECT root, string_agg(content, chr(10) || chr(10) ORDER BY chunk_id) AS body FROM down JOIN chunks c ON c.section_id = node WHERE {LEAF} GROUP BY 1),
x AS (SELECT root AS section_id, length(body) AS total, length(body) > 32000 AS truncated, md5(substr(body, 1, 32000)) AS digest FROM t) SELECT * FROM x""",
)
def r44(spark, d):
    texts = trees.node_texts(trees.ancestors(m.sections(spark, d), None), m.chunks(spark, d))
    return texts.select("section_id", "total", "truncated", F.md5("body").alias("digest"))


@query(
    "r48_entity_list",
    m.with_tables("entities") + "x AS (SELECT entity_id, kind, status FROM entities WHERE kind = 'decision' AND status = 'accepted' ORDER BY created_at DESC, entity_id LIMIT 2000) SELECT * FROM x",
)
def r48(spark, d):
    return m.entities(spark, d).where("kind = 'decision' AND status = 'accepted'").orderBy(F.desc("created_at"), "entity_id").limit(2000).select("entity_id", "kind", "status")


@query("r48_related", m.with_tables("entities") + """rel AS (SELECT a.entity_id AS f, b.entity_id AS t FROM entities a JOIN entities b ON b.entity_id = a.entity_id + 3 WHERE a.entity_id % 2 = 0),
x AS (SELECT f AS entity_id, t AS other_id FROM rel UNION SELECT t, f FROM rel) SELECT *, 'conflicts_with' AS kind FROM x""")
def r48_related(spark, d):
    e = m.entities(spark, d)
    return r.related(e, _relationships(e))


_VERSIONED = "CASE doc_id % 3 WHEN 0 THEN 1 ELSE doc_id % 3 END"


@query("i7_chunker_generation", m.with_tables("items") + f"""v AS (SELECT item_id, external_id, {_VERSIONED.replace('doc_id', 'item_id')} AS version, CASE WHEN regexp_matches(external_id, '\\.(yml|json)$') THEN 2 ELSE 1 END AS wanted FROM items),
x AS (SELECT item_id, wanted FROM v WHERE version < wanted AND NOT regexp_matches(external_id, '\\.md$')) SELECT * FROM x""")
def i7(spark, d):
    n = F.col("item_id") % 3
    items = m.items(spark, d).withColumn("chunker_version", F.when(n == 0, 1).otherwise(n))
    return r.outdated(items, dict.fromkeys(("yaml", "yml", "json", "jsonc", "toml"), 2))


@query("c34_embedding_gate", m.with_tables("chunks", "items", "sources") + """w AS (SELECT item_id, chunk_id, unnest(regexp_extract_all(lower(content), '[a-z0-9_]{3,}')) AS w FROM chunks),
p AS (SELECT item_id, chunk_id, w, count(*) AS tf FROM w GROUP BY ALL), q AS (SELECT *, sum(tf) OVER (PARTITION BY item_id, w) AS df FROM p), n AS (SELECT item_id, count(*) AS n FROM chunks GROUP BY 1),
s AS (SELECT chunk_id, round(avg(greatest(0.0, ln((n + 1.0) / (df + 1.0)))), 6) AS signal FROM q JOIN n USING (item_id) GROUP BY 1),
f AS (SELECT item_id, NOT (label IS NULL OR label = 'sensitive' OR coalesce(sensitive_override, false)) AS free FROM items LEFT JOIN sources USING (source_id)),
x AS (SELECT c.chunk_id, coalesce(signal, 0) >= 0.15 AND free AS embed FROM chunks c JOIN f USING (item_id) LEFT JOIN s ON s.chunk_id = c.chunk_id) SELECT * FROM x""".replace("GROUP BY ALL", "GROUP BY item_id, chunk_id, w"))
def c34(spark, d):
    return r.embedding_gate(m.chunks(spark, d), m.items(spark, d), m.sources(spark, d))


@query("m7_caption_patch", """WITH a AS (SELECT page_id AS asset_id, CASE WHEN page_id % 3 = 0 THEN 'old' ELSE '' END AS caption, CASE WHEN page_id % 5 = 0 THEN 'spot' ELSE '' END AS target,
  CASE WHEN page_id % 8 = 0 THEN 'ignored' ELSE 'embedded' END AS attribution, 'embedded' AS sync FROM pages),
c AS (SELECT page_id AS asset_id, CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN '  new ' END AS caption, CASE WHEN page_id % 10 = 0 THEN '' END AS target, CASE WHEN page_id % 16 = 0 THEN false WHEN page_id % 7 = 0 THEN true END AS ignore FROM pages WHERE page_id % 2 = 0 OR page_id % 7 = 0 OR page_id % 4 = 1),
j AS (SELECT a.asset_id, coalesce(trim(c.caption), a.caption) AS caption, coalesce(c.target, a.target) AS target, coalesce(ignore, attribution = 'ignored') AS ig, attribution, sync,
  c.caption IS NOT NULL OR c.target IS NOT NULL OR ignore IS NOT NULL AS touched FROM a LEFT JOIN c USING (asset_id))
SELECT asset_id, caption, target, CASE WHEN NOT touched THEN attribution WHEN ig THEN 'ignored' WHEN caption <> '' OR target <> '' THEN 'manual' ELSE sync END AS attribution FROM j""")
def m7(spark, d):
    n = F.col("page_id")
    pages = m.table(spark, d, "pages")
    assets = pages.select(n.alias("asset_id"), F.when(n % 3 == 0, "old").otherwise("").alias("caption"), F.when(n % 5 == 0, "spot").otherwise("").alias("target"),
                          F.when(n % 8 == 0, "ignored").otherwise("embedded").alias("attribution"), F.lit("embedded").alias("sync_attribution"))
    changes = pages.where((n % 2 == 0) | (n % 7 == 0) | (n % 4 == 1)).select(
        n.alias("asset_id"), F.when(n % 4 == 0, "").when(n % 4 == 1, "  new ").alias("caption"), F.when(n % 10 == 0, "").alias("target"), F.when(n % 16 == 0, False).when(n % 7 == 0, True).alias("ignore")
    )
    return r.patch_captions(assets, changes).drop("sync_attribution")


@query("m8_fingerprint", "SELECT 'embedder' AS component, 'warning' AS level, 'embedding model changed (model' || label || ':64 -> model1:64); older vectors are keyword-only until re-embedded' AS message, '' AS detail FROM embeddings WHERE label <> 1")
def m8(spark, d):
    state = m.table(spark, d, "embeddings").select(F.concat(F.lit("model"), F.col("label").cast("string"), F.lit(":64")).alias("active_fp"))
    return r.record_fingerprint(state, "model1:64")[1]


@query("s27_embeddings_export", """SELECT 'chunk_embedding' AS type, '{"type":"chunk_embedding","uid":"v' || vec_id || '","embedding_b64":"' || base64(('vector ' || vec_id)::BLOB) || '","embed_fp":"model' || label || ':64"}' AS record
FROM embeddings WHERE label <> 2""")
def s27(spark, d):
    n = F.col("vec_id").cast("string")
    vectors = m.table(spark, d, "embeddings").select(
        F.concat(F.lit("v"), n).alias("uid"), F.when(F.col("label") != 2, F.concat(F.lit("vector "), n).cast("binary")).alias("embedding"), F.concat(F.lit("model"), F.col("label").cast("string"), F.lit(":64")).alias("embed_fp")
    )
    return r.export_embeddings(vectors)


@query("k8_clamped_page", m.with_tables("items") + "x AS (SELECT item_id, count(*) OVER () AS total FROM items ORDER BY external_id, item_id LIMIT 50) SELECT * FROM x")
def k8(spark, d):
    return r.page(m.items(spark, d).select("item_id", "external_id"), [F.col("external_id"), F.col("item_id")], r.clamp(400, 1, 50, 10), r.clamp(-3, 0, 1_000, 0)).select("item_id", "total")


@query("r12_cosine", """WITH p AS (SELECT a.vec_id, a.embedding AS x, CASE WHEN a.vec_id % 5 = 0 THEN b.embedding[1:8] WHEN a.vec_id % 7 = 0 THEN list_transform(b.embedding, lambda v: 0.0) ELSE b.embedding END AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, CASE WHEN vec_id % 5 = 0 OR vec_id % 7 = 0 THEN 0.0 ELSE round(list_cosine_similarity(x::DOUBLE[], y::DOUBLE[]), 6) END AS cosine FROM p""")
def r12(spark, d):
    e = m.table(spark, d, "embeddings").select("vec_id", "embedding")
    n = F.col("vec_id")
    other = e.select((n - 1).alias("vec_id"), F.col("embedding").alias("_y"))
    y = F.when(n % 5 == 0, F.slice("_y", 1, 8)).when(n % 7 == 0, F.transform("_y", lambda v: v * 0)).otherwise(F.col("_y"))
    return e.join(other, "vec_id").select("vec_id", F.round(fx.cosine(F.col("embedding"), y), 6).alias("cosine"))


@query("r32_content_window", """WITH b AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text ELSE substr(text, 1, length(text) // 2) || chr(10) || '[match ' || doc_id || ']' || chr(10) || substr(text, length(text) // 2 + 1) END AS t FROM documents WHERE text IS NOT NULL),
e AS (SELECT *, length(t) AS size, strpos(t, '[match ' || doc_id || ']') - 1 AS p FROM b), w AS (SELECT *, least(greatest(0, p - 100) + 200, size) AS stop FROM e), s AS (SELECT *, greatest(0, stop - 200) AS start FROM w)
SELECT doc_id, CASE WHEN p < 0 THEN NULL WHEN size <= 200 THEN t ELSE CASE WHEN start > 0 THEN '…' ELSE '' END || substr(t, start + 1, 200) || CASE WHEN stop < size THEN '…' ELSE '' END END AS shown FROM s""")
def r32(spark, d):
    from ..operators.search import content_window

    n, text, half = F.col("doc_id"), F.col("text"), F.floor(F.length("text") / 2).cast("int")
    marked = F.concat(F.substring(text, F.lit(1), half), F.lit("\n[match "), n.cast("string"), F.lit("]\n"), F.substring(text, half + 1, F.length(text)))
    docs = m.table(spark, d, "documents").where("text IS NOT NULL").select(n, F.when(n % 3 == 0, text).otherwise(marked).alias("t"))
    return docs.select("doc_id", content_window(F.col("t"), n, 200).alias("shown"))


def _portable(spark, d):
    """Items and sections of the documents with uids, stamps and sources."""
    n = F.col("item_id")
    stamp = F.date_format(F.col("created_at"), "yyyy-MM-dd HH:mm:ss").alias("updated_at")
    sources = m.sources(spark, d).select("source_id", F.col("name").alias("uid"), "name", F.lit("2024-01-01").alias("updated_at"))
    items = m.items(spark, d).select("item_id", F.concat(F.lit("i"), n.cast("string")).alias("uid"), "source_id", F.col("external_id").alias("path"), stamp)
    sections = m.sections(spark, d).select("section_id", F.concat(F.lit("s"), F.col("section_id").cast("string")).alias("uid"), "item_id", "parent_id", "title", F.lit("2024-01-01").alias("updated_at"))
    return {"source": sources, "item": items, "section": sections}


def _other_library(spark, d):
    """Another installation's library: every second item with ids of its own, paths of every third changed later, of the others earlier."""
    from ..operators import portability

    t = _portable(spark, d)
    n = F.col("item_id")
    items = t["item"].where(n % 2 == 0).withColumn("path", F.concat(F.lit("new/"), "path")).withColumn("updated_at", F.when(n % 3 == 0, "2099-01-01").otherwise("1999-01-01"))
    moved = {"source": t["source"], "item": items.withColumn("item_id", n + 7_000_000), "section": t["section"].where(n % 2 == 0).withColumn("item_id", n + 7_000_000).withColumns({"section_id": F.col("section_id") + 5, "parent_id": F.col("parent_id") + 5})}
    return portability.export(moved)


@query("s25_export_scope", m.with_tables("items", "sections") + """k AS (SELECT item_id FROM items WHERE source_id IN (1, 2)),
x AS (SELECT 'source' AS kind, 'src' || s AS uid, NULL AS refs FROM (SELECT unnest([1, 2]) AS s) WHERE s IN (SELECT source_id FROM items)
UNION ALL SELECT 'item', 'i' || item_id, '{"source_id":"src' || source_id || '"}' FROM items WHERE item_id IN (SELECT item_id FROM k)
UNION ALL SELECT 'section', 's' || section_id, '{"item_id":"i' || item_id || '"' || CASE WHEN parent_id IS NULL THEN '' ELSE ',"parent_id":"s' || parent_id || '"' END || '}' FROM sections WHERE item_id IN (SELECT item_id FROM k)) SELECT * FROM x""")
def s25_scope(spark, d):
    from ..operators import portability

    t = _portable(spark, d)
    lines = portability.export(t, t["source"].where("source_id IN (1, 2)").select("source_id"))
    return lines.select("kind", "uid", F.get_json_object("line", "$.refs").alias("refs"))


@query("s26_import_uids", m.with_tables("items", "sections") + """here AS (SELECT item_id FROM items WHERE item_id % 5 <> 0), there AS (SELECT item_id FROM items WHERE item_id % 2 = 0),
i AS (SELECT item_id, CASE WHEN h.item_id IS NULL OR t.item_id % 3 = 0 AND t.item_id IS NOT NULL THEN 'new/' || external_id ELSE external_id END AS path FROM items LEFT JOIN here h USING (item_id) LEFT JOIN there t USING (item_id) WHERE h.item_id IS NOT NULL OR t.item_id IS NOT NULL),
x AS (SELECT 's' || section_id AS uid, 'i' || item_id AS item_uid, path, 's' || parent_id AS parent_uid FROM sections JOIN i USING (item_id)) SELECT * FROM x""".replace("path, 's'", "i.path AS path, 's'"))
def s26_uids(spark, d):
    """Sections after an import of another library, with what their ids lead to."""
    from ..operators import portability

    t = _portable(spark, d)
    own = {"source": t["source"], "item": t["item"].where("item_id % 5 <> 0"), "section": t["section"].where("item_id % 5 <> 0")}
    now = portability.import_lines(spark, own, _other_library(spark, d)).tables
    items = now["item"].select("item_id", F.col("uid").alias("item_uid"), "path")
    parents = now["section"].select(F.col("section_id").alias("parent_id"), F.col("uid").alias("parent_uid"))
    return now["section"].select("uid", "item_id", "parent_id").join(items, "item_id").join(parents, "parent_id", "left").select("uid", "item_uid", "path", "parent_uid")


@query("s26_dry_run", m.with_tables("items", "sections") + """x AS (SELECT 'source' AS kind, 0::BIGINT AS added, 0::BIGINT AS updated, count(DISTINCT source_id) AS kept, 0::BIGINT AS removed, 0::BIGINT AS unresolved FROM items
UNION ALL SELECT 'item', count(*) FILTER (item_id % 5 = 0), count(*) FILTER (item_id % 5 <> 0 AND item_id % 3 = 0), count(*) FILTER (item_id % 5 <> 0 AND item_id % 3 <> 0), 0, 0 FROM items WHERE item_id % 2 = 0
UNION ALL SELECT 'section', count(*) FILTER (item_id % 5 = 0), 0, count(*) FILTER (item_id % 5 <> 0), 0, 0 FROM sections WHERE item_id % 2 = 0) SELECT * FROM x""")
def s26_dry_run(spark, d):
    from ..operators import portability

    t = _portable(spark, d)
    own = {"source": t["source"], "item": t["item"].where("item_id % 5 <> 0"), "section": t["section"].where("item_id % 5 <> 0")}
    return portability.import_lines(spark, own, _other_library(spark, d), dry_run=True).report
