"""Registered queries of the text, source and streaming operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model as m
from ..functions import text as fx
from ..operators import ingest as ig
from ..operators import library as lb
from ..operators import search as se
from ..operators import structure as st
from ..sources import extract, json_map, paged
from ..storage import Scratch
from ..streaming import streams
from .relational import Query

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def scratch(spark: SparkSession) -> str:
    return Scratch(spark, "stream").root


_HTML_SQL = "regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'g')"
for _p, _r in (
    ("(?s)<!--.*?-->", "''"), *[(f"(?i)<h{n}[^>]*>", f"chr(10) || '{'#' * n} '") for n in range(1, 7)],
    ("(?i)</?(p|div|br|li|ul|ol|tr|table|section|article|header|footer|nav|h[1-6])[^>]*>", "chr(10)"), ("(?i)</t[dh]>", "chr(9)"), ("(?s)<[^>]+>", "''"),
):
    _HTML_SQL = f"regexp_replace({_HTML_SQL}, '{_p}', {_r}, 'g')"
for _n, _c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _HTML_SQL = f"replace({_HTML_SQL}, '{_n}', '{_c}')"
for _p, _r in (("[ \\x0B\\f\\r]+", "' '"), (" ?\\n ?", "chr(10)"), ("\\n{3,}", "chr(10) || chr(10)")):
    _HTML_SQL = f"regexp_replace({_HTML_SQL}, '{_p}', {_r}, 'g')"


@query("s13_html_to_text", f"SELECT page_id, trim({_HTML_SQL}, ' ') AS text FROM pages")
def s13(spark, d):
    return m.table(spark, d, "pages").select("page_id", fx.html_to_text(F.col("html")).alias("text"))


@query("s14_html_images")
def s14(spark, d):
    return st.per_document(m.table(spark, d, "pages"), "page_id", "html", "text string, images int", lambda t: [(extract.html(t), len(extract.image_refs(t)))])


@query(
    "s8_json_mapping",
    """WITH j AS (SELECT event_id, '{"id":' || event_id || ',"fields":{"name":"' || event_type || '","k":' || (props->>'k') || '},"updated":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '"}' AS item FROM events)
SELECT event_id, item->>'$.id' AS external_id, item->>'$.fields.name' AS title, (item->>'$.fields.name') || chr(10) || (item->>'$.fields.k') AS text, (item->>'$.updated')::TIMESTAMP AS updated, 'rest:' || (item->>'$.id') AS source_ref FROM j""",
)
def s8(spark, d):
    e = m.table(spark, d, "events")
    fields = F.struct(F.col("event_type").alias("name"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    item = F.to_json(F.struct(F.col("event_id").alias("id"), fields.alias("fields"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("updated")))
    how = json_map.Mapping(id="id", title="fields.name", text="/fields/name, fields.k, missing", updated="updated")
    return json_map.documents(e.select("event_id", item.alias("item")), how).select("event_id", "external_id", "title", "text", "updated", "source_ref")


@query("s9_item_locate", "SELECT event_type, (props->>'k')::INTEGER % 3 AS place, count(*) AS n FROM events GROUP BY ALL")
def s9(spark, d):
    e = m.table(spark, d, "events").withColumn("place", F.get_json_object("props", "$.k").cast("int") % 3)
    lists = e.groupBy("event_type", "place", (F.col("event_id") % 50).alias("_g")).agg(F.to_json(F.collect_list("props")).alias("a"))  # bodies of a page's size
    plain = F.regexp_replace(F.regexp_replace("a", r'\\"', '"'), r'"\{', "{")
    array = F.regexp_replace(plain, r'\}"', "}")
    body = F.when(F.col("place") == 0, array).when(F.col("place") == 1, F.concat(F.lit('{"data":'), array, F.lit("}"))).otherwise(F.concat(F.lit('{"results":'), array, F.lit("}")))
    return json_map.find_items(lists.withColumn("body", body)).groupBy("event_type", "place").agg(F.count("*").alias("n"))


@query("s10_cursor_max", "SELECT event_type, max(strftime(ts, '%Y-%m-%dT%H:%M:%S')) AS cursor FROM events GROUP BY 1")
def s10(spark, d):
    return ig.cursor(m.table(spark, d, "events"), ["event_type"], F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))


_PAGE_SQL = "regexp_matches(line, '(?i)^(?:page\\s*)?\\d{1,4}(?:\\s*of\\s*\\d{1,4})?\\s*$') OR regexp_matches(line, '^[-–—]\\s*\\d{1,4}\\s*[-–—]$')"


@query("c2_page_number_lines", f"""WITH l AS (SELECT conv_id, turn, unnest(['Page ' || turn, turn || ' of 9', '- ' || turn || ' -', 'Section ' || turn, text]) AS line FROM conversations)
SELECT conv_id, turn, count(*) FILTER ({_PAGE_SQL}) AS n FROM l GROUP BY ALL""")
def c2(spark, d):
    t = F.col("turn").cast("string")
    lines = F.array(F.concat(F.lit("Page "), t), F.concat(t, F.lit(" of 9")), F.concat(F.lit("- "), t, F.lit(" -")), F.concat(F.lit("Section "), t), F.col("text"))
    rows = m.table(spark, d, "conversations").select("conv_id", "turn", F.explode(lines).alias("line"))
    return rows.groupBy("conv_id", "turn").agg(F.count_if(fx.is_page_number(F.col("line"))).alias("n"))


@query("c4_classify_windows", """WITH w AS (SELECT doc_id, text, unnest(range(0, greatest(0, ceil((length(text) - 16000) / 8000.0))::BIGINT + 1)) AS idx FROM documents)
SELECT doc_id, idx::INTEGER AS idx, length(substr(text, idx * 8000 + 1, 16000)) AS chars FROM w""")
def c4(spark, d):
    return ig.classify_windows(m.table(spark, d, "documents"), "doc_id").select("doc_id", "idx", F.length("window").alias("chars"))


@query("c5_marker_headings", """WITH l AS (SELECT page_id, unnest(string_split(text, chr(10))) AS line FROM (SELECT page_id, trim(%s, ' ') AS text FROM pages))
SELECT page_id, length(regexp_extract(line, '^(#{1,6})[ \\t]+\\S', 1)) AS level, count(*) AS n FROM l WHERE regexp_matches(line, '^#{1,6}[ \\t]+\\S') GROUP BY ALL""" % _HTML_SQL.replace("%", "%%"))
def c5(spark, d):
    lines = s13(spark, d).select("page_id", F.explode(F.split("text", "\n")).alias("line"))
    level = F.length(F.regexp_extract("line", r"^(#{1,6})[ \t]+\S", 1))
    return lines.select("page_id", level.alias("level")).where("level > 0").groupBy("page_id", "level").agg(F.count("*").alias("n"))


@query("c12_minified_guard", """SELECT page_id, strlen(html) > 50000 AND length(html) - length(replace(html, chr(10), '')) < 10 OR strlen(html) > 2000 * (length(html) - length(replace(html, chr(10), '')) + 1) AS minified FROM pages""")
def c12(spark, d):
    size = F.octet_length("html")
    breaks = F.length("html") - F.length(F.replace("html", F.lit("\n"), F.lit("")))
    return m.table(spark, d, "pages").select("page_id", (((size > 50_000) & (breaks < 10)) | (size > 2000 * (breaks + 1))).alias("minified"))


@query("c18_page_breadcrumbs", m.with_tables("chunks") + """p AS (SELECT chunk_id, 1 + (chunk_id % 100000) // 3 AS a, 1 + (chunk_id % 100000 + 1) // 3 AS b FROM chunks WHERE section_id IS NOT NULL),
x AS (SELECT chunk_id, CASE WHEN a = b THEN '(p. ' || a || ')' ELSE '(pp. ' || a || '-' || b || ')' END AS crumb FROM p) SELECT * FROM x""")
def c18(spark, d):
    i = F.col("chunk_id") % m.ITEM_SPAN
    return m.chunks(spark, d).where("section_id IS NOT NULL").select("chunk_id", ig.page_crumb(F.floor(i / 3) + 1, F.floor((i + 1) / 3) + 1).alias("crumb"))


_EDGES = "regexp_replace({}, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g')"


@query("c20_section_summary", "WITH t AS (SELECT page_id, %s AS text FROM pages), two AS (SELECT *, %s AS two FROM t) SELECT page_id, CASE WHEN two = '' THEN %s ELSE %s END AS summary FROM two" % (
    _HTML_SQL.replace("%", "%%").replace("%%", "%"), _EDGES.format("array_to_string(string_split(trim(text, ' '), chr(10) || chr(10))[1:2], chr(10) || chr(10))"), _EDGES.format("substr(text, 1, 800)"), _EDGES.format("substr(two, 1, 1200)")))
def c20(spark, d):
    return s13(spark, d).select("page_id", ig.section_summary(F.col("text")).alias("summary"))


@query("c21_document_summary", "SELECT doc_id, %s AS summary FROM documents" % _EDGES.format("substr(" + _EDGES.format("text") + ", 1, 1200)"))
def c21(spark, d):
    return m.table(spark, d, "documents").select("doc_id", ig.document_summary(F.col("text")).alias("summary"))


_RECORD_SQL = " OR ".join(f"regexp_matches(head, '{p}')" for p in fx.RECORD_PATTERNS)


@query("c23_bucket", f"""WITH t AS (SELECT doc_id, lower(substr(CASE doc_id % 5 WHEN 0 THEN '## Decision' || chr(10) WHEN 1 THEN 'They agreed: ' ELSE '' END || coalesce(text, ''), 1, 12000)) AS head FROM documents)
SELECT doc_id, CASE WHEN {_RECORD_SQL} THEN 'record' ELSE 'reference' END AS bucket FROM t""")
def c23(spark, d):
    lead = F.when(F.col("doc_id") % 5 == 0, "## Decision\n").when(F.col("doc_id") % 5 == 1, "They agreed: ").otherwise("")
    return m.table(spark, d, "documents").select("doc_id", fx.bucket(F.concat(lead, F.coalesce("text", F.lit("")))).alias("bucket"))


@query("c30_pair_normalisation", """WITH p AS (SELECT p_partkey, lower(trim(p_brand)) AS term, lower(trim(p_type)) AS expansion FROM part)
SELECT * FROM p WHERE length(term) BETWEEN 2 AND 40 AND length(expansion) BETWEEN 2 AND 120 AND term <> expansion""")
def c30(spark, d):
    return ig.valid_pairs(m.table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("term"), F.col("p_type").alias("expansion")))


_ASKED = "brand small polished copper steel b11 anodized"
_WORDS_SQL = f"list_filter(regexp_extract_all(lower(expansion), '[\\p{{L}}\\p{{N}}_§\\-]+'), lambda w: strlen(w) >= 2 AND NOT list_contains({fx.STOPWORDS}, w))"


@query("r7_vocabulary_expansion", f"""WITH v AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'steel' WHEN 1 THEN 'brand' ELSE 'b' || p_partkey END AS term,
  CASE WHEN p_partkey % 7 = 0 THEN 'copper' ELSE lower(p_type) END AS expansion, CASE WHEN p_partkey % 5 = 0 THEN 'rule' ELSE 'manual' END AS origin FROM part WHERE p_partkey % 4 <> 0),
p AS (SELECT *, origin = 'rule' AS rule FROM v ORDER BY rule, id LIMIT 64), q AS (SELECT {fx.query_terms(_ASKED)} AS t),
f AS (SELECT rule, id, CASE WHEN list_contains(t, term) THEN expansion WHEN list_contains(t, expansion) OR (len({_WORDS_SQL}) > 0 AND len(list_filter({_WORDS_SQL}, lambda w: NOT list_contains(t, w))) = 0) THEN term END AS word FROM p, q)
SELECT word, bool_and(rule) AS rule, min(id) FILTER (NOT rule OR only_rule) AS id FROM (SELECT *, bool_and(rule) OVER (PARTITION BY word) AS only_rule FROM f WHERE word IS NOT NULL) GROUP BY word""")
def r7(spark, d):
    n = F.col("p_partkey")
    vocabulary = m.table(spark, d, "part").select(
        n.alias("id"), F.when(n % 3 == 0, "steel").when(n % 3 == 1, "brand").otherwise(F.concat(F.lit("b"), n.cast("string"))).alias("term"),
        F.when(n % 7 == 0, "copper").otherwise(F.lower("p_type")).alias("expansion"), F.when(n % 5 == 0, "rule").otherwise("manual").alias("origin"),
        F.when(n % 4 == 0, "retired").otherwise("active").alias("status"), F.lit(None).cast("int").alias("source_id"),
    )
    return se.expansions(vocabulary, fx.query_terms(_ASKED))


@query("c1_document_cleaning")
def c1(spark, d):
    return st.cleaned(m.table(spark, d, "documents"), "doc_id")


@query("c3_snapped_windows")
def c3(spark, d):
    return st.snapped_windows(m.table(spark, d, "documents"), "doc_id")


@query("c7_prose_sections")
def c7(spark, d):
    return st.sectioned(m.table(spark, d, "documents"), "doc_id")


@query("c9_c17_chunk_dispatch")
def c17(spark, d):
    return st.chunked(m.items(spark, d), "item_id", "external_id")


@query("c24_c27_records", """SELECT doc_id, 'decision' AS kind, 'Item ' || doc_id AS title, 'D' || doc_id AS record_id, 'accepted' AS status, NULL AS owner, NULL AS due, []::VARCHAR[] AS supersedes, NULL::BOOLEAN AS done FROM documents
UNION ALL SELECT doc_id, 'action', 'check it by 2024-03-01', NULL, NULL, 'Ann', '2024-03-01', []::VARCHAR[], false FROM documents""")
def c24(spark, d):
    """Records that stand in front of ordinary text, which adds none."""
    head = F.concat(F.lit("# Decision: Item "), F.col("doc_id").cast("string"), F.lit(" — D"), F.col("doc_id").cast("string"), F.lit("\n\n**Status:** Accepted. Owner: Kim\n\n## Action items\n- Ann: check it by 2024-03-01\n\n## Text\n"))
    return st.parsed_records(m.table(spark, d, "documents").select("doc_id", F.concat(head, F.coalesce("text", F.lit(""))).alias("text")), "doc_id")


@query("c28_initialisms", """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'abg' ELSE 'dd' END AS term, CASE doc_id % 3 WHEN 0 THEN 'alpha beta of the gamma' ELSE 'direct debit' END AS expansion FROM documents WHERE doc_id % 3 < 2""")
def c28(spark, d):
    n, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    said = F.when(n % 3 == 0, " see Alpha Beta of the Gamma (ABG)").when(n % 3 == 1, " by direct debit (DD), or Direct Debit (DD)").otherwise(" no such thing (QQ)")
    return st.initialism_pairs(m.table(spark, d, "documents").select(n, F.concat(text, F.lit("."), said).alias("text")), "doc_id")


@query("c29_glossary_lines", """SELECT doc_id, 'code' || doc_id AS term, 'meaning of ' || doc_id AS expansion FROM labels""")
def c29(spark, d):
    n = F.col("doc_id").cast("string")
    text = F.concat(F.lit("| Term | Meaning |\n|---|---|\n| **CODE"), n, F.lit("** | Meaning of "), n, F.lit(" |\nCODE"), n, F.lit(" - meaning of "), n)
    return st.glossary_pairs(m.table(spark, d, "labels").select("doc_id", text.alias("text")), "doc_id")


_FNV = "list_reduce(list_prepend(37, list_transform(range(0, len(hex(encode(t))) // 2), lambda i: ('0x' || substr(hex(encode(t)), (2 * i + 1)::INTEGER, 2))::INTEGER)), lambda h, b: xor(h, b) * 179 % 256)"


@query("c32_hash_embedding", f"""WITH w AS (SELECT conv_id * 1000 + turn AS id, unnest(CASE WHEN regexp_matches(text, '[\\p{{L}}\\p{{N}}]') THEN regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') ELSE [text] END) AS t0 FROM conversations),
w1 AS (SELECT id, CASE WHEN t0 IN ('car', 'automobile', 'auto') THEN 'vehicle' WHEN t0 IN ('fast', 'quick', 'velocity', 'rapid') THEN 'speed' WHEN t0 IN ('database', 'db', 'store') THEN 'storage'
  WHEN t0 IN ('red', 'crimson', 'scarlet') THEN 'color' WHEN t0 IN ('large', 'huge') THEN 'big' WHEN t0 IN ('tiny', 'little') THEN 'small' ELSE t0 END AS t FROM w),
v AS (SELECT id, {_FNV} AS bucket FROM w1), c AS (SELECT id, bucket, count(*) AS n FROM v GROUP BY 1, 2), m AS (SELECT id, map_from_entries(list((bucket, n))) AS m, sqrt(sum(n * n)::DOUBLE) AS norm FROM c GROUP BY 1)
SELECT conv_id * 1000 + turn AS id, list_transform(range(0, 256), lambda i: coalesce(m[i::INTEGER], 0) / coalesce(norm, 1.0)) AS embedding FROM conversations LEFT JOIN m ON m.id = conv_id * 1000 + turn""")
def c32(spark, d):
    return st.embedded(m.table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"), "id", dim=256)


@query("t1_event_stream_folding", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY ALL")
def t1(spark, d):
    """The events as a stream, folded by hour and type; complete results go to a table, batch by batch."""
    out = scratch(spark)
    stream = spark.readStream.schema(m.table(spark, d, "events").schema).option("maxFilesPerTrigger", 4).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")
    folded = streams.folded(stream.withColumn("ts", F.col("ts").cast("timestamp")))

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/table")

    folded.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    wall = [F.col(c).cast("timestamp_ntz").alias(a) for c, a in (("window.start", "hour"), ("first_seen", "first_seen"), ("last_seen", "last_seen"))]
    return spark.read.parquet(f"{out}/table").select("event_type", "n", *wall)


@query("t2_listing_changes", """SELECT 'f' || doc_id AS rel, CASE WHEN doc_id % 5 = 0 THEN 'removed' WHEN doc_id % 7 = 0 THEN 'added' ELSE 'changed' END AS change FROM documents WHERE doc_id % 5 = 0 AND doc_id % 7 <> 0 OR doc_id % 7 = 0 AND doc_id % 5 <> 0 OR (doc_id % 3 = 0 AND doc_id % 5 <> 0 AND doc_id % 7 <> 0)""")
def t2(spark, d):
    n = F.col("doc_id")
    files = m.table(spark, d, "documents").select(n, F.concat(F.lit("f"), n.cast("string")).alias("rel"), n.alias("mtime_ms"), F.col("n_chars").alias("size"))
    now = files.where(n % 5 != 0).withColumn("mtime_ms", F.when(n % 3 == 0, n + 1).otherwise(n))
    return streams.changed_listing(now, files.where(n % 7 != 0))


@query("t5_job_admission", """WITH j AS (SELECT event_id AS job_id, user_id AS source_id, CASE WHEN event_id = 3 THEN 'running' WHEN event_id % 2 = 0 THEN 'queued' ELSE 'done' END AS status FROM events),
f AS (SELECT source_id, min(job_id) AS job_id FROM j WHERE status = 'queued' AND source_id NOT IN (SELECT source_id FROM j WHERE status = 'running') GROUP BY 1) SELECT job_id, source_id FROM f ORDER BY job_id LIMIT 1""")
def t5(spark, d):
    n = F.col("event_id")
    status = F.when(n == 3, "running").when(n % 2 == 0, "queued").otherwise("done")
    return streams.admit_jobs(m.table(spark, d, "events").select(n.alias("job_id"), F.col("user_id").alias("source_id"), status.alias("status")))


@query("t7_last_queries", "SELECT event_id AS id, ts AS at FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def t7(spark, d):
    return streams.last_queries(m.table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("at")))


@query("s11_text_decode", "SELECT doc_id || '.txt' AS path, md5(text) AS digest FROM documents WHERE length(text) > 0")
def s11(spark, d):
    """Texts in five encodings, with marks of byte order and without, come back as they were."""
    n, text = F.col("doc_id"), F.col("text")
    wide = F.concat(F.unhex(F.lit("FFFE")), F.encode(text, "UTF-16LE"))
    data = F.when(n % 4 == 0, F.encode(text, "UTF-8")).when(n % 4 == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(text, "UTF-8"))).when(n % 4 == 2, wide).otherwise(F.concat(F.unhex(F.lit("FEFF")), F.encode(text, "UTF-16BE")))
    files = m.table(spark, d, "documents").where("length(text) > 0").select(F.concat(n.cast("string"), F.lit(".txt")).alias("path"), data.alias("content"))
    return extract.extracted(files).select("path", F.md5("text").alias("digest"))


@query("s2_skipped_files", "SELECT doc_id || CASE WHEN doc_id % 3 = 0 THEN '.txt' ELSE '.docx' END AS path, CASE WHEN doc_id % 3 = 0 THEN 'binary' ELSE 'BadZipFile' END AS error FROM documents WHERE doc_id % 3 < 2")
def s2(spark, d):
    """Files that cannot be read are skipped with the reason, and stop no other."""
    n = F.col("doc_id")
    data = F.when(n % 3 == 0, F.unhex(F.lit("0000010200000300"))).otherwise(F.encode(F.concat(F.lit("text "), n.cast("string")), "UTF-8"))
    files = m.table(spark, d, "documents").select(F.concat(n.cast("string"), F.when(n % 3 == 1, ".docx").otherwise(".txt")).alias("path"), data.alias("content"))
    return extract.extracted(files).where("text IS NULL").select("path", F.substring_index("error", ":", 1).alias("error"))


@query("c38_entity_context", m.with_tables("chunks") + """e AS (SELECT chunk_id AS entity_id, item_id, substr(content, 50, 300) AS text FROM chunks WHERE chunk_id % 37 = 0 AND kind = 'document' AND length(content) >= 300),
a AS (SELECT chunk_id, item_id, content, lag(chunk_id) OVER w AS before, lead(chunk_id) OVER w AS after FROM chunks WINDOW w AS (PARTITION BY item_id ORDER BY chunk_id)),
h AS (SELECT entity_id, min(chunk_id) AS chunk_id FROM e JOIN a USING (item_id) WHERE contains(content, substr(text, 1, 160)) GROUP BY 1),
x AS (SELECT entity_id, h.chunk_id, before, after FROM h JOIN a USING (chunk_id)) SELECT * FROM x""")
def c38(spark, d):
    chunks = m.chunks(spark, d)
    told = chunks.where("chunk_id % 37 = 0 AND kind = 'document' AND length(content) >= 300")
    return lb.entity_context(told.select(F.col("chunk_id").alias("entity_id"), "item_id", F.substring("content", 50, 300).alias("text")), chunks)


@query("s4_jira_documents", """SELECT 'K-' || event_id AS external_id, event_type AS title, event_type || chr(10) || chr(10) || 'Status: Open' || chr(10) || chr(10) || 'Assignee: u' || user_id || chr(10) || chr(10) || 'first line' || chr(10) || 'of ' || event_id
  || CASE WHEN event_id % 2 = 0 THEN chr(10) || chr(10) || 'said ' || user_id ELSE '' END AS text, 'Jira:K-' || event_id AS source_ref FROM events""")
def s4(spark, d):
    """Pages of one issue each, with rich text."""
    n, u = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    adf = F.concat(F.lit('{"type":"doc","content":[{"type":"paragraph","content":[{"type":"text","text":"first "},{"type":"text","text":"line"}]},{"type":"paragraph","content":[{"type":"text","text":"of '), n, F.lit('"}]}]}'))
    comments = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('[{"body":"said '), u, F.lit('"},{"body":""}]'))).otherwise("[]")
    body = F.concat(
        F.lit('{"issues":[{"key":"K-'), n, F.lit('","fields":{"summary":"'), "event_type", F.lit('","status":{"name":"Open"},"assignee":{"displayName":"u'), u, F.lit('"},"description":'), adf,
        F.lit(',"comment":{"comments":'), comments, F.lit('},"updated":"2024-01-02T00:00:00Z"}}]}'),
    )
    return paged.jira_documents(m.table(spark, d, "events").select(body.alias("body"))).select("external_id", "title", "text", "source_ref")


@query("s5_linear_documents", """SELECT 'T-' || event_id AS external_id, 'Issue ' || event_id AS title, 'Issue ' || event_id || chr(10) || chr(10) || 'State: ' || event_type || chr(10) || chr(10) || 'Assignee: u' || user_id || chr(10) || chr(10) || 'c' AS text, 'u' || user_id AS author FROM events""")
def s5(spark, d):
    n, u = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    body = F.concat(
        F.lit('{"data":{"issues":{"nodes":[{"id":"x","identifier":"T-'), n, F.lit('","title":"Issue '), n, F.lit('","description":null,"state":{"name":"'), "event_type", F.lit('"},"assignee":{"name":"u'), u,
        F.lit('"},"comments":{"nodes":[{"body":"c"},{"body":null}]},"updatedAt":"2024-01-02T00:00:00Z"}],"pageInfo":{"hasNextPage":false}}}}'),
    )
    return paged.linear_documents(m.table(spark, d, "events").select(body.alias("body"))).select("external_id", "title", "text", "author")


@query("s3_drive_plan", """SELECT doc_id::VARCHAR AS external_id, 'f' || doc_id || '.docx' AS title, CASE doc_id % 4 WHEN 0 THEN 'txt' WHEN 1 THEN 'csv' WHEN 2 THEN 'pdf' ELSE 'docx' END AS kind,
  CASE doc_id % 4 WHEN 0 THEN 'text/plain' WHEN 1 THEN 'text/csv' WHEN 2 THEN 'application/pdf' END AS export FROM documents WHERE doc_id % 8 <> 7""")
def s3(spark, d):
    n = F.col("doc_id")
    mime = F.when(n % 8 == 7, "google-apps.folder").when(n % 4 == 0, "google-apps.document").when(n % 4 == 1, "google-apps.spreadsheet").when(n % 4 == 2, "google-apps.drawing").otherwise("other")
    body = F.concat(F.lit('{"files":[{"id":"'), n.cast("string"), F.lit('","name":"f'), n.cast("string"), F.lit('.docx","mimeType":"application/vnd.'), mime, F.lit('"}]}'))
    return paged.drive_plan(m.table(spark, d, "documents").select(body.alias("body"))).select("external_id", "title", "kind", "export")


@query("c13_config_sections", """WITH t AS (SELECT doc_id, lang, source FROM documents),
x AS (SELECT doc_id, 0 AS idx, 'rules' AS title, 'rules' AS path, 1 AS level, NULL::INTEGER AS parent, 1 AS first_line, 11 AS last_line, 0 AS pairs FROM t
UNION ALL SELECT doc_id, 1, 'id: r' || doc_id || ', langCode: ' || lang, 'rules > id: r' || doc_id || ', langCode: ' || lang, 2, 0, 1, 6, 2 FROM t
UNION ALL SELECT doc_id, 2, 'when: ' || source, 'rules > when: ' || source, 2, 0, 7, 10, 0 FROM t
UNION ALL SELECT doc_id, 3, '#3', 'rules > #3', 2, 0, 11, 11, 0 FROM t
UNION ALL SELECT doc_id, 4, 'version, owner', 'version, owner', 1, NULL, 12, 13, 0 FROM t
UNION ALL SELECT doc_id, 5, 'source (name: ' || source || ')', 'source (name: ' || source || ')', 1, NULL, 15, 18, 1 FROM t) SELECT * FROM x""")
def c13(spark, d):
    lines = ["# rules of a document", "rules:", "  - id: 'r%s'", "    langCode: %s", "    note: |", "      id: not a key", "  # the second", "  - when: %s  # where", "    then:", "      - stop", "  - [1, 2]", "version: 3", 'owner: "a: b"', "", "source:", "  name: %s", "  weights:", "    - 5"]
    text = F.format_string("\n".join(lines), F.col("doc_id").cast("string"), "lang", "source", "source")
    files = m.table(spark, d, "documents").select("doc_id", F.lit("a/rules.yml").alias("path"), text.alias("text"))
    found = st.config_sections(files.withColumnRenamed("path", "_path"), "doc_id", "_path")
    return found.select("doc_id", "idx", "title", "path", "level", "parent", "first_line", "last_line", F.size("promoted").alias("pairs"))


@query("c15_c16_markdown_chunks", """WITH t AS (SELECT doc_id, lang, source FROM documents),
x AS (SELECT doc_id, 0 AS idx, 'Item ' || doc_id AS path, 5 AS first_line, 7 AS last_line, '# Item ' || doc_id || chr(10) || chr(10) || 'About ' || source || '.' AS content FROM t
UNION ALL SELECT doc_id, 1, 'Item ' || doc_id || ' > Front matter', 1, 4, '---' || chr(10) || 'title: Item ' || doc_id || chr(10) || 'status: draft' || chr(10) || '---' FROM t
UNION ALL SELECT doc_id, 2, 'Item ' || doc_id || ' > Table', 9, 9, '## Table' FROM t
UNION ALL SELECT doc_id, 3 + k, 'Item ' || doc_id || ' > Table', 10, 91, '| key | value |' || chr(10) || '|---|---|' || chr(10) || list_aggregate(list_transform(range(1 + 24 * k, least(81, 25 + 24 * k)), lambda i: '| ' || lpad(i::VARCHAR, 3, '0') || ' | ' || lang || repeat('x', 47) || ' |'), 'string_agg', chr(10))
  FROM t, (SELECT unnest(range(4)) AS k)) SELECT * FROM x WHERE idx < 99""")
def c16(spark, d):
    """A front matter, a heading of the same name, and a table of eighty rows, which goes into pieces with its header."""
    row = F.transform(F.sequence(F.lit(1), F.lit(80)), lambda i: F.concat(F.lit("| "), F.lpad(i.cast("string"), 3, "0"), F.lit(" | "), F.col("lang"), F.lit("x" * 47 + " |")))
    head = F.format_string("---\ntitle: Item %s\nstatus: draft\n---\n# Item %s\n\nAbout %s.\n\n## Table\n| key | value |\n|---|---|\n", F.col("doc_id").cast("string"), F.col("doc_id").cast("string"), "source")
    files = m.table(spark, d, "documents").select("doc_id", F.lit("notes/item.md").alias("_path"), F.concat(head, F.array_join(row, "\n")).alias("text"))
    return st.chunked(files, "doc_id", "_path")


def _synced(spark, d) -> ig.Ingested:
    """The documents as files that come in twice: every fourth has changed, every fifth is gone."""
    n = F.col("item_id")
    files = m.items(spark, d).select("item_id", "external_id", "text", "mtime_ms", "size")
    first = ig.ingest(spark, files.drop("item_id"), ig.Library.empty(spark), 1)
    changed = files.where(n % 5 != 0).withColumns({"text": F.when(n % 4 == 0, F.concat(F.lit("Changed. "), F.coalesce("text", F.lit("")))).otherwise(F.col("text")), "mtime_ms": F.when(n % 4 == 0, F.col("mtime_ms") + 1).otherwise(F.col("mtime_ms"))})
    return ig.ingest(spark, changed.drop("item_id"), first.library, 1)


@query("i1_i8_ingest_report", """SELECT action, count(*) AS n FROM (SELECT CASE WHEN doc_id % 5 = 0 THEN 'purge' WHEN doc_id % 4 = 0 THEN 'update' ELSE 'skip' END AS action FROM documents) GROUP BY 1""")
def ingest_report(spark, d):
    return _synced(spark, d).report


@query("c21_ingest_summaries", m.with_tables("items") + f"""t AS (SELECT external_id, CASE WHEN item_id % 4 = 0 THEN 'Changed. ' || coalesce(text, '') ELSE text END AS text FROM items WHERE item_id % 5 <> 0),
x AS (SELECT external_id, {_EDGES.format("substr(" + _EDGES.format("text") + ", 1, 1200)")} AS summary FROM t WHERE trim(coalesce(text, '')) <> '' AND NOT regexp_matches(lower(external_id), '\\.(pdf|txt|docx|odt|rtf|html?|eml)$')) SELECT * FROM x WHERE summary <> ''""")
def ingest_summaries(spark, d):
    """Summaries of whole texts after the two syncs, of files whose text is not cleaned first."""
    library = _synced(spark, d).library
    names = library.items.where("NOT lower(external_id) RLIKE '\\\\.(pdf|txt|docx|odt|rtf|html?|eml)$'").select("item_id", "external_id")
    return library.chunks.where("kind = 'doc_summary'").join(names, "item_id").select("external_id", F.col("content").alias("summary"))
