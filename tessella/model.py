"""The data model as DataFrames, and its reading of the shared test tables.

Ids are derived from natural keys, so chunk order is document order and every
run gives the same ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LABELS = ("public", "internal", "sensitive")
LEAF_KINDS = ("document", "caption")
SUMMARY_KINDS = ("section_summary", "doc_summary")
STATUSES = ("proposed", "accepted", "superseded", "disputed", "stale")

#: Room for the chunks of one item in the id space.
ITEM_SPAN = 100_000
#: Windows that stand in for chunks in the derived tables, and how many of them are cut from one piece of a text.
WINDOW, STEP, BLOCK = 800, 700, 16
#: Sections that stand in for the heading tree: parent and level of each.
TREE = ((None, 0), (0, 1), (1, 2), (1, 2), (0, 1), (4, 2))

DIRS = ("src", "docs", "adr", "tests", "config", "vendor", "specs", "notes", "build", "staging", "app", "lib")
NAMES = ("guide", "spec", "adr-1", "api-lint", "readme", "makefile", "bundle.min", "main")
EXTENSIONS = (".md", ".py", ".yml", ".txt", ".rs", ".json", ".lock")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: tuple[str, ...], n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values)).cast("int") + 1)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, source_id, external_id, text, created_at, updated_at, mtime_ms, size, sensitive_override."""
    d = table(spark, sf_dir, "documents")
    n = F.col("doc_id")
    path = F.concat("source", F.lit("/"), pick(DIRS, n), F.lit("/"), pick(NAMES, n), F.lit("_"), n.cast("string"), pick(EXTENSIONS, n))
    return d.select(
        n.alias("item_id"),
        F.substring("source", 4, 10).cast("int").alias("source_id"),
        path.alias("external_id"),
        "text",
        "lang",
        F.timestamp_seconds(F.lit(1_672_531_200) + n * 3600).alias("created_at"),
        (n * 1000).alias("mtime_ms"),
        F.col("n_chars").alias("size"),
        F.when(n % 11 == 0, F.lit(True)).alias("sensitive_override"),
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, name, label, enabled, error_count: one row per source of the documents."""
    n = F.substring("source", 4, 10).cast("int")
    return (
        table(spark, sf_dir, "documents").select("source").distinct()
        .select(n.alias("source_id"), F.col("source").alias("name"), pick(LABELS, n).alias("label"), (n % 7 != 0).alias("enabled"), (n % 4).alias("error_count"))
    )


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """section_id, item_id, parent_id, level, title, path."""
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(p).cast("int").alias("parent"), F.lit(v).alias("level")) for k, (p, v) in enumerate(TREE)])
    base = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.explode(rows).alias("s"))
    first = F.col("item_id") * 10
    return base.select(
        (first + F.col("s.k")).alias("section_id"), "item_id", (first + F.col("s.parent")).alias("parent_id"), F.col("s.level").alias("level"),
        F.concat(F.lit("Part "), F.col("s.k").cast("string")).alias("title"),
        F.concat(F.lit("Doc "), F.col("item_id").cast("string"), F.lit(" > Part "), F.col("s.k").cast("string")).alias("path"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window chunks of every item (leaves), and one document summary each."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("item_id"), "text")
    last = F.greatest(F.lit(0), F.ceil((F.length("text") - WINDOW) / STEP)).cast("int")
    # by way of pieces: a window cut from a whole text counts characters from its beginning
    pieces = d.select("item_id", last.alias("last"), "text", F.explode(F.sequence(F.lit(0), last, F.lit(BLOCK))).alias("k"))
    pieces = pieces.select("item_id", "k", F.least(F.lit(BLOCK - 1), F.col("last") - F.col("k")).alias("last"), F.substring("text", F.col("k") * STEP + 1, F.lit((BLOCK - 1) * STEP + WINDOW)).alias("text"))
    windows = pieces.select("item_id", "k", "text", F.explode(F.sequence(F.lit(0), "last")).alias("j")).select("item_id", "text", "j", (F.col("k") + F.col("j")).alias("i"))
    leaf = windows.select(
        (F.col("item_id") * ITEM_SPAN + F.col("i")).alias("chunk_id"), "item_id", F.lit(None).cast("long").alias("entity_id"),
        (F.col("item_id") * 10 + F.col("i") % len(TREE)).alias("section_id"), F.when(F.col("i") % 9 == 8, "caption").otherwise("document").alias("kind"),
        F.substring(F.col("text"), F.col("j") * STEP + 1, F.lit(WINDOW)).alias("content"),
    )
    head = d.select(
        (F.col("item_id") * ITEM_SPAN + ITEM_SPAN - 1).alias("chunk_id"), "item_id", F.lit(None).cast("long").alias("entity_id"),
        F.lit(None).cast("long").alias("section_id"), F.lit("doc_summary").alias("kind"), F.substring(F.trim("text"), 1, 1200).alias("content"),
    )
    return leaf.unionByName(head).withColumn("status", status_of(F.col("chunk_id") % 13))


def status_of(n: Column) -> Column:
    return F.when(n == 0, "stale").when(n == 1, "disputed").when(n == 2, "accepted")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id, item_id, kind, record_id, title, status, owner, due, supersedes, created_at, from the labels."""
    n = F.col("doc_id")
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (n % 60).cast("int")), "yyyy-MM-dd")
    return table(spark, sf_dir, "labels").select(
        n.alias("entity_id"), n.alias("item_id"), F.when(F.col("quality") == 1, "decision").otherwise("action").alias("kind"),
        F.concat(F.lit("D"), n.cast("string")).alias("record_id"), F.concat(F.lit("Record "), n.cast("string")).alias("title"),
        pick(STATUSES, n).alias("status"), F.when(n % 3 != 0, F.concat(F.lit("owner"), (n % 5).cast("string"))).alias("owner"),
        F.when(n % 4 == 0, F.lit("soon")).when(n % 4 != 1, day).alias("due"),
        F.when(n % 6 == 0, F.concat(F.lit("D"), (n - 2).cast("string"), F.lit(", D"), (n - 4).cast("string"))).alias("supersedes"),
        F.timestamp_seconds(F.lit(1_704_067_200) + (n % 100) * 86_400).alias("created_at"),
    )


def system_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, component, level, source_id, message, detail, created_at, dismissed_at, from the events."""
    n = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        n.alias("id"), F.col("event_type").alias("component"), pick(("info", "warning", "error"), n).alias("level"),
        F.when(F.col("user_id") % 7 != 0, F.col("user_id") % 7).alias("source_id"),
        F.concat("event_type", F.lit(" failed")).alias("message"), F.col("props").alias("detail"), F.col("ts").alias("created_at"),
        F.when(n % 5 == 0, F.col("ts")).alias("dismissed_at"),
    )


#: The same tables for the SQL twins, as DuckDB common table expressions.
SQL = {
    "items": f"""items AS (SELECT doc_id AS item_id, substr(source, 4)::INTEGER AS source_id,
  source || '/' || {list(DIRS)}[doc_id % {len(DIRS)} + 1] || '/' || {list(NAMES)}[doc_id % {len(NAMES)} + 1] || '_' || doc_id || {list(EXTENSIONS)}[doc_id % {len(EXTENSIONS)} + 1] AS external_id,
  text, lang, to_timestamp(1672531200 + doc_id * 3600)::TIMESTAMP AS created_at, doc_id * 1000 AS mtime_ms, n_chars AS size,
  CASE WHEN doc_id % 11 = 0 THEN true END AS sensitive_override FROM documents)""",
    "sources": f"""sources AS (SELECT DISTINCT substr(source, 4)::INTEGER AS source_id, source AS name, {list(LABELS)}[substr(source, 4)::INTEGER % 3 + 1] AS label,
  substr(source, 4)::INTEGER % 7 <> 0 AS enabled, substr(source, 4)::INTEGER % 4 AS error_count FROM documents)""",
    "sections": """tree(k, parent, level) AS (VALUES (0, NULL, 0), (1, 0, 1), (2, 1, 2), (3, 1, 2), (4, 0, 1), (5, 4, 2)),
sections AS (SELECT doc_id * 10 + k AS section_id, doc_id AS item_id, doc_id * 10 + parent AS parent_id, level, 'Part ' || k AS title,
  'Doc ' || doc_id || ' > Part ' || k AS path FROM documents, tree)""",
    "chunks": f"""windows AS (SELECT doc_id AS item_id, text, unnest(range(0, greatest(0, ceil((length(text) - {WINDOW}) / {STEP}))::BIGINT + 1)) AS i FROM documents WHERE text IS NOT NULL),
chunks0 AS (SELECT item_id * {ITEM_SPAN} + i AS chunk_id, item_id, NULL::BIGINT AS entity_id, item_id * 10 + i % 6 AS section_id,
    CASE WHEN i % 9 = 8 THEN 'caption' ELSE 'document' END AS kind, substr(text, i * {STEP} + 1, {WINDOW}) AS content FROM windows
  UNION ALL SELECT doc_id * {ITEM_SPAN} + {ITEM_SPAN - 1}, doc_id, NULL, NULL, 'doc_summary', substr(trim(text), 1, 1200) FROM documents WHERE text IS NOT NULL),
chunks AS (SELECT *, CASE chunk_id % 13 WHEN 0 THEN 'stale' WHEN 1 THEN 'disputed' WHEN 2 THEN 'accepted' END AS status FROM chunks0)""",
    "entities": f"""entities AS (SELECT doc_id AS entity_id, doc_id AS item_id, CASE WHEN quality = 1 THEN 'decision' ELSE 'action' END AS kind,
  'D' || doc_id AS record_id, 'Record ' || doc_id AS title, {list(STATUSES)}[doc_id % 5 + 1] AS status,
  CASE WHEN doc_id % 3 <> 0 THEN 'owner' || doc_id % 5 END AS owner,
  CASE WHEN doc_id % 4 = 0 THEN 'soon' WHEN doc_id % 4 <> 1 THEN strftime(DATE '2024-01-01' + (doc_id % 60)::INTEGER, '%Y-%m-%d') END AS due,
  CASE WHEN doc_id % 6 = 0 THEN 'D' || (doc_id - 2) || ', D' || (doc_id - 4) END AS supersedes,
  to_timestamp(1704067200 + doc_id % 100 * 86400)::TIMESTAMP AS created_at FROM labels)""",
    "events": """sys AS (SELECT event_id AS id, event_type AS component, ['info', 'warning', 'error'][event_id % 3 + 1] AS level,
  CASE WHEN user_id % 7 <> 0 THEN user_id % 7 END AS source_id, event_type || ' failed' AS message, props AS detail, ts AS created_at,
  CASE WHEN event_id % 5 = 0 THEN ts END AS dismissed_at FROM events)""",
}


def with_tables(*names: str) -> str:
    """A WITH clause of the named tables, open for more."""
    return "WITH RECURSIVE " + ",\n".join(SQL[n] for n in names) + ",\n"
