"""From files to a library in one call: what changed, sections, chunks, summaries, tags, records and vocabulary.

A call works on the items that are new, changed or made by older rules, and
leaves all other rows as they are.  Its result is the whole library after it,
as plans over stored tables; nothing is half done if it fails, as an item's
``processed_hash`` comes with its rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import document_summary, page_crumb, section_summary
from ..storage import Scratch, small_side
from . import relations, structure

__all__ = ["document_summary", "page_crumb", "section_summary"]

#: Ids that an item has for its sections and for its chunks; summaries of sections stand in the upper half.
ROOM = 1 << 24
#: Rules that chunks are made by; items of older ones are made anew.
CHUNKER = 3
#: Names of due files that are sent to all, in bytes; they take about three times that in memory.
NAMES_BYTES = 16 << 20
# Fixed values, equal to those of the service whose results are matched.
CLASSIFY_WINDOW, CLASSIFY_STEP = 16_000, 8000
TERM_CHARS, EXPANSION_CHARS = (2, 40), (2, 120)

ITEMS = "item_id long, source_id int, external_id string, text string, mtime_ms long, size long, extractor int, content_hash string, processed_hash string, chunker_version int"
SECTIONS = "section_id long, item_id long, parent_id long, title string, path string, level int, first_line int, last_line int"
CHUNKS = "chunk_id long, item_id long, entity_id long, section_id long, kind string, status string, path string, content string"
LINKS = "chunk_id long, tag string"
ENTITIES = "item_id long, kind string, title string, record_id string, status string, owner string, due string, supersedes array<string>, done boolean"
VOCABULARY = "item_id long, term string, expansion string, origin string"


@dataclass(frozen=True)
class Library:
    """The tables that ingest keeps; see the schemas above."""

    items: DataFrame
    sections: DataFrame
    chunks: DataFrame
    links: DataFrame
    entities: DataFrame
    vocabulary: DataFrame

    @staticmethod
    def empty(spark: SparkSession) -> Library:
        return Library(*[spark.createDataFrame([], s) for s in (ITEMS, SECTIONS, CHUNKS, LINKS, ENTITIES, VOCABULARY)])

    def stored(self, scratch: Scratch, label: str) -> Library:
        return Library(**{k: scratch.write(v, f"{label}-{k}") for k, v in self.__dict__.items()})


@dataclass(frozen=True)
class Ingested:
    """library after the call, and report: action (insert, update, skip, purge) and n."""

    library: Library
    report: DataFrame


# ---- what the steps are made of ----------------------------------------------------


def classify_windows(docs: DataFrame, key: str, text: str = "text", window: int = CLASSIFY_WINDOW, step: int = CLASSIFY_STEP) -> DataFrame:
    """key, idx, window and hash: overlapping windows of a text, for a classifier and for telling which of them changed."""
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - window) / step)).cast("int")
    cut = docs.where(F.col(text).isNotNull()).select(key, F.col(text).alias("_text"), F.explode(F.sequence(F.lit(0), last)).alias("idx"))
    part = F.substring(F.col("_text"), F.col("idx") * step + 1, F.lit(window))
    return cut.select(key, "idx", part.alias("window"), F.sha2(part, 256).alias("hash"))


def valid_pairs(pairs: DataFrame) -> DataFrame:
    """pairs with term and expansion trimmed and in lower case, of 2 to 40 and 2 to 120 characters, and not alike."""
    made = pairs.withColumns({"term": F.lower(F.trim("term")), "expansion": F.lower(F.trim("expansion"))})
    return made.where(F.length("term").between(*TERM_CHARS) & F.length("expansion").between(*EXPANSION_CHARS) & (F.col("term") != F.col("expansion")))


def cursor(rows: DataFrame, by: list[str], updated: Column) -> DataFrame:
    """The last update per group, as text that sorts as time does: where the next fetch begins."""
    return rows.groupBy(*by).agg(F.max(updated).alias("cursor"))


# ---- the call ------------------------------------------------------------------------


def _first() -> Column:
    """The first id of an item's room."""
    return F.col("item_id") * ROOM


def _head() -> Column:
    """The id of the summary of a section, or of a whole text, that has one."""
    return F.when(F.col("summary").isNotNull(), F.coalesce(_first() + F.col("section") + ROOM // 2, _first() + ROOM - 1))


def _sections(read: DataFrame) -> DataFrame:
    own = read.where("section IS NOT NULL")
    return own.select((_first() + F.col("section")).alias("section_id"), "item_id", (_first() + F.col("parent")).alias("parent_id"), "title", "path", "level", "first_line", "last_line")


def _chunks(read: DataFrame) -> DataFrame:
    """Leaves, and summary chunks of titled sections below the root with text and of every text."""
    whole = F.col("section").isNull()
    leaves = F.transform("leaves", lambda c: F.struct((_first() + c["at"]).alias("chunk_id"), F.lit("document").alias("kind"), c["path"].alias("path"), c["content"].alias("content")))
    head = F.struct(_head().alias("chunk_id"), F.when(whole, "doc_summary").otherwise("section_summary").alias("kind"), F.col("path"), F.col("summary").alias("content"))
    each = read.select("item_id", "section", F.explode(F.filter(F.concat(leaves, F.array(head)), lambda c: c["chunk_id"].isNotNull())).alias("c"))
    return each.select(
        "c.chunk_id", "item_id", F.lit(None).cast("long").alias("entity_id"), (_first() + F.col("section")).alias("section_id"),
        "c.kind", F.lit(None).cast("string").alias("status"), "c.path", "c.content",
    )


def _links(read: DataFrame) -> DataFrame:
    """chunk_id and tag: those of a section for its chunks, those of a whole text for its summary."""
    ids = F.array_compact(F.concat(F.transform("leaves.at", lambda n: _first() + n), F.array(_head())))
    return read.select("tags", F.explode(ids).alias("chunk_id")).select("chunk_id", F.explode("tags").alias("tag"))


def ingest(spark: SparkSession, listing: DataFrame, state: Library, source_id: int, extractor: int = 2, connector: str = "folder", protected: DataFrame | None = None) -> Ingested:
    """The library after a source's files (external_id, text, mtime_ms, size) came in.

    listing: all files of the source.  Those with the time, size and extractor
    that are stored are not looked at; of the others those with the hash that
    was processed, and of an up-to-date chunker, keep their rows.  Stored items
    of the source that are not listed go (protected: external_id of files that
    could not be read, which stay).  Null and blank texts give an item without
    sections; a file listed twice counts once (the later one).  At most one item
    is in a task at a time, and one item's sections are one row each.  A text is
    dealt once, by its file's name; all that is made from it is made where it
    is, and is stored once.
    """
    scratch = Scratch(spark, "ingest")
    last = Window.partitionBy("external_id").orderBy(F.desc("mtime_ms"), F.desc("size"))
    latest = lambda df: df.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    times = scratch.write(latest(listing.select("external_id", "mtime_ms", "size")), "times")
    mine = state.items.where(F.col("source_id") == source_id)
    current = mine.where((F.col("extractor") >= extractor) & (F.col("chunker_version") >= CHUNKER))
    due = scratch.write(relations.to_extract(times, current, extractor).select("external_id"), "due")
    none = spark.createDataFrame([], "external_id string")
    gone = scratch.write(relations.purge(mine, times, none if protected is None else protected, connector).select("item_id"), "gone")

    top = state.items.agg(F.coalesce(F.max("item_id"), F.lit(0))).first()[0]
    new = relations.numbers(due.join(mine.select("external_id"), "external_id", "left_anti"), "external_id").select("external_id", (F.lit(top) + F.col("n")).alias("_new"))
    ids = due.join(mine.select("external_id", "item_id", (F.col("chunker_version") < CHUNKER).alias("_old")), "external_id", "left").join(new, "external_id", "left")
    ids = scratch.write(ids.select("external_id", F.coalesce("item_id", "_new").alias("item_id"), "_old"), "ids")
    # texts are dealt once, by external_id; files that are not due are left out before, where the names of those that are can be sent to all
    found = listing.select("external_id", "text", "mtime_ms", "size")
    if due.count() < times.count() and (side := small_side(due, NAMES_BYTES)) is not due:
        found = found.join(side, "external_id", "left_semi")
    files = latest(found)
    told = relations.upsert(files, mine).join(ids, "external_id")
    told = told.withColumn("action", F.when(F.col("_old") & (F.col("action") == "skip"), "update").otherwise(F.col("action")))
    fixed = {"source_id": F.lit(source_id), "extractor": F.lit(extractor), "processed_hash": F.col("content_hash"), "chunker_version": F.lit(CHUNKER), "text": F.when(F.col("action") != "skip", F.col("text"))}
    fresh = scratch.write(told.withColumns(fixed).select(*state.items.columns, "action"), "fresh")
    items = fresh.where("action <> 'skip'").select(*state.items.columns)

    read = scratch.write(structure.structured(items.where(F.trim("text") != ""), "item_id", "external_id"), "parsed")
    sections, chunks, links = scratch.write(_sections(read), "sections"), scratch.write(_chunks(read), "chunks"), scratch.write(_links(read), "links")
    of_texts = read.where("section IS NULL")
    entities = scratch.write(of_texts.select("item_id", F.inline("records")).select(*state.entities.columns), "entities")
    pairs = valid_pairs(of_texts.select("item_id", F.inline("pairs"))).groupBy("item_id", "term", "expansion").agg(F.min("origin").alias("origin"))
    vocabulary = scratch.write(pairs.select(*state.vocabulary.columns), "vocabulary")
    scratch.drop("parsed")

    # what is new is stored as it is, and of the state what stays
    left = small_side(scratch.write(items.select("item_id").unionByName(gone), "left"))
    # files that were skipped keep their rows, but their new time and size
    seen = small_side(scratch.write(fresh.where("action = 'skip'").select("item_id", F.col("mtime_ms").alias("_m"), F.col("size").alias("_s")), "seen"))
    kept = state.items.join(left, "item_id", "left_anti").join(seen, "item_id", "left")
    kept = kept.withColumns({"mtime_ms": F.coalesce("_m", "mtime_ms"), "size": F.coalesce("_s", "size"), "extractor": F.when(F.col("_m").isNotNull(), extractor).otherwise(F.col("extractor"))}).select(*state.items.columns)
    old_links = state.links.join(state.chunks.select("chunk_id", "item_id").join(left, "item_id", "left_anti"), "chunk_id").select("chunk_id", "tag")
    stay = lambda df: df.join(left, "item_id", "left_anti").select(*df.columns)
    old = Library(kept, stay(state.sections), stay(state.chunks), old_links, stay(state.entities), stay(state.vocabulary)).stored(scratch, "kept")
    made = Library(items, sections, chunks, links, entities, vocabulary)
    after = Library(**{k: v.unionByName(made.__dict__[k]) for k, v in old.__dict__.items()})
    untouched = times.join(fresh.select("external_id"), "external_id", "left_anti").select(F.lit("skip").alias("action"))
    report = fresh.select("action").unionByName(untouched).unionByName(gone.select(F.lit("purge").alias("action"))).groupBy("action").agg(F.count("*").alias("n"))
    return Ingested(after, scratch.write(report, "report"))
