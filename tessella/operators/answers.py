"""What an answer cites, and the text a model is given."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fx
from . import relations
from .search import content_window, without_marks

#: Citations of an answer.
CITED = 5


#: The answer where nothing is found; a fixed value.
NOTHING_FOUND = "No relevant knowledge found yet. Ingest sources first."


def conflicts(chunks: DataFrame, entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """chunk_id and conflicts_with: sorted ids of what contradicts the chunk's entity, or live entities of its item; stale ones do not count."""
    live = entities.where("status IS NULL OR status <> 'stale'").select("entity_id", "item_id")
    own = chunks.where("entity_id IS NOT NULL").select("chunk_id", "entity_id").join(live.select("entity_id"), "entity_id", "left_semi")
    of_item = chunks.where("entity_id IS NULL").select("chunk_id", "item_id").join(live, "item_id").select("entity_id", "chunk_id")
    base = relationships.where("kind = 'conflicts_with'")
    pairs = relations.related(live, base).select("entity_id", "other_id")
    met = own.select("entity_id", "chunk_id").unionByName(of_item).join(pairs, "entity_id")
    return met.groupBy("chunk_id").agg(F.sort_array(F.collect_set("other_id")).alias("conflicts_with"))


def citations(
    hits: DataFrame, question: str, items: DataFrame, sections: DataFrame, entities: DataFrame, relationships: DataFrame, links: DataFrame | None = None, assets: DataFrame | None = None, most: int = CITED
) -> DataFrame:
    """The first hits as citations: place and file, breadcrumb, tags, environment, previews, contradictions and images.

    hits: rank, chunk_id, item_id, section_id, score, env, content and the rest
    of a search with what it returns.  links: chunk_id, name; assets: asset_id,
    section_id.  The path is the breadcrumb, or the file's path without one.
    """
    top = F.broadcast(hits.orderBy("rank").limit(most))
    meta = items.select("item_id", F.col("external_id").alias("item_path"), *(["doc_type"] if "doc_type" in items.columns and "doc_type" not in hits.columns else []))
    out = top.join(meta, "item_id", "left").join(sections.select("section_id", F.col("path").alias("breadcrumb")), "section_id", "left")
    kept = top.select("chunk_id", "item_id", F.col("entity_id") if "entity_id" in hits.columns else F.lit(None).cast("long").alias("entity_id"))
    out = out.join(conflicts(kept, entities, relationships), "chunk_id", "left")
    if links is not None:
        tags = links.join(top.select("chunk_id"), "chunk_id", "left_semi").groupBy("chunk_id").agg(F.sort_array(F.collect_set("name")).alias("tags"))
        out = out.join(tags, "chunk_id", "left")
    if assets is not None:
        images = assets.join(top.select("section_id").distinct(), "section_id", "left_semi").groupBy("section_id").agg(F.sort_array(F.collect_set("asset_id")).alias("images"))
        out = out.join(images, "section_id", "left")

    def preview(n: int):
        return F.coalesce(content_window(F.col("content"), F.col("chunk_id"), n), fx.snippet(F.col("content"), fx.query_terms(question), n))

    empty = F.array().cast("array<string>")
    shown = {
        "breadcrumb": F.coalesce("breadcrumb", F.lit("")), "path": F.coalesce("breadcrumb", "item_path", F.lit("")), "summary": preview(200), "snippet": preview(500),
        "conflicts_with": F.coalesce("conflicts_with", F.array().cast("array<bigint>")), "tags": F.coalesce("tags", empty) if links is not None else empty,
    }
    return out.withColumns(shown).orderBy("rank")


def answer_context(hits: DataFrame, per_hit: int = 2000, budget: int = 24_000) -> DataFrame:
    """Windows of at most per_hit characters around each match, marks taken out, in rank order, numbered [S1].., until the budget is used."""
    run = Window.partitionBy(F.lit(0)).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)  # a page of hits
    window = without_marks(F.coalesce(content_window(F.col("content"), F.col("chunk_id"), per_hit), F.substring("content", 1, per_hit)))
    cut = hits.withColumn("window", window).withColumn("_sum", F.sum(F.length("window")).over(run))
    return cut.where(F.col("_sum") <= budget).select("rank", "chunk_id", F.concat(F.lit("[S"), F.col("rank").cast("string"), F.lit("]")).alias("mark"), F.length("window").alias("chars"), "window")
