"""The public interface: one object over the tables of a library."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import model
from .operators import answers, ingest, library, portability, relations, retrieval, search, trees
from .operators.index import KeywordIndex
from .sources import extract
from .storage import Scratch

#: The results that a question with a filter fetches at most, to have enough left after it.
WIDEST = 50


@dataclass(frozen=True)
class Answer:
    """mode: none, context_only, composed or agent_compose; retrieval: hybrid or keyword_only; tables by name: hits, citations, context."""

    mode: str
    retrieval: str
    text: str | None
    tables: dict[str, DataFrame]

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def __contains__(self, name: str) -> bool:
        return name in self.tables


@dataclass
class Engine:
    """Search, listings, records and ingest over DataFrames.

    now, scope and knobs are arguments; the clock and the environment are never
    read.  A search runs its legs and brings their limited results together; all
    other methods return plans.
    """

    spark: SparkSession
    items: DataFrame
    sources: DataFrame
    chunks: DataFrame
    sections: DataFrame
    entities: DataFrame
    events: DataFrame
    config: retrieval.RetrievalConfig = field(default_factory=retrieval.RetrievalConfig)
    index: KeywordIndex | None = None
    vectors: DataFrame | None = None
    relationships: DataFrame | None = None
    links: DataFrame | None = None
    vocabulary: DataFrame | None = None
    assets: DataFrame | None = None
    #: item_id of files whose text is torn.
    suspects: DataFrame | None = None
    facts: DataFrame | None = None

    @classmethod
    def over_tables(cls, spark: SparkSession, sf_dir: str, config: retrieval.RetrievalConfig | None = None) -> Engine:
        """The engine over the shared test tables."""
        made = (f(spark, sf_dir) for f in (model.items, model.sources, model.chunks, model.sections, model.entities, model.system_events))
        return cls(spark, *made, config or retrieval.RetrievalConfig())

    def with_index(self, path: str | None = None) -> Engine:
        """The engine with its keyword index, built under path (or for this session) if it has none."""
        if self.index is None:
            self.index = KeywordIndex.build(self.chunks, path or f"{Scratch(self.spark, 'index').root}/keyword")
        return self

    def with_suspects(self) -> Engine:
        """The engine with its torn files, by the words of the library's own other files; a search by sections then looks through them too."""
        if self.suspects is None:
            found = library.suspects(self.items, library.lexicon(self.items))
            self.suspects = Scratch(self.spark, "suspects").write(found, "suspects")
        return self

    def library(self) -> search.Library:
        tags = self.links.join(self.chunks.select("chunk_id", "section_id"), "chunk_id").select("name", "section_id") if self.links is not None else None
        self.with_suspects()
        if self.facts is None:
            self.facts = search.item_store(self.items, f"{Scratch(self.spark, 'items').root}/facts")
        return search.Library(self.items, self.chunks, self.sections, self.with_index().index, self.vectors, tags, self.vocabulary, self.suspects, self.facts)

    def _scoped(self, project: DataFrame | None, public_only: bool) -> tuple[DataFrame, DataFrame]:
        items = relations.public_items(self.items, self.sources) if public_only else self.items
        items = relations.source_scope(items, project)
        return items, self.chunks.join(items.select("item_id"), "item_id", "left_semi") if project is not None or public_only else self.chunks

    def search(
        self, question: str, now: str, mode: str = "hybrid", vector: list[float] | None = None, project: DataFrame | None = None, public_only: bool = False,
        prefix: str | None = None, env: str | None = None, exclude_disputed: bool = False, whole: bool = False,
    ) -> DataFrame:
        """Ranked hits.  mode: hybrid (the whole search), keyword_only or exact (document order).

        prefix and env filter the ranked hits; then more than a page is fetched
        and cut afterwards.  whole: with what is returned for each hit.
        """
        items, chunks = self._scoped(project, public_only)
        if prefix:
            items = relations.path_prefix(items, prefix)
            chunks = chunks.join(items.select("item_id"), "item_id", "left_semi")
        scope = items.select("item_id", "source_id") if project is not None or public_only or prefix else None
        filtered = env in ("live", "test")
        c = retrieval.RetrievalConfig(**{**self.config.__dict__, "top_k": min(max(self.config.top_k * 5, self.config.top_k), WIDEST)}) if filtered else self.config
        at = F.lit(now).cast("timestamp")
        if mode == "exact":
            return retrieval.exact_leg(chunks, question, self.config.top_k)
        if mode == "keyword_only":
            legs = [("keyword", retrieval.keyword_leg(self.with_index().index, question, c.top_k * 10, c, scope=scope), 1.0)]
            hits = retrieval.fuse_and_rank(legs, chunks, items, at, c, exclude_disputed=exclude_disputed)
        elif mode == "hybrid":
            hits = search.search(self.library(), question, at, c, vector, scope, exclude_disputed, whole)
        else:
            raise ValueError(f"unknown mode: {mode!r}")
        if not filtered:
            return hits
        kept = hits.where(F.col("env") == env).orderBy("rank").limit(self.config.top_k)
        return kept.withColumn("rank", F.row_number().over(search.Window.partitionBy(F.lit(0)).orderBy("rank")))

    def context(self, hits: DataFrame) -> DataFrame:
        """Numbered windows of hits for a model, within the budget."""
        return answers.answer_context(hits if "content" in hits.columns else hits.join(self.chunks.select("chunk_id", "content"), "chunk_id"))

    def ask(self, question: str, now: str, mode: str = "context_only", compose: Callable[[str, list[str]], str | None] | None = None, **scope) -> Answer:
        """What is found for a question, and the answer where there is one.

        mode: context_only, or agent_compose where the caller composes from
        citations alone.  compose: writes an answer from the question and the
        windows of the context; with it the mode becomes composed, unless it
        returns None.  Without hits the mode is none, and nothing else is there.
        """
        if mode not in ("context_only", "agent_compose"):
            raise ValueError(f"unknown mode: {mode!r}")
        hits = self.search(question, now, whole=True, **scope)
        retrieval_mode = "hybrid" if self.vectors is not None and scope.get("vector") is not None else scope.get("mode", "keyword_only")
        if hits.isEmpty():
            return Answer("none", retrieval_mode, answers.NOTHING_FOUND, {"hits": hits})
        found = {"hits": hits, "citations": self.citations(hits, question)}
        if mode == "agent_compose":
            return Answer(mode, retrieval_mode, None, found)
        found["context"] = self.context(hits)
        text = compose(question, [r["window"] for r in found["context"].orderBy("rank").collect()]) if compose else None  # within the budget of the context
        return Answer("context_only" if text is None else "composed", retrieval_mode, text, found)

    def citations(self, hits: DataFrame, question: str) -> DataFrame:
        none = self.spark.createDataFrame([], "from_id long, to_id long, kind string")
        hits = hits if "parent_section" not in hits.columns else hits.withColumn("section_id", F.coalesce("parent_section", "section_id"))
        return answers.citations(hits, question, self.items, self.sections, self.entities, self.relationships if self.relationships is not None else none, self.links, self.assets)

    def node(self, section_id: int, most: int = 32_000) -> DataFrame:
        """body, total and truncated of one section's subtree."""
        own = self.sections.join(self.sections.where(F.col("section_id") == section_id).select("item_id"), "item_id", "left_semi")
        ways = trees.Tree.of(own).below(section_id).withColumn("ancestor", F.lit(section_id))
        return trees.node_texts(ways, self.chunks, relations.clamp(most, 1, 1_000_000, 32_000))

    def node_links(self, section_id: int) -> DataFrame:
        own = self.sections.join(self.sections.where(F.col("section_id") == section_id).select("item_id"), "item_id", "left_semi")
        return relations.node_links(own).where(F.col("section_id") == section_id)

    def section_list(self, depth: int | None = None, item_id: int | None = None) -> DataFrame:
        rows = self.sections if item_id is None else self.sections.where(F.col("item_id") == item_id)
        return (rows if depth is None else rows.where(F.col("level") <= depth)).orderBy("level", "section_id")

    def section_chunks(self, section_id: int) -> DataFrame:
        return self.chunks.where(F.col("section_id") == section_id).orderBy("chunk_id")

    def tag_list(self) -> DataFrame:
        return self.links.groupBy("name").agg(F.count("*").alias("usage")).orderBy(F.desc("usage"), "name")

    def tag_chunks(self, name: str) -> DataFrame:
        return self.links.where(F.col("name") == name).join(self.chunks, "chunk_id").orderBy("chunk_id")

    def entity_list(self, kind: str | None = None, status: str | None = None, limit: int | None = None) -> DataFrame:
        rows = self.entities
        for column, value in (("kind", kind), ("status", status)):
            rows = rows if value is None else rows.where(F.col(column) == value)
        return rows.orderBy(F.desc("created_at"), "entity_id").limit(relations.clamp(limit, 1, 2000, 500))

    def related(self, entity_id: int) -> DataFrame:
        return relations.related(self.entities, self.relationships).where(F.col("entity_id") == entity_id)

    def dispute(self, disputes: DataFrame) -> DataFrame:
        """The entities after disputes (entity_id)."""
        return relations.dispute(self.entities, disputes)

    def import_bundle(self, tables: dict[str, DataFrame], path: str, replace: bool = False, dry_run: bool = False) -> portability.Imported:
        """tables after the import of a bundle that ``portability.write_bundle`` wrote, and what it changed."""
        return portability.import_lines(self.spark, tables, portability.read_bundle(self.spark, path), replace, dry_run)

    def import_items(self, incoming: DataFrame, stamp: str = "created_at") -> DataFrame:
        """The items after an import: by id, the later stamp wins."""
        return relations.merge_last_writer(self.items, incoming, "item_id", stamp)

    def set_project(self, current: DataFrame, project: int, wanted: DataFrame) -> DataFrame:
        """current with the project's sources replaced; an unknown id refuses the whole change."""
        unknown = [r["source_id"] for r in library.unknown_sources(wanted, self.sources).limit(20).collect()]
        if unknown:
            raise ValueError(f"unknown sources: {unknown}")
        return library.set_project_sources(current, project, wanted, self.sources)

    def decisions(self, public_only: bool = False, limit: int | None = None) -> DataFrame:
        rows = self._records("decision", public_only).join(relations.supersession(self.entities).select("entity_id", "superseded_by"), "entity_id")
        return rows.orderBy(F.desc("created_at"), F.desc("entity_id")).limit(relations.clamp(limit, 1, 500, 100))

    def actions(self, public_only: bool = False, overdue_on: str | None = None, limit: int | None = None) -> DataFrame:
        rows = self._records("action", public_only)
        rows = rows.where(relations.overdue(F.col("due"), overdue_on)) if overdue_on else rows
        return rows.orderBy(*relations.action_order(rows)).limit(relations.clamp(limit, 1, 500, 100))

    def _records(self, kind: str, public_only: bool) -> DataFrame:
        items, _ = self._scoped(None, public_only)
        return relations.records(self.entities.where(F.col("kind") == kind), items, self.sources)

    def list_items(self, prefix: str | None = None, public_only: bool = False, limit: int | None = None, offset: int = 0) -> DataFrame:
        items, _ = self._scoped(None, public_only)
        items = relations.path_prefix(items, prefix) if prefix else items
        return relations.page(items.select("item_id", "external_id"), [F.col("external_id"), F.col("item_id")], relations.clamp(limit, 1, 500, 100), offset)

    def outline(self, item_id: int, depth: int = 3) -> DataFrame:
        own = self.sections.where((F.col("item_id") == item_id) & (F.col("level") <= depth))
        return relations.section_sizes(own, self.chunks.where(F.col("item_id") == item_id)).orderBy("level", "section_id")

    def event_groups(self, limit: int | None = None) -> DataFrame:
        return relations.folded_events(self.events).orderBy(F.desc("last_seen"), F.desc("last_id")).limit(relations.clamp(limit, 1, 200, 50))

    def event_facets(self, filters: dict[str, str] | None = None) -> DataFrame:
        return relations.facets(self.events, filters or {})

    def ingest(self, root: str, source_id: int, state: ingest.Library | None = None, pattern: str = "*") -> ingest.Ingested:
        """The library after the files under root came in, as source_id: sections, chunks, summaries, tags, records and vocabulary of what changed since state."""
        listed = extract.folder(self.spark, root, pattern)
        read = Scratch(self.spark, "read").write(extract.extracted(listed), "files")
        facts = listed.select("path", F.col("rel").alias("external_id"), "mtime_ms", "size")
        broken = read.where("error IS NOT NULL").join(facts, "path").select("external_id")
        files = read.where("error IS NULL").join(facts, "path").select("external_id", "text", "mtime_ms", "size")
        return ingest.ingest(self.spark, files, state or ingest.Library.empty(self.spark), source_id, protected=broken)

    def entity(self, entity_id: int) -> DataFrame:
        """One entity, or no row."""
        return self.entities.where(F.col("entity_id") == entity_id)

    def export(self) -> DataFrame:
        """Typed JSON lines of items, sections and entities."""
        return relations.export_lines({"item": self.items.drop("text"), "section": self.sections, "entity": self.entities})
