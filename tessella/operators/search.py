"""The whole of ranked search: legs, fusion, slots, boost, what is returned, gate.

A leg is a Spark job over the library that ends in a limit.  What the limits
leave (a few hundred rows) is fused, ordered and cut as small local tables, and
the library is read again for those candidates only, by their ids.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fx
from ..model import LEAF_KINDS, SUMMARY_KINDS
from ..storage import Scratch, local
from . import library as lb
from . import retrieval as rt
from . import trees
from .cells import VectorIndex
from .index import KeywordIndex

#: Vocabulary pairs that a question looks at.
PAIRS = 64


@dataclass(frozen=True)
class Library:
    """What a search reads.

    vectors: chunk_id, item_id, section_id, kind, status, embedding, or an index of them; tags: name,
    section_id; vocabulary: id, term, expansion, origin, status, source_id;
    suspects: item_id of files whose text is torn, which the fence of a search
    by sections does not keep out, as their summaries tell little; facts: the
    items as ``item_store`` keeps them.  Texts of chunks come from the index.
    """

    items: DataFrame
    chunks: DataFrame
    sections: DataFrame
    index: KeywordIndex
    vectors: DataFrame | VectorIndex | None = None
    tags: DataFrame | None = None
    vocabulary: DataFrame | None = None
    suspects: DataFrame | None = None
    facts: DataFrame | None = None

    def items_of(self, ids: list[int]) -> DataFrame:
        """A few items: from the stored facts (row groups with their ids only), or else from the items."""
        return (self.items if self.facts is None else self.facts).where(F.col("item_id").isin(ids))


def item_store(items: DataFrame, path: str) -> DataFrame:
    """What searches ask of items (item_id, external_id, created_at, env, tier and doc_type where there is one), stored by item_id.

    Paths and heads of texts are classified once, here.
    """
    facts = {"env": fx.env_class(F.col("external_id"), F.col("text")), "tier": fx.authority_tier(F.col("external_id"))}
    kind = ["doc_type"] if "doc_type" in items.columns else []
    rows = items.withColumns(facts).select("item_id", "external_id", "created_at", "env", "tier", *kind)
    rows.repartitionByRange("item_id").sortWithinPartitions("item_id").write.option("parquet.block.size", 4 << 20).parquet(path)
    return items.sparkSession.read.parquet(path)


def expansions(vocabulary: DataFrame, terms: list[str], scope: DataFrame | None = None, rules: bool = True) -> DataFrame:
    """rule, id and word: what the first 64 active pairs (rules last, then by id) add to a question's terms.

    A term brings its expansion, an expansion its term, and the words of an
    expansion, if the question has them all, its term.  scope: source ids; pairs
    without a source always count.
    """
    pairs = vocabulary.where("status = 'active'")
    pairs = pairs if rules else pairs.where("origin <> 'rule'")
    if scope is not None:
        known = scope.select("source_id").distinct().withColumn("_in", F.lit(True))
        pairs = pairs.join(known, "source_id", "left").where("source_id IS NULL OR _in")
    pairs = pairs.withColumn("_rule", F.col("origin") == "rule").orderBy("_rule", "id").limit(PAIRS)
    asked = F.array(*[F.lit(t) for t in terms]).cast("array<string>")
    words = fx.terms_column(F.col("expansion"))
    whole = (F.size(words) > 0) & (F.size(F.array_except(words, asked)) == 0)
    word = F.when(F.array_contains(asked, F.col("term")), F.col("expansion")).when(F.array_contains(asked, F.col("expansion")) | whole, F.col("term"))
    return pairs.select("_rule", "id", word.alias("word")).where("word IS NOT NULL").groupBy("word").agg(F.min(F.struct("_rule", "id")).alias("_at")).select(F.col("_at._rule").alias("rule"), F.col("_at.id").alias("id"), "word")


def tagged_sections(tags: DataFrame, question: str) -> DataFrame:
    """section_id of the sections with a tag (name, section_id) that equals a word of the question, of three bytes or more."""
    import regex

    words = sorted({w for w in regex.findall(r"[\p{L}\p{N}]+", question.lower()) if len(w.encode()) >= 3})
    return tags.where(F.col("name").isin(words) & F.col("section_id").isNotNull()).select("section_id").distinct()


def names_environment(question: str) -> bool:
    """Whether the question itself speaks of tests: then live does not go first."""
    import regex

    return bool(set(regex.split(r"[^\p{L}\p{N}]+", question.lower())) & set(fx.TEST_MARKERS))


def content_window(content: Column, chunk_id: Column, n: int) -> Column:
    """n characters around the mark of a match, with ellipses where it is cut; null without a mark."""
    mark, size = F.concat(F.lit("[match "), chunk_id.cast("string"), F.lit("]")), F.length(content)
    at = F.instr(content, mark) - 1
    end = F.least(F.greatest(F.lit(0), at - n // 2) + n, size)
    start = F.greatest(F.lit(0), end - n)
    cut = F.concat(F.when(start > 0, "…").otherwise(""), F.substring(content, (start + 1).cast("int"), F.lit(n)), F.when(end < size, "…").otherwise(""))
    return F.when(F.lit(n == 0), F.lit("")).when(at >= 0, F.when(size <= n, content).otherwise(cut))


def without_marks(content: Column) -> Column:
    """content without its lines of match marks."""
    return F.array_join(F.filter(F.split(content, "\n"), lambda v: ~F.trim(v).rlike(r"^\[/?match [0-9]+\]$")), "\n")


class Search:
    """One question over a library; see ``search``."""

    def __init__(self, lib: Library, question: str, now: Column, c: rt.RetrievalConfig, vector: list[float] | None, scope: DataFrame | None, exclude_disputed: bool):
        self.lib, self.question, self.now, self.c, self.vector, self.scope, self.exclude = lib, question, now, c, vector, scope, exclude_disputed
        self.live_first = not names_environment(question)
        self.tiers = not lb.filename_tokens(question)
        self.extra: tuple[str, ...] = ()
        if lib.vocabulary is not None:
            found = expansions(lib.vocabulary, fx.query_terms(question), scope).orderBy("rule", "id").collect()  # 64 pairs at most
            self.extra = tuple(r["word"] for r in found)
        self.stats = rt.keyword_stats(lib.index, question, self.extra) if rt.phrases_of(question, self.extra) else None  # all legs share it

    def keyword(self, limit: int, kinds: tuple[str, ...] = LEAF_KINDS, fence: DataFrame | None = None) -> DataFrame:
        def narrow(rows: DataFrame) -> DataFrame:  # postings, before they are brought together
            rows = rt.status_filter(rows, self.exclude)
            return rows if fence is None else self.fenced(rows, fence)

        rows = rt.keyword_scores(self.lib.index, self.question, self.c, kinds, self.extra, self.scope, self.stats, narrow)
        return local(rows.orderBy(F.desc("score"), "chunk_id").limit(limit))

    def fenced(self, rows: DataFrame, fence: DataFrame) -> DataFrame:
        """rows in the sections of the fence (ten), or of suspect items."""
        inside = rows.join(F.broadcast(fence.select("section_id", F.lit(True).alias("_in"))), "section_id", "left")
        kept = F.col("_in")
        if self.lib.suspects is not None:
            inside = inside.join(self.lib.suspects.select("item_id", F.lit(True).alias("_torn")).distinct(), "item_id", "left")
            kept = F.coalesce("_in", "_torn")
        return inside.where(kept).select(*rows.columns)

    def by_vector(self, limit: int, kinds: tuple[str, ...] = LEAF_KINDS, fence: DataFrame | None = None) -> DataFrame | None:
        """The vector leg, or None where there is no vector to ask with or nothing is near."""
        if self.vector is None or self.lib.vectors is None:
            return None

        def narrow(rows: DataFrame) -> DataFrame:
            rows = rt.status_filter(rows.where(F.col("kind").isin(*kinds)), self.exclude)
            rows = rows if self.scope is None else rows.join(self.scope.select("item_id").distinct(), "item_id", "left_semi").select(*rows.columns)
            return rows if fence is None else self.fenced(rows, fence)

        if isinstance(self.lib.vectors, VectorIndex):
            found = self.lib.vectors.near(self.vector, limit, self.c.cosine_floor, narrow=narrow)
        else:
            found = local(rt.vector_leg(narrow(self.lib.vectors), self.vector, limit, self.c.cosine_floor, key="chunk_id").drop("embedding"))
        return None if found.isEmpty() else found

    def sections_first(self) -> DataFrame | None:
        """Leaves of the sections that the best summaries admit, or None where there are none."""
        c, wide = self.c, self.c.top_k * 10
        summaries = self.by_vector(rt.SUMMARIES, SUMMARY_KINDS)
        summaries = self.keyword(rt.SUMMARIES, SUMMARY_KINDS) if summaries is None else summaries
        if summaries.isEmpty():
            return None
        ids = [r["item_id"] for r in summaries.select("item_id").distinct().collect()]
        sections = self.lib.sections.where(F.col("item_id").isin(ids))
        if self.lib.tags is not None:
            tagged = tagged_sections(self.lib.tags, self.question)
            if not tagged.isEmpty():
                sections = sections.join(tagged, "section_id", "left_semi").select(*sections.columns)
        facts = rt.item_facts(summaries, self.lib.items_of(ids))
        fence = local(rt.toc_fence(facts.withColumn("test", F.lit(self.live_first) & (F.col("env") == "test")), sections))
        if fence.isEmpty():
            return None
        leaves, near = self.keyword(wide, fence=fence), self.by_vector(wide, fence=fence)
        legs = [*([("vector", near, 1.0)] if near is not None else []), *([("keyword", leaves, 1.0)] if not leaves.isEmpty() else [])]
        return rt.fuse(legs, c).orderBy(F.desc("score"), "chunk_id").limit(c.top_k * 5) if legs else None

    def candidates(self, legs: list[tuple[str, DataFrame, float]]) -> DataFrame:
        """All fused candidates in their order, with rank."""
        seen = {r["chunk_id"]: r["item_id"] for _, df, _ in legs for r in df.select("chunk_id", "item_id").collect()}  # what limits have left
        ids = sorted(set(seen.values()))
        chunks, items = self.lib.index.texts_of(ids, sorted(seen)), self.lib.items_of(ids)
        ranked = rt.fuse_and_rank(legs, chunks, items, self.now, self.c, self.live_first, self.tiers, self.exclude, cut=False)
        types = items.select("item_id", F.nullif("doc_type", F.lit(""))) if "doc_type" in items.columns else items.select("item_id", F.lit(None).cast("string"))
        return local(ranked.join(types.toDF("item_id", "doc_type"), "item_id", "left"))

    def admitted(self, page: DataFrame, more: DataFrame) -> DataFrame:
        """The page with more at its end and as many of its own evicted as it gets too long, in order again."""
        n = more.count()
        if not n:
            return page
        kept = lb.evict(page, max(0, page.count() + n - self.c.top_k))
        last = Window.partitionBy(F.lit(0)).orderBy("rank")
        both = kept.unionByName(more.withColumn("rank", F.row_number().over(last) + 1_000_000))
        order = [x for x in rt.page_order(self.live_first, self.tiers)[:-2]]
        return local(both.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order, "rank"))))

    def page(self) -> DataFrame:
        c, wide = self.c, self.c.top_k * 10
        with ThreadPoolExecutor(3) as pool:  # jobs that do not wait for each other
            legs_of = [pool.submit(f, *a) for f, *a in ((self.sections_first,), (self.keyword, wide), (self.by_vector, wide))]
            first, floor, near = (x.result() for x in legs_of)
        if first is not None:
            legs = [("toc", local(first), 1.0), *([("vector", near, 0.5)] if near is not None else []), *([("keyword", floor, 0.5)] if not floor.isEmpty() else [])]
        else:
            legs = [*([("vector", near, 1.0)] if near is not None else []), *([("keyword", floor, c.keyword_weight)] if not floor.isEmpty() else [])]
        if not legs:
            legs = [("keyword", floor, c.keyword_weight)]
        every = self.candidates(legs)
        page = local(every.where(F.col("rank") <= c.top_k))
        page = self.admitted(page, rt.type_slots(every, c.top_k, c.type_slots))
        return self.admitted(page, self.missing(page, floor)) if first is not None else page

    def missing(self, page: DataFrame, floor: DataFrame) -> DataFrame:
        """The keyword hits that the page lacks, in its columns, decayed."""
        slots = rt.keyword_slots(page, floor, self.c).join(rt._told(floor, "keyword", self.c).drop("score", "item_id"), "chunk_id")
        ids = [r["item_id"] for r in slots.select("item_id").distinct().collect()]
        facts = rt.item_facts(slots, self.lib.items_of(ids))
        score = F.round(F.col("score") * rt.age_decay(F.col("created_at"), self.now, self.c), 9)
        facts = facts.withColumns({"score": score, "legs": F.lit("keyword"), "rank": F.col("leg_rank"), "doc_type": F.lit(None).cast("string")})
        return local(facts.select(*page.columns))

    def boosted(self, page: DataFrame) -> DataFrame:
        """The page with the mark boosted, and on top a leaf of each file that the question names."""
        if self.tiers:
            return page.withColumn("boosted", F.lit(False))
        items = self.lib.items if self.scope is None else self.lib.items.join(self.scope.select("item_id").distinct(), "item_id", "left_semi")
        named = local(lb.named_items(items, self.question))
        ids = [r["item_id"] for r in named.collect()]
        own = self.lib.index.texts_of(ids)
        marks = lb.boosted(page.select("chunk_id", "item_id", "score"), named, own, self.question, self.lib.index, self.extra).where("boosted")
        up = rt.status_filter(marks.join(own.select("chunk_id", "section_id", "status"), "chunk_id"), self.exclude)
        up = rt.item_facts(up, self.lib.items_of(ids))
        blank = {"rank": F.lit(0), "legs": F.lit("filename"), "keyword": F.lit(False), "rich": F.lit(False), "cosine": F.lit(None).cast("double"), "doc_type": F.lit(None).cast("string")}
        up = local(up.withColumns({k: v for k, v in blank.items() if k not in up.columns}).select(*page.columns, "boosted"))
        rest = page.join(up.select("chunk_id"), "chunk_id", "left_anti").withColumn("boosted", F.lit(False)).select(*page.columns, "boosted")
        by = Window.partitionBy(F.lit(0)).orderBy(F.desc("boosted"), F.desc("score"), "rank", "chunk_id")
        return local(up.unionByName(rest).withColumn("rank", F.row_number().over(by)))


def search(
    lib: Library, question: str, now: Column, c: rt.RetrievalConfig = rt.RetrievalConfig(), vector: list[float] | None = None, scope: DataFrame | None = None, exclude_disputed: bool = False, whole: bool = True
) -> DataFrame:
    """Ranked hits of a question; with whole also what is returned for each (see ``returned``).

    Sections first, with flat legs underneath at half weight; where no section
    is admitted, flat legs alone.  Then decay, per-item cap, near copies, live
    first, authority, status, the cut with type slots, keyword slots, files that
    the question names, and the relevance gate.  scope: item_id, source_id of
    the items that may be found.
    """
    run = Search(lib, question, now, c, vector, scope, exclude_disputed)
    hits = rt.status_filter(run.boosted(run.page()), exclude_disputed)
    if scope is not None:
        hits = hits.join(scope.select("item_id").distinct(), "item_id", "left_semi").select(*hits.columns)
    hits = local(rt.relevance_gate(hits, F.col("keyword") | F.col("boosted"), F.col("cosine"), c))
    return returned(hits, lib, c.parent_chars) if whole else hits.orderBy("rank")


def returned(hits: DataFrame, lib: Library, most: int = 8000) -> DataFrame:
    """hits (a page) with content: the nearest section that fits, matches marked, once for all its hits; else the chunk and its neighbours.

    A neighbour goes to the best-ranked hit that wants it, and to none if a
    returned section or another hit has it; it comes as long as the whole fits.
    """
    ids = [r["item_id"] for r in hits.select("item_id").distinct().collect()]
    scratch = Scratch(hits.sparkSession, "page")
    chunks = scratch.write(lib.index.texts_of(ids).select("chunk_id", "item_id", "section_id", "kind", "content"), "chunks")  # of the page's items
    tree = trees.Tree.of(lib.sections.where(F.col("item_id").isin(ids)))
    ways = scratch.write(tree.ways(), "ways")
    leaves = chunks.where(F.col("kind").isin(*LEAF_KINDS))
    own = hits.drop("section_id").join(leaves.select("chunk_id", "section_id"), "chunk_id", "left")
    parents = local(trees.parent_return(own, ways.where(F.col("distance") < trees.WAY), trees.subtree_sizes(tree, chunks), most))
    placed = own.join(parents.select("chunk_id", "parent_section"), "chunk_id")
    by = Window.partitionBy("parent_section").orderBy("rank")
    first = placed.withColumn("_n", F.row_number().over(by)).where("_n = 1 OR parent_section IS NULL").drop("_n")
    under = ways.join(F.broadcast(parents.where("parent_section IS NOT NULL").select(F.col("parent_section").alias("ancestor")).distinct()), "ancestor").select("ancestor", "section_id")
    matched = parents.where("parent_section IS NOT NULL").select(F.col("chunk_id"), F.col("parent_section").alias("ancestor"), F.lit(True).alias("_hit"))
    told = under.join(leaves.select("section_id", "chunk_id", "content"), "section_id").join(F.broadcast(matched), ["chunk_id", "ancestor"], "left")
    n = F.col("chunk_id").cast("string")
    marked = F.when(F.col("_hit"), F.concat(F.lit("[match "), n, F.lit("]\n"), "content", F.lit("\n[/match "), n, F.lit("]"))).otherwise(F.col("content"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_id", marked.alias("text")))), lambda x: x["text"]), "\n\n")
    bodies = told.groupBy(F.col("ancestor").alias("parent_section")).agg(body.alias("_body"), F.collect_set("chunk_id").alias("_ids"))
    taken = bodies.select(F.explode("_ids").alias("chunk_id")).unionByName(placed.select("chunk_id")).distinct()
    alone = placed.where("parent_section IS NULL").select("rank", "chunk_id").join(rt.neighbours(chunks), "chunk_id")
    wants = alone.select("rank", "chunk_id", F.explode(F.array("before_1", "after_1")).alias("extra")).where("extra IS NOT NULL").join(taken.select(F.col("chunk_id").alias("extra")), "extra", "left_anti")
    claimed = wants.withColumn("_n", F.row_number().over(Window.partitionBy("extra").orderBy("rank"))).where("_n = 1")
    around = claimed.join(chunks.select(F.col("chunk_id").alias("extra"), F.col("content").alias("_text")), "extra").join(chunks.select("chunk_id", F.length("content").alias("_own")), "chunk_id")
    upto = F.sum(F.length("_text") + 4).over(Window.partitionBy("chunk_id").orderBy("extra")) + F.col("_own")
    more = around.withColumn("_used", upto).where(F.col("_used") <= most).groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct("extra", "_text"))).alias("_more"))
    out = first.join(bodies.select("parent_section", "_body"), "parent_section", "left").join(chunks.select("chunk_id", "content"), "chunk_id").join(more, "chunk_id", "left")
    tail = F.when(F.col("_more").isNotNull(), F.concat(F.lit("\n\n[continued]\n\n"), F.array_join(F.transform("_more", lambda x: x["_text"]), "\n\n"))).otherwise("")
    return local(out.withColumn("content", F.coalesce("_body", F.concat("content", tail))).drop("_body", "_more").orderBy("rank"))
