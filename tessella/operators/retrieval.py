"""Ranked retrieval: legs, fusion, ordering partitions and gates, as plans.

Every leg gives rows (chunk_id, item_id, score, ...) ordered by score, then
chunk_id.  Nothing is collected; only the last page leaves the cluster.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fx
from ..model import LEAF_KINDS, SUMMARY_KINDS
from ..storage import local
from .cells import VectorIndex
from .index import KeywordIndex


@dataclass(frozen=True)
class RetrievalConfig:
    """Knobs of ranked search."""

    top_k: int = 10
    max_per_source: int = 3
    cosine_floor: float = 0.2
    rrf_k: int = 60
    half_life_days: float = 365.0
    decay_floor: float = 0.8
    relevance: float = 0.5
    keyword_weight: float = 1.0
    pierce_terms: int = 3
    pierce_bm25: float = 5.0
    k1: float = 1.2
    b: float = 0.75
    parent_chars: int = 8000
    keyword_slots: int = 2
    type_slots: int = 2


def _once(**columns: Column) -> Column:
    """Columns made once per row by a generator of one row."""
    return F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))


def _phrase_count(words: Column, phrase: list[str]) -> Column:
    """How often the words of a phrase stand next to each other."""
    if len(phrase) == 1:
        return F.size(F.filter(words, lambda w: w == phrase[0]))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - len(phrase) + 1))
    hit = F.filter(starts, lambda i: reduce(lambda a, b: a & b, [F.coalesce(F.get(words, i - 1 + k) == w, F.lit(False)) for k, w in enumerate(phrase)]))
    return F.size(hit)


def keyword_leg(
    chunks: DataFrame | KeywordIndex, question: str, limit: int, c: RetrievalConfig = RetrievalConfig(), kinds: tuple[str, ...] | None = LEAF_KINDS, extra: tuple[str, ...] = (), scope: DataFrame | None = None
) -> DataFrame:
    """The best of keyword_scores."""
    return keyword_scores(chunks, question, c, kinds, extra, scope, narrow=None).orderBy(F.desc("score"), "chunk_id").limit(limit)


def keyword_scores(
    chunks: DataFrame | KeywordIndex, question: str, c: RetrievalConfig = RetrievalConfig(), kinds: tuple[str, ...] | None = LEAF_KINDS, extra: tuple[str, ...] = (), scope: DataFrame | None = None,
    stats: DataFrame | None = None, narrow: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """BM25 over an OR of quoted phrases; chunk_id, item_id, section_id, kind, status, score, terms (distinct query phrases met).

    Over an index only the postings of the question's words are read.  Over
    chunks without one, a scan makes the counts.  Document frequencies, corpus
    size and average length are those of chunks of every kind; the filters on
    kind and on items in scope come after.  A term with separators inside is a
    phrase of its parts.  No terms or no chunks give no rows.  stats: the row of
    ``keyword_stats``, if several legs of one question share it.  narrow: a
    filter on item_id, section_id and status; like kinds and scope it is put
    before the postings of an index are brought together.
    """
    phrases = phrases_of(question, extra)
    indexed = isinstance(chunks, KeywordIndex)
    if not phrases:
        none = chunks.postings if indexed else chunks
        return none.limit(0).select("chunk_id", "item_id", "section_id", "kind", "status", F.lit(0.0).alias("score"), F.lit(0).alias("terms"))
    n = len(phrases)

    def wanted(rows: DataFrame) -> DataFrame:
        rows = rows if kinds is None else rows.where(F.col("kind").isin(*kinds))
        rows = rows if scope is None else rows.join(scope.select("item_id").distinct(), "item_id", "left_semi").select(*rows.columns)
        return narrow(rows) if narrow else rows

    if indexed and stats is None:
        stats = keyword_stats(chunks, question, extra)
    if indexed and all(len(p) == 1 for p in phrases):  # words alone: what each posting adds is known, and adds up
        row = stats.first()  # a local table of one row

        def of(w: str) -> Column:
            df = row[f"_df{phrases.index((w,))}"]
            idf = math.log((row["_n"] - df + 0.5) / (df + 0.5)) if df < row["_n"] + 0.5 else 0.0
            return F.lit(idf if idf > 0 else 1e-6) * F.col("tf") * (c.k1 + 1) / (F.col("tf") + c.k1 * (1 - c.b + c.b * F.col("length") / F.lit(row["_avg"] or 1.0)))

        found = chunks.scored([p[0] for p in phrases], of, wanted)
        return found.select("chunk_id", "item_id", "section_id", "kind", "status", F.round("score", 9).alias("score"), "terms")
    counted = chunks.counted(phrases, wanted) if indexed else _scanned(chunks, phrases)
    if stats is None:
        stats = counted.agg(F.count("*").alias("_n"), F.avg("_len").alias("_avg"), *_frequencies(n))
    joined = counted.where(F.exists("_tf", lambda t: t > 0)).join(F.broadcast(stats))  # one row

    def part(i: int) -> Column:
        df, tf = F.col(f"_df{i}"), F.col("_tf")[i]
        idf = F.ln((F.col("_n") - df + 0.5) / (df + 0.5))
        idf = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
        return idf * tf * (c.k1 + 1) / (tf + c.k1 * (1 - c.b + c.b * F.col("_len") / F.col("_avg")))

    score = reduce(lambda a, b: a + b, [part(i) for i in range(n)])
    out = joined.select("chunk_id", "item_id", "section_id", "kind", "status", F.round(score, 9).alias("score"), F.size(F.filter("_tf", lambda t: t > 0)).alias("terms"))
    return out if indexed else wanted(out)


def phrases_of(question: str, extra: tuple[str, ...] = ()) -> list[tuple[str, ...]]:
    """The distinct phrases that a question asks for, its synonyms and extra terms among them."""
    asked = [*fx.expanded(fx.query_terms(question)), *extra]
    return [p for p in dict.fromkeys(tuple(_split(t)) for t in asked) if p]


def _frequencies(n: int) -> list[Column]:
    return [F.sum((F.col("_tf")[i] > 0).cast("long")).alias(f"_df{i}") for i in range(n)]


def keyword_stats(index: KeywordIndex, question: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row: chunks, average length, and how many chunks have each phrase of the question."""
    found = index.frequencies(phrases_of(question, extra))
    one = [(index.n, index.words / index.n if index.n else None, *found)]
    return index.spark.createDataFrame(one, "_n long, _avg double" + "".join(f", _df{i} long" for i in range(len(found))))


def _scanned(chunks: DataFrame, phrases: list[tuple[str, ...]]) -> DataFrame:
    """chunk_id, its own columns, _len and _tf of every chunk, without an index."""
    # each step behind a generator: filters on its result are not pushed down and evaluated anew
    ids = ["chunk_id", "item_id", "section_id", "kind", "status"]
    words = chunks.select(*ids, _once(_words=fx.tokens(F.col("content"))))
    firsts = F.filter("_words", lambda w: w.isin(*{p[0] for p in phrases}))
    whole = F.col("_words") if any(len(p) > 1 for p in phrases) else F.array().cast("array<string>")
    narrow = words.select(*ids, _once(_len=F.size("_words"), _hits=firsts, _all=whole))
    counts = F.array(*[_phrase_count(F.col("_hits" if len(p) == 1 else "_all"), list(p)) for p in phrases])
    none = F.array(*[F.lit(0)] * len(phrases))
    return narrow.select(*ids, _once(_len=F.col("_len"), _tf=F.when(F.size("_hits") > 0, counts).otherwise(none)))


def _split(term: str) -> list[str]:
    import regex

    table = str.maketrans(fx.MARKED, fx.PLAIN)
    return regex.findall(r"[\p{L}\p{N}]+", term.lower().translate(table))


def vector_leg(vectors: DataFrame | VectorIndex, query: list[float], limit: int, floor: float = 0.2, key: str = "vec_id", family_of: str | None = None) -> DataFrame:
    """vectors with score: cosine above the floor, best first; of the query's width, and of a family if one is given.

    Over an index only the cells that can hold the best are read.  Without one
    all are scanned: a stored norm is used where vectors have one
    (``with_norms``); the query's is a literal, so a row costs one product.
    """
    if isinstance(vectors, VectorIndex):
        return vectors.near(query, limit, floor, key, None if family_of is None else lambda rows: rows.where(family(F.col("fp")) == family_of))
    q = F.array(*[F.lit(float(x)) for x in query])
    size = sum(x * x for x in query) ** 0.5
    own = vectors if family_of is None else vectors.where(family(F.col("fp")) == family_of)
    norm = F.col("norm") if "norm" in vectors.columns else fx.norm(F.col("embedding"))
    fits = (F.size("embedding") == len(query)) & (norm > 0) & F.lit(size > 0)
    score = F.when(fits, fx.dot(F.col("embedding"), q) / (norm * size)).otherwise(0.0)
    scored = own.withColumn("score", F.round(F.nanvl(score, F.lit(0.0)), 6))  # what is no number is no match
    return scored.where(F.col("score") > floor).orderBy(F.desc("score"), key).limit(limit)


def family(fp: Column) -> Column:
    """The model of a vector's stamp: what stands before the colon."""
    return F.substring_index(fp, ":", 1)


def with_norms(vectors: DataFrame) -> DataFrame:
    """vectors with their norm, to be stored with them."""
    return vectors.withColumn("norm", fx.norm(F.col("embedding")))


def exact_leg(chunks: DataFrame, needle: str, limit: int) -> DataFrame:
    """Leaf chunks that contain the needle, case counted, in document order; an empty needle finds nothing."""
    found = chunks.where(F.lit(bool(needle)) & F.col("kind").isin(*LEAF_KINDS) & F.col("content").contains(needle))
    return found.select("chunk_id", "item_id", "section_id", "kind", "status", F.lit(1.0).alias("score")).orderBy("item_id", "chunk_id").limit(limit)


def ranked(leg: DataFrame, name: str) -> DataFrame:
    """A leg with its name and 1-based ranks."""
    by = Window.partitionBy(F.lit(name)).orderBy(F.desc(F.coalesce(F.nanvl("score", F.lit(float("-inf"))), F.lit(float("-inf")))), "chunk_id")
    return leg.withColumn("leg", F.lit(name)).withColumn("leg_rank", F.row_number().over(by))


def fuse(legs: list[tuple[str, DataFrame, float]], c: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """Reciprocal rank fusion: sum of weight / (60 + rank) per chunk; a single leg keeps its scores.

    keyword, rich (terms and score of a keyword match reach the bars of c) and
    cosine tell what the legs knew of a chunk.
    """
    parts = [_told(ranked(df, name), name, c).withColumn("weight", F.lit(float(w))) for name, df, w in legs]
    base = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    score = F.sum(F.col("weight") / (c.rrf_k + F.col("leg_rank"))) if len(legs) > 1 else F.max("score")
    return base.groupBy("chunk_id", "item_id").agg(
        F.round(score, 9).alias("score"), F.first("status", True).alias("status"), F.first("kind", True).alias("kind"), F.first("section_id", True).alias("section_id"),
        F.array_join(F.sort_array(F.collect_set("leg")), ",").alias("legs"), F.max("keyword").alias("keyword"), F.max("rich").alias("rich"), F.max("cosine").alias("cosine"),
    )


def _told(leg: DataFrame, name: str, c: RetrievalConfig) -> DataFrame:
    """A leg with keyword, rich and cosine, where it does not bring them."""
    by_words = "terms" in leg.columns
    rich = (F.col("terms") >= c.pierce_terms) & (F.col("score") >= c.pierce_bm25) if by_words and c.pierce_bm25 >= 0 else F.lit(False)
    own = {"keyword": F.lit(by_words), "rich": rich, "cosine": F.col("score") if name == "vector" else F.lit(None).cast("double")}
    return leg.withColumns({k: v for k, v in own.items() if k not in leg.columns})


def age_decay(created: Column, now: Column, c: RetrievalConfig = RetrievalConfig()) -> Column:
    """max(0.5 ** (age in days / half life), floor); 1 for the future, a missing date or no half life."""
    days = (F.unix_timestamp(now) - F.unix_timestamp(created)) / 86_400.0
    if c.half_life_days <= 0:
        return F.lit(1.0)
    return F.when(created.isNull() | (days <= 0), 1.0).otherwise(F.greatest(F.pow(F.lit(0.5), days / c.half_life_days), F.lit(c.decay_floor)))


def per_item_cap(hits: DataFrame, c: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """At most max_per_source hits of an item when at least three items are there, else top_k.  hits is what limits have left of the legs."""
    by, over = Window.partitionBy("item_id").orderBy(F.desc("score"), "chunk_id"), Window.partitionBy(F.lit(0))
    numbered = hits.withColumn("_n", F.row_number().over(by)).withColumn("_items", F.size(F.collect_set("item_id").over(over)))
    return numbered.where(F.col("_n") <= F.when(F.col("_items") >= 3, c.max_per_source).otherwise(c.top_k)).drop("_n", "_items")


def drop_near_copies(hits: DataFrame, signature: Column) -> DataFrame:
    """The best hit of each (item, signature)."""
    by = Window.partitionBy("item_id", "_sig").orderBy(F.desc("score"), "chunk_id")
    return hits.withColumn("_sig", signature).withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_sig", "_n")


def signature(content: Column) -> Column:
    """The first 160 characters with white space collapsed, lower case, without a leading page number."""
    return F.substring(F.regexp_replace(fx.repeat_key(content), r"^[0-9]{1,4} +", ""), 1, 160)


def status_filter(rows: DataFrame, exclude_disputed: bool = False, status: str = "status") -> DataFrame:
    """Without stale rows, and without disputed ones when asked; a null status passes."""
    bad = ["stale", *(["disputed"] if exclude_disputed else [])]
    return rows.where(F.col(status).isNull() | ~F.col(status).isin(*bad))


def item_facts(hits: DataFrame, items: DataFrame) -> DataFrame:
    """hits with created_at, env and tier of their items; where items do not have env and tier, the candidates' paths and heads are classified."""
    if "env" in items.columns and "tier" in items.columns:
        return F.broadcast(hits).join(items.select("item_id", "created_at", "env", "tier"), "item_id")  # hits are limited per leg
    own = items.select("item_id", "created_at", F.col("external_id").alias("_path"), F.col("text").alias("_text"))
    facts = F.broadcast(hits).join(own, "item_id")  # hits are limited per leg
    return facts.withColumns({"env": fx.env_class(F.col("_path"), F.col("_text")), "tier": fx.authority_tier(F.col("_path"))}).drop("_path", "_text")


def page_order(live_first: bool = True, tiers: bool = True) -> list[Column]:
    """Live before test, strong matches before others, then authority; the score decides what is left."""
    env = [F.when(F.lit(live_first), F.col("env") == "test").otherwise(False)]
    return [*env, *([~F.col("rich"), F.col("tier")] if tiers else []), F.desc("score"), F.col("chunk_id")]


def fuse_and_rank(
    legs, chunks: DataFrame, items: DataFrame, now: Column, c: RetrievalConfig = RetrievalConfig(), live_first: bool = True, tiers: bool = True, exclude_disputed: bool = False, cut: bool = True
) -> DataFrame:
    """Fusion, decay, per-item cap, near-copy drop, live first, authority tiers (strong matches pierce), status filter, cut.

    Content and item text are joined to the few fused candidates only.  Without
    the cut, what is below it comes too.
    """
    hits = item_facts(fuse(legs, c), items)
    hits = F.broadcast(hits).join(chunks.select("chunk_id", "content"), "chunk_id")
    hits = hits.withColumn("score", F.round(F.col("score") * age_decay(F.col("created_at"), now, c), 9))
    hits = status_filter(drop_near_copies(per_item_cap(hits, c), signature(F.col("content"))), exclude_disputed)
    ranked_hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*page_order(live_first, tiers))))
    ranked_hits = ranked_hits.where(F.col("rank") <= c.top_k) if cut else ranked_hits
    return ranked_hits.select("rank", "chunk_id", "item_id", "score", "env", "tier", "legs", "status", "section_id", "keyword", "rich", "cosine", "created_at")


def relevance_gate(hits: DataFrame, keyword: Column, cosine: Column, c: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """All hits if any has a keyword match (or a boost, if the caller says so) or a cosine of at least 0.5, else none."""
    ok = F.max(F.coalesce(keyword, F.lit(False)) | F.coalesce(cosine >= c.relevance, F.lit(False))).over(Window.partitionBy(F.lit(0)))
    return hits.withColumn("_ok", ok).where("_ok").drop("_ok")


def admitted_sections(section_hits: DataFrame, per_item: int = 2, most: int = 10) -> DataFrame:
    """Sections for the fenced search: at most two per item and ten in all, best first; those marked test last, where a mark is there."""
    last = [F.col("test")] if "test" in section_hits.columns else []
    by = Window.partitionBy("item_id").orderBy(F.desc("score"), "section_id")
    over = Window.partitionBy(F.lit(0)).orderBy(*last, F.desc("score"), "section_id")
    first = section_hits.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= per_item).drop("_n")
    return first.withColumn("place", F.row_number().over(over)).where(F.col("place") <= most)


#: Summaries that choose the sections of a fenced search.
SUMMARIES = 15


def toc_fence(summaries: DataFrame, sections: DataFrame) -> DataFrame:
    """section_id of the sections that summary hits (item_id, score) admit; deeper sections count a little less."""
    own = [c for c in ("item_id", "score", "test") if c in summaries.columns]
    named = summaries.select(*own).join(sections.select("item_id", "section_id", "level"), "item_id")
    return admitted_sections(named.select("section_id", *own[:1], *own[2:], F.round(F.col("score") - F.col("level") * 1e-3, 9).alias("score"))).select("section_id")


def toc_search(chunks: DataFrame | KeywordIndex, sections: DataFrame, question: str, c: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """Summaries by keyword, sections admitted from the items they name, leaves fenced to those sections, five times top_k."""
    stats = keyword_stats(chunks, question) if isinstance(chunks, KeywordIndex) and phrases_of(question) else None  # both legs share it
    summaries = keyword_scores(chunks, question, c, SUMMARY_KINDS, stats=stats).orderBy(F.desc("score"), "chunk_id").limit(SUMMARIES)
    best = local(summaries)  # fifteen at most, so that their sections are a pushed filter
    ids = [r["item_id"] for r in best.collect()]
    fence = [r["section_id"] for r in toc_fence(best, sections.where(F.col("item_id").isin(ids))).collect()]  # ten sections
    leaves = keyword_scores(chunks, question, c, stats=stats, narrow=lambda rows: rows.where(F.col("section_id").isin(fence)))
    return leaves.orderBy(F.desc("score"), "chunk_id").limit(c.top_k * 5)


def keyword_slots(ranked_hits: DataFrame, floor_hits: DataFrame, c: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """Up to two keyword hits that the list lacks, with half the reciprocal rank score, and their leg_rank."""
    missing = ranked(floor_hits, "floor").join(ranked_hits.select("chunk_id"), "chunk_id", "left_anti")
    return missing.orderBy("leg_rank").limit(c.keyword_slots).select("chunk_id", "item_id", F.round(F.lit(0.5) / (c.rrf_k + F.col("leg_rank")), 9).alias("score"), "leg_rank")


def type_slots(hits: DataFrame, cut: int, kinds: int = 2) -> DataFrame:
    """From below the cut, the best hit of up to two document types that the page lacks; unknown types never."""
    top = hits.where(F.col("rank") <= cut).select("doc_type").distinct()
    by = Window.partitionBy("doc_type").orderBy("rank")
    below = hits.where((F.col("rank") > cut) & F.col("doc_type").isNotNull()).join(F.broadcast(top), "doc_type", "left_anti")
    return below.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n").orderBy("rank").limit(kinds)


def neighbours(chunks: DataFrame, width: int = 1) -> DataFrame:
    """Each chunk with the ids before and after it in its item."""
    by = Window.partitionBy("item_id").orderBy("chunk_id")
    cols = [F.lag("chunk_id", k).over(by).alias(f"before_{k}") for k in range(1, width + 1)] + [F.lead("chunk_id", k).over(by).alias(f"after_{k}") for k in range(1, width + 1)]
    return chunks.select("chunk_id", "item_id", *cols)


# Fixed values, equal to those of the service whose results are matched.
FOLLOWUP_WORDS = "it its this that these those they them their itself".split()
NOT_ACRONYMS = "OK AM PM ID TODO FYI ASAP AND OR NOT THE".split()


def followups(turns: DataFrame, most: int = 500) -> DataFrame:
    """User turns with a pronoun get the user turn before them in front, cut to most characters."""
    by = Window.partitionBy("conv_id").orderBy("turn")
    users = turns.where("role = 'user'").withColumn("_last", F.lag("text").over(by))
    words = F.split(F.lower("text"), r"\s+")
    vague = F.arrays_overlap(words, F.array(*[F.lit(w) for w in FOLLOWUP_WORDS])) | F.lower("text").contains("its ") | F.lower("text").contains(" for it")
    whole = F.when(vague & F.col("_last").isNotNull(), F.concat("_last", F.lit(" "), "text")).otherwise(F.col("text"))
    return users.select("conv_id", "turn", F.substring(whole, 1, most).alias("question"))


def acronyms(text: Column, most: int = 4) -> Column:
    """The first four distinct tokens of two to seven ASCII capitals or digits that begin with a capital and are no plain word."""
    words = F.split(text, r"[^\p{L}\p{N}]+")
    return F.slice(F.array_distinct(F.filter(words, lambda t: t.rlike("^[A-Z][A-Z0-9]{1,6}$") & ~t.isin(NOT_ACRONYMS))), 1, most)
