"""Predicates, joins, aggregations, windows and mutations over the data model."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as fx
from ..model import LEAF_KINDS
from ..storage import Scratch

# ---- predicates and scopes -------------------------------------------------


def source_scope(rows: DataFrame, scope: DataFrame | None) -> DataFrame:
    """Rows of the sources in scope (source_id); None means all, an empty scope nothing."""
    return rows if scope is None else rows.join(scope.select("source_id").distinct(), "source_id", "left_semi")


def section_fence(chunks: DataFrame, fence: DataFrame | None, leaf: bool) -> DataFrame:
    """Chunks in the fenced sections; an absent fence matches nothing for leaves and everything for summaries."""
    if fence is None:
        return chunks.limit(0) if leaf else chunks
    return chunks.join(fence.select("section_id").distinct(), "section_id", "left_semi")


def project_scope(project_sources: DataFrame, sources: DataFrame, project: int | None, public_only: bool = False) -> DataFrame:
    """The source ids a project may see: all for None; public ones only when asked."""
    own = sources.select("source_id") if project is None else project_sources.where(F.col("project_id") == project).select("source_id").distinct()
    return own.intersect(sources.where("label = 'public'").select("source_id")) if public_only else own


def sensitivity(items: DataFrame, sources: DataFrame) -> DataFrame:
    """items with blocked_by: the source's label sensitive, item_sensitive for an override, null when free; an unknown source blocks."""
    label = sources.select("source_id", "label")
    reason = F.when(F.col("label").isNull(), "sensitive").when(F.col("label") == "sensitive", F.col("label")).when(F.coalesce("sensitive_override", F.lit(False)), "item_sensitive")
    return items.join(label, "source_id", "left").withColumn("blocked_by", reason)


def public_items(items: DataFrame, sources: DataFrame) -> DataFrame:
    public = sources.where("label = 'public'").select("source_id")
    return items.where(~F.coalesce("sensitive_override", F.lit(False))).join(public, "source_id", "left_semi")


def kind_filter(rows: DataFrame, wanted: str, known: tuple[str, ...], column: str = "kind") -> DataFrame:
    """Rows of the kinds in a comma list; unknown kinds are dropped, an empty list filters nothing."""
    kinds = [k.strip() for k in wanted.split(",") if k.strip() in known]
    return rows.where(F.col(column).isin(*kinds)) if kinds else rows


def check_prefix(prefix: str) -> str:
    """The prefix with forward slashes, or ValueError for one that could not be a path."""
    if any(ord(c) < 32 for c in prefix) or re.search(r"[*?]|://", prefix):
        raise ValueError(f"not a path prefix: {prefix!r}")
    clean = prefix.replace("\\", "/")
    parts = clean.split("/")
    if ".." in parts or "." in parts or clean.startswith("~") or re.match(r"^[A-Za-z]:(?!/)", clean):
        raise ValueError(f"not a path prefix: {prefix!r}")
    return clean


def path_prefix(rows: DataFrame, prefix: str, column: str = "external_id") -> DataFrame:
    clean = check_prefix(prefix).lower()
    return rows.where(F.lower(F.replace(column, F.lit("\\"), F.lit("/"))).startswith(clean))


def symbol_filter(rows: DataFrame, symbol: str) -> DataFrame:
    low = symbol.lower()
    return rows.where(F.lower("title").contains(low) | F.lower("path").contains(low))


def like_escaped(column: Column, needle: str) -> Column:
    """Case-insensitive contains, with % and _ of the needle taken literally."""
    quoted = re.sub(r"([\\%_])", r"\\\1", needle)
    return column.ilike(f"%{quoted}%")


def overdue(due: Column, today: str) -> Column:
    """An ISO date at the start of due that lies before today."""
    return due.rlike(r"^\d{4}-\d{2}-\d{2}") & (F.substring(due, 1, 10) < today)


def line_window(text: Column, spec: str) -> Column:
    """Lines a-b, a or a- (from 1); the end is clamped, a start past the end gives null."""
    m = re.fullmatch(r"(\d+)(-(\d*))?", spec.strip())
    if not m or int(m[1]) < 1:
        raise ValueError(f"not a line window: {spec!r}")
    start = int(m[1])
    lines = F.split(text, "\n")
    stop = F.size(lines) if m[2] and not m[3] else F.least(F.lit(int(m[3]) if m[3] else start), F.size(lines))
    return F.when(F.size(lines) >= start, F.array_join(F.slice(lines, F.lit(start), F.greatest(F.lit(0), stop - start + 1)), "\n"))


def clamp(value: int | None, low: int, high: int, default: int) -> int:
    return max(low, min(high, default if value is None else value))


# ---- joins -------------------------------------------------------------------


def effective_items(chunks: DataFrame, entities: DataFrame, items: DataFrame) -> DataFrame:
    """chunks with the item they belong to, directly or through their entity."""
    e = entities.select("entity_id", F.col("item_id").alias("_via"))
    joined = chunks.join(e, "entity_id", "left").withColumn("effective_item", F.coalesce("item_id", "_via"))
    i = items.select(F.col("item_id").alias("effective_item"), "source_id", "external_id")
    return joined.join(i, "effective_item", "left").drop("_via")


def records(entities: DataFrame, items: DataFrame, sources: DataFrame) -> DataFrame:
    return entities.join(items.select("item_id", "source_id", "external_id"), "item_id").join(sources.select("source_id", "name", "label"), "source_id")


def items_per_source(sources: DataFrame, items: DataFrame) -> DataFrame:
    n = items.groupBy("source_id").agg(F.count("*").alias("n_items"))
    return sources.join(n, "source_id", "left").select("source_id", "name", "label", F.coalesce("n_items", F.lit(0)).alias("n_items"))


def section_sizes(sections: DataFrame, chunks: DataFrame) -> DataFrame:
    """section_id, n_chunks, chars, over chunks of every kind; sections without chunks have zeros."""
    n = chunks.where("section_id IS NOT NULL").groupBy("section_id").agg(F.count("*").alias("n_chunks"), F.sum(F.length("content")).alias("chars"))
    return sections.join(n, "section_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_chunks", "chars")})


def conflict_pairs(relationships: DataFrame, entities: DataFrame) -> DataFrame:
    """entity_id and counterpart for both directions of conflicts_with; stale counterparts are left out."""
    base = relationships.where("kind = 'conflicts_with'")
    both = base.select("from_id", "to_id").unionByName(base.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id")))
    live = entities.where("status IS NULL OR status <> 'stale'").select(F.col("entity_id").alias("to_id"), "record_id")
    return both.join(live, "to_id").groupBy(F.col("from_id").alias("entity_id")).agg(F.array_join(F.sort_array(F.collect_set("record_id")), ",").alias("conflicts"))


def supersession(entities: DataFrame) -> DataFrame:
    """entity_id, record_id and superseded_by: the first record, by id, whose comma list names it."""
    listed = entities.where("supersedes IS NOT NULL").select("entity_id", F.col("record_id").alias("_by"), F.explode(F.split("supersedes", ",")).alias("_one"))
    first = listed.groupBy(F.trim("_one").alias("record_id")).agg(F.min_by("_by", "entity_id").alias("superseded_by"))
    return entities.select("entity_id", "record_id").join(first, "record_id", "left")


def first_chunk(entities: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each entity with the first chunk of its item, by a pre-aggregate in place of a correlated subquery."""
    first = chunks.where(F.col("kind").isin(*LEAF_KINDS)).groupBy("item_id").agg(F.min("chunk_id").alias("first_chunk"))
    return entities.join(first, "item_id", "left").select("entity_id", "first_chunk")


def node_links(sections: DataFrame) -> DataFrame:
    """section_id with its parent, number of children and of siblings (roots of an item are siblings)."""
    kids = sections.where("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("section_id")).agg(F.count("*").alias("children"))
    peers = Window.partitionBy("item_id", "parent_id")
    base = sections.select("section_id", "parent_id", (F.count("*").over(peers) - 1).alias("siblings"))
    return base.join(kids, "section_id", "left").withColumn("children", F.coalesce("children", F.lit(0)))


# ---- aggregations ---------------------------------------------------------------


def folded_events(events: DataFrame) -> DataFrame:
    """Repeats in one row: n, first and last time, newest id with its detail, and whether all are dismissed."""
    return events.groupBy("component", "level", "source_id", "message").agg(
        F.count("*").alias("n"), F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"), F.max("id").alias("last_id"),
        F.coalesce(F.max_by("detail", "id"), F.lit("")).alias("detail"), F.every(F.col("dismissed_at").isNotNull()).alias("all_dismissed"),
    )


def facets(events: DataFrame, filters: dict[str, str]) -> DataFrame:
    """facet, value, n for component, level and source_id; a facet ignores its own filter."""
    parts = []
    for facet in ("component", "level", "source_id"):
        kept = reduce(lambda df, f: df.where(F.col(f[0]) == f[1]), [f for f in filters.items() if f[0] != facet], events)
        parts.append(kept.groupBy(F.col(facet).cast("string").alias("value")).agg(F.count("*").alias("n")).select(F.lit(facet).alias("facet"), "value", "n"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def top_terms(texts: DataFrame, key: str, text: str, most: int = 4) -> DataFrame:
    """key, term, n, place: the most frequent words of four characters or more, ties by word."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]{4,}"), 0)
    counts = texts.select(key, F.explode(F.filter(words, lambda w: ~w.isin(fx.TAG_STOPWORDS))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("n"))
    by = Window.partitionBy(key).orderBy(F.desc("n"), "term")
    return counts.withColumn("place", F.row_number().over(by)).where(F.col("place") <= most)


def top_words(text: Column, most: int = 4) -> Column:
    """The terms that top_terms finds in a text in lower case, counted where the text is; null texts have none."""
    word, out = re.compile(r"[^\W_]{4,}"), frozenset(fx.TAG_STOPWORDS)

    def first(text: str | None) -> list[str]:
        counts = Counter(word.findall(text or ""))
        for w in out & counts.keys():
            del counts[w]
        least = sorted(counts.values(), reverse=True)[:most][-1:]  # only words as frequent as the last of them are compared
        return sorted((w for w, n in counts.items() if [n] >= least), key=lambda w: (-counts[w], w))[:most]

    def counted(texts: pd.Series) -> pd.Series:
        return texts.map(first)

    return F.pandas_udf(counted, "array<string>")(text)


def repeated_lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, line, n of lines of at most 120 characters that repeat at least max(3, 1 % of the lines, half to even) times."""
    lines = texts.select(key, F.explode(F.split(text, "\n")).alias("_l")).select(key, fx.repeat_key(F.col("_l")).alias("line"))
    counts = lines.where((F.length("line") > 0) & (F.length("line") <= 120)).groupBy(key, "line").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(key))
    whole, rest = F.floor(total / 100), total % 100
    limit = F.greatest(F.lit(3), whole + F.when(rest > 50, 1).when(rest < 50, 0).otherwise(whole % 2))
    return counts.withColumn("_limit", limit).where("n >= _limit").select(key, "line", "n")


def idf_signal(chunks: DataFrame, key: str = "item_id") -> DataFrame:
    """chunk_id, signal: mean over a chunk's distinct words of max(0, ln((n + 1) / (df + 1))).

    df counts every occurrence in the item's chunks; n is their number.
    """
    return _signals(chunks, key).drop(key)


def _signals(chunks: DataFrame, key: str) -> DataFrame:
    """key, chunk_id, signal: texts are dealt by item once, and an item's words are counted where its chunks meet."""
    schema = T.StructType([chunks.schema[key], chunks.schema["chunk_id"], T.StructField("signal", T.DoubleType())])
    word = re.compile(r"[a-z0-9_]{3,}")

    def rated(item, texts: list[str | None]) -> list[float]:
        own = [word.findall(t or "") for t in texts]
        df = Counter(w for words in own for w in words)
        idf = {w: max(0.0, math.log((len(own) + 1.0) / (n + 1.0))) for w, n in df.items()}
        once = [set(words) for words in own]
        return [sum(idf[w] for w in words) / len(words) if words and item is not None else 0.0 for words in once]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True))
        items, ids, found = [], [], []
        for item, group in groupby(rows, lambda r: r[0]):
            own = list(group)
            items += [item] * len(own)
            ids += [r[1] for r in own]
            found += rated(item, [r[2] for r in own])
            if len(ids) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip((items, ids, found), kinds, strict=True)], names=schema.names)
                items, ids, found = [], [], []
        yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip((items, ids, found), kinds, strict=True)], names=schema.names)

    kinds = [to_arrow_type(f.dataType) for f in schema.fields]
    dealt = chunks.select(key, "chunk_id", F.lower("content").alias("_text")).repartition(key).sortWithinPartitions(key)
    return dealt.mapInArrow(run, schema).withColumn("signal", F.round("signal", 6))


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page of rows with the total before the cut."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total))  # one row


def action_order(entities: DataFrame) -> list[Column]:
    """ISO-dated first by date, then the others, then id."""
    dated = F.coalesce(F.col("due").rlike(r"^\d{4}-\d{2}-\d{2}"), F.lit(False))
    return [~dated, F.when(dated, F.col("due")).asc_nulls_last(), F.col("entity_id")]


# ---- windows ---------------------------------------------------------------------


def running_pages(chunks: DataFrame) -> DataFrame:
    """chunk_id, first_page, last_page: [page N] marks counted on through the chunks of an item."""
    by = Window.partitionBy("item_id").orderBy("chunk_id")
    marks = F.transform(F.regexp_extract_all("content", F.lit(r"\[page (\d+)\]"), 1), lambda x: x.cast("int"))
    seen = chunks.withColumn("_m", marks).withColumn("_top", F.array_max("_m"))
    before = F.last("_top", True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    first = F.coalesce(before, F.array_min("_m"))
    return seen.select("chunk_id", first.alias("first_page"), F.coalesce("_top", before).alias("last_page"))


def section_ends(starts: DataFrame, total: str, levels: int = 7) -> DataFrame:
    """start lines of headings with their end: the line before the next heading that is as shallow or shallower.

    Levels are 0 to levels: for each, the next line at that level or above it is
    a running minimum from below, so memory does not grow with a document.
    """
    later = Window.partitionBy("doc").orderBy("line").rowsBetween(1, Window.unboundedFollowing)
    nexts = F.array(*[F.min(F.when(F.col("level") <= k, F.col("line"))).over(later) for k in range(levels + 1)])
    marked = starts.withColumn("_next", nexts)
    return marked.withColumn("end", F.coalesce(F.get("_next", F.col("level").cast("int")) - 1, F.col(total))).drop("_next")


def heading_parents(heads: DataFrame, levels: int = 7) -> DataFrame:
    """doc, line and parent: the line of the last heading before that is shallower."""
    before = Window.partitionBy("doc").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    lasts = F.array(*[F.max(F.when(F.col("level") < k, F.col("line"))).over(before) for k in range(levels + 1)])
    return heads.withColumn("_last", lasts).select("doc", "line", F.get("_last", F.col("level").cast("int")).alias("parent"))


def numbered(chunks: DataFrame) -> DataFrame:
    """chunk_id and label: base §n when the item has more than one leaf."""
    by = Window.partitionBy("item_id").orderBy("chunk_id")
    n, count = F.row_number().over(by), F.count("*").over(Window.partitionBy("item_id"))
    base = F.concat(F.lit("item "), F.col("item_id").cast("string"))
    return chunks.where(F.col("kind").isin(*LEAF_KINDS)).select("chunk_id", F.when(count > 1, F.concat(base, F.lit(" §"), n.cast("string"))).otherwise(base).alias("label"))


# ---- incremental load -----------------------------------------------------------


def to_extract(listing: DataFrame, stored: DataFrame, generation: int) -> DataFrame:
    """Listed files that are new, changed in time or size, or stored by an older extractor."""
    known = stored.where(F.col("extractor") >= generation).select("external_id", "mtime_ms", "size")
    return listing.join(known, ["external_id", "mtime_ms", "size"], "left_anti")


def upsert(fetched: DataFrame, stored: DataFrame) -> DataFrame:
    """fetched with content_hash and action: insert, update or skip (skip needs both hashes equal and a text)."""
    old = stored.select("external_id", F.col("content_hash").alias("_c"), F.col("processed_hash").alias("_p"), F.col("text").isNotNull().alias("_t"), F.lit(True).alias("_there"))
    hashed = fetched.withColumn("content_hash", F.sha2(F.coalesce("text", F.lit("")), 256)).join(old, "external_id", "left")
    same = (F.col("content_hash").eqNullSafe(F.col("_c"))) & (F.col("content_hash").eqNullSafe(F.col("_p"))) & F.coalesce("_t", F.lit(False))
    return hashed.withColumn("action", F.when(F.col("_there").isNull(), "insert").when(same, "skip").otherwise("update")).drop("_c", "_p", "_t", "_there")


def purge(stored: DataFrame, fetched: DataFrame, protected: DataFrame, connector: str) -> DataFrame:
    """Stored items to delete: not fetched and not protected.  An empty fetch purges nothing, and rest sources never purge."""
    if connector == "rest":
        return stored.limit(0)
    some = fetched.agg((F.count("*") > 0).alias("_some"))
    gone = stored.join(fetched.select("external_id"), "external_id", "left_anti").join(protected.select("external_id"), "external_id", "left_anti")
    return gone.join(F.broadcast(some)).where("_some").drop("_some")  # one row


def windows_to_classify(now: DataFrame, before: DataFrame) -> DataFrame:
    """Windows (item_id, idx, hash) whose hash is not stored at their place."""
    return now.join(before, ["item_id", "idx", "hash"], "left_anti")


def reuse_vectors(fresh: DataFrame, old: DataFrame) -> DataFrame:
    """fresh chunks with the vector of an old chunk of equal kind, path and content, else null."""
    first = old.groupBy("kind", "path", "content").agg(F.min_by("vector_id", "chunk_id").alias("vector_id"))
    return fresh.join(first, ["kind", "path", "content"], "left")


def backfill(chunks: DataFrame, stale: list[str], items: DataFrame, sources: DataFrame) -> DataFrame:
    """Chunks to embed: without vector, without stamp or with a stale one, and not of sensitive items."""
    free = sensitivity(items, sources).where("blocked_by IS NULL").select("item_id")
    need = chunks.where(F.col("embed_fp").isNull() | ~F.col("has_vector") | F.col("embed_fp").isin(*stale))
    return need.join(free, "item_id", "left_semi")


def outdated(items: DataFrame, generations: dict[str, int], base: int = 1) -> DataFrame:
    """item_id and wanted of the items whose chunks an older chunker made; generations: by extension, base for all others.

    Items that host images are made anew by sync and are left out.
    """
    name = F.lower(F.element_at(F.split("external_id", r"[/\\]"), -1))
    known = F.create_map(*[F.lit(x) for kv in generations.items() for x in kv]) if generations else F.create_map().cast("map<string,int>")
    wanted = F.coalesce(F.when(name.contains("."), known[F.element_at(F.split(name, r"\."), -1)]), F.lit(base))
    return items.where(~name.rlike(IMAGE_HOSTS)).withColumn("wanted", wanted).where(F.col("chunker_version") < F.col("wanted")).select("item_id", "wanted")


#: Names of files with images inside.
IMAGE_HOSTS = r"\.(html|htm|docx|docm|pptx|pptm|odt|odp|pdf|md|markdown)$"


def embedding_gate(chunks: DataFrame, items: DataFrame, sources: DataFrame, least: float = 0.15, trusted: bool = False) -> DataFrame:
    """chunk_id and embed: whether a chunk's raw text says enough, and may be shown to the provider (sensitive text only to a trusted one)."""
    free = sensitivity(items, sources).select("item_id", (F.lit(trusted) | F.col("blocked_by").isNull()).alias("_free"))
    rated = _signals(chunks, "item_id").join(free, "item_id", "left")
    return rated.select("chunk_id", ((F.col("signal") >= least) & F.coalesce("_free", F.lit(False))).alias("embed"))


def related(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """entity_id with other_id and kind for relations in both directions, each once; both ends must be there."""
    ways = relationships.select(F.col("from_id").alias("entity_id"), F.col("to_id").alias("other_id"), "kind")
    both = ways.unionByName(ways.select(F.col("other_id").alias("entity_id"), F.col("entity_id").alias("other_id"), "kind")).distinct()
    there = entities.select("entity_id")
    return both.join(there, "entity_id", "left_semi").join(there.withColumnRenamed("entity_id", "other_id"), "other_id", "left_semi").select("entity_id", "other_id", "kind")


# ---- mutations --------------------------------------------------------------------


def patch(rows: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """rows with the non-null fields of changes (one row per key) put over theirs."""
    new = changes.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    return rows.join(new, key, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns])


def dispute(entities: DataFrame, disputes: DataFrame) -> DataFrame:
    """entities with their dispute count; any dispute makes the status disputed."""
    n = disputes.groupBy("entity_id").agg(F.count("*").alias("dispute_count"))
    out = entities.join(n, "entity_id", "left").withColumn("dispute_count", F.coalesce("dispute_count", F.lit(0)))
    return out.withColumn("status", F.when(F.col("dispute_count") > 0, "disputed").otherwise(F.col("status")))


def link_conflicts(existing: DataFrame, wanted: DataFrame) -> DataFrame:
    """Conflict links (a, b, note) after adding wanted ones: unordered pairs once, no self links, notes cut at 1000."""

    def keyed(df: DataFrame) -> DataFrame:
        return df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.substring("note", 1, 1000).alias("note"))

    new = keyed(wanted.where("a <> b")).groupBy("a", "b").agg(F.min("note").alias("note"))
    old = keyed(existing)
    return old.unionByName(new.join(old, ["a", "b"], "left_anti"))


def dismiss(events: DataFrame, match: Column, at: Column, restore: bool = False) -> DataFrame:
    """events with dismissed_at stamped (or cleared) on matching rows in the opposite state."""
    if restore:
        return events.withColumn("dismissed_at", F.when(match, F.lit(None)).otherwise(F.col("dismissed_at")))
    return events.withColumn("dismissed_at", F.when(match & F.col("dismissed_at").isNull(), at).otherwise(F.col("dismissed_at")))


def replace_glossary(vocabulary: DataFrame, fresh: DataFrame) -> DataFrame:
    """vocabulary with the rows of fresh's items replaced; manual rows (no item) stay, and no pair of an item stands twice."""
    kept = vocabulary.join(fresh.select("item_id").distinct(), "item_id", "left_anti")
    return kept.unionByName(fresh.dropDuplicates(["item_id", "term", "expansion"]))


def patch_captions(assets: DataFrame, changes: DataFrame, most: int = 4000) -> DataFrame:
    """assets after people's changes (asset_id, caption, target, ignore; null leaves a field, an empty target clears it).

    Captions are trimmed and cut at most characters.  Ignored wins; then any
    caption or target makes the attribution manual; without both it is what sync
    derives (sync_attribution).
    """
    new = changes.select("asset_id", F.substring(F.trim("caption"), 1, most).alias("_c"), F.col("target").alias("_t"), F.col("ignore").alias("_i"))
    joined = assets.join(new, "asset_id", "left").withColumns({"caption": F.coalesce("_c", "caption", F.lit("")), "target": F.coalesce("_t", "target", F.lit(""))})
    said = (F.length("caption") > 0) | (F.length("target") > 0)
    ignored = F.coalesce("_i", F.col("attribution") == "ignored", F.lit(False))
    changed = F.when(ignored, "ignored").when(said, "manual").otherwise(F.col("sync_attribution"))
    touched = F.col("_c").isNotNull() | F.col("_t").isNotNull() | F.col("_i").isNotNull()
    return joined.withColumn("attribution", F.when(touched, changed).otherwise(F.col("attribution"))).select(*assets.columns)


def record_fingerprint(state: DataFrame, fp: str) -> tuple[DataFrame, DataFrame]:
    """(state with fp as its one row, the warning event if the family changed); state: active_fp, no row before the first query."""
    spark = state.sparkSession
    family = F.substring_index("active_fp", ":", 1)
    message = F.concat(F.lit("embedding model changed ("), "active_fp", F.lit(f" -> {fp}); older vectors are keyword-only until re-embedded"))
    moved = state.where(F.col("active_fp").isNotNull() & (family != fp.split(":")[0]))
    event = moved.select(F.lit("embedder").alias("component"), F.lit("warning").alias("level"), message.alias("message"), F.lit("").alias("detail"))
    return spark.createDataFrame([(fp,)], "active_fp string"), event


def export_embeddings(vectors: DataFrame, kind: str = "chunk_embedding") -> DataFrame:
    """One typed JSON line per vector (uid, embedding binary, and embed_fp where there is one); rows without a vector are left out."""
    some = vectors.where("uid IS NOT NULL AND embedding IS NOT NULL")
    cells = [F.lit(kind).alias("type"), "uid", F.base64("embedding").alias("embedding_b64"), *(["embed_fp"] if "embed_fp" in vectors.columns else [])]
    return some.select(F.lit(kind).alias("type"), F.to_json(F.struct(*cells)).alias("record"))


def merge_last_writer(existing: DataFrame, incoming: DataFrame, key: str, stamp: str) -> DataFrame:
    """Full outer merge by key: the incoming row wins if its stamp is later; equal or missing stamps keep the old one."""
    cols = [c for c in existing.columns if c != key]
    a = existing.select(key, F.struct(*cols).alias("_a"))
    b = incoming.select(key, F.struct(*cols).alias("_b"))
    joined = a.join(b, key, "full_outer")
    wins = F.col("_a").isNull() | (F.col("_b").isNotNull() & F.coalesce(F.col(f"_b.{stamp}") > F.col(f"_a.{stamp}"), F.lit(False)))
    picked = F.when(wins, F.col("_b")).otherwise(F.col("_a"))
    return joined.withColumn("_r", picked).select(key, *[F.col(f"_r.{c}").alias(c) for c in cols])


def export_lines(tables: dict[str, DataFrame]) -> DataFrame:
    """One typed JSON line per record of every table."""
    parts = [df.select(F.lit(name).alias("type"), F.to_json(F.struct(*df.columns)).alias("record")) for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def collect_blobs(blobs: DataFrame, assets: DataFrame) -> DataFrame:
    """Blobs that an asset still refers to."""
    return blobs.join(assets.select("hash"), "hash", "left_semi")


def numbers(rows: DataFrame, order: str) -> DataFrame:
    """rows with n from 1 on in the order of a column of distinct values, without meeting in one task.

    Rows are range-partitioned by the column; a partition counts its own on top
    of what the partitions before it have.
    """
    scratch = Scratch(rows.sparkSession, "numbers")
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = scratch.write(rows.repartitionByRange(width, order).withColumn("_part", F.spark_partition_id()), "dealt")
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(upto), F.lit(0)).alias("_before"))  # a row per partition
    own = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return dealt.join(F.broadcast(before), "_part").withColumn("n", own + F.col("_before")).drop("_part", "_before")


def pseudonyms(rows: DataFrame, column: str, prefix: str) -> DataFrame:
    """rows with the column replaced by prefix and the place of its first appearance by id, ties by value."""
    first = rows.groupBy(column).agg(F.min("item_id").alias("_first")).withColumn("_at", F.struct("_first", column))
    named = numbers(first, "_at").select(F.col(column), F.concat(F.lit(prefix), F.col("n").cast("string")).alias("pseudonym"))
    return rows.join(named, column)
