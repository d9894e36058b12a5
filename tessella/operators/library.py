"""Tags, vocabulary, assets, captions, named files and page slots."""

from __future__ import annotations

import bisect
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import LEAF_KINDS
from .index import KeywordIndex
from .retrieval import keyword_scores


def propose_tags(sections_text: DataFrame, key: str, text: str) -> DataFrame:
    """key and tag: the four most frequent words of a section with its title."""
    from .relations import top_terms

    return top_terms(sections_text, key, text, 4).select(key, F.col("term").alias("tag"), "place")


#: Cosine of two names' words over which a new name of several words means a known tag.
SAME_TAG = 0.82
TOKENS = r"[\p{L}\p{N}]+"


def tag_links(sections: DataFrame, chunks: DataFrame, items: DataFrame) -> DataFrame:
    """chunk_id and tag: the top four words of each titled section for its chunks, the top two of a whole text for its document summaries.

    sections: section_id, title; items: item_id, text.  A section without text
    goes by its title; untitled ones have no tags.
    """
    titled = sections.where(F.coalesce(F.length("title"), F.lit(0)) > 0).select("section_id", "title")
    own = chunks.where("section_id IS NOT NULL").groupBy("section_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_id", "content"))), lambda x: x["content"]), "\n\n").alias("_text"))
    text = F.concat("title", F.lit("\n"), F.coalesce("_text", F.lit("")))
    of_sections = propose_tags(titled.join(own, "section_id", "left").select("section_id", text.alias("text")), "section_id", "text")
    of_items = propose_tags(items.select("item_id", "text"), "item_id", "text").where("place <= 2")
    first = of_sections.join(chunks.select("chunk_id", "section_id"), "section_id").select("chunk_id", "tag")
    return first.unionByName(of_items.join(chunks.where("kind = 'doc_summary'").select("chunk_id", "item_id"), "item_id").select("chunk_id", "tag")).distinct()


def reuse_tags(wanted: DataFrame, tags: DataFrame, least: float = SAME_TAG) -> DataFrame:
    """name, tag: what each wanted name (trimmed, lower case) is called among the tags (name).

    A known name is itself, and so is a single word.  A name of several words
    takes the tag whose words have the highest cosine with its own, if that is
    over least (ties: the smaller name), else it is new.  Only names and tags
    that share one of the name's rarer words meet: its most frequent words that
    are too few to reach least by themselves are left out of the join.
    """
    norm = F.lower(F.trim("name"))
    asked = wanted.select(norm.alias("name")).where("name <> ''").distinct()
    known = tags.select(norm.alias("tag")).where("tag <> ''").distinct()

    def bags(rows: DataFrame, name: str) -> DataFrame:
        words = rows.select(name, F.explode(F.regexp_extract_all(F.col(name), F.lit(TOKENS), 0)).alias("word"))
        counted = words.groupBy(name, "word").agg(F.count("*").alias("n"))
        return counted.withColumn("size", F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(name)))

    have = bags(known, "tag")
    several = asked.join(known, F.col("name") == F.col("tag"), "left_anti").where(F.size(F.regexp_extract_all("name", F.lit(TOKENS), 0)) > 1)
    frequent = have.groupBy("word").agg(F.count("*").alias("_tags"))
    own = bags(several, "name").join(frequent, "word")  # a word that no tag has joins nothing
    rest = Window.partitionBy("name").orderBy(F.desc("_tags"), "word").rowsBetween(Window.unboundedPreceding, 0)
    # the most frequent words, as long as they alone could not reach the bar
    rare = own.withColumn("_most", F.sum(F.col("n") * F.col("n")).over(rest)).where(F.col("_most") >= least * least * F.col("size"))
    pairs = rare.select("name", "word").join(have.select("tag", "word"), "word").select("name", "tag").distinct()
    product = pairs.join(own.select("name", "word", F.col("n").alias("_n"), F.col("size").alias("_size")), "name").join(have, ["tag", "word"])
    cosine = F.sum(F.col("_n") * F.col("n")) / F.sqrt(F.first("_size") * F.first("size"))
    best = product.groupBy("name", "tag").agg(F.round(cosine, 9).alias("cosine")).where(F.col("cosine") > least)
    found = best.groupBy("name").agg(F.min_by("tag", F.struct(-F.col("cosine"), F.col("tag"))).alias("_tag"))
    return asked.join(found, "name", "left").select("name", F.coalesce("_tag", "name").alias("tag"))


def ensure_tags(tags: DataFrame, used: DataFrame) -> DataFrame:
    """tags (name, usage) after use: known names add to their usage, new names come in with theirs."""
    new = used.groupBy("name").agg(F.count("*").alias("_n"))
    return tags.join(new, "name", "full_outer").select("name", (F.coalesce("usage", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("usage"))


def recount_tags(tags: DataFrame, links: DataFrame) -> DataFrame:
    """Tags with their usage counted from links; unused ones go."""
    return tags.select("name").join(links.groupBy("name").agg(F.count("*").alias("usage")), "name")


def chunks_of_tag(tags: DataFrame, links: DataFrame, chunks: DataFrame, name: str) -> DataFrame:
    one = tags.where(F.col("name") == name).select("name")
    return links.join(F.broadcast(one), "name").join(chunks, "chunk_id").orderBy("chunk_id")  # one tag


def set_project_sources(current: DataFrame, project: int, wanted: DataFrame, sources: DataFrame) -> DataFrame:
    """current (project_id, source_id) with the project's set replaced by the known, distinct wanted ids."""
    known = wanted.select("source_id").distinct().join(sources.select("source_id"), "source_id", "left_semi")
    return current.where(F.col("project_id") != project).unionByName(known.select(F.lit(project).alias("project_id"), "source_id"))


def unknown_sources(wanted: DataFrame, sources: DataFrame) -> DataFrame:
    """Ids that a project must not be given: any row here refuses the whole change."""
    return wanted.select("source_id").distinct().join(sources.select("source_id"), "source_id", "left_anti")


def attribution(assets: DataFrame, refs: DataFrame, least_words: int = 5) -> DataFrame:
    """assets with attribution: embedded with words around it, referenced by some other place, else none; a person's value stays."""
    elsewhere = refs.select("path").distinct().withColumn("_ref", F.lit(True))
    auto = F.when(F.col("kind").eqNullSafe("embed") & (F.col("words") >= least_words), "embedded").when(F.coalesce("_ref", F.lit(False)), "referenced").otherwise("none")
    return assets.join(elsewhere, "path", "left").withColumn("attribution", F.when(F.col("by_person"), F.col("attribution")).otherwise(auto)).drop("_ref")


def caption_chunks(assets: DataFrame) -> DataFrame:
    """A caption leaf for every asset with a caption: chunk_id, item_id, section_id, kind, content."""
    own = assets.where(F.length(F.trim("caption")) > 0)
    return own.select("chunk_id", "item_id", "section_id", F.lit("caption").alias("kind"), F.trim("caption").alias("content"))


def _file_names(question: str) -> list[str]:
    import re

    words = [w.strip("\"'`()[]{},;:?!") for w in question.split()]
    named = [w.rstrip(".") for w in words if "." in w.rstrip(".") and len(w.encode()) >= 4 and re.search(r"[A-Za-z]", w)]
    return [w for w in named if not re.fullmatch(r"v?\d+(\.\d+)+([-+.]\w+)?", w)]


def filename_tokens(question: str) -> list[str]:
    """The first three tokens with a dot inside, of four bytes or more, with a letter, that are no version."""
    return _file_names(question)[:3]


def without_file_names(question: str) -> str:
    for name in _file_names(question):
        question = question.replace(name, " ")
    return question


def named_item(items: DataFrame, token: str) -> DataFrame:
    """The item a file name means: of the first 25 that contain it, best by exact name, then suffix, then length of path and id."""
    low, path = token.lower(), F.lower("external_id")
    base = F.element_at(F.split(path, "/"), -1)
    tier = F.when(base == low, 0).when(path.endswith(low), 1).otherwise(2)
    found = items.where(path.contains(low)).orderBy("item_id").limit(25)
    return found.withColumn("tier", tier).orderBy("tier", F.length("external_id"), "item_id").limit(1).select("item_id", "external_id", "tier")


def named_items(items: DataFrame, question: str) -> DataFrame:
    """item_id of the up to three items whose files the question names."""
    found = [named_item(items, token).select("item_id") for token in filename_tokens(question)]
    return reduce(DataFrame.unionByName, found, items.select("item_id").limit(0)).distinct()


def boosted(hits: DataFrame, named: DataFrame, chunks: DataFrame, question: str, index: KeywordIndex | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """hits with a leaf of each named item on top (score over all others) and the mark boosted.

    The leaf is the item's best one for the question without its file names (looked up in the index, if there is one), and the first where none matches.
    """
    top = hits.agg(F.max("score").alias("_top"))
    ids = F.broadcast(named.select("item_id").distinct())  # three items at most
    first = chunks.where(F.col("kind").isin(*LEAF_KINDS)).join(ids, "item_id", "left_semi").groupBy("item_id").agg(F.min("chunk_id").alias("_first"))
    matches = keyword_scores(index or chunks, without_file_names(question), extra=extra, scope=ids)
    best = matches.groupBy("item_id").agg(F.max_by("chunk_id", F.struct("score", -F.col("chunk_id"))).alias("_best"))
    leaves = first.join(best, "item_id", "left").select(F.coalesce("_best", "_first").alias("chunk_id"), "item_id")
    up = leaves.join(F.broadcast(top)).select("chunk_id", "item_id", (F.coalesce("_top", F.lit(0.0)) + 1).alias("score"), F.lit(True).alias("boosted"))
    rest = hits.join(up.select("chunk_id"), "chunk_id", "left_anti").select("chunk_id", "item_id", "score", F.lit(False).alias("boosted"))
    return up.unionByName(rest)


def evict(page: DataFrame, need: int) -> DataFrame:
    """page without its need lowest hits, those first whose kind is unknown or stands higher up too."""
    up = Window.partitionBy("doc_type").orderBy("rank")
    spare = (F.row_number().over(up) > 1) | F.col("doc_type").isNull()
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("_spare"), F.desc("rank"))
    marked = page.withColumn("_spare", spare).withColumn("_n", F.row_number().over(order))  # a page of at most 50 rows
    return marked.where(F.col("_n") > need).drop("_spare", "_n")


def shredded(text: Column) -> Column:
    """Text that looks torn apart: most words of one or two characters over at least forty words of the whole text."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    short = F.size(F.filter(words, lambda w: F.length(w) <= 2))
    return (F.size(words) >= 40) & (short > 0.6 * F.size(words))


def split_suspects(text: str, known: frozenset[str]) -> tuple[int, int]:
    """(short unknown fragments beside a word, and pairs that join to a known word with an unknown side; tokens) of a text."""
    import re

    words = [re.sub(r"^[\W_]+|[\W_]+$", "", w).lower() for w in text.split()]
    words = [w for w in words if w]
    plain = [re.fullmatch("[a-z]+", w) is not None for w in words]
    found = 0
    for i, w in enumerate(words):
        beside = i > 0 and "a" <= words[i - 1][-1] <= "z" or i + 1 < len(words) and "a" <= words[i + 1][0] <= "z"
        found += plain[i] and 2 <= len(w) <= 4 and w not in known and beside
        if i + 1 < len(words) and plain[i] and plain[i + 1]:
            v = words[i + 1]
            found += len(w) >= 2 and len(v) >= 2 and len(w + v) >= 5 and w + v in known and not (w in known and v in known)
    return found, len(words)


#: Words that a lexicon has, at most: the most frequent ones.
LEXICON = 200_000


def lexicon(items: DataFrame, least: int = 3, most: int = LEXICON) -> frozenset[str]:
    """The words of ASCII letters that at least so many items have, counted over all items that are no PDF files.

    It stands in for a word list: torn words come from PDF files, so these do
    not vote.  At most LEXICON words, so it may be broadcast.
    """
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))
    told = items.where(~F.coalesce(is_pdf(F.col("external_id")), F.lit(False))).select(F.explode(words).alias("word"))
    counted = told.where(F.col("word").rlike("^[a-z]{2,40}$")).groupBy("word").agg(F.count("*").alias("n"))
    return frozenset(r["word"] for r in counted.where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(most).collect())


def is_pdf(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, r"[/\\\\]"), -1)).endswith(".pdf")


def suspects(items: DataFrame, known: frozenset[str]) -> DataFrame:
    """item_id of PDF files whose whole text is torn, by these words."""
    return items.where(is_pdf(F.col("external_id"))).where(split_words(F.col("text"), known)).select("item_id")


def split_words(text: Column, known: frozenset[str]) -> Column:
    """Six split words at least, and six in a thousand tokens; known: all words that are no fragments."""

    def trips(texts: pd.Series) -> pd.Series:
        found = [split_suspects(t or "", known) for t in texts]
        return pd.Series([k >= 6 and k * 1000 >= n * 6 for k, n in found], dtype=bool)

    return F.pandas_udf(trips, "boolean")(text)


def quality_flags(items: DataFrame, events: DataFrame, known: frozenset[str] | None = None) -> DataFrame:
    """item_id and flag of every item: of PDF files suspect from the whole text now, else repaired if an event says so; else null.

    With a list of known words split words are looked for, without one shredded text.
    """
    fixed = events.select("item_id").distinct().withColumn("_fixed", F.lit(True))
    suspect = shredded(F.col("text")) if known is None else split_words(F.col("text"), known)
    flag = F.when(F.coalesce(is_pdf(F.col("external_id")), F.lit(False)), F.when(suspect, "suspect").when(F.col("_fixed"), "repaired"))
    return items.join(fixed, "item_id", "left").select("item_id", flag.alias("flag"))


def entity_context(entities: DataFrame, chunks: DataFrame, width: int = 160) -> DataFrame:
    """entity_id with the first chunk of its item that holds its first characters, and that chunk's neighbours (ids).

    The texts of one item's chunks are searched as one, once for each of its
    entities, so no pairs of entities and chunks are made.
    """
    schema = "entity_id long, chunk_id long, before long, after long"

    def search(own: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        parts = parts.sort_values("chunk_id")
        ids, texts = parts["chunk_id"].tolist(), parts["content"].tolist()
        ends, end = [], 0
        for t in texts:
            end += len(t) + 1
            ends.append(end)
        whole, rows = "\0".join(texts), []
        for entity, text in zip(own["entity_id"], own["text"], strict=True):
            at = whole.find(text[:width])
            if at >= 0 and "\0" not in text[:width]:
                k = bisect.bisect_right(ends, at)
                rows.append((entity, ids[k], ids[k - 1] if k else None, ids[k + 1] if k + 1 < len(ids) else None))
        return pd.DataFrame(rows, columns=["entity_id", "chunk_id", "before", "after"]).astype("Int64")

    told = entities.where("text IS NOT NULL AND item_id IS NOT NULL").select("entity_id", "item_id", F.substring("text", 1, width).alias("text"))
    parts = chunks.where("content IS NOT NULL").select(F.col("item_id").alias("_item"), "chunk_id", "content")
    parts = parts.join(told.select(F.col("item_id").alias("_item")).distinct(), "_item", "left_semi")
    return told.groupBy("item_id").cogroup(parts.groupBy("_item")).applyInPandas(search, schema)


def claimed_neighbours(hits: DataFrame, around: DataFrame) -> DataFrame:
    """Each neighbour id goes to the best-ranked hit that wants it, and never to a chunk that is a hit itself."""
    wants = hits.select("chunk_id", "rank").join(around, "chunk_id").select("rank", "chunk_id", F.explode(F.array("before_1", "after_1")).alias("extra")).where("extra IS NOT NULL")
    free = wants.join(hits.select(F.col("chunk_id").alias("extra")), "extra", "left_anti")
    by = Window.partitionBy("extra").orderBy("rank")
    return free.withColumn("_n", F.row_number().over(by)).where("_n = 1").select("rank", "chunk_id", "extra")


def embed_input(breadcrumb: Column, content: Column) -> Column:
    """Breadcrumb, a new line, and the text with links replaced by their labels."""
    plain = F.regexp_replace(content, r"!?\[([^\]]*)\]\((?:[^()]|\([^()]*\))*\)", "$1")
    return F.when(F.length(F.coalesce(breadcrumb, F.lit(""))) > 0, F.concat(breadcrumb, F.lit("\n"), plain)).otherwise(plain)


