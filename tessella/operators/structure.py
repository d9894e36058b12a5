"""Parsers run per document in Arrow batches; documents are independent, so nothing shuffles."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import configs, parsers
from ..functions import text as fx
from . import relations


def per_document(docs: DataFrame, key: str, text: str, schema: str, parse: Callable[..., list[tuple]], *given: str) -> DataFrame:
    """key and the fields of schema: a row for everything that parse finds in a document; null texts give none.

    parse gets the columns given behind the text.
    """
    fields = T.StructType.fromDDL(schema).fields
    out = T.StructType([docs.schema[key], *fields])
    kinds = [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for top in range(0, big.num_rows, 256):
                b = big.slice(top, 256)
                rows, which = [], []
                for k, (t, *more) in enumerate(zip(*[c.to_pylist() for c in b.columns[1:]], strict=True)):
                    found = parse(t, *more) if t is not None else []
                    rows += found
                    which += [k] * len(found)
                columns = list(zip(*rows, strict=True)) or [[] for _ in fields]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(which, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=out.names)

    return docs.select(key, text, *given).mapInArrow(run, out)


def cleaned(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    return per_document(docs, key, text, "clean string", lambda t: [(parsers.clean(t),)])


def snapped_windows(docs: DataFrame, key: str, text: str = "text", size: int = 800, overlap: int = 100) -> DataFrame:
    return per_document(docs, key, text, "idx int, window string", lambda t: list(enumerate(parsers.windows(t, size, overlap))))


#: Files that are cut by their symbols.
CODE = ("py", "pyi", "rb", "rs", "ts", "js", "go", "java", "cs", "c", "cpp")


def _kind(path: str) -> str:
    return path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""


def _stem(path: str) -> str:
    return re.sub(r"(?<=.)\.[^.]*$", "", re.split(r"[/\\]", path)[-1]).strip() or "Untitled document"


def chunk(path_kind: str, text: str, stem: str = "") -> list[tuple[int, str, int, int, str]]:
    """(idx, path, first line, last line, content): configuration by keys and list entries, markdown by blocks, code by symbols, other text by sections."""
    rows: list[tuple[str, int, int, str]] = []
    lines = text.split("\n")
    if parsers.is_minified(text):
        rows = [("", 1, len(lines), w) for w in parsers.windows(text, 2000, 0)]
    elif path_kind in ("yml", "yaml", "json", "jsonc", "toml"):
        rows = configs.config_chunks(text, path_kind)
    elif path_kind in ("md", "markdown"):
        rows = parsers.markdown_chunks(text, stem)
    elif path_kind in CODE:
        style = "indent" if path_kind in ("py", "pyi", "rb") else "brace"
        symbols = parsers.code_symbols(text, style)
        ends = [a - 1 for _, _, a, _ in symbols[1:]] + [len(lines)] * bool(symbols)  # up to the next symbol, so that no line stands twice
        rows = [(k, *p) for (k, _, a, _), b in zip(symbols, ends, strict=True) for p in parsers.line_pieces(lines, a, b)]
    if not rows:
        for s in parsers.prose_sections(text, ""):
            shown = parsers.paragraphs(s.body) or [s.title]  # a heading without a body is shown itself
            rows += [(s.path, s.start, s.end, p) for p in shown if p]
    return [(n, *r) for n, r in enumerate(rows)]


def parts(path: str, text: str) -> list[tuple]:
    """(section, title, path, level, parent, first line, last line, chunks) of a file's sections in order; chunks: (first line, last line, content).

    A section without chunks of its own (a parent, a bare heading) is there too.
    """
    kind, stem, lines = _kind(path), _stem(path), text.split("\n")
    if kind in ("yml", "yaml", "json", "jsonc", "toml") and not parsers.is_minified(text):
        return [(n, s.title, s.path, s.level, s.parent, s.first, s.last, [(a, b, "\n".join(lines[a - 1 : b])) for a, b in s.chunks]) for n, s in enumerate(configs.sections(text, kind))]
    if kind in ("md", "markdown") and not parsers.is_minified(text):
        out = []
        for n, s in enumerate(parsers.markdown_sections(text, stem)):
            own = parsers.markdown_packed(s)
            out.append((n, s["title"], s["path"], s["level"], s["parent"], own[0][1] if own else 1, own[-1][2] if own else 1, [x[1:] for x in own]))
        return out
    rows = chunk(kind, text, stem)
    if kind in CODE or parsers.is_minified(text):
        root = (0, stem, stem, 0, None, 1, len(lines), [x[2:] for x in rows if not x[1]])
        named = [(x[1], x[2:]) for x in rows if x[1]]
        groups = [(name, [v for _, v in run]) for name, run in groupby(named, lambda x: x[0])]
        return [root] + [(n, name, f"{stem} > {name}", 1, 0, run[0][0], run[-1][1], run) for n, (name, run) in enumerate(groups, 1)]
    out = []
    for n, s in enumerate(parsers.prose_sections(text, stem)):
        own = [(s.start, s.end, x) for x in parsers.paragraphs(s.body) or ([s.title] if n else []) if x]
        out.append((n, s.title, s.path, s.level, s.parent, s.start, s.end, own))
    return out


#: Files whose text is cleaned before it is parsed.
CLEANED = r"\.(pdf|txt|docx|odt|rtf|html?|eml)$"
#: The tags that a section and a whole text have.
SECTION_TAGS, TEXT_TAGS = 4, 2
RECORDS = "kind string, title string, record_id string, status string, owner string, due string, supersedes array<string>, done boolean"
_FOUND = f"""section int, title string, path string, level int, parent int, first_line int, last_line int, chunks array<struct<at:int,content:string,first_page:int,last_page:int>>,
whole string, pairs array<struct<term:string,expansion:string,origin:string>>, records array<struct<{RECORDS.replace(" ", ":").replace(",:", ",")}>>"""


def _found(text: str, path: str, is_record: bool, is_glossary: bool) -> list[tuple]:
    """Rows of _FOUND: the sections, whose chunks are numbered and paged through the file, and one of the whole text with its pairs and records."""
    rows, at, page = [], 0, None
    for section, title, name, level, parent, first, last, own in parts(path, text):
        chunks = []
        for _, _, content in own:
            begins, page = parsers.pages(content, page)
            chunks.append({"at": at, "content": content, "first_page": begins, "last_page": page})
            at += 1
        rows.append((section, title, name, level, parent, first, last, chunks, None, [], []))
    pairs = [(*p, "glossary") for p in (parsers.glossary(text) if is_glossary else [])] + [(*p, "rule") for p in parsers.initialisms(text)]
    names = [f.split()[0] for f in RECORDS.split(", ")]
    records = [dict(zip(names, r, strict=True)) for r in (_records(text) if is_record else [])]
    return [*rows, (None, None, "", None, None, None, None, [], text, [dict(zip(("term", "expansion", "origin"), p, strict=True)) for p in pairs], records)]


def structured(items: DataFrame, key: str, path: str, text: str = "text") -> DataFrame:
    """What one pass over the files finds, without a shuffle: a row per section and, where section is null, one per file.

    Sections have title, path, level, parent, first_line, last_line and leaves
    (at: their number in the file, path, content), in order; both have their
    summary (null: none) and tags; files have pairs (of terms) and records.
    Texts of some kinds are cleaned first.  Paths have their pages, and leaves
    stand without the lines of page marks, where a text has them.
    """
    name = F.lower(path)
    taken = items.select(key, path, text, name.rlike(CLEANED).alias("_clean"))
    whole = per_document(taken, key, text, f"{path} string, _text string", lambda t, p, dirty: [(p, parsers.clean(t) if dirty else t)], path, "_clean")
    told = whole.select(key, path, "_text", (fx.bucket(F.col("_text")) == "record").alias("_record"), name.rlike("glossary|vocabulary").alias("_glossary"))
    rows = per_document(told, key, "_text", _FOUND, _found, path, "_record", "_glossary")

    def leaf(c: Column) -> Column:
        crumb = fx.page_crumb(c["first_page"], c["last_page"])
        paged = F.when((F.col("path") != "") & crumb.isNotNull(), F.concat("path", F.lit(" "), crumb)).otherwise(F.col("path"))
        bare = F.regexp_replace(c["content"], r"(?m)^[ \t]*\[page [1-9][0-9]*\][ \t]*\n?", "")
        return F.struct(c["at"].alias("at"), paged.alias("path"), F.when(c["content"].contains("[page "), bare).otherwise(c["content"]).alias("content"))

    leaves = F.filter(F.transform("chunks", leaf), lambda c: F.trim(c["content"]) != "")
    span = fx.page_crumb(F.array_min("chunks.first_page"), F.array_max("chunks.last_page"))
    # not in one step: in a lambda function Spark takes a column that is made beside it for the one from below
    rows = rows.withColumn("leaves", leaves).withColumn("path", F.concat_ws(" ", F.nullif("path", F.lit("")), span))
    headed = (F.col("title") != "") & ((F.col("level") > 0) | (F.col("first_line") > 1)) & (F.size("leaves") > 0)
    summary = F.when(F.col("section").isNull(), fx.document_summary(F.col("whole"))).when(headed, fx.section_summary(F.array_join("leaves.content", "\n\n")))
    rows = rows.withColumn("summary", F.nullif(summary, F.lit("")))
    # a section without text goes by its title, untitled ones have no tags
    own = F.array_join(F.concat("leaves.content", F.array_compact(F.array("summary"))), "\n\n")
    rows = rows.withColumn("_own", F.lower(F.when(F.col("section").isNull(), F.col("whole")).when(F.col("title") != "", F.concat("title", F.lit("\n"), own))))
    tags = F.slice(relations.top_words(F.col("_own"), max(SECTION_TAGS, TEXT_TAGS)), F.lit(1), F.when(F.col("section").isNull(), TEXT_TAGS).otherwise(SECTION_TAGS))
    return rows.select(key, "section", "title", "path", "level", "parent", "first_line", "last_line", "leaves", "summary", tags.alias("tags"), "pairs", "records")


def chunked(items: DataFrame, key: str, path: str, text: str = "text") -> DataFrame:
    """Chunks of every item by the rules of its file kind."""
    tagged = items.select(key, F.concat(F.col(path), F.lit("\0"), F.col(text)).alias("_t"))

    def parse(t: str) -> list[tuple]:
        p, _, body = t.partition("\0")
        return chunk(_kind(p), body, _stem(p))

    return per_document(tagged, key, "_t", "idx int, path string, first_line int, last_line int, content string", parse)


def config_sections(docs: DataFrame, key: str, path: str, text: str = "text") -> DataFrame:
    """idx, title, path, level, parent, lines and promoted pairs of the sections of configuration texts."""
    tagged = docs.select(key, F.concat(F.col(path), F.lit("\0"), F.col(text)).alias("_t"))

    def parse(t: str) -> list[tuple]:
        p, _, body = t.partition("\0")
        return [(n, s.title, s.path, s.level, s.parent, s.first, s.last, list(s.promoted.items())) for n, s in enumerate(configs.sections(body, _kind(p)))]

    return per_document(tagged, key, "_t", "idx int, title string, path string, level int, parent int, first_line int, last_line int, promoted map<string,string>", parse)


def sectioned(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    def parse(t: str) -> list[tuple]:
        return [(n, s.title, s.level, s.path, s.parent, s.start, s.end) for n, s in enumerate(parsers.prose_sections(t, "root"))]

    return per_document(docs, key, text, "idx int, title string, level int, path string, parent int, first_line int, last_line int", parse)


def _records(text: str) -> list[tuple]:
    r = parsers.record(text)
    if not r:
        return []
    rows = [("decision", r["title"], r["record_id"], r["status"], r["owner"], r["date"], r["supersedes"], None)] if r["decision"] else []
    return rows + [("action", a["text"], None, None, a["owner"], a["due"], [], a["done"]) for a in r["actions"]]


def parsed_records(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """A row per decision and per action of every record text."""
    return per_document(docs, key, text, RECORDS, _records)


def glossary_pairs(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    return per_document(docs, key, text, "term string, expansion string", parsers.glossary)


def initialism_pairs(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    return per_document(docs, key, text, "term string, expansion string", parsers.initialisms)


def embedded(docs: DataFrame, key: str, text: str = "text", dim: int = 768, stopwords: frozenset[str] | None = None) -> DataFrame:
    """key and embedding: hash vectors; with stopwords as evaluations make them (256 dimensions there)."""
    return per_document(docs, key, text, "embedding array<double>", lambda t: [(parsers.hash_embedding(t, dim, stopwords),)])
