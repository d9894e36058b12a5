"""Paged JSON APIs as a Spark data source, and the documents of four trackers and boards from their pages.

A list (a project, a team, a board) is a partition: its pages follow one another
by token, number or offset, different lists are read side by side.  What comes
out are raw bodies, so that mapping is ordinary DataFrame work and recorded
pages read from files serve as well.
"""

from __future__ import annotations

import base64
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructType

from ..functions import parsers

#: Pages of a list: what is read if nothing is said, and at most.
PAGES, MOST_PAGES = 20, 200
#: How often a request is repeated that the server asks to send later.
RETRIES = 4


def authorization(options: dict[str, str]) -> dict[str, str]:
    """The header of auth_mode none, bearer, basic or header."""
    mode = options.get("auth_mode", "none")
    if mode == "bearer":
        return {"Authorization": f"Bearer {options['token']}"}
    if mode == "basic":
        return {"Authorization": "Basic " + base64.b64encode(f"{options['email']}:{options['password']}".encode()).decode()}
    if mode == "header":
        return {options["header_name"]: options["api_key"]}
    if mode != "none":
        raise ValueError(f"unknown auth_mode: {mode!r}")
    return {}


def at(body, pointer: str):
    """The value at a pointer (a.b or /a/b), or None."""
    names = pointer.strip("/").split("/") if pointer.startswith("/") else pointer.split(".")
    for name in filter(None, names):
        name = name.replace("~1", "/").replace("~0", "~")
        body = body.get(name) if isinstance(body, dict) else body[int(name)] if isinstance(body, list) and name.isdigit() and int(name) < len(body) else None
    return body


def items_of(body, pointer: str = "") -> list:
    """The array at the pointer, else the body itself, else /data, /items or /results."""
    for found in [at(body, pointer)] if pointer else [body, *(body.get(k) for k in ("data", "items", "results"))] if isinstance(body, dict) else [body]:
        if isinstance(found, list):
            return found
    return []


def request(url: str, method: str, params: dict[str, str], headers: dict[str, str], body: str) -> object:
    """A JSON answer; None for 404.  Asked to come later (429), it waits as told, or longer each time."""
    if method == "POST":
        data = json.dumps({**json.loads(body or "{}"), **params}).encode()
        headers = {"Content-Type": "application/json", **headers}
    else:
        data, url = None, url + ("&" if "?" in url else "?") * bool(params) + urllib.parse.urlencode(params)
    for turn in range(RETRIES + 1):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, data, headers, method=method), timeout=60) as answer:
                return json.load(answer)
        except urllib.error.HTTPError as e:
            if e.code == 404:
                return None
            if e.code != 429 or turn == RETRIES:
                raise RuntimeError(f"{method} {url} failed ({e.code}): {e.read()[:300].decode('utf-8', 'replace')}") from None
            wait = e.headers.get("Retry-After", "")
            time.sleep(min(60.0, float(wait) if wait.replace(".", "", 1).isdigit() else 2.0**turn))
    return None


def pages(options: dict[str, str], path: str, since: str = "") -> Iterator[object]:
    """The bodies of one list, page by page, until one is empty, the last, or the most allowed."""
    mode, size = options.get("page_mode", "none"), int(options.get("page_size", "50"))
    url = path if path.startswith("http") else options["base_url"].rstrip("/") + path
    number, token = int(options.get("page_start", "1")), ""
    for turn in range(min(MOST_PAGES, max(1, int(options.get("max_pages", PAGES))))):
        params = {options["since_param"]: since} if since and options.get("since_param") else {}
        if mode == "token" and token:
            params[options.get("page_param", "pageToken")] = token
        elif mode == "page":
            params |= {options.get("page_param", "page"): str(number + turn), options.get("page_size_param", "per_page"): str(size)}
        elif mode == "offset":
            params |= {options.get("offset_param", "offset"): str(turn * size), options.get("limit_param", "limit"): str(size)}
        body = request(url, options.get("method", "GET").upper(), params, authorization(options), options.get("body_json", ""))
        found = items_of(body, options.get("items_path", ""))
        if not found:
            return
        yield body
        token = at(body, options.get("next_token_path", "/nextPageToken")) if mode == "token" else ""
        if mode == "none" or mode == "token" and not token or mode in ("page", "offset") and len(found) < size:
            return


class _List(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [_List(p.strip()) for p in self.options["list_path"].split(",") if p.strip()]

    def read(self, partition: _List) -> Iterator[tuple]:
        for n, body in enumerate(pages(self.options, partition.path, self.options.get("since", ""))):
            yield partition.path, n, json.dumps(body)


class PagedSource(DataSource):
    """list, page, body of the lists at list_path (comma separated); options as ``pages`` and ``authorization`` name them."""

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "list string, page int, body string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_pages(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    spark.dataSource.register(PagedSource)
    return spark.read.format("paged_json").options(**options).load()


# ---- documents from pages ----------------------------------------------------------


def _flat_text(node: str | None) -> str:
    if not node or not node.lstrip().startswith(("{", "[")):
        return node or ""
    lines = parsers.flatten_adf(json.loads(node)).split("\n")
    return "\n".join(v.strip() for v in lines if v.strip())


@F.pandas_udf(StringType())
def _flat(nodes: pd.Series) -> pd.Series:
    """An issue tracker's rich text, or a plain string, as text."""
    return nodes.map(_flat_text)


def _each(bodies: DataFrame, *paths: str) -> DataFrame:
    """bodies with a row per element of the first array that is there."""
    found = [F.from_json(F.get_json_object("body", p), "array<string>") for p in paths]
    return bodies.withColumn("item", F.explode(F.coalesce(*found)))


def _text(path: str, of: str = "item") -> Column:
    return F.coalesce(F.get_json_object(of, path), F.lit(""))


def _documents(rows: DataFrame, external_id: Column, title: Column, parts: Column, author: Column, updated: str, kind: str) -> DataFrame:
    """external_id, title (else the id), text (parts that are there, a blank line between), author, updated, source_ref."""
    made = rows.select(
        external_id.alias("external_id"), F.coalesce(F.nullif(title, F.lit("")), external_id).alias("title"), F.array_join(F.filter(parts, lambda p: p != ""), "\n\n").alias("text"),
        author.alias("author"), F.try_to_timestamp(_text(updated)).alias("updated"),
    )
    return made.withColumn("source_ref", F.concat(F.lit(kind + ":"), "external_id"))


def jira_options(base_url: str, email: str, token: str, projects: list[str], since: str = "") -> dict[str, str]:
    """Issues of projects by the time of their change, after since, in pages of fifty by token."""
    quoted = ",".join(f'"{p}"' for p in projects)
    jql = (f"project in ({quoted})" if len(projects) > 1 else f"project = {quoted}") + (f' AND updated > "{since}"' if since else "") + " ORDER BY updated ASC"
    query = urllib.parse.urlencode({"jql": jql, "maxResults": "50", "fields": "summary,description,comment,updated,creator,assignee,status"})
    return {
        "base_url": base_url, "list_path": f"/rest/api/3/search/jql?{query.replace(',', '%2C')}", "auth_mode": "basic", "email": email, "password": token, "items_path": "/issues",
        "page_mode": "token", "page_param": "nextPageToken", "next_token_path": "/nextPageToken", "max_pages": str(MOST_PAGES),
    }


def jira_documents(bodies: DataFrame) -> DataFrame:
    rows = _each(bodies, "$.issues")
    comments = F.coalesce(F.from_json(F.get_json_object("item", "$.fields.comment.comments"), "array<struct<body:string>>"), F.array().cast("array<struct<body:string>>"))
    rows = rows.withColumn("_n", F.monotonically_increasing_id())
    said = rows.select("_n", F.posexplode(comments).alias("at", "c")).select("_n", "at", _flat("c.body").alias("text"))
    said = said.groupBy("_n").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]).alias("_said"))
    rows = rows.withColumn("_desc", _flat(F.get_json_object("item", "$.fields.description"))).join(said, "_n", "left")
    title = _text("$.fields.summary")
    head = F.array(title, F.concat(F.lit("Status: "), _text("$.fields.status.name")), F.concat(F.lit("Assignee: "), _text("$.fields.assignee.displayName")), F.col("_desc"))
    parts = F.concat(head, F.coalesce("_said", F.array().cast("array<string>")))
    return _documents(rows, _text("$.key"), title, parts, F.lit(""), "$.fields.updated", "Jira")


def linear_documents(bodies: DataFrame) -> DataFrame:
    """Issues from pages of a team's query."""
    rows = _each(bodies, "$.data.issues.nodes", "$.data.team.issues.nodes")
    said = F.transform(F.coalesce(F.from_json(F.get_json_object("item", "$.comments.nodes"), "array<struct<body:string>>"), F.array().cast("array<struct<body:string>>")), lambda c: F.coalesce(c["body"], F.lit("")))
    title, assignee = _text("$.title"), _text("$.assignee.name")
    parts = F.concat(F.array(title, F.concat(F.lit("State: "), _text("$.state.name")), F.concat(F.lit("Assignee: "), assignee), _text("$.description")), said)
    named = F.coalesce(F.nullif(_text("$.identifier"), F.lit("")), _text("$.id"))
    return _documents(rows, named, title, parts, F.coalesce(F.nullif(_text("$.creator.name"), F.lit("")), assignee), "$.updatedAt", "Linear")


#: What native files are exported as: kind of the extractor and MIME type.
EXPORTS = {
    "application/vnd.google-apps.document": ("txt", "text/plain"),
    "application/vnd.google-apps.spreadsheet": ("csv", "text/csv"),
    "application/vnd.google-apps.presentation": ("txt", "text/plain"),
}


def drive_plan(bodies: DataFrame) -> DataFrame:
    """external_id, title, updated, kind (of the extractor; null: left out), export (MIME type of native files) of a flat folder's files; folders go."""
    rows = _each(bodies, "$.files")
    mime, name = _text("$.mimeType"), _text("$.name")
    native = mime.startswith("application/vnd.google-apps.")
    known = F.create_map(*[F.lit(x) for k, (kind, _) in EXPORTS.items() for x in (k, kind)])
    types = F.create_map(*[F.lit(x) for k, (_, out) in EXPORTS.items() for x in (k, out)])
    by_name = F.when(name.contains("."), F.lower(F.element_at(F.split(name, r"\."), -1)))
    by_mime = F.when(mime == "text/plain", "txt").when(mime == "text/html", "html").when(mime == "text/csv", "csv").when(mime == "application/pdf", "pdf")
    kind = F.when(native, F.coalesce(known[mime], F.lit("pdf"))).otherwise(F.coalesce(by_mime, by_name))
    export = F.when(native, F.coalesce(types[mime], F.lit("application/pdf")))
    planned = rows.where(mime != "application/vnd.google-apps.folder")
    return planned.select(_text("$.id").alias("external_id"), name.alias("title"), F.try_to_timestamp(_text("$.modifiedTime")).alias("updated"), kind.alias("kind"), export.alias("export"))


def boards_to_fetch(boards: DataFrame, known: DataFrame) -> DataFrame:
    """board_id and modified_at of the boards (body: a board) that are new or changed since known (board_id, modified_at); each id once."""
    listed = boards.select(_text("$.id", "body").alias("board_id"), _text("$.modifiedAt", "body").alias("modified_at")).where("board_id <> ''").dropDuplicates(["board_id"])
    return listed.join(known.where("modified_at <> ''"), ["board_id", "modified_at"], "left_anti")


def _plain(c: Column) -> Column:
    """HTML of a note as a line of text."""
    text = F.regexp_replace(F.regexp_replace(c, r"(?i)<br\s*/?>|</p>", " "), "<[^>]+>", "")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def board_documents(boards: DataFrame, items: DataFrame, links: DataFrame) -> DataFrame:
    """A document per board: its description, notes by frame and place (top to bottom, left to right), and what is linked to what.

    boards: body; items and links: board_id, item (JSON of an item, of a connector).
    """
    kind = _text("$.type")
    note = F.when(kind.isin("sticky_note", "shape", "text"), _plain(_text("$.data.content"))).when(
        kind.isin("card", "app_card"), F.array_join(F.filter(F.array(_plain(_text("$.data.title")), _plain(_text("$.data.description"))), lambda v: v != ""), " — ")
    )
    number = lambda p: F.coalesce(F.get_json_object("item", p).cast("double"), F.lit(0.0))
    placed = items.select("board_id", _text("$.id").alias("id"), kind.alias("type"), F.get_json_object("item", "$.parent.id").alias("frame"), note.alias("text"), _plain(_text("$.data.title")).alias("head"), number("$.position.x").alias("x"), number("$.position.y").alias("y"))
    frames = placed.where("type = 'frame'").select("board_id", F.col("id").alias("frame"), F.col("head").alias("frame_title"), F.col("x").alias("fx"), F.col("y").alias("fy"))
    notes = placed.where("text <> ''").join(frames, ["board_id", "frame"], "left")
    order = F.struct(F.coalesce("fy", F.lit(float("-inf"))).alias("fy"), F.coalesce("fx", F.lit(float("-inf"))).alias("fx"), F.coalesce("frame_title", F.lit("")).alias("frame"), "y", "x", "text")
    groups = notes.groupBy("board_id", "frame_title").agg(F.min(order).alias("_first"), F.array_join(F.transform(F.sort_array(F.collect_list(order)), lambda v: F.concat(F.lit("- "), v["text"])), "\n").alias("_lines"))
    shown = F.when(F.coalesce("frame_title", F.lit("")) != "", F.concat(F.lit("## "), "frame_title", F.lit("\n"), "_lines")).otherwise(F.col("_lines"))
    body = groups.groupBy("board_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_first", shown.alias("text")))), lambda v: v["text"]), "\n\n").alias("_notes"))
    known = placed.where("text <> ''").select("board_id", "id", "text")
    ends = links.select("board_id", F.get_json_object("item", "$.startItem.id").alias("a"), F.get_json_object("item", "$.endItem.id").alias("b"), _plain(F.coalesce(F.get_json_object("item", "$.captions[0].content"), F.lit(""))).alias("label"))
    named = ends.join(known.select("board_id", F.col("id").alias("a"), F.col("text").alias("_a")), ["board_id", "a"]).join(known.select("board_id", F.col("id").alias("b"), F.col("text").alias("_b")), ["board_id", "b"])
    arrow = F.concat(F.lit("- "), "_a", F.when(F.col("label") != "", F.concat(F.lit(" -["), "label", F.lit("]-> "))).otherwise(" -> "), "_b")
    lines = named.groupBy("board_id").agg(F.concat(F.lit("Links:\n"), F.array_join(F.sort_array(F.collect_list(arrow)), "\n")).alias("_links"))
    own = boards.select(F.col("body").alias("item")).withColumn("board_id", _text("$.id")).join(body, "board_id", "left").join(lines, "board_id", "left")
    parts = F.array(_plain(_text("$.description")), F.coalesce("_notes", F.lit("")), F.coalesce("_links", F.lit("")))
    made = _documents(own, F.concat(F.lit("miro:"), "board_id"), _text("$.name"), parts, _text("$.owner.name"), "$.modifiedAt", "miro")
    return made.drop("source_ref").withColumn("source_ref", F.col("external_id"))
