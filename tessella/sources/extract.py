"""Text out of bytes: decoding, office packages, mail, RTF, spreadsheets, diagrams, image headers (standard library only)."""

from __future__ import annotations

import csv
import email
import email.policy
import html as html_entities
import io
import json
import re
import struct
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import parsers
from . import pdf

MAX_ROWS, MAX_COLUMNS = 5000, 64  # of a sheet
TEXT_EXTENSIONS = "txt md markdown rst adoc py rs ts tsx js jsx go java kt c h cpp hpp cs rb php swift sh sql yml yaml json jsonc toml ini cfg conf xml log tex".split()


def decode(data: bytes) -> str | None:
    """Text by BOM, by NUL bytes for UTF-16, as UTF-8, else as cp1252; None for binary data."""
    for bom, codec in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(bom):
            return data.decode(codec, "replace")
    head = data[:4096]
    if head and b"\0" in head:
        even, odd = head[::2].count(0), head[1::2].count(0)
        if max(even, odd) > 0.4 * len(head) / 2 and min(even, odd) < 0.1 * len(head) / 2:
            return data.decode("utf-16-le" if odd > even else "utf-16-be", "replace")
        return None
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        control = sum(b < 9 or 13 < b < 32 for b in head)
        return None if control > len(head) // 50 else data.decode("cp1252", "replace")


def html(text: str) -> str:
    """Headings as #, blocks as lines, cells as tabs, images as markdown, scripts and styles out."""
    t = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", "", text)
    t = re.sub(r"(?is)<img\b[^>]*>", _image, t)
    t = re.sub(r"(?i)<h([1-6])\b[^>]*>", lambda m: "\n" + "#" * int(m[1]) + " ", t)
    t = re.sub(r"(?i)</?(?:p|div|br|li|ul|ol|tr|table|section|article|header|footer|nav|h[1-6])\b[^>]*>", "\n", t)
    t = re.sub(r"(?i)</t[dh]\s*>", "\t", t)
    t = html_entities.unescape(re.sub(r"(?s)<[^>]+>", "", t))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r" ?\n ?", "\n", re.sub(r"[ \x0b\f\r]+", " ", t))).strip()


def _image(m: re.Match) -> str:
    found = dict((k.lower(), v) for k, _, v in re.findall(r"(\w+)\s*=\s*(['\"])(.*?)\2", m[0], re.S))
    alt, src = found.get("alt", ""), found.get("src", "")
    return alt if src.startswith("data:") or not src else f"![{alt}]({src})"


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _paragraphs(root: ElementTree.Element) -> Iterator[str]:
    """Paragraphs of a word-processing tree: headings as #, table rows as tab lines; contents lines are left out."""
    for node in root:
        name = _local(node.tag)
        if name in ("tbl", "table"):
            for row in node.iter():
                if _local(row.tag) in ("tr", "table-row"):
                    cells = [" ".join("".join(c.itertext()).split()) for c in row if _local(c.tag) in ("tc", "table-cell")]
                    yield "\t".join(cells)
        elif name in ("p", "h"):
            style = next((v for e in node.iter() for k, v in e.attrib.items() if _local(e.tag) in ("pStyle", "p", "h") and _local(k) in ("val", "style-name")), "")
            level = next((v for k, v in node.attrib.items() if _local(k) == "outline-level"), None) or (re.search(r"(?i)heading[ _]?(\d)", style) or [None, None])[1]
            text = "".join(node.itertext()).strip()
            if re.match(r"(?i)toc ?\d", style) or not text:
                continue
            yield "#" * min(6, int(level or 1)) + " " + text if level or style.lower() == "title" else text
        else:
            yield from _paragraphs(node)


def office(data: bytes, kind: str) -> str:
    """docx, odt, odp, pptx and xlsx from their packages."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        if kind == "docx":
            return "\n\n".join(_paragraphs(ElementTree.fromstring(z.read("word/document.xml"))))
        if kind in ("odt", "odp"):
            return "\n\n".join(_paragraphs(ElementTree.fromstring(z.read("content.xml"))))
        if kind == "pptx":
            slides = sorted((n for n in names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
            texts = [["".join(t.text or "" for t in p.iter() if _local(t.tag) == "t") for p in ElementTree.fromstring(z.read(n)).iter() if _local(p.tag) == "p"] for n in slides]
            return "\n\n".join(f"# Slide {k}\n" + "\n".join(filter(None, t)) for k, t in enumerate(texts, 1))
        shared = [] if "xl/sharedStrings.xml" not in names else ["".join(s.itertext()) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if _local(s.tag) == "si"]
        book = [e.attrib.get("name", "") for e in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _local(e.tag) == "sheet"]
        out = []
        for k, name in enumerate(book, 1):
            rows = []
            for row in (e for e in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{k}.xml")).iter() if _local(e.tag) == "row"):
                cells = []
                for c in list(row)[:MAX_COLUMNS]:
                    value = next((v.text or "" for v in c if _local(v.tag) == "v"), "".join(t for v in c if _local(v.tag) == "is" for t in v.itertext()))
                    cells.append(shared[int(value)] if c.attrib.get("t") == "s" and value.isdigit() and int(value) < len(shared) else value)
                rows.append(" | ".join(cells))
            out.append(f"## Sheet: {name}\n" + "\n".join(rows[:MAX_ROWS]))
        return "\n\n".join(out)


def delimited(text: str, mark: str) -> str:
    rows = list(csv.reader(io.StringIO(text), delimiter=mark))[:MAX_ROWS]
    return "\n".join(" | ".join(r[:MAX_COLUMNS]) for r in rows)


def eml(data: bytes) -> str:
    """Headers that matter, then the plain text part, else the HTML part."""
    m = email.message_from_bytes(data, policy=email.policy.default)
    body = m.get_body(("plain", "html"))
    text = body.get_content() if body else ""
    text = html(text) if body and body.get_content_type() == "text/html" else text
    return "\n".join(f"{h}: {m[h]}" for h in ("From", "To", "Cc", "Date", "Subject") if m[h]) + "\n\n" + text.strip()


# Fixed values, equal to those of the service whose results are matched.
_SKIPPED = (
    "fonttbl colortbl stylesheet info pict object generator listtable rsidtbl themedata colorschememapping latentstyles datastore xmlnstbl private blipuid"
).split()
_RTF = re.compile(r"\\u(-?\d+) ?|\\'([0-9a-fA-F]{2})|\\([a-zA-Z]+)(-?\d+)? ?|\\([^a-zA-Z])|([{}])|[\r\n]+|([^\\{}\r\n]+)")


def rtf(text: str) -> str:
    """Plain text of RTF: skipped destinations, signed 16-bit unicode with its fallback characters, cp1252 bytes."""
    out, stack, skip, fallback, pending = [], [], False, 1, 0
    for m in _RTF.finditer(text):
        code, byte, word, number, symbol, brace, plain = m.groups()
        if brace == "{":
            stack.append((skip, fallback))
        elif brace == "}":
            skip, fallback = stack.pop() if stack else (False, 1)
        elif code and not skip:
            out.append(chr(int(code) % 65536))
            pending = fallback
        elif byte:
            if pending:
                pending -= 1
            elif not skip:
                out.append(bytes.fromhex(byte).decode("cp1252", "replace"))
        elif word:
            skip = skip or word in _SKIPPED
            fallback = int(number) if word == "uc" and number else fallback
            if not skip and word in ("par", "line", "row"):
                out.append("\n")
            elif not skip and word in ("tab", "cell"):
                out.append("\t")
        elif symbol:
            skip = skip or symbol == "*"
            if not skip and symbol in "\\{}~":
                out.append(" " if symbol == "~" else symbol)
        elif plain and not skip:
            out.append(plain[pending:])
            pending = 0
    return "".join(out).strip()


def diagram(text: str) -> str:
    """A draw.io page as headings of frames, nodes in reading order and edges A → B: label."""
    cells = {c.attrib["id"]: c for c in ElementTree.fromstring(text).iter("mxCell") if "id" in c.attrib}

    def label(c: ElementTree.Element | None) -> str:
        return "" if c is None else html(c.attrib.get("value", "")).replace("\n", " ")

    nodes, edges = [], []
    for c in cells.values():
        if c.attrib.get("edge") == "1":
            a, b = (label(cells.get(c.attrib.get(k, ""))) for k in ("source", "target"))
            edges.append(f"{a} → {b}" + (f": {label(c)}" if label(c) else ""))
        elif c.attrib.get("vertex") == "1" and label(c):
            g = c.find("mxGeometry")
            x, y, h = (float(g.attrib.get(k, 0)) if g is not None else 0.0 for k in ("x", "y", "height"))
            nodes.append((y, x, h, label(c)))
    heights = sorted(n[2] for n in nodes)
    tolerance = heights[len(heights) // 2] / 2 if heights else 0
    nodes.sort()
    rows: list[list[tuple]] = []
    for n in nodes:
        if rows and n[0] - rows[-1][0][0] <= tolerance:
            rows[-1].append(n)
        else:
            rows.append([n])
    return "\n".join([t for r in rows for *_, t in sorted(r, key=lambda n: n[1])] + edges)


def image_size(data: bytes) -> tuple[str, int | None, int | None] | None:
    """(kind, width, height) from the header of PNG, GIF, BMP, JPEG, WebP or SVG bytes (SVG without a size); None for anything else."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return "png", *struct.unpack(">II", data[16:24])
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return "gif", *struct.unpack("<HH", data[6:10])
    if data[:2] == b"BM" and len(data) >= 26:
        w, h = struct.unpack("<ii", data[18:26])
        return "bmp", abs(w), abs(h)
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP" and len(data) >= 30:
        if data[12:16] == b"VP8X":
            return "webp", int.from_bytes(data[24:27], "little") + 1, int.from_bytes(data[27:30], "little") + 1
        if data[12:16] == b"VP8L":
            bits = int.from_bytes(data[21:25], "little")
            return "webp", (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
        w, h = struct.unpack("<HH", data[26:30])
        return "webp", w & 0x3FFF, h & 0x3FFF
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 <= len(data) and data[at] == 0xFF:
            kind = data[at + 1]
            if kind == 0xFF or kind == 1 or 0xD0 <= kind <= 0xD9:  # filling, and marks without a length
                at += 1 if kind == 0xFF else 2
            elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                return "jpeg", w, h
            else:
                at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
        return "jpeg", None, None
    return ("svg", None, None) if b"<svg" in data[:2048].lower() else None


def image_refs(text: str) -> list[tuple[str, str]]:
    """(alt, target) of markdown and HTML images outside fenced code."""
    plain = re.sub(r"(?ms)^\s*(```|~~~).*?^\s*\1", "", text)
    found = [(m.start(), m[1], m[2]) for m in re.finditer(r"!\[([^\]]*)\]\(([^)\s]+)[^)]*\)", plain)]
    found += [(m.start(), "", m[2]) for m in re.finditer(r"(?is)<img\b[^>]*?\bsrc\s*=\s*(['\"])(.*?)\1", plain)]
    return [(alt, src) for _, alt, src in sorted(found)]


def dehyphenated(text: str) -> str:
    """Words split by a hyphen at a line's end joined again."""
    return re.sub(r"(\w)-\n(?=[a-zà-ÿ])", r"\1", text)


def extract(kind: str, data: bytes) -> tuple[str | None, str | None]:
    """(text, error) of a file by its extension."""
    try:
        if kind in ("docx", "odt", "odp", "pptx", "xlsx"):
            return office(data, kind), None
        if kind == "eml":
            return eml(data), None
        if kind == "pdf":
            return dehyphenated(pdf.pdf_text(data)), None
        text = decode(data)
        if text is None:
            return None, "binary"
        if kind in ("html", "htm"):
            return html(text), None
        if kind == "rtf":
            return rtf(text), None
        if kind in ("csv", "tsv"):
            return delimited(text, "\t" if kind == "tsv" else ","), None
        if kind == "drawio":
            return diagram(text), None
        if kind == "adf":
            return parsers.flatten_adf(json.loads(text)), None
        return (dehyphenated(text) if kind == "pdftext" else text), None
    except Exception as e:  # a broken file is a skipped file
        return None, f"{type(e).__name__}: {e}"


def extracted(files: DataFrame) -> DataFrame:
    """path, text, error, generation from path and content; each file alone decides its row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [extract(p.rsplit(".", 1)[-1].lower() if "." in p else "", bytes(c)) for p, c in zip(f["path"], f["content"], strict=True)]
            yield pd.DataFrame({"path": f["path"], "text": [t for t, _ in got], "error": [e for _, e in got], "generation": 2})

    return files.select("path", "content").mapInPandas(run, "path string, text string, error string, generation int")


# Fixed values, equal to those of the service whose results are matched.
SKIP_DIRS = (
    ".git .hg .svn node_modules bower_components vendor __pycache__ .venv venv target dist build .next .nuxt .svelte-kit .cache .parcel-cache .tox .mypy_cache "
    ".pytest_cache .gradle .idea .vs .terraform pods deriveddata"
).split()


def ignore_files(spark: SparkSession, root: str, depth: int) -> list[tuple[str, str]]:
    """(place under the root, text) of the .gitignore files in folders of less than this depth; Spark's own listings leave dot files out."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for level in range(depth):
        pattern = jvm.org.apache.hadoop.fs.Path(root.rstrip("/") + "/*" * level + "/.gitignore")
        fs = pattern.getFileSystem(conf)
        for status in fs.globStatus(pattern) or []:
            with_root = status.getPath().toString()
            stream = fs.open(status.getPath())
            try:
                found.append(("/".join(with_root.rsplit("/", level + 1)[1:]), jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
            finally:
                stream.close()
    return found


def folder(spark: SparkSession, root: str, pattern: str = "*", ignore: bool = True) -> DataFrame:
    """rel, path, mtime_ms, size, content of the files under root, without skipped folders; content is read only if selected.

    The names of folders under the root decide, whatever their case; the root's own path never does.  With ignore, what the
    .gitignore files under the root keep out stays out.
    """
    if ignore:
        files = folder(spark, root, pattern, ignore=False)
        rules = ignore_files(spark, root, files.agg(F.max(F.size(F.split("rel", "/")))).first()[0] or 0)
        return not_ignored(files, spark.createDataFrame(rules, "rel string, text string")) if rules else files
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    rel = F.regexp_replace("path", "^.*?" + re.escape(root.rstrip("/").split("://")[-1]) + "/", "")
    parts = F.split(F.lower("rel"), "/")
    dirs = F.slice(parts, F.lit(1), F.size(parts) - 1)
    kept = files.withColumn("rel", rel).where(~F.arrays_overlap(dirs, F.array(*[F.lit(d) for d in SKIP_DIRS])))
    return kept.select("rel", "path", (F.unix_millis("modificationTime")).alias("mtime_ms"), F.col("length").alias("size"), "content")


def ignore_rule(line: str) -> tuple[str, bool, bool] | None:
    """(pattern of paths below the rule's folder, negated, folders only) of a line of an ignore file; None for blanks and comments."""
    line = re.sub(r"(?<!\\)[ \t]+$", "", line.rstrip("\r\n"))
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[negated:]
    folders = line.endswith("/")
    line = line.rstrip("/") if folders else line
    anchored = "/" in line
    line = line.removeprefix("/")
    if not line:
        return None
    out, k = "" if anchored else "(?:.*/)?", 0
    while k < len(line):
        rest = line[k:]
        if rest.startswith("**/") and (k == 0 or line[k - 1] == "/"):
            out, k = out + "(?:.*/)?", k + 3
        elif rest == "**" and k and line[k - 1] == "/":
            out, k = out + ".+", k + 2
        elif m := re.match(r"\[([!^]?)(\]?[^\]]*)\]", rest):
            out, k = out + "[" + ("^/" if m[1] else "") + re.sub(r"([\\\[&])", r"\\\1", m[2]) + "]", k + m.end()
        elif rest[0] == "\\" and len(rest) > 1:
            out, k = out + re.escape(rest[1]), k + 2
        elif rest[0] in "*?":
            run = len(rest) - len(rest.lstrip("*")) if rest[0] == "*" else 1
            out, k = out + ("[^/]*" if rest[0] == "*" else "[^/]"), k + run
        else:
            out, k = out + re.escape(rest[0]), k + 1
    return f"^{out}$", negated, folders


def not_ignored(files: DataFrame, ignores: DataFrame, rel: str = "rel") -> DataFrame:
    """files that no ignore file keeps out; ignores: rel (the place of an ignore file under the same root) and its text.

    Every folder above a file and the file itself is held against the rules of
    the ignore files above it.  The last rule that matches decides, those of
    deeper folders later; what lies in a folder that is kept out stays out,
    whatever rules below say.  Folders are judged once, not once per file.
    """
    rules = T.StructType.fromDDL("base string, level int, place int, pattern string, negated boolean, folders boolean")

    def lines(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for at, text in zip(f["rel"], f["text"], strict=True):
                base = at.rpartition("/")[0]
                for k, line in enumerate((text or "").split("\n")):
                    if (rule := ignore_rule(line)) is not None:
                        rows.append((base, base.count("/") + 1 if base else 0, k, *rule))
            yield pd.DataFrame(rows, columns=rules.names)

    ruled = ignores.select("rel", "text").mapInPandas(lines, rules)
    parts = F.split(F.col(rel), "/")
    ways = files.select(F.col(rel).alias("_file"), F.explode(F.sequence(F.lit(1), F.size(parts))).alias("_n"), parts.alias("_parts"))
    entries = ways.select("_file", F.array_join(F.slice("_parts", 1, F.col("_n")), "/").alias("entry"), (F.col("_n") < F.size("_parts")).alias("folder"), "_n", "_parts")
    judged = entries.select("entry", "folder", "_n", F.slice("_parts", F.lit(1), F.col("_n")).alias("_parts")).distinct()
    bases = judged.select("entry", "folder", "_parts", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_depth"))
    below = F.array_join(F.slice("_parts", F.col("_depth") + 1, F.size("_parts")), "/")
    placed = bases.select("entry", "folder", F.array_join(F.slice("_parts", F.lit(1), F.col("_depth")), "/").alias("base"), below.alias("_below"))
    met = placed.join(ruled, "base").where("(folder OR NOT folders) AND _below RLIKE pattern")
    out = met.groupBy("entry", "folder").agg(F.max_by("negated", F.struct("level", "place")).alias("_again")).where("NOT _again")
    gone = entries.join(out, ["entry", "folder"], "left_semi").select(F.col("_file").alias(rel)).distinct()
    return files.join(gone, rel, "left_anti").select(*files.columns)
