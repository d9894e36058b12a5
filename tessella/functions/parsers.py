"""Sequential parsers over one text: cleaning, windows, sections, packing, records, glossaries, embeddings.

They keep state from line to line, which column expressions can't; the
operators in ``operators.structure`` run them per document in Arrow batches.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

import numpy as np

# Fixed values, equal to those of the service whose results are matched.
EDGE_LINES = 3
MAX_REPEAT_LINE = 120
RECORD_KEYS = "decision status owner date attendees supersedes deciders id".split()
STATUS_WORDS = {
    "accepted": "approved accepted confirmed decided agreed done implemented completed".split(),
    "superseded": "superseded replaced".split(),
    "rejected": "rejected declined".split(),
    "deferred": "postponed deferred".split(),
    "proposed": "proposed draft pending".split(),
}
HEADER_TERMS = ("term", "terms", "acronym", "abbreviation", "code", "name", "short form", "key")
HEADER_MEANINGS = ("expansion", "meaning", "definition", "description", "long form", "full form", "value", "stands for")
STRUCTURE_WORDS = "article annex section schedule rule appendix".split()

_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\xad​-‏﻿�]")
_PAGE_MARK = re.compile(r"\[page (\d+)\]")
_WORD_START = re.compile(r"(?<!\S)\S")
_PAGES = re.compile(r"\[page ([0-9]{1,9})\]")
_PAGE_LINE = re.compile(r"(?i)(?:page\s*)?\d{1,4}(?:\s*of\s*\d{1,4})?\s*|[-–—]\s*\d{1,4}\s*[-–—]")
_WORDS = "|".join(STRUCTURE_WORDS)
_NUMBERED = re.compile(rf"(?:§\s*\d+(?:\.\d+)*|\d{{1,4}}(?:\.\d{{1,4}}){{1,3}}|(?:{_WORDS})\s+\d+)(?:\s|[:.)\-]|$)")
_CAPS = re.compile(r"[A-Z][A-Z0-9 &()/\-]{3,80}")


def repeat_key(line: str) -> str:
    return " ".join(line.split()).lower()


def clean(text: str) -> str:
    """Control characters out, blanks collapsed; page numbers and repeated lines go within three lines of a page's edge only."""
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    keys = [k for k in map(repeat_key, text.split("\n")) if 0 < len(k) <= MAX_REPEAT_LINE]
    often: dict[str, int] = {}
    for k in keys:
        often[k] = often.get(k, 0) + 1
    whole, rest = divmod(len(keys), 100)
    limit = max(3, whole + (rest > 50 or rest == 50 and whole % 2))
    pages: list[list[int]] = [[]]
    for i, line in enumerate(lines):
        if _PAGE_MARK.fullmatch(line.strip()):
            pages.append([])
        elif line.strip():
            pages[-1].append(i)
    edge = {i for p in pages for i in p[:EDGE_LINES] + p[-EDGE_LINES:]}
    out: list[str] = []
    gap = False
    for i, line in enumerate(lines):
        plain = _CONTROL.sub("", line)
        body = plain.strip()
        if not body:
            if not gap:
                out.append("")
            gap = True
            continue
        drop = _PAGE_LINE.fullmatch(body) or often.get(repeat_key(body), 0) >= limit
        if i in edge and drop and not _PAGE_MARK.fullmatch(body):
            continue
        gap = False
        out.append(re.sub(r"[ \t]+", " ", plain).rstrip())
    return "\n".join(out).strip()


def pages(text: str, page: int | None) -> tuple[int | None, int | None]:
    """The first and last page of a chunk by its [page N] marks; page: the last one of the chunk before."""
    marks = [int(n) for n in _PAGES.findall(text)] if "[page " in text else []
    return (page if page is not None else min(marks, default=None)), max(marks, default=page)


def windows(text: str, size: int = 800, overlap: int = 100) -> list[str]:
    """Overlapping windows whose ends fall back to a sentence end, else a blank, and whose starts are word starts."""
    if len(text) <= size or size == 0:
        return [text]
    step, back = max(1, size - overlap), min(overlap, size - 1)
    body = text.rstrip()
    last = len(body) - len((body.rsplit(None, 1) or [""])[-1])  # where the last word starts

    def word_from(p: int, end: int) -> int:
        """The first start of a word from p on, at most end; p if no word starts behind it."""
        m = _WORD_START.search(text, p, end) if p <= last else None
        return m.start() if m else min(end if p <= last else p, end)

    out, start = [], word_from(0, len(text))
    while True:
        end = min(start + size, len(text))
        if end < len(text):
            low = max(0, end - back)
            stops = [m for m in re.finditer(r"[.?!]\s+", text[low:end])]
            blanks = [m for m in re.finditer(r"\s", text[low:end])]
            end = low + stops[-1].end() if stops else low + blanks[-1].start() if blanks else end
        piece = text[start:end].rstrip()
        if piece:
            out.append(piece)
        if end == len(text):
            return out or [""]
        start = word_from(start + step, end)


def heading_of(line: str) -> tuple[str, int, str] | None:
    """(kind, level, title) of a heading line: marker, numbered or caps; None for body text."""
    m = re.match(r"\s*(#{1,6})[ \t]+(\S.*)", line)
    if m and not line.strip().startswith("#######"):
        return "marker", len(m[1]), m[2].strip()
    s = line.strip()
    if not s or len(s.encode()) > 80:
        return None
    if _NUMBERED.match(s) and not _reads_as_data(s):
        return "numbered", _numbered_level(s), s
    single = " " not in s and "\t" not in s and len(s) < 8
    if _CAPS.fullmatch(s) and not s.isdigit() and not single:
        return "caps", 1, s
    return None


def _reads_as_data(s: str) -> bool:
    """Dates, addresses, bare numbers, and quantities that run on in lower case."""
    if s.startswith("§") or s.lower().startswith(tuple(w + " " for w in STRUCTURE_WORDS)):
        return False
    token = re.match(r"[\d.]*", s)[0]
    rest = s[len(token) :].lstrip(" \t:)-.")
    parts = token.rstrip(".").split(".")
    sizes = [len(p) for p in parts]
    date = len(parts) == 3 and (sizes[0] == 4 and max(sizes[1:]) <= 2 or sizes[2] == 4 and max(sizes[:2]) <= 2)
    address = len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    return not rest or date or address or rest[0].islower()


def _numbered_level(s: str) -> int:
    m = re.match(r"§\s*([\d.]*)", s) or re.match(r"(\d[\d.]*)", s)
    return 1 + m[1].rstrip(".").count(".") if m else 1


@dataclass
class Section:
    title: str
    level: int
    path: str
    parent: int | None
    start: int
    end: int
    body: list[str] = field(default_factory=list)


#: Lines of a contents page: at least so many entries within so many lines.
CONTENTS_LEAST, CONTENTS_MOST = 3, 8
CONTENTS_TITLES = ("contents", "table of contents", "index")


def contents_lines(lines: list[str]) -> set[int]:
    """Numbers of the lines of contents pages, which open no section, with the title line above them.

    An entry is a heading with a page number behind it.  Entries count where at
    least three make up half of three to eight lines in a row (blank ones aside)
    that span at most twice as many.
    """
    filled = [n for n, v in enumerate(lines) if v.strip()]
    entry = []
    for n in filled:
        line = lines[n].strip()
        m = re.fullmatch(r"(.*\S)\s+\d{1,4}", line) if line[-1].isdecimal() else None
        words = re.sub(r"[.·…\s]+$", "", m[1]) if m else ""
        entry.append(0 < len(words) <= 80 and heading_of(words) is not None)
    if sum(entry) < CONTENTS_LEAST:
        return set()
    upto = np.append(0, np.cumsum(entry))
    found: set[int] = set()
    for size in range(CONTENTS_LEAST, min(CONTENTS_MOST, len(filled)) + 1):
        starts = np.arange(len(filled) - size + 1)
        many = upto[starts + size] - upto[starts]
        span = np.array(filled)[starts + size - 1] - np.array(filled)[starts]
        for k in starts[(many >= CONTENTS_LEAST) & (2 * many >= size) & (span <= 2 * size)].tolist():
            found |= {i for i in range(k, k + size) if entry[i]}
    titles = {i - 1 for i in found if i and lines[filled[i - 1]].strip().lower() in CONTENTS_TITLES}
    return {filled[i] for i in found | titles}


def prose_sections(text: str, title: str) -> list[Section]:
    """Sections by a stack of headings; the first is the root.

    A caps line heads a section only when set off by a blank line before it; the
    lines of contents pages head none.  A long text without headings is cut in
    windows of whole paragraphs that overlap a little.
    """
    root = Section(title, 0, title, None, 1, 0)
    out, stack, blank = [root], [0], True
    lines = text.split("\n")
    listed = contents_lines(lines)
    for n, line in enumerate(lines, 1):
        found = heading_of(line) if n - 1 not in listed else None
        if found and (found[0] != "caps" or blank):
            _, level, name = found
            while len(stack) > 1 and out[stack[-1]].level >= level:
                out[stack.pop()].end = n - 1
            above = out[stack[-1]]
            out.append(Section(name, level, f"{above.path} > {name}", stack[-1], n, 0))
            stack.append(len(out) - 1)
        else:
            out[stack[-1]].body.append(line)
        blank = not line.strip()
    for i in stack:
        out[i].end = len(lines)
    return out if len(out) > 1 else fallback_windows(root, lines)


def fallback_windows(root: Section, lines: list[str], least: int = 2000, most: int = 4000, shared: int = 500) -> list[Section]:
    """The root as it is, or where it is longer than most characters in several paragraphs, windows of them.

    A window ends before it exceeds most, once it has least; the next begins
    with the last paragraphs of it that make up shared characters.
    """
    parts: list[tuple[int, list[str]]] = []
    for n, line in enumerate(lines, 1):
        if line.strip():
            if parts and parts[-1][0] + len(parts[-1][1]) == n:
                parts[-1][1].append(line)
            else:
                parts.append((n, [line]))
    sizes = [len("\n".join(p)) + 2 for _, p in parts]
    if len(parts) < 2 or sum(sizes) <= most:
        return [root]
    out, a = [], 0
    while True:
        e, size = a + 1, sizes[a]
        while e < len(parts) and not (size >= least and size + sizes[e] > most):
            size += sizes[e]
            e += 1
        first, last = parts[a][0], parts[e - 1][0] + len(parts[e - 1][1]) - 1
        out.append(Section("", 0, root.path, None, first, last, lines[first - 1 : last]))
        if e == len(parts):
            return out
        back, held = e, 0
        while back > a + 1 and held < shared:
            back -= 1
            held += sizes[back]
        a = max(min(back, e - 1), a + 1)


def line_pieces(lines: list[str], first: int, last: int, most: int = 3000) -> list[tuple[int, int, str]]:
    """(first line, last line, text) of pieces of whole lines of at most most characters; a longer line alone is cut in windows."""
    out: list[tuple[int, int, str]] = []
    held: list[str] = []
    size, start = 0, first
    for n in range(first, last + 1):
        line = lines[n - 1]
        if held and size + len(line) + 1 > most:
            out.append((start, n - 1, "\n".join(held)))
            held, size, start = [], 0, n
        if len(line) > most:
            out += [(n, n, w) for w in windows(line, most, 0)]
            start = n + 1
            continue
        held.append(line)
        size += len(line) + 1
    if held:
        out.append((start, last, "\n".join(held)))
    return [x for x in out if x[2].strip()]


def paragraphs(body: list[str], most: int = 1600, least: int = 150) -> list[str]:
    """Paragraphs packed up to most characters; tables split by rows with their header repeated; short parts join the one before."""
    blocks = [b for b in re.split(r"\n\s*\n", "\n".join(body)) if b.strip()]
    pieces: list[str] = []
    for b in blocks:
        rows = b.split("\n")
        if len(b) <= most:
            pieces.append(b)
        elif all("|" in r or "\t" in r for r in rows if r.strip()):
            head, part = rows[0], [rows[0]]
            for row in rows[1:]:
                if len("\n".join([*part, row])) > most and len(part) > 1:
                    pieces.append("\n".join(part))
                    part = [head]
                part.append(row)
            pieces.append("\n".join(part))
        else:
            pieces += windows(b, most, most // 8)
    out: list[str] = []
    for p in pieces:
        if out and (len(out[-1]) + 2 + len(p) <= most or len(p) < least and len(out[-1]) + 2 + len(p) <= most + least):
            out[-1] += "\n\n" + p
        else:
            out.append(p)
    return out


_FENCE = re.compile(r"\s*(```+|~~~+)")


def markdown_blocks(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, first line, last line, text): front matter, heading, code, table, list, quote, image, paragraph."""
    lines, out, i = text.split("\n"), [], 0

    def take(kind: str, end: int) -> None:
        nonlocal i
        out.append((kind, i + 1, end, "\n".join(lines[i:end])))
        i = end

    def run(test) -> int:
        end = i
        while end < len(lines) and lines[end].strip() and test(lines[end]):
            end += 1
        return max(end, i + 1)

    if lines and lines[0].strip() == "---":
        close = next((k for k in range(1, len(lines)) if lines[k].strip() == "---"), None)
        if close:
            take("front", close + 1)
    while i < len(lines):
        line = lines[i]
        if not line.strip():
            i += 1
            continue
        fence = _FENCE.match(line)
        if fence:
            close = next((k for k in range(i + 1, len(lines)) if lines[k].strip().startswith(fence[1])), len(lines) - 1)
            take("code", close + 1)
        elif re.match(r"\s*#{1,6}\s+\S", line):
            take("heading", i + 1)
        elif i + 1 < len(lines) and re.fullmatch(r"\s*(=+|-{3,})\s*", lines[i + 1]) and not re.match(r"\s*[-*+|>]", line):
            take("heading", i + 2)
        elif line.lstrip().startswith("|"):
            take("table", run(lambda x: x.lstrip().startswith("|")))
        elif re.match(r"\s*([-*+]|\d+[.)])\s+", line):
            take("list", run(lambda x: bool(re.match(r"\s*([-*+]|\d+[.)])\s+|\s{2,}", x))))
        elif line.lstrip().startswith(">"):
            take("quote", run(lambda x: x.lstrip().startswith(">")))
        elif re.fullmatch(r"\s*!\[[^\]]*\]\([^)]*\)\s*", line):
            take("image", i + 1)
        else:
            take("paragraph", run(lambda x: not re.match(r"\s*(#{1,6}\s|```|~~~|\||>)", x)))
    return out


def sentences(text: str) -> list[str]:
    """Cut after . ! ? before white space."""
    return [x.strip() for x in re.split(r"(?<=[.!?])\s+", text) if x.strip()]


def _gathered(units: list[str], most: int, glue: str) -> list[str]:
    """Units joined in order as long as they stay within most."""
    out: list[str] = []
    for u in units:
        if out and len(out[-1]) + len(glue) + len(u) <= most:
            out[-1] += glue + u
        else:
            out.append(u)
    return out


def _fitting(lines: list[str], most: int) -> list[str]:
    return [x for line in lines for x in (windows(line, most, 0) if len(line) > most else [line])]


def block_pieces(kind: str, body: str, cap: int = 1500, code_cap: int = 3000) -> list[str]:
    """A block over its cap in pieces: code by lines with its fences, tables by rows with their header, lists by items, prose by sentences with one of overlap."""
    lines = body.split("\n")
    if len(body) <= (code_cap if kind == "code" else cap):
        return [body]
    if kind == "code":
        closed = len(lines) > 1 and _FENCE.match(lines[-1])
        head, inner, tail = lines[0], lines[1 : -1 if closed else None], lines[-1] if closed else _FENCE.match(lines[0])[1]
        room = max(1, code_cap - len(head) - len(tail) - 2)
        return [f"{head}\n{x}\n{tail}" for x in _gathered(_fitting(inner, room), room, "\n")]
    if kind == "table":
        head = lines[:2] if len(lines) > 2 and re.fullmatch(r"[\s|:-]+", lines[1]) else []
        room = cap - len("\n".join(head)) - 1
        if head and room > 0:
            return ["\n".join([*head, x]) for x in _gathered(_fitting(lines[2:], room), room, "\n")]
        return _gathered(_fitting(lines, cap), cap, "\n")
    if kind == "list":
        starts = [k for k, x in enumerate(lines) if re.match(r"([-*+]|\d+[.)])\s", x)] or [0]
        items = ["\n".join(lines[a:b]) for a, b in zip([0, *starts[1:]], [*starts[1:], len(lines)], strict=True)]
        return _gathered([x for i in items for x in (_gathered(_fitting(i.split("\n"), cap), cap, "\n") if len(i) > cap else [i])], cap, "\n")
    words = [x for v in sentences(body) for x in (_gathered(_fitting(v.split(), cap), cap, " ") if len(v) > cap else [v])]
    pieces = _gathered(words, cap, " ")
    for k in range(len(pieces) - 1, 0, -1):
        last = sentences(pieces[k - 1])[-1]
        if len(last) + 1 + len(pieces[k]) <= cap:
            pieces[k] = f"{last} {pieces[k]}"
    return pieces


def front_pairs(body: str) -> dict[str, str]:
    """The plain pairs of a front matter block, keys in lower case."""
    found = [re.match(r"([A-Za-z][\w -]*?)\s*:\s*(.*)", x) for x in body.split("\n")[1:-1]]
    return {m[1].lower(): m[2].strip().strip("\"'") for m in found if m}


def markdown_sections(text: str, stem: str = "") -> list[dict]:
    """The sections of a markdown text: title, path, level, parent, kind, meta and blocks ((kind, first line, last line, text)).

    The root is named by the front matter's title, else by the first heading of
    level 1 (which then opens no section of its own), else by stem.  Front
    matter is a section below it.  The root's meta tells status, date and number
    of a decision record.
    """
    blocks = markdown_blocks(text)
    front = front_pairs(blocks[0][3]) if blocks and blocks[0][0] == "front" else {}

    def heading(body: str) -> tuple[int, str]:
        m = re.match(r"\s*(#{1,6})\s+(.*)", body)
        return (len(m[1]), re.sub(r"\s+#+\s*$", "", m[2]).strip()) if m else (1 if "=" in body.split("\n")[1] else 2, body.split("\n")[0].strip())

    top = next((k for k, b in enumerate(blocks) if b[0] == "heading" and heading(b[3])[0] == 1 and heading(b[3])[1]), None)
    first = heading(blocks[top][3])[1] if top is not None else ""
    title = front.get("title") or first or stem
    donated = top if top is not None and first.lower() == title.lower() else None
    meta = {k: front[k] for k in ("status", "date") if front.get(k)}
    if m := re.match(r"(?i)adr[-_ ]?0*(\d+)", title) or re.match(r"(?i)adr[-_ ]?0*(\d+)", stem):
        meta["number"] = m[1]
    out = [{"title": title, "path": title, "level": 0, "parent": None, "kind": "section", "meta": meta, "blocks": []}]
    if front or blocks and blocks[0][0] == "front":
        path = f"{title} > Front matter" if title else "Front matter"
        out.append({"title": "Front matter", "path": path, "level": 1, "parent": 0, "kind": "front_matter", "meta": front, "blocks": [blocks[0]]})
    way = [(0, 0)]  # (level of the heading, section)
    for k, block in enumerate(blocks):
        if block[0] == "front":
            continue
        if k == donated:
            out[0]["blocks"].append(("paragraph", *block[1:]))
        elif block[0] == "heading":
            level, name = heading(block[3])
            while len(way) > 1 and way[-1][0] >= level:
                way.pop()
            above = out[way[-1][1]]
            out.append({"title": name, "path": f"{above['path']} > {name}" if above["path"] else name, "level": level, "parent": way[-1][1], "kind": "section", "meta": {}, "blocks": [("paragraph", *block[1:])]})
            way.append((level, len(out) - 1))
        else:
            out[way[-1][1]]["blocks"].append(block)
    return out


def markdown_chunks(text: str, stem: str = "", target: int = 900, cap: int = 1500, least: int = 150, code_cap: int = 3000) -> list[tuple[str, int, int, str]]:
    """(path, first line, last line, text): whole blocks packed within a section to the target; longer ones in pieces of their kind; short chunks join the one before."""
    return [x for section in markdown_sections(text, stem) for x in markdown_packed(section, target, cap, least, code_cap)]


def markdown_packed(section: dict, target: int = 900, cap: int = 1500, least: int = 150, code_cap: int = 3000) -> list[tuple[str, int, int, str]]:
    """The chunks of one section; see ``markdown_chunks``."""
    mine: list[tuple[int, int, str, bool]] = []  # whether more may follow
    for kind, a, b, body in section["blocks"]:
        if len(body) > cap:
            mine += [(a, b, x, False) for x in block_pieces(kind, body, cap, code_cap)]
        elif mine and mine[-1][3] and len(mine[-1][2]) + 2 + len(body) + 2 <= target:
            mine[-1] = (mine[-1][0], b, f"{mine[-1][2]}\n\n{body}", True)
        else:
            mine.append((a, b, body, True))
    done: list[tuple[str, int, int, str]] = []
    for a, b, body, _ in mine:
        if done and len(body) < least and len(done[-1][3]) + 2 + len(body) <= code_cap:
            done[-1] = (section["path"], done[-1][1], b, f"{done[-1][3]}\n\n{body}")
        else:
            done.append((section["path"], a, b, body))
    return done


_SYMBOLS = {
    "indent": re.compile(r"(\s*)(?:async\s+)?(class|def|module)\s+([\w.]+)"),
    "brace": re.compile(
        r"(\s*)(?:export\s+|default\s+|pub(?:\([^)]*\))?\s+|public\s+|private\s+|protected\s+|static\s+|abstract\s+|async\s+|unsafe\s+|const\s+(?=fn))*"
        r"(class|interface|struct|enum|trait|impl|fn|func|function|type|namespace|module|object)\b\s*(?:\([^)]*\)\s*)?([\w:<>]+)"
    ),
}
_ARROW = re.compile(r"(\s*)(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>")


def code_symbols(text: str, style: str, most: int = 500) -> list[tuple[str, str, int, int]]:
    """(symbol path, kind, first line, last line); nesting by indentation, two levels deep at most.

    Lines before the first symbol are a preamble without a path.  Past the most symbols of the brace style the lines stay
    with the symbols that are open there; the indent style has no limit.
    """
    lines, found = text.split("\n"), []
    for n, line in enumerate(lines, 1):
        if style == "brace" and len(found) >= most:
            break
        m = _SYMBOLS[style].match(line)
        arrow = _ARROW.match(line) if style == "brace" and not m else None
        if m or arrow:
            found.append((len((m or arrow)[1].expandtabs(4)), m[2] if m else "function", (m[3] if m else arrow[2]), n))
    ends, still = [len(lines)] * len(found), []
    for k, (indent, _, _, n) in enumerate(found):
        while still and found[still[-1]][0] >= indent:
            ends[still.pop()] = n - 1
        still.append(k)
    out, stack = [], []
    if found and any(x.strip() for x in lines[: found[0][3] - 1]):
        out.append(("", "preamble", 1, found[0][3] - 1))
    for (indent, kind, name, n), end in zip(found, ends, strict=True):
        while stack and stack[-1][0] >= indent:
            stack.pop()
        if len(stack) >= 2:
            continue
        stack.append((indent, name))
        out.append((".".join(x for _, x in stack), kind, n, end))
    return out


def is_minified(text: str) -> bool:
    size, breaks = len(text.encode()), text.count("\n")
    return size > 50_000 and breaks < 10 or size > 2000 * (breaks + 1)


_FIELD = re.compile(r"\s*(?:\*\*([A-Za-z ]+):\*\*|\*\*([A-Za-z ]+)\*\*:|([A-Z][a-z]+):)\s*(.*)")
_ID = re.compile(r"\b((?:D|ADR)-?\d+)\b")  # of any length: large libraries number on past five digits
_BULLET = re.compile(r"\s*(?:[-*+]|\d+[.)])\s+(.*)")
_BOX = re.compile(r"\[( |x|X)\]\s+(.*)")


def front_matter(text: str) -> tuple[dict[str, str], str]:
    """Keys and values between the --- lines at the top, and the body."""
    m = re.match(r"---[ \t]*\n(.*?)\n---[ \t]*(?:\n|$)", text, re.S)
    if not m:
        return {}, text
    out: dict[str, str] = {}
    last = ""
    for line in m[1].split("\n"):
        item = re.match(r"\s*- (.*)", line)
        if item and last:
            out[last] = ", ".join(x for x in (out[last], item[1].strip()) if x)
        elif ":" in line:
            last, value = (x.strip() for x in line.split(":", 1))
            last = last.lower()
            out[last] = value.strip("[]\"'")
    return out, text[m.end() :]


def record(text: str) -> dict | None:
    """A decision's fields and all action items of a record text; None if it has neither."""
    front, body = front_matter(text)
    lines, fenced = [], False
    for line in body.split("\n"):
        if _FENCE.match(line):
            fenced = not fenced
        elif not fenced and not line.lstrip().startswith("|"):
            lines.append(line)
    fields: dict[str, str] = {}
    last = None
    for line in lines:
        m = _FIELD.fullmatch(line)
        key = next((g for g in m.groups()[:3] if g), "").strip().lower() if m else ""
        if key in RECORD_KEYS:
            last = key if key not in fields else None
            if last:
                fields[key] = m[4].strip()
        elif not line.strip() or heading_of(line) or _BULLET.match(line):
            last = None
        elif last:
            fields[last] = f"{fields[last]} {line.strip()}".strip()
    top = next((h[2] for h in map(heading_of, lines) if h and h[0] == "marker" and h[1] == 1), None)
    named = top is not None and top.lower().startswith("decision:")
    raw = fields.get("status", front.get("status", ""))
    word = re.sub(r"^\W+|\W+$", "", (raw.split() or [""])[0]).lower()
    status = next((s for s, words in STATUS_WORDS.items() if word in words), None)
    actions = _actions(lines)
    title = (top.split(":", 1)[1] if named else top or front.get("title") or "").strip()
    decided = (named or "decision" in fields or status) and bool(title)
    if not decided and not actions:
        return None
    by = re.search(r"(?i)superseded by(.*)", raw)
    ids = _ID.findall(front.get("supersedes", fields.get("supersedes", "")))
    number = front.get("id") or next(iter(_ID.findall(title)), None)
    return {
        "decision": bool(decided), "title": re.sub(r"\s*(?:[—–-]+\s*|\()(?:D|ADR)-?\d+\)?\s*$", "", title), "record_id": number, "status": status,
        "owner": re.split(r"[.;]", fields.get("owner", ""))[0].strip() or None, "date": fields.get("date", front.get("date")),
        "summary": fields.get("decision", "")[:400] or None, "supersedes": ids, "superseded_by": next(iter(_ID.findall(by[1])), None) if by else None, "actions": actions,
    }


def _actions(lines: list[str]) -> list[dict]:
    """Checkboxes anywhere, and bullets under an action heading or label; each text once."""
    out: dict[str, dict] = {}
    inside = False
    for line in lines:
        label = re.sub(r"[#*:\s]+", " ", line).strip().lower()
        if label in ("action items", "action item", "actions"):
            inside = True
            continue
        if heading_of(line):
            inside = False
        m = _BULLET.match(line)
        box = _BOX.match(m[1]) if m else None
        if not m or not (inside or box):
            inside = inside and (bool(m) or not line.strip())
            continue
        text = (box[2] if box else m[1]).strip()
        owner = re.match(r"(?:\*\*)?@?([A-Z][\w.-]+)(?:\*\*)?\s*(?::|—|–| - )\s*(.+)", text)
        due = re.search(r"(?i)\b(?:by|due:?)\s+(\d{4}-\d{2}-\d{2}|[A-Z][a-z]+ \d{1,2})", text)
        item = {"text": owner[2] if owner else text, "owner": owner[1] if owner else None, "due": due[1] if due else None, "done": bool(box and box[1] in "xX")}
        out.setdefault(item["text"].lower(), item)
    return list(out.values())


def initialisms(text: str) -> list[tuple[str, str]]:
    """(term, phrase) of Full Phrase (FP): the letters are the words' initials in order; small glue words may be left out."""
    out: dict[str, str] = {}
    for m in re.finditer(r"\(([A-Z][A-Za-z]{1,7})\)", text):
        term, before = m[1], re.findall(r"[A-Za-z]+", text[max(0, m.start() - 120) : m.start()])
        for n in range(2, min(len(before), len(term) + 4) + 1):
            words = before[-n:]
            letters = "".join("".join(c for i, c in enumerate(w) if i == 0 or c.isupper()) for w in words if w.lower() not in ("of", "and", "the", "for", "to", "in", "on"))
            if letters.lower() == term.lower() and words[0].lower() not in ("of", "and", "the", "for", "to", "in", "on"):
                out.setdefault(term.lower(), " ".join(words).lower())
                break
    return list(out.items())


def glossary(text: str, most: int = 2000) -> list[tuple[str, str]]:
    """Pairs of a glossary file: table rows, tab rows, CODE - meaning, term: meaning, then ; and , rows with quotes; header rows go."""
    out: dict[tuple[str, str], None] = {}
    for line in text.splitlines():
        t = line.strip()
        if not t or t.startswith("#"):
            continue
        if t.startswith("|"):
            cells = [c.strip() for c in t.strip("|").split("|")]
            cells = [] if all(set(c) <= set("-: ") for c in cells) else cells
        elif "\t" in t:
            cells = _fields(t, "\t")
        else:
            m = re.fullmatch(r"([A-Za-z][A-Za-z0-9]{1,15})\s+[-–—]\s+(.+)", t) or re.fullmatch(r"([^:]{2,40}?)\s*:\s+(.{2,})", t)
            mark = next((d for d in ";," if d in t), None)
            cells = [m[1], m[2]] if m else _fields(t, mark) if mark else []
        if len(cells) < 2:
            continue
        term, meaning = (re.sub(r"^[*`_\"]+|[*`_\"]+$", "", re.sub(r"^[-*+]+", "", c.strip()).strip()).strip().lower() for c in cells[:2])
        if term in HEADER_TERMS and meaning in HEADER_MEANINGS:
            continue
        if 2 <= len(term) <= 40 and 2 <= len(meaning) <= 120 and term != meaning:
            out.setdefault((term, meaning))
        if len(out) >= most:
            break
    return list(out)


def _fields(line: str, mark: str) -> list[str]:
    return ["".join(p.split('"')) for p in re.split(rf'{re.escape(mark)}(?=(?:[^"]*"[^"]*")*[^"]*$)', line)]


# Fixed values, equal to those of the service whose results are matched: words that a vector takes for one.
ONE_WORD = {
    "car": "vehicle", "automobile": "vehicle", "vehicle": "vehicle", "auto": "vehicle", "fast": "speed", "quick": "speed", "speed": "speed", "velocity": "speed", "rapid": "speed", "database": "storage", "db": "storage",
    "storage": "storage", "store": "storage", "red": "color", "crimson": "color", "scarlet": "color", "big": "big", "large": "big", "huge": "big", "small": "small", "tiny": "small", "little": "small",
}


def fnv(text: str) -> int:
    """FNV-1a of the UTF-8 bytes, 64 bits."""
    h = 0xCBF29CE484222325
    for byte in text.encode():
        h = (h ^ byte) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def hash_embedding(text: str, dim: int = 768, stopwords: frozenset[str] | None = None) -> list[float]:
    """Term frequencies by FNV-1a of each token modulo dim, L2 normalised.

    Words of one meaning count as one (``ONE_WORD``); a text without tokens is
    hashed whole.  With stopwords, as evaluations do it: they and tokens of one
    byte are left out, no words are taken for others, and a text without tokens
    gives zeros.
    """
    import regex

    v = np.zeros(dim)
    tokens = regex.findall(r"[\p{L}\p{N}]+", text.lower())
    if stopwords is not None:
        tokens = [t for t in tokens if len(t.encode()) >= 2 and t not in stopwords]
    elif not tokens:
        tokens = [text]
    for token in tokens:
        v[fnv(token if stopwords is not None else ONE_WORD.get(token, token)) % dim] += 1
    norm = np.sqrt((v * v).sum())
    return (v / norm if norm else v).tolist()


def flatten_adf(node) -> str:
    """The text of an issue tracker's document tree: text nodes joined, blocks on lines of their own."""
    if isinstance(node, str):
        node = json.loads(node)
    if isinstance(node, list):
        return "".join(map(flatten_adf, node))
    if not isinstance(node, dict):
        return ""
    own = node.get("text", "") + flatten_adf(node.get("content", []))
    return own + "\n" if node.get("type") in ("paragraph", "heading", "listItem", "codeBlock", "blockquote") else own
