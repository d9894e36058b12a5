"""Sections and chunks of YAML, JSON and TOML texts, by where their keys and list entries stand; bytes are never rewritten.

A format only says which lines begin a key or an entry, and how deep.  The rest
is alike for all: units that own lines, sections of top-level keys or of the
entries of a list, titles from what identifies an entry, and chunks of whole
lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate, groupby

# Fixed values, equal to those of the service whose results are matched.
LOW, HIGH, CAP = 500, 800, 1600  # characters of a chunk: grow under the first, aim under the second, never over the third but for one long line
ENTRIES = 500
PROMOTED, PROMOTED_CHARS, TITLE_CHARS = 3, 32, 80
IDENTIFYING = "id name key code slug title type kind tenant rule route".split()
IDENTIFYING_ENDS = ("_id", "_code", "_type", "_name", "_key", "_slug", "_tenant")
SWITCHES = "true false yes no on off".split()


@dataclass
class Mark:
    """What a line begins: an entry of a list or a key, with its scalar; pairs and maps tell of an entry's own line."""

    depth: int
    entry: bool
    name: str = ""
    value: str | None = None
    pairs: list[tuple[str, str]] = field(default_factory=list)
    maps: bool = False


@dataclass
class Unit:
    """A marked line with the lines that it owns, from start up to end, and the units below it."""

    line: int
    depth: int
    start: int = 0
    end: int = 0
    kids: list[Unit] = field(default_factory=list)


def scalar(rest: str) -> str | None:
    """A value as it is written: what quotes hold, or the text up to a comment or a closing comma; None for nothing."""
    rest = rest.strip()
    quoted = re.match(r'"((?:[^"\\]|\\.)*)"|\'([^\']*)\'', rest)
    if quoted:
        value = re.sub(r"\\(.)", r"\1", quoted[1]) if quoted[1] is not None else quoted[2]
    else:
        value = rest.split(" #")[0].strip().rstrip(",").strip() if rest[:1] not in ('"', "'") else ""
    return value or None


_YAML_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'[^']*'|[^\s"'#&*!|>{}\[\],-][^#]*?|-[^\s#][^#]*?)\s*:(?:\s+(.*)|$)""")


def _yaml(lines: list[str]) -> list[Mark | None]:
    out: list[Mark | None] = []
    text_under: int | None = None  # the column of a key whose value is a block of text
    for line in lines:
        column = len(line) - len(line.lstrip(" "))
        if text_under is not None and (not line.strip() or column > text_under):
            out.append(None)
            continue
        text_under = None
        body = line.strip()
        if not body or body[0] == "#" or body in ("---", "..."):
            out.append(None)
            continue
        dash = re.match(r"-(\s+|$)", body)
        rest = body[dash.end() :] if dash else body
        key = _YAML_KEY.match(rest)
        name, value = (key[1].strip("\"'"), scalar(key[2] or "")) if key else ("", None)
        if re.match(r"[|>][+-]?\d*[+-]?(\s|$)", (key[2] or "") if key else rest):
            text_under = column + (len(dash[0]) if dash and key else 0)
            value = None
        if dash:
            out.append(Mark(2 * column + 1, True, "", None, [(name, value)] if key and value else [], key is not None))
        else:
            out.append(Mark(2 * column, False, name, value) if key else None)
    return out


def _json(lines: list[str]) -> list[Mark | None]:
    out: list[Mark | None] = []
    open_: list[str] = []
    comment = False
    for line in lines:
        body, mark = line.strip(), None
        if open_ and not comment and body and not body.startswith(("//", "/*", "]", "}")):
            key = re.match(r'"((?:[^"\\]|\\.)*)"\s*:\s*(.*)', body)
            if open_[-1] == "{" and key:
                mark = Mark(len(open_), False, key[1], None if key[2][:1] in ("{", "[") else scalar(re.sub(r"\s//.*$", "", key[2])))
            elif open_[-1] == "[":
                pairs = re.findall(r'"((?:[^"\\]|\\.)*)"\s*:\s*("(?:[^"\\]|\\.)*"|[^\s,{}\[\]"]+)', body) if body[0] == "{" else []
                mark = Mark(len(open_), True, "", None, [(k, v) for k, v in ((k, scalar(v)) for k, v in pairs) if v], body[0] == "{")
        out.append(mark)
        for token in re.finditer(r'/\*|\*/|//.*|"(?:[^"\\]|\\.)*"|[{}\[\]]', line):
            if comment or token[0] in ("/*", "*/"):
                comment = token[0] != "*/" and (comment or token[0] == "/*")
            elif token[0] in "{[":
                open_.append(token[0])
            elif token[0] in "}]" and open_:
                open_.pop()
    return out


def _toml(lines: list[str]) -> list[Mark | None]:
    out: list[Mark | None] = []
    under, quotes = 0, None
    for line in lines:
        body = line.strip()
        if quotes:
            quotes = None if quotes in body else quotes
            out.append(None)
            continue
        head, pair = re.match(r"\[(\[?)\s*([^\[\]]+?)\s*\]", body), re.match(r"""((?:[\w-]+|"[^"]*"|'[^']*')(?:\.[\w"'-]+)*)\s*=\s*(.*)""", body)
        if head:
            under = 1
            out.append(Mark(0, bool(head[1]), head[2].strip("\"'"), None, [], bool(head[1])))
        elif pair:
            block = re.match(r'"""|\'\'\'', pair[2])
            quotes = block[0] if block and block[0] not in pair[2][3:] else None
            out.append(Mark(under, False, pair[1].strip("\"'"), None if block else scalar(pair[2])))
        else:
            out.append(None)
    return out


def units(lines: list[str], marks: list[Mark | None]) -> list[Unit]:
    """The top-level units; the first takes the lines above it, and a comment right above a unit belongs to it."""
    root = Unit(-1, -1, 0, len(lines))
    way = [root]
    for n, mark in enumerate(marks):
        if mark is not None:
            while way[-1].depth >= mark.depth:
                way.pop()
            way[-1].kids.append(Unit(n, mark.depth))
            way.append(way[-1].kids[-1])

    def lead(unit: Unit, floor: int) -> int:
        at, column = unit.line, len(lines[unit.line]) - len(lines[unit.line].lstrip())
        for n in range(unit.line - 1, floor - 1, -1):
            body = lines[n].strip()
            if body and not (body.startswith(("#", "//", "/*")) and len(lines[n]) - len(lines[n].lstrip()) <= column):
                break
            at = n if body else at
        return at

    todo = [(root, 0)]
    while todo:
        unit, low = todo.pop()
        before = None
        for kid in unit.kids:
            kid.start, kid.end = (low if before is None else lead(kid, before.line + 1)), unit.end
            if before is not None:
                before.end = kid.start
            before = kid
        todo += [(kid, kid.line + 1) for kid in unit.kids]
    return root.kids


@dataclass
class Section:
    title: str
    path: str
    level: int
    parent: int | None
    first: int
    last: int
    promoted: dict[str, str]
    chunks: list[tuple[int, int]]


def _snake(key: str) -> str:
    return re.sub(r"[-. ]", "_", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", key)).lower()


def _promotable(value: str) -> bool:
    return 1 <= len(value.strip()) <= PROMOTED_CHARS and value.strip()[0] not in "{[|>&*!" and value.strip() not in ("null", "~")


def identifying(pairs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The first three short values whose keys name things."""
    names = [(k, v) for k, v in pairs if (s := _snake(k)) in IDENTIFYING or s.endswith(IDENTIFYING_ENDS) or s.startswith("tenant")]
    return [(k, v) for k, v in names if _promotable(v)][:PROMOTED]


class Plan:
    """The sections of one text; see ``sections``."""

    def __init__(self, text: str, kind: str, cap: int):
        self.lines, self.cap, self.out = text.split("\n"), cap, []
        self.upto = [0, *accumulate(len(x) + 1 for x in self.lines)]
        self.marks = {"json": _json, "jsonc": _json, "toml": _toml}.get(kind, _yaml)(self.lines)
        tops = units(self.lines, self.marks)
        if not tops:
            self.add("", 0, None, 0, len(self.lines), [], [(0, len(self.lines), None)])
        for (what, _), run in groupby(tops, self.sort_of):
            own = list(run)
            if what == "entry":
                self.entries(own, self.marks[own[0].line].name, own[0].start)
            elif what == "scalar":
                self.add(", ".join(self.marks[u.line].name for u in own), 1, None, own[0].start, own[-1].end, [], [(u.start, u.end, u) for u in own])
            else:
                self.key(own[0])

    def sort_of(self, u: Unit) -> tuple[str, object]:
        m = self.marks[u.line]
        if m.entry:
            return "entry", m.name
        return ("scalar", 0) if not u.kids and m.value is not None else ("key", u.line)

    def is_list(self, run: list[Unit]) -> bool:
        """The list is the main content: 2 to 500 entries, half of them mappings."""
        maps = [self.marks[u.line].maps or any(not self.marks[k.line].entry for k in u.kids) for u in run]
        return 2 <= len(run) <= ENTRIES and all(self.marks[u.line].entry for u in run) and 2 * sum(maps) >= len(run)

    def pairs(self, u: Unit) -> list[tuple[str, str]]:
        below = [self.marks[k.line] for k in u.kids]
        return self.marks[u.line].pairs + [(m.name, m.value) for m in below if not m.entry and m.value is not None]

    def entries(self, run: list[Unit], name: str, start: int) -> None:
        """Entries at the top of a text."""
        if not self.is_list(run):
            self.add(name or "list", 1, None, start, run[-1].end, [], [(u.start, u.end, u) for u in run])
            return
        parent = self.add(name, 1, None, start, run[-1].end, [], []) if name else None
        self.each(run, parent, start)

    def each(self, run: list[Unit], parent: int | None, start: int) -> None:
        for n, u in enumerate(run):
            named = identifying(self.pairs(u))
            short = [(k, v) for k, v in self.pairs(u) if _promotable(v) and v.lower() not in SWITCHES][:1]
            title = ", ".join(f"{k}: {v}" for k, v in named or short) or f"#{n + 1}"
            low = u.start if n else start
            self.add(title, 1 if parent is None else 2, parent, low, u.end, named, self.spans(u, low))

    def key(self, u: Unit) -> None:
        name = self.marks[u.line].name
        if self.is_list(u.kids):
            self.each(u.kids, self.add(name, 1, None, u.start, u.end, [], []), u.start)
            return
        named = identifying(self.pairs(u) if not self.marks[u.line].entry else [])
        self.add(name + (f" ({', '.join(f'{k}: {v}' for k, v in named)})" if named else ""), 1, None, u.start, u.end, named, self.spans(u, u.start))

    def spans(self, u: Unit, start: int) -> list[tuple[int, int, Unit | None]]:
        """What a unit is packed from: the units below it, its own line with the first."""
        if not u.kids:
            return [(start, u.end, u)]
        return [(k.start if n else start, k.end, k) for n, k in enumerate(u.kids)]

    def size(self, a: int, b: int) -> int:
        return self.upto[b] - self.upto[a]

    def packed(self, spans: list[tuple[int, int, Unit | None]]) -> Iterator[tuple[int, int]]:
        held: tuple[int, int] | None = None
        for a, b, u in spans:
            n = self.size(a, b)
            if held and (n > self.cap or not (self.size(*held) + n <= HIGH or self.size(*held) < LOW and self.size(*held) + n <= self.cap)):
                yield held
                held = None
            if n <= self.cap:
                held = (held[0] if held else a, b)
            elif u is not None and u.kids:
                below = self.spans(u, a)
                yield from self.packed([*below[:-1], (below[-1][0], b, below[-1][2])])
            else:
                yield from self.by_lines(a, b)
        if held:
            yield held

    def by_lines(self, a: int, b: int) -> Iterator[tuple[int, int]]:
        low = a
        for n in range(a, b):
            if n > low and self.size(low, n + 1) > HIGH:
                yield low, n
                low = n
        yield low, b

    def trimmed(self, a: int, b: int) -> tuple[int, int]:
        full = [n for n in range(a, b) if self.lines[n].strip()]
        return (full[0], full[-1] + 1) if full else (a, a)

    def add(self, title: str, level: int, parent: int | None, start: int, end: int, promoted: list[tuple[str, str]], spans: list[tuple[int, int, Unit | None]]) -> int:
        title = title.strip()
        title = title if len(title) <= TITLE_CHARS else title[: TITLE_CHARS - 3] + "..."
        path = f"{self.out[parent].path} > {title}" if parent is not None and self.out[parent].path else title
        a, b = self.trimmed(start, end)
        chunks = [(x + 1, y) for x, y in (self.trimmed(*s) for s in self.packed(spans)) if x < y]
        self.out.append(Section(title, path, level, parent, a + 1, max(b, a + 1), dict(promoted), chunks))
        return len(self.out) - 1


def sections(text: str, kind: str, cap: int = CAP) -> list[Section]:
    """The sections of a text with their chunks (first and last line); every line that is not blank is in one chunk, as it stands."""
    return Plan(text, kind, cap).out


def config_chunks(text: str, kind: str, cap: int = CAP) -> list[tuple[str, int, int, str]]:
    """(path, first line, last line, text) of all chunks."""
    lines = text.split("\n")
    return [(s.path, a, b, "\n".join(lines[a - 1 : b])) for s in sections(text, kind, cap) for a, b in s.chunks]
