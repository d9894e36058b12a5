import random
import json
import pytest
from hypothesis import given
from hypothesis import strategies as st

from tessella.functions import configs
from tessella.functions import parsers as p
from tessella.operators import structure


def test_page_numbers_and_repeated_lines_go_at_page_edges_only():
    page = "HEADER LINE\nalpha\nbeta\ngamma\ndelta\nYes\nYes\nYes\nepsilon\nzeta\neta\ntheta\n{n}"
    text = "\n".join(f"[page {n}]\n" + page.format(n=n) for n in range(1, 6))
    got = p.clean(text)
    assert "HEADER LINE" not in got and got.count("Yes") == 15 and got.count("[page") == 5
    assert p.clean("a\t\tb  \n\n\n\nc\x00\u00ad") == "a b\n\nc"


@given(st.text(alphabet="ab. \n!", max_size=600))
def test_windows_cover_all_words(text):
    got = p.windows(text, 80, 15)
    assert all(len(w) <= 80 for w in got)
    assert not set(text.split()) - set(" ".join(got).split()) or max(map(len, text.split()), default=0) > 40


def test_headings():
    assert p.heading_of("## Two words") == ("marker", 2, "Two words")
    assert p.heading_of("4.2.1 Title here")[1] == 3
    assert p.heading_of("§ 434 Scope")[0] == "numbered"
    assert p.heading_of("GENERAL PROVISIONS")[0] == "caps"
    for body in ("3.5 million users", "1.0.31 release", "21.10.2026 Notes", "10.0.0.1 Gateway", "NOTE", "plain text", "12.5"):
        assert p.heading_of(body) is None


def test_sections_nest_and_end():
    s = p.prose_sections("intro\n# A\na\n## B\nb\n# C\nc", "doc")
    assert [(x.title, x.parent, x.start, x.end) for x in s] == [("doc", None, 1, 7), ("A", 0, 2, 5), ("B", 1, 4, 5), ("C", 0, 6, 7)]


def test_packing_repeats_table_headers():
    rows = ["h1 | h2"] + [f"{i} | {'x' * 30}" for i in range(40)]
    got = p.paragraphs(rows, most=400)
    assert len(got) > 2 and all(g.startswith("h1 | h2") for g in got) and sum(g.count("x" * 30) for g in got) == 40


def test_markdown_blocks_keep_every_line():
    text = "---\na: 1\n---\n# T\n\npara\nmore\n\n```\n# not a heading\n```\n| a |\n|---|\n- x\n- y\n> q\n![i](p.png)"
    kinds = [k for k, *_ in p.markdown_blocks(text)]
    assert kinds == ["front", "heading", "paragraph", "code", "table", "list", "quote", "image"]


def test_records():
    r = p.record("# Decision: Use it (D0005)\n\n**Decision:** We use it\nfor all.\n**Status:** Superseded by D9\n**Owner:** Kim\n\n## Action items\n- Ann: write by 2024-05-01\n- [x] test")
    assert (r["title"], r["record_id"], r["status"], r["superseded_by"], r["owner"]) == ("Use it", "D0005", "superseded", "D9", "Kim")
    assert r["summary"] == "We use it for all."
    assert [(a["owner"], a["due"], a["done"]) for a in r["actions"]] == [("Ann", "2024-05-01", False), (None, None, True)]
    assert p.record("nothing here") is None


def test_record_ids_of_six_digits():
    r = p.record("# Decision: Item 123456 — D123456\n\n**Status:** Accepted\n**Supersedes:** D100000, ADR-2345678\n")
    assert (r["title"], r["record_id"], r["supersedes"]) == ("Item 123456", "D123456", ["D100000", "ADR-2345678"])


def test_glossary_and_initialisms():
    assert p.glossary('| Term | Meaning |\n|--|--|\n| **DD** | direct debit |\nKYC - know your customer\n"a, b",c d\nx') == [("dd", "direct debit"), ("kyc", "know your customer"), ("a, b", "c d")]
    assert ("dd", "direct debit") in p.initialisms("Direct Debit (DD)")


def test_code_and_configuration():
    assert [x[0] for x in p.code_symbols("class A:\n    def f(self):\n        def deep():\n            pass\ndef g():\n    pass", "indent")] == ["A", "A.f", "g"]
    assert [x[0] for x in p.code_symbols("export class A {\n  x\n}\nconst f = (a) => 1\npub fn g() {}", "brace")] == ["A", "f", "g"]
    titles = lambda *a: [s.title for s in configs.sections(*a)]
    assert titles("a: 1\nurl: http://x\nb:\n  c: 2\nd: |\n  x: y\n", "yaml") == ["a, url", "b", "d"]
    assert titles('{\n "a": {"x": 1},\n // c\n "b": [\n 1]\n}', "jsonc") == ["a", "b"]
    assert titles("[one]\nx=1\n[[two]]\ny=2", "toml") == ["one", "two"]
    assert p.is_minified("x" * 3000) and not p.is_minified("x\n" * 3000)


def test_chunks_of_code_and_configuration_cover_every_line():
    many = "".join(f"def f{i}():\n    return {i}\n" for i in range(600))
    brace = "".join(f"fn f{i}() {{\n  {i}\n}}\n" for i in range(600))
    cases = {
        "py": '"""Licence."""\nimport os\n\nLIMIT = 3\n' + many,
        "rs": "// licence\nuse std::fmt;\n" + brace,
        "ts": "import x\n\nexport class A {\n  go() {}\n}\nconst f = (a) => 1\n",
        "yaml": "# comment\n---\n# more\na: 1\nb:\n  - c\n",
        "json": '{\n  "a": 1,\n  "b": {"c": 2}\n}',
        "toml": 'name = "x"\n\n[one]\nx = 1\n[[two]]\ny = 2',
    }
    for kind, text in cases.items():
        lines, rows = text.split("\n"), structure.chunk(kind, text)
        assert {n for _, _, a, b, _ in rows for n in range(a, b + 1)} >= {n for n, x in enumerate(lines, 1) if x.strip()}, kind  # blank lines at the edges of a chunk stay out
        assert all(content == "\n".join(lines[a - 1 : b]) for _, _, a, b, content in rows), kind
    assert p.code_symbols(cases["py"], "indent")[0] == ("", "preamble", 1, 4)
    assert len(p.code_symbols(cases["py"], "indent")) == 601
    assert len(p.code_symbols(cases["rs"], "brace")) == 501 and p.code_symbols(cases["rs"], "brace")[-1][2:] == (2 + 499 * 3 + 1, 2 + 600 * 3 + 1)
    assert p.code_symbols("\n\ndef f():\n    pass", "indent") == [("f", "def", 3, 4)]


def test_hash_embedding():
    v = p.hash_embedding("a b a", 16)
    assert abs(sum(x * x for x in v) - 1) < 1e-12 and sorted(p.hash_embedding("", 8)) == [0.0] * 7 + [1.0]
    assert p.hash_embedding("Fast car, in scarlet", 768) == p.hash_embedding("speed automobile in red", 768) != p.hash_embedding("slow car in red", 768)
    few = frozenset(["the", "in"])
    assert p.hash_embedding("the car in x", 256, few) == p.hash_embedding("car", 256, few) != p.hash_embedding("vehicle", 256, few) and p.hash_embedding("the", 8, few) == [0.0] * 8


def test_contents_pages_open_no_sections():
    page = ["Contents", "1.1 Scope ........ 3", "", "1.2 Terms and Words 7", "DEFINITIONS 12", "some prose", "", "1.1 Scope", "body", "1.2 Terms and Words", "more"]
    assert p.contents_lines(page) == {0, 1, 3, 4}
    assert [s.title for s in p.prose_sections("\n".join(page), "doc")] == ["doc", "1.1 Scope", "1.2 Terms and Words"]
    assert p.contents_lines(["1.1 Scope 3", "prose", "prose", "prose", "1.2 Terms 4", "x", "x", "x", "x", "x", "1.3 End 9"]) == set()


def test_long_texts_without_headings_are_cut_by_paragraphs():
    text = "\n\n".join(f"para {k} " + "word " * 60 for k in range(30))
    parts = p.prose_sections(text, "doc")
    assert len(parts) > 2 and all(len("\n".join(part.body)) <= 4000 for part in parts)
    assert all(b.start <= a.end for a, b in zip(parts, parts[1:]))  # they overlap
    assert {line for part in parts for line in part.body} >= set(text.split("\n"))
    assert len(p.prose_sections("one\n\ntwo", "doc")) == 1


@pytest.mark.parametrize("kind", ["py", "rs", "yml", "json", "md", "txt"])
def test_every_line_is_in_a_chunk_and_no_chunk_is_huge(kind):
    import random

    rng = random.Random(kind)
    starts = {
        "py": ["class A{}:", "def f{}():", "    def g{}(self):", "import x{}", "    return {}", ""], "rs": ["fn f{}() {{", "}}", "use a{};", "impl B{} {{", "    fn g{}() {{}}", ""],
        "yml": ["key{}: 1", "  sub{}: 2", "# note {}", "", "- item {}"], "json": ['  "k{}": 1,', '    "n{}": 2,', "{{", "}}"],
        "md": ["# Head {}", "## Under {}", "text {}", "", "- item {}", "| a{} | b |"], "txt": ["1.{} Heading Words", "body line {}", "", "LOUD LINE {}"],
    }[kind]
    assert structure.chunk(kind, "plain words only")[0][4] == "plain words only" and structure.chunk(kind, "") == []
    for _ in range(30):
        lines = [rng.choice(starts).format(n) for n in range(rng.randint(1, 900))] + ["x" * rng.choice([1, 50, 400])]
        rows = structure.chunk(kind, "\n".join(lines))
        shown = "\n".join(r[4] + "\n" + r[1] for r in rows)
        assert not {w for v in lines for w in v.split()} - set(shown.split()) - {"#", "##", ">"}
        assert max(len(r[4]) for r in rows) <= 4600
        if kind in ("py", "rs"):
            assert [v for r in rows for v in r[4].split("\n") if v.strip()] == [v for v in lines if v.strip()]  # each once, in order


def test_entries_of_a_list_are_sections_named_by_what_identifies_them():
    text = "# the rules\nrules:\n  - id: r1\n    tenantName: 'north'\n    on: true\n    body: |\n      id: no key\n\n      more\n  # second\n  - when: x # note\n    then:\n      - a\n      - b\n  - [1, 2]\nversion: 3\nname: \"n: 1\"\n\nlast:\n  code: c9\n"
    got = configs.sections(text, "yml")
    assert [(s.path, s.level, s.parent, s.first, s.last) for s in got] == [
        ("rules", 1, None, 1, 15), ("rules > id: r1, tenantName: north", 2, 0, 1, 9), ("rules > when: x", 2, 0, 10, 14), ("rules > #3", 2, 0, 15, 15), ("version, name", 1, None, 16, 17), ("last (code: c9)", 1, None, 19, 20),
    ]
    assert got[1].promoted == {"id": "r1", "tenantName": "north"} and got[0].chunks == [] and got[1].chunks == [(1, 9)]
    rows = '[\n  {"id": 1, "type": "a"},\n  {\n    "settle_code": "x",\n    "deep": {\n      "id": 2\n    }\n  }, // c\n  3\n]'
    assert [s.title for s in configs.sections(rows, "jsonc")] == ["id: 1, type: a", "settle_code: x", "#3"]
    tables = 'title = "t"\n[[job]]\nname = "one"\n[[job]]\nname = "two"\ntext = """\nname = 3\n"""\n[other.part]\nx = 1'
    assert [s.path for s in configs.sections(tables, "toml")] == ["title", "job", "job > name: one", "job > name: two", "other.part"]
    assert [s.path for s in configs.sections("[1, 2]\n# only", "json")] == [""] and [s.title for s in configs.sections("- a\n- b\n", "yaml")] == ["list"]


@pytest.mark.parametrize("seed", range(40))
def test_configuration_chunks_hold_every_line_once_and_in_order(seed):
    rng = random.Random(seed)

    def value(depth):
        if depth < 4 and rng.random() < 0.5:
            return {f"{rng.choice(['id', 'name', 'k'])}{i if rng.random() < 0.7 else ''}": value(depth + 1) for i in range(rng.randint(0, 5))}
        if depth < 4 and rng.random() < 0.4:
            return [value(depth + 1) for _ in range(rng.randint(0, 6))]
        return rng.choice([1, "x", "word " * rng.choice([1, 40, 400]), None, True])

    tree = {f"top{i}": value(1) for i in range(rng.randint(1, 6))}
    texts = {"json": json.dumps(tree, indent=rng.choice([1, 2, 4])), "yaml": as_yaml(tree, rng), "toml": "\n".join(f"[{k}]\nx = {json.dumps(str(v))}\n# c" for k, v in tree.items())}
    for kind, text in texts.items():
        lines = text.split("\n")
        chunks = configs.config_chunks(text, kind)
        seen = [n for _, a, b, _ in chunks for n in range(a, b + 1)]
        assert seen == sorted(set(seen)) and {n for n, x in enumerate(lines, 1) if x.strip()} <= set(seen)
        assert all("\n".join(lines[a - 1 : b]) == body for _, a, b, body in chunks)
        assert all(len(body) <= configs.CAP or a == b for _, a, b, body in chunks)


def as_yaml(tree, rng, indent=0):
    pad, out = " " * indent, []
    for k, v in tree.items() if isinstance(tree, dict) else [(None, v) for v in tree]:
        head = pad + (f"{k}:" if k is not None else "-")
        if rng.random() < 0.2:
            out += ["", pad + "# note"]
        if isinstance(v, (dict, list)) and v:
            below = as_yaml(v, rng, indent + 2)
            out += [head + " " + below.lstrip()] if k is None and below.lstrip() and not below.lstrip().startswith("#") else [head, below]
        elif isinstance(v, str) and rng.random() < 0.4:
            out += [head + " |", *[pad + "    id: " + x for x in v.split(" ")[:9]]]
        else:
            out.append(f"{head} {json.dumps(v)}")
    return "\n".join(out)


def test_markdown_sections_have_a_root_and_front_matter():
    text = "---\ntitle: 'ADR 007'\nStatus: accepted\n---\n# adr 007\n\nintro\n\n## One ##\ntext\n\nTwo\n---\nmore"
    got = p.markdown_sections(text, "file")
    assert [(s["path"], s["level"], s["parent"]) for s in got] == [("ADR 007", 0, None), ("ADR 007 > Front matter", 1, 0), ("ADR 007 > One", 2, 0), ("ADR 007 > Two", 2, 0)]
    assert got[0]["meta"] == {"status": "accepted", "number": "7"} and [b[3] for b in got[0]["blocks"]] == ["# adr 007", "intro"]
    assert [s["path"] for s in p.markdown_sections("para\n\n# Other\nx", "file")] == ["Other"]
    assert [s["path"] for s in p.markdown_sections("para", "file")] == ["file"]


def test_long_blocks_are_cut_by_their_kind():
    table = "| a | b |\n|---|---|\n" + "\n".join(f"| {i} | {'x' * 40} |" for i in range(100))
    parts = p.block_pieces("table", table)
    assert len(parts) > 2 and all(x.startswith("| a | b |\n|---|---|\n| ") and len(x) <= 1500 for x in parts)
    assert [r for x in parts for r in x.split("\n")[2:]] == table.split("\n")[2:]
    code = "```py\n" + "\n".join(f"    line_{i} = {i}" for i in range(400)) + "\n```"
    parts = p.block_pieces("code", code)
    assert all(x.startswith("```py\n") and x.endswith("\n```") and len(x) <= 3000 for x in parts) and [r for x in parts for r in x.split("\n")[1:-1]] == code.split("\n")[1:-1]
    items = "\n".join(f"- item {i} {'y' * 60}\n  below" for i in range(60))
    parts = p.block_pieces("list", items)
    assert all(x.startswith("- item") and len(x) <= 1500 for x in parts) and "\n".join(parts) == items
    prose = " ".join(f"Sentence number {i} is {'long ' * 8}here." for i in range(80))
    parts = p.block_pieces("paragraph", prose)
    assert all(len(x) <= 1500 for x in parts) and all(p.sentences(b)[0] == p.sentences(a)[-1] or len(p.sentences(a)[-1]) + 1 + len(b) > 1500 for a, b in zip(parts, parts[1:], strict=False))
    parts = p.block_pieces("paragraph", " ".join(f"Number {i} " + "w" * 700 + "." for i in range(5)))
    assert [x.count("Number") for x in parts] == [2, 2, 2] and parts[2].startswith("Number 3")  # the last one has room for a sentence before
    assert all(len(x) <= 1500 for x in p.block_pieces("paragraph", "z" * 4000)) and "".join(p.block_pieces("paragraph", "z" * 4000)) == "z" * 4000


def test_windows_start_where_a_list_of_all_word_starts_says(monkeypatch):
    import bisect
    import re

    r = random.Random(3)
    for size, overlap in ((30, 5), (80, 15), (200, 0)):
        for _ in range(100):
            text = "".join(r.choice(["a", "bc", "def ", " ", ". ", "\n", "? ", "\t", "x" * r.randrange(1, 90)]) for _ in range(r.randrange(300)))
            starts = [m.start() for m in re.finditer(r"(?<!\S)\S", text)]
            from_ = lambda n: starts[bisect.bisect_left(starts, n)] if starts and n <= starts[-1] else min(n, len(text))  # noqa: E731, B023
            want, start = [], from_(0)
            while len(text) > size:
                end = min(start + size, len(text))
                if end < len(text):
                    low = end - min(overlap, size - 1)
                    stops, blanks = list(re.finditer(r"[.?!]\s+", text[low:end])), list(re.finditer(r"\s", text[low:end]))
                    end = low + stops[-1].end() if stops else low + blanks[-1].start() if blanks else end
                want += [text[start:end].rstrip()] * bool(text[start:end].rstrip())
                if end == len(text):
                    break
                start = min(from_(start + size - overlap), end)
            assert p.windows(text, size, overlap) == (want or [text if len(text) <= size else ""])
    # no array is made of all starts for each window
    monkeypatch.setattr(p.np, "searchsorted", None)
    assert len(p.windows("word " * 1000, 800, 100)) > 6
