import pytest
from pyspark.sql import functions as F

from tessella.operators import ingest as ig

FILES = [
    ("notes/a.md", "# Refunds\n\nRefund rules for direct debit (DD) apply.\n\n## Fees\n\nThe fee table of fees.\n\nMore fees here.", 1),
    ("conf/rules.yml", "rules:\n  - id: r1\n    when: x\n  - id: r2\n    when: y\n", 1),
    ("src/m.py", "import os\n\ndef one():\n    return 1\n\ndef two():\n    return 2\n", 1),
    ("docs/report.pdf", "[page 1]\nFIRST PART\n\nWords of the first page here.\n[page 2]\nWords of the second page.", 1),
    ("adr/d1.md", "# Decision: Use it (D0005)\n\n**Decision:** We use it.\n**Status:** Accepted\n\n## Action items\n- Ann: write by 2024-05-01", 1),
    ("glossary.txt", "KYC - know your customer", 1),
    ("empty.txt", "  ", 1),
    ("null.bin", None, 1),
]


def listed(spark, files):
    return spark.createDataFrame([(p, t, m, len(t or "")) for p, t, m in files], "external_id string, text string, mtime_ms long, size long")


@pytest.fixture(scope="module")
def first(spark):
    return ig.ingest(spark, listed(spark, FILES), ig.Library.empty(spark), 3)


def test_texts_are_parsed_once_and_records_told_as_before(spark, monkeypatch):
    from tessella.functions import text as fx
    from tessella.operators import structure

    made, stored = [], []
    parsed, write = structure.structured, ig.Scratch.write
    monkeypatch.setattr(structure, "structured", lambda *a, **k: made.append(parsed(*a, **k)) or made[-1])
    monkeypatch.setattr(ig.Scratch, "write", lambda self, df, name, *a: stored.append((df, name)) or write(self, df, name, *a))
    ig.ingest(spark, listed(spark, FILES[:3]), ig.Library.empty(spark), 3)
    assert [n for df, n in stored if df is made[0]] == ["parsed"] and all("MapInArrow" not in df._jdf.queryExecution().executedPlan().toString() for df, n in stored if n in ("sections-0", "leaves-0"))
    texts = ["The Agenda of", "agendas", "retro", "retrospect", "# Decision one", "a decision", "Status:\n accepted", "**Status:** Approved", "## Action items:\nx", "**action item**", "ADR-1", "quadr-1", "revisit triggers", None, ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    head = F.lower(F.substring(F.coalesce("t", F.lit("")), 1, 12_000))
    for r in rows.select(fx.bucket(F.col("t")).alias("b"), F.array(*[head.rlike(p) for p in fx.RECORD_PATTERNS]).alias("m")).collect():
        assert (r.b == "record") == any(r.m)


def by_path(done):
    items = {r.item_id: r.external_id for r in done.library.items.collect()}
    out = {}
    for r in done.library.chunks.orderBy("chunk_id").collect():
        out.setdefault(items[r.item_id], []).append((r.kind, r.path, r.content))
    return out


def test_one_call_makes_the_whole_library(spark, first):
    assert {r.action: r.n for r in first.report.collect()} == {"insert": 8}
    chunks = by_path(first)
    assert chunks["notes/a.md"][1] == ("document", "Refunds > Fees", "## Fees\n\nThe fee table of fees.\n\nMore fees here.")
    assert ("section_summary", "Refunds > Fees", "## Fees\n\nThe fee table of fees.") in chunks["notes/a.md"] and chunks["notes/a.md"][-1][0] == "doc_summary"
    assert [c[1] for c in chunks["conf/rules.yml"] if c[0] == "document"] == ["rules > id: r1", "rules > id: r2"]
    assert [c[2] for c in chunks["src/m.py"] if c[0] == "document"] == ["import os\n", "def one():\n    return 1\n", "def two():\n    return 2\n"]
    pages = [c for c in chunks["docs/report.pdf"] if c[0] == "document"]
    assert not any("[page" in c[2] for c in pages) and any(c[1].endswith("(pp. 1-2)") or c[1].endswith("(p. 2)") for c in pages)
    assert "empty.txt" not in chunks and "null.bin" not in chunks
    sections = {r.section_id: r for r in first.library.sections.collect()}
    assert all(r.parent_id is None or sections[r.parent_id].item_id == r.item_id for r in sections.values())
    assert all(r.section_id in sections for r in first.library.chunks.where("section_id IS NOT NULL").collect())
    assert {(r.kind, r.record_id) for r in first.library.entities.collect()} == {("decision", "D0005"), ("action", None)}
    assert {(r.term, r.expansion) for r in first.library.vocabulary.collect()} >= {("kyc", "know your customer"), ("dd", "direct debit")}
    tagged = {r.chunk_id for r in first.library.links.collect()}
    assert tagged and {r.tag for r in first.library.links.collect()} >= {"fees", "refunds"}
    assert all(r.processed_hash == r.content_hash and r.chunker_version == ig.CHUNKER for r in first.library.items.collect())


def test_nothing_changes_when_nothing_did(spark, first):
    again = ig.ingest(spark, listed(spark, FILES), first.library, 3)
    assert {r.action: r.n for r in again.report.collect()} == {"skip": 8}
    for name in first.library.__dict__:
        key = lambda df: sorted(map(str, df.collect()))
        assert key(getattr(again.library, name)) == key(getattr(first.library, name)), name


def test_changes_touch_their_items_only(spark, first):
    files = [("notes/a.md", "# Refunds\n\nAll new.", 2), ("conf/rules.yml", FILES[1][1], 9), *FILES[2:6], ("z.txt", "A new file.", 1)]
    protected = spark.createDataFrame([("null.bin",)], "external_id string")
    now = ig.ingest(spark, listed(spark, files), first.library, 3, protected=protected)
    assert {r.action: r.n for r in now.report.collect()} == {"insert": 1, "update": 1, "skip": 5, "purge": 1}
    old, new = {r.external_id: r for r in first.library.items.collect()}, {r.external_id: r for r in now.library.items.collect()}
    assert set(new) == set(old) - {"empty.txt"} | {"z.txt"} and all(new[p].item_id == old[p].item_id for p in set(new) & set(old))
    assert new["conf/rules.yml"].mtime_ms == 9 and new["z.txt"].item_id == max(r.item_id for r in old.values()) + 1
    chunks = by_path(now)
    assert [c[2] for c in chunks["notes/a.md"] if c[0] == "document"] == ["# Refunds\n\nAll new."] and chunks["src/m.py"] == by_path(first)["src/m.py"]
    other = ig.ingest(spark, listed(spark, [("b.txt", "Of another source.", 1)]), now.library, 4)
    assert {r.action: r.n for r in other.report.collect()} == {"insert": 1} and other.library.items.count() == len(new) + 1
    none = ig.ingest(spark, listed(spark, []), now.library, 3)
    assert none.library.items.count() == len(new)  # an empty listing purges nothing


def test_older_rules_are_made_anew(spark, first):
    aged = ig.Library(**{**first.library.__dict__, "items": first.library.items.withColumn("chunker_version", F.when(F.col("external_id") == "src/m.py", 1).otherwise(F.col("chunker_version")))})
    done = ig.ingest(spark, listed(spark, FILES), aged, 3)
    assert {r.action: r.n for r in done.report.collect()} == {"update": 1, "skip": 7} and by_path(done) == by_path(first)


#: What holds texts in the plans of an ingest.
TEXTS = r"\b(?:text|content|_text|_own|whole|leaves|chunks|summary)#"


def watched(spark, monkeypatch, made):
    """From now on what is stored, as (name, whether its rows hold texts, how many of its shuffles hold texts)."""
    import re

    write = ig.Scratch.write

    def told(self, df, name, *a):
        plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        dealt = [re.search(r"^Input \[\d+\]: (.*)$", p, re.M)[1] for p in re.split(r"\n(?=\(\d+\) )", plan) if re.match(r"\(\d+\) Exchange\b", p)]
        made.append((name, bool(set(df.columns) & {"text", "content", "leaves", "clean"}), sum(bool(re.search(TEXTS, x)) for x in dealt)))
        return write(self, df, name, *a)

    monkeypatch.setattr(ig.Scratch, "write", told)


def test_texts_are_dealt_once_and_stored_once_a_step(spark, monkeypatch):
    made = []
    watched(spark, monkeypatch, made)
    ig.ingest(spark, listed(spark, FILES), ig.Library.empty(spark), 3)
    assert sum(n for *_, n in made) == 1
    assert [name for name, holds, _ in made if holds and not name.startswith("kept-")] == ["fresh", "parsed", "chunks"]


def test_leaves_and_sections_have_their_own_pages(spark):
    text = "1.1 Intro\n\n[page 1]\nSome words of the first page.\n\n[page 2]\n1.2 Scope\n\nMore words here, of [page 0003] too.\n\n1.3 Rest\n\nNone."
    done = ig.ingest(spark, listed(spark, [("docs/a.log", text, 1)]), ig.Library.empty(spark), 3)
    chunks = {(r.kind, r.content.strip()): r.path for r in done.library.chunks.collect()}
    assert {c: p for (k, c), p in chunks.items() if k == "document"} == {
        "Some words of the first page.": "a > 1.1 Intro (pp. 1-2)", "More words here, of [page 0003] too.": "a > 1.2 Scope (pp. 2-3)", "None.": "a > 1.3 Rest (p. 3)",
    }
    assert {r.title: r.path for r in done.library.sections.collect()} == {"a": "a", "1.1 Intro": "a > 1.1 Intro (pp. 1-2)", "1.2 Scope": "a > 1.2 Scope (pp. 2-3)", "1.3 Rest": "a > 1.3 Rest (p. 3)"}
    assert chunks["section_summary", "More words here, of [page 0003] too."] == "a > 1.2 Scope (pp. 2-3)"


def test_a_second_sync_moves_no_text_that_stays(spark, first, monkeypatch):
    made = []
    watched(spark, monkeypatch, made)
    files = [("notes/a.md", "# Refunds\n\nAll new.", 2), *FILES[1:6]]
    now = ig.ingest(spark, listed(spark, files), first.library, 3)
    assert {r.action: r.n for r in now.report.collect()} == {"update": 1, "skip": 5, "purge": 2}
    assert {n for name, _, n in made if name.startswith("kept-")} == {0} and sum(n for *_, n in made) == 1
