import random
import subprocess

import pytest
from pyspark.sql import functions as F

from tessella.operators import library as lb
from tessella.sources import extract


def test_names_of_several_words_take_the_nearest_tag(spark):
    tags = spark.createDataFrame([(t,) for t in ("direct debit", "debit", "the fee table of banks", "b a", "a b c d e f", None, "")], "name string")
    asked = ["Direct  debit", "debit", "debits", "debit direct", "direct debit fee", "the fee table of the banks", "a b", "new thing", "  ", None]
    got = {r.name: r.tag for r in lb.reuse_tags(spark.createDataFrame([(t,) for t in asked], "name string"), tags).collect()}
    assert got == {"direct  debit": "direct debit", "debit": "debit", "debits": "debits", "debit direct": "direct debit", "direct debit fee": "direct debit fee", "the fee table of the banks": "the fee table of banks", "a b": "b a", "new thing": "new thing"}


def test_tag_reuse_equals_all_pairs(spark):
    rng = random.Random(5)
    name = lambda: " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    tags, asked = {name() for _ in range(150)}, {name() for _ in range(150)}

    def cosine(a, b):
        x, y = a.split(), b.split()
        dot = sum(x.count(w) * y.count(w) for w in set(x))
        return round(dot / (sum(x.count(w) ** 2 for w in set(x)) * sum(y.count(w) ** 2 for w in set(y))) ** 0.5, 9)

    want = {}
    for a in asked:
        best = min(((-cosine(a, t), t) for t in tags), default=(0, a))
        want[a] = a if a in tags or " " not in a or -best[0] <= 0.82 else best[1]
    frame = lambda names: spark.createDataFrame([(n,) for n in names], "name string")
    assert {r.name: r.tag for r in lb.reuse_tags(frame(asked), frame(tags)).collect()} == want


def test_links_of_sections_and_documents(spark):
    sections = spark.createDataFrame([(1, "Refunds"), (2, ""), (3, "Empty chapter")], "section_id long, title string")
    chunks = spark.createDataFrame([(10, 1, 1, "document", "refund rules rules"), (11, 1, 1, "document", "rules apply"), (12, 1, 2, "document", "words"), (19, 1, None, "doc_summary", "sum")], "chunk_id long, item_id long, section_id long, kind string, content string")
    items = spark.createDataFrame([(1, "alpha alpha beta beta gamma")], "item_id long, text string")
    got = {}
    for r in lb.tag_links(sections, chunks, items).collect():
        got.setdefault(r.chunk_id, set()).add(r.tag)
    assert got == {10: {"rules", "refund", "refunds", "apply"}, 11: {"rules", "refund", "refunds", "apply"}, 19: {"alpha", "beta"}}


def test_torn_files_by_the_words_of_the_others(spark):
    words = "cancellations corrections notifications processing subscriptions installations confirmations".split()
    whole, torn = " ".join(words * 3), " ".join(w[:-4] + " " + w[-4:] for w in words * 3)
    rows = [(k, f"a/{k}.md", whole) for k in range(3)] + [(10, "x.pdf", torn), (11, "x.pdf", whole), (12, "torn.md", torn), (13, "y.PDF", None)]
    items = spark.createDataFrame(rows, "item_id long, external_id string, text string")
    known = lb.lexicon(items)
    assert known == frozenset(words)
    assert [r.item_id for r in lb.suspects(items, known).collect()] == [10]
    assert len(lb.lexicon(items, most=2)) == 2


IGNORES = {".gitignore": "*.log\n!keep.log\nout/\n/top.txt\ndeep/**/x.md\n**/any\n\\#odd\n[ab]?.py\n[!a-c]z\nlast/**\ntrail \n", "sub/.gitignore": "!*.log\n/only\nout2\n", "out/.gitignore": "!*\n"}
PATHS = [
    "a.log", "keep.log", "sub/b.log", "out/x", "sub/out/x", "sub/out", "top.txt", "sub/top.txt", "deep/x.md", "deep/p/q/x.md", "x.md", "any", "sub/any/file", "#odd", "a1.py", "c1.py", "sub/b2.py", "zz", "az",
    "last/f", "last/g/h", "sub/last/f", "sub/only", "sub/more/only", "only", "sub/out2/f", "out2/f", "trail", "plain", "out/keep.log",
]


def test_ignore_files_as_git_reads_them(spark, tmp_path):
    for at, text in [*IGNORES.items(), *[(p, "x") for p in PATHS if p != "sub/out"]]:
        (tmp_path / at).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / at).write_text(text)
    paths = [p for p in PATHS if p != "sub/out"]
    files = spark.createDataFrame([(p, 1) for p in paths], "rel string, size int")
    got = {r.rel for r in extract.not_ignored(files, spark.createDataFrame(list(IGNORES.items()), "rel string, text string")).collect()}
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    said = subprocess.run(["git", "-C", str(tmp_path), "check-ignore", "--no-index", "--stdin"], input="\n".join(paths), capture_output=True, text=True)
    assert got == set(paths) - set(said.stdout.splitlines())
    listed = extract.folder(spark, str(tmp_path)).where(F.col("rel").isin(paths))
    assert {r.rel for r in listed.select("rel").collect()} == got - {p for p in paths if p.startswith("build/")}


@pytest.mark.parametrize("line", ["", "  ", "# note", "/", "!"])
def test_lines_that_are_no_rules(line):
    assert extract.ignore_rule(line) is None
