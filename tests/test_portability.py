import pytest

from tessella.operators import portability as po

ITEM = "item_id long, uid string, source_id int, path string, updated_at string"
SECTION = "section_id int, uid string, item_id long, parent_id int, title string, updated_at string"


@pytest.fixture
def tables(spark):
    return {
        "source": spark.createDataFrame([(1, "a", "A", "1"), (2, "b", "B", "1")], "source_id int, uid string, name string, updated_at string"),
        "item": spark.createDataFrame([(10, "x", 1, "x.md", "2"), (11, "y", 2, "y.md", None)], ITEM),
        "section": spark.createDataFrame([(5, "s1", 10, None, "one", "1"), (6, "s2", 10, 5, "two", "1"), (7, "s3", 11, None, "three", "1")], SECTION),
    }


def rows(df):
    return {r.uid: r for r in df.collect()}


def test_export_names_by_uid_and_keeps_to_its_scope(spark, tables):
    lines = po.export(tables, spark.createDataFrame([(1,)], "source_id int"))
    assert sorted((r.kind, r.uid) for r in lines.collect()) == [("item", "x"), ("section", "s1"), ("section", "s2"), ("source", "a")]
    text = {r.uid: r.line for r in lines.collect()}
    assert '"refs":{"item_id":"x","parent_id":"s1"}' in text["s2"] and "10" not in text["s2"] and '"section_id"' not in text["s2"]


def test_a_round_trip_into_an_empty_and_into_a_full_library(spark, tables, tmp_path):
    po.write_bundle(po.export(tables), f"{tmp_path}/b")
    lines = po.read_bundle(spark, f"{tmp_path}/b")
    empty = {k: t.limit(0) for k, t in tables.items()}
    done = po.import_lines(spark, empty, lines)
    got = {k: rows(t) for k, t in done.tables.items()}
    assert got["section"]["s2"].parent_id == got["section"]["s1"].section_id and got["section"]["s2"].item_id == got["item"]["x"].item_id
    assert got["item"]["y"].source_id == got["source"]["b"].source_id and sorted(r.item_id for r in got["item"].values()) == [1, 2]
    again = po.import_lines(spark, tables, lines)
    assert {r.kind: (r.added, r.updated, r.kept, r.removed, r.unresolved) for r in again.report.collect()} == {"source": (0, 0, 2, 0, 0), "item": (0, 0, 2, 0, 0), "section": (0, 0, 3, 0, 0)}
    assert {k: rows(t) for k, t in again.tables.items()} == {k: rows(t) for k, t in tables.items()}


def test_later_stamps_win_and_references_wait_for_all_ids(spark, tables):
    other = {
        "source": tables["source"].limit(0),
        "item": spark.createDataFrame([(1, "x", 9, "old.md", "1"), (2, "y", 9, "newer.md", "0"), (3, "z", 9, "z.md", None)], ITEM),
        "section": spark.createDataFrame([(1, "t2", 3, 2, "child", "1"), (2, "t1", 3, 1, "parent of its parent", "1"), (3, "s1", 2, 99, "moved", "2")], SECTION),
    }
    junk = spark.createDataFrame([("{broken",), ('{"kind":"other","uid":"q"}',), ('{"kind":"item","fields":{}}',), ('{"kind":"item","uid":"y","fields":{"path":"twice.md","updated_at":"3"},"refs":{"source_id":"nowhere"}}',)], "line string")
    done = po.import_lines(spark, tables, po.export(other).select("line").unionByName(junk))
    items, sections = rows(done.tables["item"]), rows(done.tables["section"])
    assert (items["x"].path, items["x"].source_id) == ("x.md", 1)  # an earlier stamp changes nothing
    assert (items["y"].path, items["y"].item_id, items["y"].source_id) == ("twice.md", 11, None)  # the latest line of a uid; nowhere leads nowhere
    assert items["z"].item_id == 12 and (sections["t1"].section_id, sections["t2"].section_id) == (8, 9)
    assert sections["t1"].parent_id == 9 and sections["t2"].parent_id == 8 and sections["t2"].item_id == 12
    assert (sections["s1"].title, sections["s1"].item_id, sections["s1"].section_id) == ("moved", 11, 5)
    told = {r.kind: (r.added, r.updated, r.kept, r.removed, r.unresolved) for r in done.report.collect()}
    assert told == {"source": (0, 0, 0, 0, 0), "item": (1, 1, 1, 0, 1), "section": (2, 1, 0, 0, 0)}


def test_replace_and_dry_run(spark, tables):
    lines = po.export({k: t.where("uid IN ('a', 'x', 's1')") for k, t in tables.items()})
    dry = po.import_lines(spark, tables, lines, replace=True, dry_run=True)
    assert {r.kind: (r.updated, r.removed) for r in dry.report.collect()} == {"source": (1, 1), "item": (1, 1), "section": (1, 2)} and dry.tables is tables
    done = po.import_lines(spark, tables, lines, replace=True)
    assert {k: set(rows(t)) for k, t in done.tables.items()} == {"source": {"a"}, "item": {"x"}, "section": {"s1"}}
    assert rows(done.tables["item"])["x"].item_id == 10
