import base64
import io
import struct
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessella.sources import assets, extract
from tessella.streaming import streams

PNG = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 64, 48) + b"\x08"


@pytest.mark.parametrize("data,want", [
    (PNG, ("png", 64, 48)), (b"RIFF\0\0\0\0WEBPVP8 " + b"\0" * 10 + struct.pack("<HH", 100, 50), ("webp", 100, 50)),
    (b"RIFF\0\0\0\0WEBPVP8L" + b"\0" * 5 + struct.pack("<I", 99 | 49 << 14) + b"\0" * 9, ("webp", 100, 50)), (b"\xff\xd8\xff\xe0\0\x04ab\xff\xff\xc5\0\x0b\x08\0\x32\0\x64\0\0", ("jpeg", 100, 50)),
    (b"\xff\xd8\xff\xd9", ("jpeg", None, None)), (b"<?xml?><SVG width='9'>", ("svg", None, None)), (b"text", None), (b"", None),
])
def test_image_headers(data, want):
    assert extract.image_size(data) == want


def test_references_lead_to_files_inside_the_root(spark):
    cases = {
        ("docs/a/x.md", "pic.png"): "docs/a/pic.png", ("docs/a/x.md", "../pic.png?v=1#t"): "docs/pic.png", ("docs/a/x.md", "/img/p%20q.png"): "img/p q.png", ("x.md", "../../out.png"): None, ("docs/x.md", "../../docs/a.png"): None,
        ("x.md", "http://h/p.png"): None, ("x.md", "//h/p.png"): None, ("x.md", "mailto:a@b"): None, ("x.md", "data:image/png;base64,AA=="): None, ("x.md", ""): None, ("a/x.md", "./b/../c.png"): "a/c.png",
    }
    df = spark.createDataFrame([(d, s, w) for (d, s), w in cases.items()], "doc string, src string, want string")
    bad = df.withColumn("got", assets.target_path(F.col("doc"), F.col("src"))).where("NOT got <=> want").collect()
    assert not bad
    refs = spark.createDataFrame([("docs/x.md", "a.png"), ("docs/x.md", "gone.png"), ("docs/x.md", "note.txt"), ("docs/x.md", "big.gif"), ("docs/x.md", "data:image/png;base64," + base64.b64encode(PNG).decode())], "doc string, src string")
    files = spark.createDataFrame([("docs/a.png", len(PNG), PNG), ("docs/note.txt", 4, b"text"), ("docs/big.gif", 999, b"GIF89a")], "rel string, size long, content binary")
    got = {r.ref_path: (r.kind, r.width, r.height, r.size) for r in assets.resolved(refs, files, 500).collect()}
    assert got == {"docs/a.png": ("png", 64, 48, len(PNG)), "docs/big.gif": ("gif", None, None, 999), "": ("png", 64, 48, len(PNG))}
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("word/media/image1.png", PNG)
        z.writestr("word/media/dot.png", PNG[:16] + struct.pack(">II", 4, 4) + b"\x08")
        z.writestr("word/document.xml", "<x/>")
    inside = assets.package_images(spark.createDataFrame([("a.docx", box.getvalue()), ("b.docx", b"no zip")], "path string, content binary")).collect()
    assert [(r.path, r.part, r.width) for r in inside] == [("a.docx", "word/media/image1.png", 64)]


def test_a_watched_folder_goes_on_where_it_stopped(spark, tmp_path):
    root, seen = tmp_path / "in", []
    root.mkdir()
    Path(root / "a.txt").write_text("a")
    run = lambda: streams.watched(spark, str(root), lambda batch, _: seen.extend(Path(r.path).name for r in batch.select("path").collect()), str(tmp_path / "state"), None).awaitTermination()
    run()
    Path(root / "b.txt").write_text("b")
    run()
    assert seen == ["a.txt", "b.txt"]


def test_backfill_tries_again_and_polls_are_due(spark, tmp_path):
    spark.range(10).write.parquet(f"{tmp_path}/chunks")
    failed, out = [1, 1], f"{tmp_path}/vectors"

    def embed(batch):
        if failed:
            failed.pop()
            raise RuntimeError("provider")
        return batch.withColumn("embedding", F.array(F.lit(1.0)))

    step = streams.backfill_step(embed, lambda df: df.write.mode("append").parquet(out), wait=0)
    for _ in range(2):  # the second run has nothing left to do
        streams.in_batches(streams.table_stream(spark, f"{tmp_path}/chunks"), step, f"{tmp_path}/state").awaitTermination()
    assert spark.read.parquet(out).count() == 10
    rows = [(1, "jira", True, "2024-01-01 00:50:00"), (2, "jira", True, "2024-01-01 00:40:00"), (3, "folder", True, None), (4, "folder", False, None), (5, "rest", True, None)]
    sources = spark.createDataFrame(rows, "source_id int, connector string, enabled boolean, last_sync string").withColumn("last_sync", F.col("last_sync").cast("timestamp"))
    due = streams.due_sources(sources, F.lit("2024-01-01 01:00:00").cast("timestamp"))
    assert sorted(r.source_id for r in due.collect()) == [2, 3]
