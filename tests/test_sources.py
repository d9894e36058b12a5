import io
import struct
import zipfile

import pytest

from tessella.sources import extract, json_map


def test_decode():
    assert extract.decode("é".encode()) == "é"
    assert extract.decode("\ufeffa".encode("utf-16")) is not None
    assert extract.decode("abcd".encode("utf-16-le")) == "abcd"
    assert extract.decode(b"caf\xe9 au lait") == "café au lait"
    assert extract.decode(bytes(range(256)) * 4) is None
    assert extract.decode(b"") == ""


def test_html_and_images():
    assert extract.html("<style>x</style><h2>T</h2><p>a<br>b &amp; c</p><img src='u.png' alt='A'>") == "## T\n\na\nb & c\n![A](u.png)"
    assert extract.image_refs("![a](b.png)\n```\n![x](y)\n```\n<img src=\"c.png\">") == [("a", "b.png"), ("", "c.png")]


def package(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def test_office():
    w = 'xmlns:w="w"'
    doc = f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    assert extract.office(package({"word/document.xml": doc}), "docx") == "## Head\n\nBody\n\na\tb"
    book = '<workbook><sheets><sheet name="S"/></sheets></workbook>'
    sheet = '<worksheet><sheetData><row><c t="s"><v>0</v></c><c><v>2</v></c></row></sheetData></worksheet>'
    xlsx = package({"xl/workbook.xml": book, "xl/sharedStrings.xml": "<sst><si><t>x</t></si></sst>", "xl/worksheets/sheet1.xml": sheet})
    assert extract.office(xlsx, "xlsx") == "## Sheet: S\nx | 2"
    slide = '<p:sld xmlns:p="p" xmlns:a="a"><a:p><a:r><a:t>Hi</a:t></a:r></a:p></p:sld>'
    assert extract.office(package({"ppt/slides/slide1.xml": slide}), "pptx") == "# Slide 1\nHi"


def test_other_formats():
    assert extract.rtf(r"{\rtf1\ansi{\fonttbl x}Hello\par caf\'e9 \u8364?{\*\x y}}") == "Hello\ncafé €"
    assert extract.eml(b"From: a@b\nSubject: S\nContent-Type: text/plain\n\nhello") == "From: a@b\nSubject: S\n\nhello"
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 3, 4)
    assert extract.image_size(png) == ("png", 3, 4) and extract.image_size(b"no") is None
    xml = '<mxfile><mxCell id="1" vertex="1" value="A"><mxGeometry x="9" y="0" height="10"/></mxCell><mxCell id="2" vertex="1" value="B"><mxGeometry x="0" y="2" height="10"/></mxCell><mxCell id="3" edge="1" source="1" target="2" value="go"/></mxfile>'
    assert extract.diagram(xml) == "B\nA\nA → B: go"
    assert extract.dehyphenated("exam-\nple A-\nB") == "example A-\nB"
    assert extract.extract("docx", b"broken")[1]


def test_folder_and_extraction(spark, tmp_path):
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "x.txt").write_text("skipped")
    (tmp_path / "a.html").write_text("<h1>Hi</h1>")
    (tmp_path / "b.txt").write_bytes(bytes(range(256)) * 4)
    files = extract.folder(spark, str(tmp_path))
    assert sorted(r.rel for r in files.select("rel").collect()) == ["a.html", "b.txt"]
    got = {r.path.rsplit("/", 1)[-1]: (r.text, r.error) for r in extract.extracted(files).collect()}
    assert got == {"a.html": ("# Hi", None), "b.txt": (None, "binary")}


@pytest.mark.parametrize("body,n", [('[{"id":1}]', 1), ('{"data":[{"id":1},{"id":2}]}', 2), ('{"results":[{"id":1}]}', 1), ('{"x":1}', 0)])
def test_find_items(spark, body, n):
    assert json_map.find_items(spark.createDataFrame([(body,)], "body string")).count() == n


def test_mapping_falls_back(spark):
    rows = [('{"key":"K1","a":{"b":"T"},"n":5}',), ('{"a":{"b":"T"}}',), ('{"z":1}',)]
    got = json_map.documents(spark.createDataFrame(rows, "item string"), json_map.Mapping(title="a.b", text="/n")).select("external_id", "title", "text").collect()
    assert sorted(r.title for r in got) == ["T", "T"]
    assert {r.external_id for r in got} > {"K1"} and any(r.external_id.startswith("rest-") for r in got)
