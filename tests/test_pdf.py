import zlib

import pytest
from pyspark.sql import functions as F

from tessella.operators.library import split_suspects
from tessella.sources import extract, pdf


def plain(contents, fonts="/F1 << /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>", extra=b""):
    """A file as simple writers make it: numbered objects, a table of them at the end."""
    kids = " ".join(f"{10 + 2 * k} 0 R" for k in range(len(contents)))
    parts = [b"1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj", f"2 0 obj\n<< /Type /Pages /Kids [{kids}] /Count {len(contents)} /Resources << /Font << {fonts} >> >> >>\nendobj".encode()]
    for k, c in enumerate(contents):
        parts += [f"{10 + 2 * k} 0 obj\n<< /Type /Page /Parent 2 0 R /Contents {11 + 2 * k} 0 R >>\nendobj".encode(), f"{11 + 2 * k} 0 obj\n<< /Length {len(c)} >>\nstream\n".encode() + c + b"\nendstream\nendobj"]
    return b"%PDF-1.4\n" + b"\n".join([*parts, extra]) + b"\ntrailer\n<< /Root 1 0 R >>\n%%EOF"


def packed(text):
    """As newer writers do: objects inside a compressed object stream, contents compressed, no trailer."""
    inner = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", 3: b"<< /Type /Page /Resources << /Font << /T 5 0 R >> >> /Contents [6 0 R 7 0 R] >>"}
    inner[5] = b"<< /Type /Font /Subtype /TrueType /FirstChar 65 /Widths [600 600 600] /Encoding << /Differences [1 /fi /eacute 200 /uni20AC] >> >>"
    heads, body = [], b""
    for n, value in inner.items():
        heads.append(f"{n} {len(body)}")
        body += value + b" "
    head = " ".join(heads).encode() + b" "
    made = zlib.compress(head + body)
    out = b"%%PDF-1.7\n9 0 obj\n<< /Type /ObjStm /N 4 /First %d /Filter /FlateDecode /Length %d >>\nstream\n" % (len(head), len(made)) + made + b"\nendstream\nendobj\n"
    for n, part in zip((6, 7), text, strict=True):
        z = zlib.compress(part)
        out += b"%d 0 obj\n<< /Filter [/FlateDecode] /Length 8 0 R >>\nstream\r\n" % n + z + b"\nendstream\nendobj\n"
    return out + b"10 0 obj\n<< /Type /XRef /Root 1 0 R >>\nendobj\n"


def test_simple_pages_lines_and_escapes():
    got = pdf.pdf_text(plain([rb"BT /F1 12 Tf 72 720 Td (First \(page\) w\157rds.) Tj 0 -14 Td (Second line) Tj ET", b"", b"BT /F1 10 Tf 1 0 0 1 72 700 Tm 12 TL (Third) Tj T* (page) Tj (s) ' ET"]))
    assert got == "[page 1]\nFirst (page) words.\nSecond line\n[page 3]\nThird\npage\ns"


def test_object_streams_kerning_and_differences():
    got = pdf.pdf_text(packed([b"q 2 0 0 2 0 0 cm BT /T 10 Tf [(AB) 20 (C) -400 (C\\001\\002\\310)] TJ", b"0 -20 Td <4142> Tj ET Q"]))
    assert got == "[page 1]\nABC Cfié€\nAB"


def test_character_maps_of_composite_fonts():
    cmap = b"begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0003> <0020> <0010> <00660069> endbfchar 1 beginbfrange <0020> <0022> <0041> <0030> <0031> [<0078> <D835DC00>] endbfrange endcmap"
    extra = b"5 0 obj\n<< /Length %d >>\nstream\n" % len(cmap) + cmap + b"\nendstream\nendobj\n6 0 obj\n<< /Subtype /CIDFontType2 /DW 500 /W [32 [700 700] 34 40 650] >>\nendobj"
    font = "/F1 << /Type /Font /Subtype /Type0 /Encoding /Identity-H /DescendantFonts [6 0 R] /ToUnicode 5 0 R >>"
    assert pdf.pdf_text(plain([b"BT /F1 12 Tf 10 10 Td <0020002100220003001000300031> Tj ET"], font, extra)) == "[page 1]\nABC fix𝐀"


def test_forms_and_spread_letters():
    form = b"5 0 obj\n<< /Subtype /Form /Length 35 >>\nstream\nBT /F1 10 Tf 5 5 Td (in a form) Tj ET\nendstream\nendobj"
    body = plain([b"/X Do"], extra=form).replace(b"/Resources << /Font", b"/Resources << /XObject << /X 5 0 R >> /Font")
    assert pdf.pdf_text(body) == "[page 1]\nin a form"
    words = "cancellations corrections notifications installations processing subscriptions".split()
    shown = b" ".join(b"[" + b" ".join(b"(%s) -150" % w[k : k + 3].encode() for k in range(0, len(w), 3)) + b" -250] TJ ( ) Tj" for w in words)
    data = plain([b"BT /F1 10 Tf 10 10 Td " + shown + b" ET"])
    known = frozenset(words)
    assert "can cel lat" in pdf.pdf_text(data)
    assert pdf.pdf_text(data, lambda t: split_suspects(t, known)[0]).split()[2:] == words


@pytest.mark.parametrize("data", [b"", b"%PDF-1.4\nnothing", b"%PDF-1.4\n1 0 obj\n<< /Type /Page /Contents 2 0 R >>\nendobj\n2 0 obj\n<< /Filter /FlateDecode >>\nstream\nxx\nendstream", b"%PDF-1.4\ntrailer << /Encrypt 1 0 R >>", plain([b"BT (x) Tj ET"])[:40]])
def test_broken_files_are_skipped(data):
    text, error = extract.extract("pdf", data)
    assert text is None and error


def test_extraction_in_a_job(spark):
    files = spark.createDataFrame([("a.pdf", bytearray(plain([b"BT /F1 9 Tf (one) Tj ET"]))), ("b.pdf", bytearray(b"no"))], "path string, content binary")
    got = {r.path: (r.text, r.error is None) for r in extract.extracted(files).select("path", "text", "error", F.lit(1)).collect()}
    assert got == {"a.pdf": ("[page 1]\none", True), "b.pdf": (None, False)}
