import io
import zipfile

import pytest

from folioforge.sources import detect, html, markdown, office, store


def md(spark, text):
    rows = spark.createDataFrame([("d", text)], "document_id string, source string")
    return markdown.markdown_blocks(rows).orderBy("block_index").collect()


def test_markdown_blocks(spark):
    got = md(spark, "# Guide\nText one\n\n## Safety\nMore\n")
    assert [r.kind for r in got] == ["heading", "paragraph", "heading", "paragraph"]
    assert got[-1].heading_path == ["Guide", "Safety"] and got[1].start_offset == 8 and got[1].end_offset == 17


def test_markdown_fences_lists_and_gaps(spark):
    got = md(spark, "- a\n- b\n\n```\n# no\n\ncode\n```\n#### Deep ##\r\nend")
    assert [r.kind for r in got] == ["list", "paragraph", "heading", "paragraph"]
    assert got[1].text == "``` # no code ```" and got[2].text == "Deep" and got[3].heading_path == [None, None, None, "Deep"]
    assert md(spark, "") == [] and md(spark, " \n\n") == []


def blocks(text):
    return html.blocks_of(html.parse_tree(text))


def test_html_blocks():
    got = blocks("<h1>Manual</h1><script>x</script><p>one<h2>Settings</h2><table><tr><th>a<td>b<tr><td>c</table>")
    assert [k for k, *_ in got] == ["heading", "paragraph", "heading", "table"]
    assert got[3][1:] == ("a | b c", ["Manual", "Settings"])


def test_html_lists_containers_quotes():
    assert blocks("<ol><li>x<ul><li>y</ul><li>z</ol>") == [("list", "1. x 2. y 3. z", [])]
    assert blocks("<div>own<p>in</p></div><div>leaf</div>") == [("paragraph", "in", []), ("paragraph", "leaf", [])]
    assert [t for _, t, _ in blocks("<blockquote><p>q</p></blockquote>")] == ["q", "q"]
    assert blocks("<p>a<br>b <b>c<p>d") == [("paragraph", "a b c", []), ("paragraph", "d", [])]
    assert blocks("") == [] and blocks("<p> </p>") == []


def test_embedded_images(spark):
    pages = spark.createDataFrame([(1, '<img src="data:image/png;base64,aGVsbG8="><img src="data:image/png;base64,aGVsbG8="><img src="data:image/svg+xml;base64,aGVsbG8=">')], "page_id int, html string")
    got = html.embedded_images(pages).collect()
    assert [(r.media_type, bytes(r.data)) for r in got] == [("image/png", b"hello")]
    assert html.decode_data_url("data:image/bmp;base64,aGVsbG8=") is None


def archive(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name.replace("__", "/"), text)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
RELS = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'


def para(text, style="", numbered=False):
    props = (f'<w:pStyle w:val="{style}"/>' if style else "") + ("<w:numPr/>" if numbered else "")
    return f"<w:p><w:pPr>{props}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>"


def test_docx():
    cell = lambda t: f"<w:tc>{para(t)}</w:tc>"
    body = para("Operations Guide", "Heading1") + para("Hello") + para("Security", "Heading2") + para("a", numbered=True) + para("b", numbered=True) + f"<w:tbl><w:tr>{cell('x')}{cell('y')}</w:tr></w:tbl>"
    got = office.docx_blocks(archive(**{"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>"}))
    assert [k for k, *_ in got] == ["heading", "paragraph", "heading", "list", "table"]
    assert got[3][1:3] == ("- a - b", ["Operations Guide", "Security"]) and got[4][1] == "x | y"


def workbook(cells):
    rows = "".join(f'<row><c r="{a}" t="inlineStr"><is><t>{t}</t></is></c></row>' for a, t in cells)
    return {
        "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="Summary" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships {RELS}><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f"<worksheet {S}><sheetData>{rows}</sheetData></worksheet>",
    }


def test_xlsx_regions():
    got = office.xlsx_blocks(archive(**workbook([("A1", "a"), ("C2", "b"), ("A3", "c"), ("A5", "d"), ("B7", "e"), ("A6", "f")])))
    assert [b[3]["cell_range"] for b in got] == ["A1:C3", "A5:B7"]
    assert got[0][2] == ["Summary"]


def test_xlsx_images():
    d = 'xmlns:xdr="http://schemas.openxmlformats.org/drawingml/2006/spreadsheetDrawing" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    files = workbook([("A1", "a")]) | {
        "xl/worksheets/_rels/sheet1.xml.rels": f'<Relationships {RELS}><Relationship Id="d1" Target="../drawings/drawing1.xml"/></Relationships>',
        "xl/drawings/drawing1.xml": f'<xdr:wsDr {d}><xdr:oneCellAnchor><xdr:from><xdr:col>1</xdr:col><xdr:row>2</xdr:row></xdr:from><xdr:pic><a:blip r:embed="i1"/></xdr:pic></xdr:oneCellAnchor></xdr:wsDr>',
        "xl/drawings/_rels/drawing1.xml.rels": f'<Relationships {RELS}><Relationship Id="i1" Target="../media/image1.png"/></Relationships>',
        "xl/media/image1.png": "pic",
        "xl/media/image2.png": "other",
    }
    got = office.xlsx_images(archive(**files))
    assert got[0] == ("image/png", b"pic", {"sheet": "Summary", "cell_range": "B3", "image_index": 1}) and got[1][1] == b"other"


def test_broken_office_files(spark):
    with pytest.raises(office.BadFile):
        office.docx_blocks(b"text")
    rows = spark.createDataFrame([("a", "xlsx", bytearray(b"text")), ("b", "odt", bytearray(b""))], "document_id string, source_type string, content binary")
    assert all(r.error for r in office.office_blocks(rows).collect())


def test_detection(spark):
    rows = spark.createDataFrame(
        [("a.PDF", "text/plain", 5), ("b", "text/html; charset=utf-8", 5), ("c.bin", "x/y", 5), (" ", "text/plain", 5), ("d.txt", None, 0)], "name string, mime_type string, size_bytes long"
    )
    got = [(r.source_type, r.reason) for r in detect.validate_uploads(rows).collect()]
    assert got == [("pdf", None), ("html", None), (None, "type"), ("text", "name"), ("text", "size")]


def test_manual_rule_and_rename(spark):
    from pyspark.sql import functions as F

    got = spark.range(1).select(detect.manual_rule(F.lit(" First: line\r\nsecond ")).alias("m"), detect.rename_reason(F.lit("a.pdf"), F.lit("b.txt")).alias("r"), detect.rename_reason(F.lit("a.pdf"), F.lit("b.PDF")).alias("ok")).first()
    assert (got.m.content, got.m.title, got.m.filename, got.m.reason) == ("First: line\nsecond", "First: line", "First line.md", None)
    assert got.r == "extension" and got.ok is None


def test_snapshots(spark, tmp_path):
    s = store.Snapshots(spark, str(tmp_path / "t"))
    with pytest.raises(FileNotFoundError):
        s.read()
    s.replace(spark.createDataFrame([("o", 1)], "owner_id string, v int"))
    s.replace(spark.createDataFrame([("o", 2), ("p", 3)], "owner_id string, v int"))
    assert sorted(r.v for r in s.read().collect()) == [2, 3] and s.drop_old() == 1
    kept = store.replace_group(s.read().select("owner_id", "v"), spark.createDataFrame([("o", 9)], "owner_id string, v int"), ["owner_id"])
    assert sorted((r.owner_id, r.v) for r in kept.collect()) == [("o", 9), ("p", 3)]
    with pytest.raises(ValueError):
        store.delete_where(kept, "o")
