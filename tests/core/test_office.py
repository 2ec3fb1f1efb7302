"""Office readers over small files built by hand, the head of a page left open, sidecars, and the canonical hash."""

import io
import struct
import zipfile
import zlib

import pytest

from tidemark.operators import converters, office, pdf


def pack(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'
REL = '<Relationship Id="{}" Type="http://x/{}" Target="{}"/>'


def workbook():
    rows = "".join(f'<row r="{k}"><c r="B{k}"><v>{k}</v></c><c r="C{k}" t="s"><v>1</v></c></row>' for k in range(3, 300))
    sheet = f'<worksheet><sheetData><row r="2"><c r="B2" t="s"><v>0</v></c><c r="C2" t="inlineStr"><is><t>name|x</t></is></c><c r="D2" s="1"><v>45292.5</v></c><c r="E2" t="b"><v>1</v></c></row>{rows}</sheetData><mergeCells><mergeCell ref="E2:F2"/></mergeCells></worksheet>'
    return pack({
        "xl/workbook.xml": '<workbook xmlns:r="http://r"><sheets><sheet name="Data" r:id="rId1"/><sheet name="Empty" state="hidden" r:id="rId2"/><sheet name="Chart" r:id="rId3"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": RELS.format(REL.format("rId1", "worksheet", "worksheets/sheet1.xml") + REL.format("rId2", "worksheet", "/xl/worksheets/sheet2.xml") + REL.format("rId3", "chartsheet", "chartsheets/sheet1.xml")),
        "xl/sharedStrings.xml": "<sst><si><t>n</t></si><si><r><t>two </t></r><r><t>runs</t></r></si></sst>",
        "xl/styles.xml": '<styleSheet><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": sheet, "xl/worksheets/sheet2.xml": "<worksheet><sheetData/></worksheet>", "xl/chartsheets/sheet1.xml": "<chartsheet/>",
    })


def test_workbook():
    units = office.from_workbook("w.xlsx", workbook())
    assert [(u["unit_id"], u["kind"]) for u in units] == [("00-index", "index"), ("01-Data", "sheet"), ("01-Data.csv", "sidecar"), ("02-Empty", "sheet")]
    index, data, whole, empty = (u["body"] for u in units)
    assert "| 1 | Data | B2:F299 | 298 | 5 |" in index and "| 3 | Chart | chartsheet |" in index and "Terms: n; name|x; true; two runs" in index
    assert "| n | name\\|x | 2024-01-01 12:00:00 | true | true |" in data and "97 more rows in the sidecar" in data and "| 203 |" not in data
    assert whole.count("\n") == 298 and "299,two runs,,," in whole and "[empty sheet]" in empty


def test_slides():
    shape = '<p:sp><p:nvPr><p:ph type="{}"/></p:nvPr><a:off x="{}" y="{}"/><a:p><a:t>{}</a:t></a:p></p:sp>'
    slide = '<p:sld xmlns:p="p" xmlns:a="a">' + shape.format("body", 500, 900_000, "low") + shape.format("", 900, 100_000, "right") + shape.format("", 100, 120_000, "left") + shape.format("title", 0, 0, "Head") + shape.format("sldNum", 0, 0, "7") + "</p:sld>"
    data = pack({
        "ppt/presentation.xml": '<p:presentation xmlns:p="p" xmlns:r="http://r"><p:sldIdLst><p:sldId id="256" r:id="rId9"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": RELS.format(REL.format("rId9", "slide", "slides/slide1.xml")),
        "ppt/slides/slide1.xml": slide, "ppt/slides/_rels/slide1.xml.rels": RELS.format(REL.format("rId1", "notesSlide", "../notesSlides/n1.xml")),
        "ppt/notesSlides/n1.xml": '<p:notes xmlns:p="p" xmlns:a="a">' + shape.format("body", 0, 0, "said") + "</p:notes>",
    })
    (u,) = office.from_slides("s.pptx", data)
    assert u["title"] == "Head" and u["body"] == "## Slide 1: Head\n\nleft\n\nright\n\nlow\n\n> said\n"


DOCUMENT = '<w:document xmlns:w="w"><w:body><w:p w:rsidR="{}"><w:pPr><w:pStyle w:val="H"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:pPr><w:numPr/></w:pPr><w:ins><w:r><w:t>in</w:t></w:r></w:ins><w:del><w:r><w:delText>out</w:delText></w:r></w:del></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl><w:p><w:r><w:t>{}</w:t></w:r></w:p></w:body></w:document>'
STYLES = '<w:styles xmlns:w="w"><w:style w:styleId="H"><w:name w:val="heading 2"/></w:style></w:styles>'


def test_documents():
    docx = lambda rsid, text, core="x": pack({"word/document.xml": DOCUMENT.format(rsid, text), "word/styles.xml": STYLES, "docProps/core.xml": f"<c><title>{core}</title></c>"})
    (u,) = office.from_document("d.docx", docx("1", "end", ""))
    assert (u["title"], u["body"]) == ("Top", "## Top\n\n- in\n\n| a |  |\n| --- | --- |\n\nend\n")
    assert office.canonical_hash(docx("1", "end")) == office.canonical_hash(docx("2", "end", "y")) != office.canonical_hash(docx("1", "other"))
    odt = pack({"content.xml": '<o:d xmlns:o="o" xmlns:t="t"><o:body><o:text><t:h t:outline-level="2">Top</t:h><t:p>a<t:s t:c="2"/>b<t:note>n</t:note></t:p><t:list><t:list-item><t:p>x</t:p></t:list-item></t:list></o:text></o:body></o:d>'})
    assert office.from_document("d.odt", odt)[0]["body"] == "## Top\n\na  b\n\n- x\n"
    rtf = rb"{\rtf1\ansi{\fonttbl{\f0 Arial;}}{\*\generator x;}\uc1 Caf\'e9 \u8364?\par\tab b\{c\}}"
    assert office.from_rich_text("r.rtf", rtf)[0]["body"] == "Café €\n\tb{c}\n"


def compound(streams):
    """A compound file whose streams all stand in full sectors (the small-stream limit is 0)."""
    chunks, fat = [], []

    def put(data):
        n = max(1, -(-len(data) // 512))
        start = len(chunks)
        chunks.extend(data[k * 512 : k * 512 + 512].ljust(512, b"\0") for k in range(n))
        fat.extend([start + k + 1 for k in range(n - 1)] + [0xFFFFFFFE])
        return start

    def entry(label, kind, left, right, child, start, size):
        raw = label.encode("utf-16-le")
        return raw.ljust(64, b"\0") + struct.pack("<HBBIII", len(raw) + 2, kind, 1, left, right, child) + b"\0" * 36 + struct.pack("<IQ", start, size)

    none, rows = 0xFFFFFFFF, []
    for k, (label, data) in enumerate(streams):
        rows.append(entry(label, 2, none, k + 2 if k + 1 < len(streams) else none, none, put(data), len(data)))
    listing = put(b"".join([entry("Root Entry", 5, none, none, 1, 0xFFFFFFFE, 0), *rows]))
    at = len(chunks)
    fat.append(0xFFFFFFFD)
    chunks.append(b"".join(struct.pack("<I", x) for x in fat).ljust(512, b"\xff"))
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0" * 16 + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + b"\0" * 10
    head += struct.pack("<IIIIIIII", 1, listing, 0, 0, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0)
    return head + struct.pack("<109I", at, *[none] * 108) + b"".join(chunks)


def test_message():
    data = compound([("__substg1.0_0037001F", "Subjéct".encode("utf-16-le")), ("__substg1.0_0C1A001E", b"Ann"), ("__substg1.0_1000001F", ("line\r\n" * 200).encode("utf-16-le"))])
    (u,) = office.from_message("m.msg", data)
    assert u["title"] == "Subjéct" and u["body"].startswith("**From:** Ann\n**Subject:** Subjéct\n\nline\nline") and u["body"].count("line") == 200
    with pytest.raises(ValueError):
        office.from_message("m.msg", b"no")


def written(*bodies, trailer=b"/Root 1 0 R"):
    return b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k, b) for k, b in enumerate(bodies, 1)) + b"trailer\n<< " + trailer + b" >>\n%%EOF"


def flowing(data, more=b""):
    z = zlib.compress(data)
    return b"<< /Filter /FlateDecode %s /Length %d >>\nstream\n%s\nendstream" % (more, len(z), z)


def test_pdf():
    cmap = b"1 beginbfchar <0001> <00480069> endbfchar 1 beginbfrange <0010> <0012> <0061> endbfrange"
    first = flowing(b"BT /F1 12 Tf 10 700 Td (A first \\(line\\)) Tj 0 -14 Td [(of sec) -20 (ond) -400 (text)] TJ T* (caf\\351) ' ET")
    second = flowing(b"BT /F2 9 Tf 1 0 0 1 5 60 Tm <0001> Tj <00100011> Tj ET")
    inner = b"9 0 10 30 " + b"<< /Type /Page /Parent 2 0 R >>".ljust(30) + b"(x)"
    held = flowing(inner, b"/Type /ObjStm /N 2 /First 10")
    data = written(
        b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R 4 0 R 9 0 R] /Resources << /Font << /F1 5 0 R /F2 6 0 R >> >> >>",
        b"<< /Type /Page /Contents [7 0 R] /Annots [<< /Subtype /Text /Contents (a note) >>] >>", b"<< /Type /Page /Contents 8 0 R >>", b"<< /Type /Font /Subtype /Type1 >>",
        b"<< /Type /Font /Subtype /Type0 /ToUnicode 11 0 R >>", first, second, b"null", b"null", flowing(cmap), held, trailer=b"/Root 1 0 R /Info << /Title (T) >>",
    )
    data = data.replace(b"9 0 obj\nnull\nendobj\n", b"", 1)
    (u,) = pdf.from_pdf("f.pdf", data)
    assert u["title"] == "T" and u["body"] == "## Page 1\n\nA first (line)\nof second text\ncafé\n\n> a note\n\n## Page 2\n\nHiab\n[page 2 may hold a picture of its text]\n\n## Page 3\n\n[page 3 may hold a picture of its text]\n"
    with pytest.raises(ValueError, match="encrypted"):
        pdf.from_pdf("f.pdf", written(b"null", trailer=b"/Encrypt 5 0 R"))


def test_conversion_of_bytes_and_bad_files(spark):
    files = [("a.xlsx", workbook()), ("b.docx", b"PK\x03\x04 broken"), ("c.csv", "\n".join(f"{k},x" for k in range(500)).encode()), ("d.htm", b"<html><head><title>T</title><body><p>Hello world")]
    rows = converters.convert(spark.createDataFrame([(n, n, bytearray(d)) for n, d in files], "path string, name string, content binary")).collect()
    got = {(r.path, r.unit_id): r for r in rows}
    assert got["a.xlsx", "00-index"].status == "ok" and got["b.docx", None].status == "failed"
    assert got["c.csv", "whole.csv"].kind == "sidecar" and got["c.csv", "whole.csv"].body.count("\n") == 500 and "299 more rows" in got["c.csv", "whole"].body
    assert (got["d.htm", "whole"].title, got["d.htm", "whole"].body) == ("T", "Hello world\n")


def test_engines_are_optional_and_their_version_is_in_the_key(spark):
    files = spark.createDataFrame([("p.png", "p.png", bytearray(b"pixels")), ("r.mp4", "r.mp4", bytearray(b"sound"))], "path string, name string, content binary")
    without = {r.path: (r.status, r.action_key) for r in converters.convert(files).collect()}
    assert without["p.png"][0] == without["r.mp4"][0] == "refused"
    engines = {"image": ("ocr@3", lambda data: [data.decode(), " "]), "recording": ("speech@1", lambda data: [(299_000, 301_000, "Ann", "hello"), (301_500, 302_000, "Ann", "again"), (900_000, 901_000, "", "bye")])}
    got = {(r.path, r.unit_id): r for r in converters.convert(files, engines=engines).collect()}
    assert got["p.png", "whole"].body == "pixels\n" and got["p.png", "whole"].action_key != without["p.png"][1]
    assert got["r.mp4", "00-index"].kind == "index" and {u for p, u in got if p == "r.mp4"} == {"00-index", "w001", "w002", "w004"}
    assert got["r.mp4", "w002"].body == "[00:04:59] Ann: hello again\n" and got["r.mp4", "w004"].body == "[00:15:00] ?: bye\n"
