import io
import random
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from leafmill.functions import profile
from leafmill.operators import parsing
from leafmill.plans.archive import Archive
from leafmill.scratch import Scratch
from leafmill.sources import parsers, pdf


def slow_chain(given):
    """The chain in plain loops: ``given`` are (cost, parser, ok, quality, wish,
    lost, reason, error), one for each candidate."""
    order = [g[1] for g in sorted(given)]
    by = {g[1]: g for g in given}
    if not order:
        return None, "failed", 0.0
    tried, best, first, turn, escalating, unmet = set(), None, None, order[0], False, None
    while turn:
        tried.add(turn)
        _, name, ok, value, wish, lost, reason, error = by[turn]
        if not ok:
            first = first or (name, error)
            if escalating:
                unmet = error
                break
            turn = next((p for p in order if p not in tried), None)
            continue
        if best is None or value > best[1]:
            best = (name, value, wish, lost, reason)
        turn = wish if wish in order and wish not in tried else None
        escalating = turn is not None
    if best is None:
        return first[0], "failed", 0.0
    if best[3] or best[2] and best[2] != best[0]:
        return best[0], "degraded", best[1]
    return best[0], "ok", best[1]


def test_chain_against_plain_loops(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for i in range(400):
        given = []
        for cost, name in ((5, "text"), (10, "pdf"), (100, "ocr"), (200, "docling")):
            if rng.random() < 0.75:
                ok, lost = rng.random() < 0.65, rng.random() < 0.15
                wish = None if lost else rng.choice([None, None, "ocr", "docling"])
                given.append((cost, name, ok, rng.choice([0.1, 0.5, 0.5, 0.9]), wish, lost, "r", None if ok else f"no {name}"))
        want[str(i)] = slow_chain(given)
        rows += [(str(i), g[0], g[1:]) for g in given]
    kind = parsing.OUTCOME
    shape = "struct<parser:string,ok:boolean,quality:double,escalate_to:string,unrecoverable:boolean,reason:string,error:string>"
    df = spark.createDataFrame(rows, f"document_id string, cost int, outcome {shape}").withColumn("outcome", F.col("outcome").cast(kind))
    got = {r.document_id: (r.parser, r.status, r.quality) for r in parsing.resolve(df).collect()}
    assert got == {k: v for k, v in want.items() if v[0] is not None}


def page(text, size=12):
    lines = "".join(f"({t}) Tj T* " for t in text.split("\n"))
    return f"BT /F1 {size} Tf 72 700 Td 14 TL {lines} ET".encode()


def make_pdf(pages, deflate=False, extra=b""):
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"}
    kids = []
    for i, content in enumerate(pages):
        body = zlib.compress(content) if deflate else content
        head = b" /Filter /FlateDecode" if deflate else b""
        objects[10 + 2 * i] = b"<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % (11 + 2 * i)
        objects[11 + 2 * i] = b"<< /Length %d%s >>\nstream\n%s\nendstream" % (len(body), head, body)
        kids.append(b"%d 0 R" % (10 + 2 * i))
    objects[2] = b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(pages), b" ".join(kids))
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, b) for n, b in sorted(objects.items(), reverse=True)) + extra + b"%%EOF"


def test_text_layer_of_pdf_files():
    for deflate in (False, True):
        got = pdf.read(make_pdf([page("First line\nsecond \\(one\\)"), page("caf\\351 x"), b"q Q"], deflate))
        assert got == [("First line\nsecond (one)", 1, "text", None), ("café x", 2, "text", None)]
    spaced = b"BT /F1 9 Tf 1 0 0 1 5 5 Tm [(He) 20 (llo) -300 (World)] TJ 40 0 Td <21> Tj 0 -12 Td (next) Tj ET"
    assert pdf.read(make_pdf([spaced]))[0][0] == "Hello World !\nnext"
    cmap = b"1 begincodespacerange <0000> <ffff> endcodespacerange 1 beginbfchar <0003> <015F> endbfchar 1 beginbfrange <0010> <0012> <0061> endbfrange"
    mapped = make_pdf([b"BT /F1 9 Tf <0003001000110012> Tj ET"]).replace(b"/BaseFont /Helvetica", b"/ToUnicode 99 0 R")
    mapped = mapped.replace(b"%%EOF", b"99 0 obj\n<< >>\nstream\n" + cmap + b"\nendstream\nendobj\n%%EOF")
    assert pdf.read(mapped)[0][0] == "şabc"
    inner = b"1 0 2 36 " + b"<< /Type /Catalog /Pages 2 0 R >>   << /Type /Pages /Kids [10 0 R] >>"
    packed = b"%%PDF-1.5\n5 0 obj\n<< /Type /ObjStm /N 2 /First 9 /Filter /FlateDecode >>\nstream\n%s\nendstream\nendobj\n" % zlib.compress(inner)
    packed += b"10 0 obj\n<< /Type /Page /Contents [11 0 R] >>\nendobj\n11 0 obj\n<< >>\nstream\n" + page("packed") + b"\nendstream\nendobj\n"
    assert pdf.read(packed)[0][0] == "packed"
    for bad in (b"", b"%PDF-1.4 nothing", make_pdf([page("x")], extra=b"trailer << /Encrypt 9 0 R >>")):
        with pytest.raises(ValueError):
            pdf.read(bad)


def office(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


REL = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'
R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def test_sheets_by_relation_and_sparse_cells():
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    data = office({
        "xl/workbook.xml": f'<workbook {s} {R}><sheets><sheet name="First" r:id="rId2"/><sheet name="Second" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships {REL}><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="/xl/worksheets/sheet2.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {s}><si><t>shared</t></si></sst>",
        "xl/worksheets/sheet1.xml": f'<worksheet {s}><sheetData><row r="1"><c r="A1"><v>1</v></c><c r="C1"><v>3</v></c></row></sheetData></worksheet>',
        "xl/worksheets/sheet2.xml": f'<worksheet {s}><sheetData><row r="1"><c r="B1" t="s"><v>0</v></c></row></sheetData></worksheet>',
    })
    assert parsers.xlsx(data) == [("First", 1, "heading", 1), (" | shared", 1, "table", None), ("Second", 2, "heading", 1), ("1 |  | 3", 2, "table", None)]


def test_slides_in_the_order_of_the_presentation():
    a = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="p"'
    slide = lambda t: f'<p:sld {a}><p:sp><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:sp></p:sld>'
    data = office({
        "ppt/presentation.xml": f'<p:presentation xmlns:p="p" {R}><p:sldIdLst><p:sldId id="9" r:id="b"/><p:sldId id="8" r:id="a"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": f'<Relationships {REL}><Relationship Id="a" Target="slides/slide1.xml"/><Relationship Id="b" Target="slides/slide2.xml"/></Relationships>',
        "ppt/slides/slide1.xml": slide("one"), "ppt/slides/slide2.xml": slide("two"),
    })
    assert [(b[0], b[1]) for b in parsers.pptx(data)] == [("two", 1), ("one", 2)]


def test_merged_cells():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    cell = lambda t, p="": f"<w:tc><w:tcPr>{p}</w:tcPr><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    rows = [cell("a", '<w:vMerge w:val="restart"/>') + cell("b"), cell("ghost", "<w:vMerge/>") + cell("c"), cell("wide", '<w:gridSpan w:val="2"/>')]
    body = "".join(f"<w:tr>{r}</w:tr>" for r in rows)
    assert parsers.docx(office({"word/document.xml": f"<w:document {w}><w:body><w:tbl>{body}</w:tbl></w:body></w:document>"}))[0][0] == "a | b\n | c\nwide | "


GOOD = "The contract that is made by the parties shall be as good as the others. " * 60


def test_chain_over_files(spark):
    files = [
        ("a.txt", GOOD.encode()), ("short.txt", b"x"), ("b.pdf", make_pdf([page(GOOD.replace(". ", ".\n"))])), ("scan.pdf", make_pdf([b"q Q"])),
        ("c.zip", b"x"), ("thin.pdf", make_pdf([page("a")])), ("broken.docx", b"no zip"),
    ]
    df = spark.createDataFrame(files, "path string, content binary")
    got = {r.path: r for r in parsing.parse(df, Scratch(spark, "t")).collect()}
    assert {p: (r.status, r.parser) for p, r in got.items()} == {
        "a.txt": ("ok", "text"), "short.txt": ("degraded", "text"), "b.pdf": ("ok", "pdf"), "scan.pdf": ("failed", "pdf"),
        "c.zip": ("failed", None), "thin.pdf": ("degraded", "pdf"), "broken.docx": ("failed", "docx"),
    }
    assert "OCR is not installed" in got["thin.pdf"].error and got["a.txt"].quality > 0.9 and len(got["b.pdf"].blocks) == 1
    assert parsing.parse(df.limit(0), Scratch(spark, "t")).count() == 0


def test_interrupted_runs_are_taken_up(spark, tmp_path, monkeypatch):
    folder, root = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    (folder / "a.txt").write_text(GOOD)
    (folder / "b.zip").write_text("x")
    archive = Archive(spark, str(root))
    monkeypatch.setattr(Archive, "_store", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        archive.index(str(folder))
    assert {r.status for r in archive.read("state").collect()} == {"pending"}
    monkeypatch.undo()
    assert archive.index(str(folder))["profiled"] == 1
    assert archive.index(str(folder))["failed"] == 1  # not tried again, unless it is asked for
    state = archive.read("state").withColumn("status", F.when(F.col("status") == "profiled", "parsed").otherwise(F.col("status")))
    archive._write("state", Scratch(spark, "t").keep(state, "s"))
    assert archive.index(str(folder))["profiled"] == 1 and archive.read("chunks").select("chunk_id").distinct().count() == archive.read("chunks").count()
    assert archive.profile(archive.read("state").where("status = 'profiled'").first().document_id).parse_quality > 0.9
    archive.drop_all()
    assert archive.read("state").count() == 0 and archive.read("meta").first() is None


def test_outline_text_and_largest(spark):
    heads = parsers.outline([(1, "A"), (2, "B"), (4, "deep"), (2, "C"), (2, "D"), (1, "E"), (3, "F")])
    df = spark.createDataFrame([(heads,)], "o array<struct<ord:int,level:int,title:string,path:string>>")
    assert df.select(profile.outline_text(df.o).alias("t")).first().t == "A · B · C · D · E · F"
    assert df.select(profile.outline_text(df.o, 1, 2).alias("t")).first().t == "A · B · C"
    blocks = spark.createDataFrame([([(0, "x", None), (1, "first", 9.0), (2, "second", 9.0)],)], "b array<struct<ix:int,text:string,font_size:double>>")
    assert blocks.select(profile.largest(blocks.b).alias("t")).first().t == "first"
