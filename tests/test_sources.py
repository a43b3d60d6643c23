"""Files to chunks, tables on disk, arriving files, registry."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lodestone.operators import store
from lodestone.sources import cells, elements, office, router
from lodestone.streaming import ingest

_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def archive(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), body)
    return out.getvalue()


def docx():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda text, style="": f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'
    return archive(word__document_dot_xml=f"<w:document {w}><w:body>{p('Top', 'H1')}{p('  ')}{p('Body')}{p('Sub', 'Heading2')}{p('More')}</w:body></w:document>", word__styles_dot_xml=f'<w:styles {w}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>')


def xlsx():
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    return archive(
        xl__workbook_dot_xml=f'<workbook {s} xmlns:r="{_REL}"><sheets><sheet name="One" r:id="rId1"/></sheets></workbook>',
        xl___rels__workbook_dot_xml_dot_rels='<Relationships><Relationship Id="rId1" Type="x/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        xl__sharedStrings_dot_xml=f"<sst {s}><si><t>Hi</t></si></sst>",
        xl__worksheets__sheet1_dot_xml=f'<worksheet {s}><sheetData><row><c r="A1"><v>12</v></c><c r="B1"><f>A1*2</f></c><c r="C1" t="s"><v>0</v></c></row></sheetData></worksheet>',
    )


def pptx():
    p, a = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"', 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
    shape = lambda t, place="": f"<p:sp><p:nvSpPr><p:nvPr>{place}</p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>"
    return archive(
        ppt__presentation_dot_xml=f'<p:presentation {p} xmlns:r="{_REL}"><p:sldIdLst><p:sldId r:id="r1"/></p:sldIdLst></p:presentation>',
        ppt___rels__presentation_dot_xml_dot_rels='<Relationships><Relationship Id="r1" Type="x/slide" Target="slides/slide1.xml"/></Relationships>',
        ppt__slides__slide1_dot_xml=f"<p:sld {p} {a}>{shape('Title')}</p:sld>",
        ppt__slides___rels__slide1_dot_xml_dot_rels='<Relationships><Relationship Id="n" Type="x/notesSlide" Target="../notesSlides/n1.xml"/></Relationships>',
        ppt__notesSlides__n1_dot_xml=f"<p:notes {p} {a}>{shape('Say this', '<p:ph type=' + chr(34) + 'body' + chr(34) + '/>')}{shape('7', '<p:ph type=' + chr(34) + 'sldNum' + chr(34) + '/>')}</p:notes>",
    )


def test_router():
    assert router.route("a/b/File.CSV") == "csv"
    for bad in ("file.unknown", "file", "dir.csv/file"):
        with pytest.raises(ValueError):
            router.route(bad)


def test_csv_cells():
    text = '﻿Name,"Head\nline",\r\n a ,1,x\r\n\r\n,2\r\n'
    got = [(r[0], r[3], r[7]) for r in cells.parse_csv(text.encode(), "d")]
    assert got == [("d:csv:r1:c1", "Name", "Row: 1, Col: 1"), ("d:csv:r1:c2", "Head\nline", "Row: 1, Col: 2"), ("d:csv:r2:c1", "Name: a", "Row: 2, Col: 1"), ("d:csv:r2:c2", "Head\nline: 1", "Row: 2, Col: 2"), ("d:csv:r2:c3", "Col 3: x", "Row: 2, Col: 3"), ("d:csv:r4:c2", "Head\nline: 2", "Row: 4, Col: 2")]
    assert [r[3] for r in cells.parse_csv("k\ré".encode("latin-1"), "d")] == ["k", "k: é"]


def test_office_files():
    assert [(r[3], r[4], r[6], r[7]) for r in office.parse_docx(docx(), "d")] == [("Top", "heading", ["Top"], "Paragraph: 1"), ("Body", "paragraph", ["Top"], "Paragraph: 3"), ("Sub", "heading", ["Top", "Sub"], "Paragraph: 4"), ("More", "paragraph", ["Top", "Sub"], "Paragraph: 5")]
    assert [(r[3], r[6]) for r in office.parse_xlsx(xlsx(), "d")] == [("12", ["One"]), ("Hi", ["One"])]
    assert [(r[3], r[4], r[5]) for r in office.parse_pptx(pptx(), "d")] == [("Title", "paragraph", 1), ("Say this", "caption", 1)]


def test_files_become_chunks(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.csv").write_text("h\n1\n")
    (tmp_path / "in" / "deep" / "b.docx").write_bytes(docx())
    assert router.read_chunks(spark, str(tmp_path / "in"), "csv").count() == 2
    got = router.read_chunks(spark, str(tmp_path / "in"), "docx")
    assert got.count() == 4
    saved = str(tmp_path / "saved")
    store.save_chunks(got, saved)
    store.save_chunks(router.read_chunks(spark, str(tmp_path / "in"), "csv"), saved)
    store.save_chunks(got.where("element_type = 'heading'"), saved)
    loaded = store.load_chunks(spark, saved)
    assert sorted(r.text for r in loaded.collect()) == ["Sub", "Top", "h", "h: 1"]
    doc = got.first().document_id
    assert [c.text for c in store.get_document(spark, saved, doc).first().chunks] == ["Top", "Sub"]
    assert store.load_chunks(spark, saved, [doc]).count() == 2


def test_parser_elements(spark, tmp_path):
    one = {"kids": [{"content": " A ", "type": "heading", "page number": 2, "bounding box": [1, 2, 3, 4]}, {"type": "image", "source": "x.png"}, {"text": "B", "bbox": {"x1": 5.0, "page_number": 3}}, {"content": " "}]}
    (tmp_path / "doc1.json").write_text(json.dumps(one))
    (tmp_path / "doc2.json").write_text(json.dumps([{"source": "C", "page": "4"}]))
    (tmp_path / "bad.json").write_text("{oops")
    read = elements.read_json(spark, str(tmp_path))
    got = {r.chunk_id: r for r in elements.normalized(read).collect()}
    assert sorted(got) == ["doc1:page:1:element:2", "doc1:page:2:element:0", "doc2:page:4:element:0"]
    a, b = got["doc1:page:2:element:0"], got["doc1:page:1:element:2"]
    assert a.text == "A" and a.element_type == "heading" and a.bounding_box.y2 == 4.0 and b.bounding_box.x1 == 5.0 and b.element_type == "paragraph"
    assert [r.document_id for r in elements.failed_documents(read, elements.normalized(read)).collect()] == ["bad"]
    responses = spark.createDataFrame([("a", ["a"])], "document_id string, failed array<string>")
    with pytest.raises(Exception, match="parser failed on a"):
        elements.require_parsed(responses).collect()


def test_arriving_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.docx").write_bytes(docx())
    (tmp_path / "in" / "bad.docx").write_bytes(b"no archive")
    target = str(tmp_path / "out")
    for extra in (None, "b.docx"):
        if extra:
            (tmp_path / "in" / extra).write_bytes(docx())
        ingest.ingest_arriving(spark, str(tmp_path / "in"), "docx", target, str(tmp_path / "check")).awaitTermination(120)
    assert store.load_chunks(spark, target).count() == 8
    assert [(r.path.rsplit("/", 1)[-1], r.receives) for r in ingest.pending(spark, target).collect()] == [("bad.docx", 1)]


def test_tables_are_created_once(spark):
    store.initialize(spark, "lodestone_test")
    store.initialize(spark, "lodestone_test")
    assert "chunks" in {t.name for t in spark.catalog.listTables("lodestone_test")}
    spark.sql("DROP DATABASE lodestone_test CASCADE")


def test_registry():
    known = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(known) and len(known) > 50
    assert F is not None
