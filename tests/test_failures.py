"""What fails in part: damaged files, corrupt responses, models that err, deliveries again, entries that expire."""

import hashlib
import json
import math

import pytest

from lodestone.operators import calls
from lodestone.sources import datasource, elements, office
from lodestone.streaming import ingest
from tests.test_sources import archive, docx, pptx, xlsx

_S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def values_book(late=""):
    cells = [
        ("A1", "", "0", "12"), ("B1", "", "0", "0.10000000000000001"), ("C1", "b", "0", "1"), ("D1", "b", "0", "0"), ("E1", "", "1", "45306"), ("F1", "", "1", "45306.520833333336"),
        ("G1", "", "1", "0.5"), ("H1", "", "2", "1.25"), ("I1", "", "3", "45306"), ("J1", "", "4", "45306"), ("K1", "str", "0", "made"), ("L1", "e", "0", "#DIV/0!"), ("M1", "d", "0", "2024-01-15"), ("N1", "", "5", "59"), ("O1", "", "9", "1E3"),
    ]
    body = "".join(f'<c r="{r}" s="{s}"{f" t={chr(34)}{t}{chr(34)}" if t else ""}><v>{v}</v></c>' for r, t, s, v in cells) + '<c r="P1"><f>A1*2</f></c><c r="Q1"><f>A1*2</f><v>24</v></c>'
    return archive(
        xl__workbook_dot_xml=f'<workbook {_S} xmlns:r="{_REL}">{late}<sheets><sheet name="V" r:id="rId1"/></sheets></workbook>',
        xl___rels__workbook_dot_xml_dot_rels='<Relationships><Relationship Id="rId1" Type="x/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        xl__styles_dot_xml=f"""<styleSheet {_S}><numFmts><numFmt numFmtId="164" formatCode="[h]:mm"/><numFmt numFmtId="165" formatCode="yyyy\\-mm\\-dd;@"/><numFmt numFmtId="166" formatCode="0.0&quot; days&quot;[Red]"/></numFmts>
        <cellXfs><xf numFmtId="0"/><xf numFmtId="22"/><xf numFmtId="164"/><xf numFmtId="165"/><xf numFmtId="166"/><xf numFmtId="14"/></cellXfs></styleSheet>""",
        xl__worksheets__sheet1_dot_xml=f"<worksheet {_S}><sheetData><row>{body}</row></sheetData></worksheet>",
    )


def test_workbook_values():
    got = [r[3] for r in office.parse_xlsx(values_book(), "d")]
    assert got == ["12", "0.1", "True", "False", "2024-01-15 00:00:00", "2024-01-15 12:30:00", "12:00:00", "1 day, 6:00:00", "2024-01-15 00:00:00", "45306", "made", "#DIV/0!", "2024-01-15 00:00:00", "1900-02-28 00:00:00", "1000.0", "24"]
    late = [r[3] for r in office.parse_xlsx(values_book('<workbookPr date1904="1"/>'), "d")]
    assert late[4] == "2028-01-16 00:00:00" and late[13] == "1904-02-29 00:00:00"


def test_office_data_source(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    for name, content in {"a.docx": docx(), "b.XLSX": xlsx(), "deep/c.pptx": pptx(), "d.csv": b"h\n1\n2\n", "bad.docx": b"no zip", "other.txt": b"x"}.items():
        (tmp_path / name).write_bytes(content)
    datasource.register(spark)
    read = lambda **o: spark.read.format("office").options(**o).load(str(tmp_path))
    found = read(damaged="record")
    assert found.rdd.getNumPartitions() == 5
    rows = found.collect()
    assert {(r.path.rsplit("/", 1)[-1], r.error.split(":")[0]) for r in rows if r.error} == {("bad.docx", "BadZipFile")}
    assert sorted(r.text for r in rows if r.path.endswith(("d.csv", "b.XLSX"))) == ["12", "Hi", "h", "h: 1", "h: 2"]
    assert {r.document_id for r in rows if r.path.endswith("d.csv")} == {hashlib.sha256(f"file:{tmp_path}/d.csv".encode()).hexdigest()}
    assert read(damaged="skip", suffixes="docx").count() == 4 and read(suffixes="csv", recursive="false").count() == 3
    with pytest.raises(Exception, match="BadZipFile"):
        read().count()
    for options in ({"suffixes": "txt"}, {"damaged": "never"}):
        with pytest.raises(Exception, match="unsupported|damaged must be"):
            read(**options).count()


def test_three_good_and_one_corrupt(spark, tmp_path):
    element = [{"content": "Hello", "page number": 2}, {"type": "image", "content": "x.png"}]
    good = {"results": [{"document_id": f"d{k}", "markdown": "m", "elements": element, "image_s3_keys": [f"k/{k}/1.png", f"k/{k}/2.png"][:k]} for k in range(3)], "failed": ["d9"]}
    odd = {"results": [{"document_id": None, "elements": []}, {"document_id": "d5", "elements": None}]}
    for name, text in {"good.json": json.dumps(good), "corrupt.json": '{"results": [{"document_id": "d7", ', "odd.json": json.dumps(odd), "blank.json": " "}.items():
        (tmp_path / name).write_text(text)
    results, failures = elements.read_batches(spark, str(tmp_path))
    assert sorted((r.document_id, r.image_keys) for r in results.collect()) == [("d0", []), ("d1", ["k/1/1.png"]), ("d2", ["k/2/1.png", "k/2/2.png"]), ("d5", [])]
    assert sorted((str(r.document_id), r.file, r.reason) for r in failures.collect()) == [("None", "blank.json", "no response"), ("None", "corrupt.json", "no response"), ("None", "odd.json", "no document id"), ("d9", "good.json", "failed in the parser")]
    chunks = elements.with_image_keys(elements.normalized(results), results)
    assert {(r.document_id, r.text, r.page_number, tuple(r.image_keys)) for r in chunks.collect()} == {(f"d{k}", "Hello", 2, tuple([f"k/{k}/1.png", f"k/{k}/2.png"][:k])) for k in range(3)}
    images = spark.createDataFrame([("d1-1.png",), ("d12.PNG",), ("d1.txt",), ("x.png",)], "file string")
    documents = spark.createDataFrame([("d1",), ("d12",), ("d",)], "document_id string")
    assert sorted(map(tuple, elements.image_documents(images, documents).collect())) == [("d1-1.png", "d1"), ("d12.PNG", "d12")]


FAST = calls.Policy(batch=20, per_second=0, attempts=3, backoff=0.01)


def test_bucket_and_retries():
    now, slept = [0.0], []

    def sleep(seconds):
        slept.append(seconds)
        now[0] += seconds

    bucket = calls.Bucket(2, 1, lambda: now[0], sleep)
    for _ in range(5):
        bucket.take()
    assert now[0] == pytest.approx(2.0)
    tries, waits = [], []

    def flaky(rows):
        tries.append(1)
        if len(tries) < 3:
            raise calls.RateLimited(7) if len(tries) == 1 else ValueError("no")
        return [1.0] * len(rows)

    policy = calls.Policy(per_second=0, attempts=5, backoff=1.0, jitter=0.5)
    assert calls.attempted(flaky, [{}] * 4, policy, calls.Bucket(0, 1), waits.append) == ([1.0] * 4, None, 3)
    assert waits[0] == 7 and 2 <= waits[1] <= 3
    got = calls.attempted(lambda rows: [1], [{}] * 2, policy, calls.Bucket(0, 1), waits.append)
    assert got == ([None, None], "ValueError: 1 results for 2 rows", 5) and len(waits) == 6 and waits[-1] >= 8


def test_scorers_that_fail(spark):
    """Batch by batch: fails twice and then answers; always fails; answers."""

    def client():
        seen = {}

        def score(rows):
            assert len(rows) <= 20
            first = rows[0]["query_id"]
            seen[first] = seen.get(first, 0) + 1
            if first == 1 or first == 0 and seen[first] < 3:
                raise calls.RateLimited(0.01)
            return [r["fused_rank"] / 10 - 700 * (r["fused_rank"] == 1) for r in rows]

        return score

    rows = [(q, "red fox", f"c{q}-{k}", "the red fox" if k == 3 else f"fox number {k}", k) for q in range(3) for k in range(1, 21)]
    candidates = spark.createDataFrame(rows, "query_id int, query string, chunk_id string, text string, fused_rank int").coalesce(1)
    got = calls.reranked(candidates, client, 20, FAST).collect()
    by = {q: sorted((r for r in got if r.query_id == q), key=lambda r: r.rerank_rank) for q in range(3)}
    assert {r.scored_by for r in by[0]} == {r.scored_by for r in by[2]} == {"model"} and {r.scored_by for r in by[1]} == {"jaccard"}
    assert [r.fused_rank for r in by[0]] == [*range(20, 1, -1), 1] and by[0][0].rerank_score == round(1 / (1 + math.exp(-2)), 6)
    assert by[1][0].fused_rank == 3 and by[1][0].rerank_score == round(2 / 3, 6) and {r.attempts for r in by[1]} == {3}
    assert calls.reranked(candidates.limit(0), client, 5, FAST).count() == 0


def test_extraction_in_batches(spark):
    def client():
        def ask(rows):
            assert len(rows) <= 20
            if any(r["chunk_id"] == "c25" for r in rows):
                return "I cannot"
            facts = [{"concept": " Pump ", "property_name": "Rate", "property_value": r["text"], "source_chunk_id": r["chunk_id"], "confidence": 0.7} for r in rows[:2]]
            return "```json\n" + json.dumps([*facts, {"concept": "", "source_chunk_id": "c0"}, {"concept": "Other", "source_chunk_id": "nowhere"}]) + "\n```"

        return ask

    chunks = spark.createDataFrame([(f"c{k:02}", f"text {k}") for k in range(50)], "chunk_id string, text string").coalesce(1)
    found, failures = calls.extracted(chunks, client, FAST)
    assert sorted((r.concept, r.source_chunk_id, r.confidence) for r in found.collect()) == [("Pump", c, 0.7) for c in ("c00", "c01", "c40", "c41")]
    assert sorted(r.chunk_id for r in failures.collect()) == [f"c{k}" for k in range(20, 40)] and failures.first().error == "JSONDecodeError: Expecting value: line 1 column 1 (char 0)"


def test_answers_and_judgements(spark):
    contexts = spark.createDataFrame([(1, "q" * 40_000, "c" * 9_000), (2, "broken", "x")], "query_id int, query string, context string")

    def client():
        def ask(rows):
            if rows[0]["query"] == "broken":
                raise OSError("down")
            return [json.dumps({"answer": f"{len(r['query'])} {len(r['context'])}", "citations": [1]}) for r in rows]

        return ask

    got = {r.query_id: r for r in calls.answered(contexts, client, calls.Policy(batch=1, per_second=0, attempts=2, backoff=0)).collect()}
    assert got[1].answer == "30000 4000" and got[1].citations == [1] and (got[2].answer, got[2].error) == ("NOT_FOUND", "OSError: down")
    answers = spark.createDataFrame([(1, "a", "a", False), (2, "b", "no", False), (3, "b", "NOT_FOUND", False), (4, "b", "b", True), (5, "boom", "x", False)], "query_id int, context string, answer string, fast_path boolean")

    def judge():
        def ask(rows):
            if rows[0]["context"] == "boom":
                raise OSError
            return ["Yes." if r["answer"] in r["context"] else "NO" for r in rows]

        return ask

    said = calls.judged(answers, judge, calls.Policy(batch=1, per_second=0, attempts=2, backoff=0))
    assert {r.query_id: r.faithful for r in said.collect()} == {1: True, 2: False, 5: False}
    one = calls.faithfulness(said).first()
    assert (round(one.faithfulness, 4), one.judged) == (0.3333, 3)


def test_deliveries(spark, tmp_path):
    source, target, check = tmp_path / "in", str(tmp_path / "chunks"), str(tmp_path / "check")
    source.mkdir()
    (source / "good.docx").write_bytes(docx())
    (source / "late.docx").write_bytes(b"not yet")
    (source / "never.docx").write_bytes(b"never")
    (source / "gone.docx").write_bytes(b"gone")
    start = lambda: ingest.ingest_arriving(spark, str(source), "docx", target, check).awaitTermination(120)
    name = lambda r: r.path.rsplit("/", 1)[-1]
    start()
    assert sorted(name(r) for r in ingest.pending(spark, target).collect()) == ["gone.docx", "late.docx", "never.docx"]
    start()  # a restart without new files delivers nothing again
    assert {r.receives for r in ingest.receives(spark, target).collect()} == {1} and spark.read.parquet(target).count() == 4
    (source / "gone.docx").unlink()
    assert ingest.redeliver(spark, "docx", target) == 3
    (source / "late.docx").write_bytes(docx())
    assert ingest.redeliver(spark, "docx", target) == 3 and ingest.redeliver(spark, "docx", target) == 0
    assert spark.read.parquet(target).groupBy("document_id").count().where("count = 4").count() == 2
    assert sorted((name(r), r.receives, r.error.split(":")[0]) for r in ingest.dead_letters(spark, target).collect()) == [("gone.docx", 3, "the file is gone"), ("never.docx", 3, "BadZipFile")]
    (source / "new.docx").write_bytes(b"damaged")
    ingest.drain(spark, str(source), "docx", target, check)
    assert ingest.dead_letters(spark, target).count() == 3 and ingest.pending(spark, target).count() == 0
    ingest.purge(spark, target, "2000-01-01 00:00:00")
    assert ingest.dead_letters(spark, target).count() == 3
    ingest.purge(spark, target, "2100-01-01 00:00:00")
    assert ingest.dead_letters(spark, target).count() == 0 and ingest.receives(spark, target).count() == 0


def test_entries_expire(spark, tmp_path):
    arrive = tmp_path / "in"
    arrive.mkdir()
    stream = spark.readStream.schema("cache_key string, payload string, created_at timestamp").json(str(arrive))
    query = ingest.expiring(stream, 3600).writeStream.format("memory").queryName("life").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for k, rows in enumerate([[("a", "1", "00:00:00"), ("b", "1", "00:30:00")], [("a", "2", "00:50:00"), ("a", "0", "00:10:00")], [("c", "1", "01:40:00")], [("d", "1", "03:00:00")], [("e", "1", "03:01:00")]]):
            (arrive / f"{k}.json").write_text("\n".join(json.dumps({"cache_key": a, "payload": p, "created_at": f"2024-01-01T{t}"}) for a, p, t in rows))
            query.processAllAvailable()
        life = [(r.cache_key, r.payload, r.live) for r in spark.table("life").collect()]
    finally:
        query.stop()
    assert ("a", "1", True) in life and ("a", "2", True) in life and ("a", "0", True) not in life and ("a", "1", False) not in life
    assert ("b", "1", False) in life and ("a", "2", False) in life and ("c", "1", False) in life and ("e", "1", False) not in life
