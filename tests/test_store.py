"""Points, tables that are exchanged whole, pooled vectors, and the small functions of sources and measures."""

import json
import math
import uuid

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text, vectors
from lodestone.operators import answer, evaluate, pooling, sampling, store
from lodestone.sources import elements
from tests.test_operators import chunk_rows, one


def test_uuid5_equals_the_librarys(spark):
    names = [f"doc-{k}:page:{k % 7}:é{k * 31}" for k in range(1000)] + [""]
    got = spark.createDataFrame([(n,) for n in names], "name string").select("name", store.uuid5(F.col("name")).alias("id")).collect()
    assert all(r.id == str(uuid.uuid5(uuid.NAMESPACE_OID, r.name)) for r in got)


def test_points_are_written_once(spark, tmp_path):
    path = str(tmp_path / "points")
    chunks = store.with_embeddings(chunk_rows(spark, ["a", "b", "c"]))
    chunks = chunks.withColumn("embedding_full", F.when(F.col("document_id") != "d1", F.col("embedding_full")))
    for _ in range(2):
        store.save_points(chunks, path)
    assert {r.chunk_id for r in store.points(spark, path, 384).collect()} == {"d0:p0", "d1:p0", "d2:p0"} and store.points(spark, path, 384).count() == 3
    assert sorted(r.chunk_id for r in store.points(spark, path, 1024).collect()) == ["d0:p0", "d2:p0"]
    store.save_points(chunks.where("document_id = 'd0'").withColumn("page_number", F.lit(9)), path)
    pages = {r.chunk_id: r.page_number for r in store.points(spark, path, 1024).collect()}
    assert pages == {"d0:p0": 9, "d2:p0": 1}
    with pytest.raises(Exception, match="has 1 places, not 384"):
        store.save_points(chunks.withColumn("embedding_fast", F.array(F.lit(1.0))), path)


def test_an_upsert_computes_its_rows_once(spark, tmp_path):
    ran = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            ran.add(b.num_rows)
            yield b

    path = str(tmp_path / "table")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "key string, n long")
    for more in (0, 10):
        store.upsert(rows.select("key", (F.col("n") + more).alias("n")).mapInArrow(counted, rows.schema), path, "key")
    assert ran.value == 4
    assert sorted((r.key, r.n) for r in spark.read.parquet(path).collect()) == [("a", 11), ("b", 12)]


def test_tables_are_exchanged_whole(spark, tmp_path):
    path = str(tmp_path / "chunks")
    store.save_chunks(chunk_rows(spark, ["one", "two", "three"]), path)
    store.replaced(spark, path, lambda c: c.withColumn("text", F.upper("text")).where("text <> 'TWO'"))
    texts = lambda: sorted(r.text for r in store.load_chunks(spark, path).collect())
    assert texts() == ["ONE", "THREE"] and store.recovered(spark, path) == "whole"
    store.save_chunks(chunk_rows(spark, ["again"]), path)
    assert texts() == ["THREE", "again"]
    (tmp_path / "chunks").rename(tmp_path / "chunks.before")  # cut off between the renames, before and after the new one was whole
    assert store.recovered(spark, path) == "undone" and texts() == ["THREE", "again"]
    spark.read.parquet(path).where("text = 'again'").write.partitionBy("bucket").parquet(path + ".next")
    (tmp_path / "chunks").rename(tmp_path / "chunks.before")
    assert store.recovered(spark, path) == "finished" and texts() == ["again"] and not (tmp_path / "chunks.before").exists()


def test_pooling(spark):
    rows = [(1, [[3.0, 0.0], [0.0, 4.0], [9.0, 9.0]], [1, 1, 0]), (2, [[1.0, 1.0]], [0]), (3, [], []), (4, None, None), (5, [[0.0, 2.0], [0.0, 4.0]], None), (6, [[1.0, 0.0], [0.0, 1.0]], [1]), (7, [[0.0, 1.0]] * 512 + [[1.0, 0.0]] * 300, [1] * 812)]
    df = spark.createDataFrame(rows, "id int, vectors array<array<float>>, mask array<int>")
    got = {r.id: r.pooled for r in pooling.masked_mean(df).collect()}
    assert [round(x, 9) for x in got[1]] == [0.6, 0.8] and got[2] == [0.0, 0.0] and got[3] is None and got[4] is None
    assert got[5] == [0.0, 1.0] and got[6] == [1.0, 0.0] and got[7] == [0.0, 1.0]


def test_small_functions(spark, tmp_path):
    assert one(spark, vectors.sigmoid(F.col("x")), x=0.0) == 0.5 and round(one(spark, vectors.sigmoid(F.col("x")), x=2.0), 9) == round(1 / (1 + math.exp(-2)), 9)
    assert one(spark, text.page_of_chunk(F.col("c")), c="d:page:12:element:3") == 12
    assert one(spark, evaluate.candidate_reduction(F.col("a"), F.col("b")), a=5, b=20) == 0.75
    assert set(one(spark, evaluate.keywords(F.col("t")), t="The pump and the valve")) >= {"pump", "valve"}
    near = lambda **x: one(spark, evaluate.hit(F.col("s"), F.col("p"), F.lit(5), F.split("w", " "), F.col("t")), **x)
    assert near(s=True, p=8, w="a b", t="") and not near(s=True, p=9, w="a b", t="") and near(s=False, p=5, w="a b c", t="B") and not near(s=False, p=5, w="a b c d e", t="B")
    results = F.array(F.struct(F.lit("a").alias("document_id"), F.lit(1).alias("n")), F.struct(F.lit("b").alias("document_id"), F.lit(2).alias("n")))
    assert one(spark, elements.own_result(results, F.col("d"))["n"], d="b") == 2 and one(spark, elements.own_result(results, F.col("d"))["n"], d="x") == 1
    (tmp_path / "set.json").write_text(json.dumps([{"query": "q", "expected_answer": "a", "source_page": 3, "folder": "f", "document_filename": "x.pdf"}]))
    asked = elements.eval_queries(spark, str(tmp_path / "set.json"))
    documents = spark.createDataFrame([("d1", "x.pdf"), ("d2", "y.pdf")], "document_id string, filename string")
    assert [r.document_id for r in evaluate.expected_documents(asked.withColumn("query_id", F.lit(1)), documents).collect()] == ["d1"]
    chunks = spark.createDataFrame([("d3", "pdf of z.pdf"), ("d4", "in z.pdf, too")], "document_id string, source_format string")
    names = spark.createDataFrame([(1, "x.pdf"), (2, "z.pdf"), (3, "w.pdf")], "query_id int, document_filename string")
    assert {r.query_id: r.document_id for r in evaluate.expected_documents(names, documents, chunks).collect()} == {1: "d1", 2: "d3", 3: None}
    store.write_json(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first()[0] == '{"a":1}'
    chunks = store.with_embeddings(chunk_rows(spark, ["x", "y"]))
    new = store.reembedded(chunks, lambda t: F.when(t == "x", F.array(F.lit(1.0))))
    assert {r.text: len(r.embedding_full) for r in new.collect()} == {"x": 1, "y": 1024}
    ranked = chunk_rows(spark, ["x", "y"]).select(F.lit(1).alias("query_id"), "chunk_id", (F.substring("document_id", 2, 1).cast("int") + 1).alias("rerank_rank"))
    said = spark.createDataFrame([(1, [2, 7])], "query_id int, citations array<int>")
    assert [r.chunk_id for r in answer.cited(said, ranked).collect()] == ["d1:p0"]


def test_rows_of_a_key_value_store(spark):
    rows = [("CHUNK#1", "c1", "d", "text", '["A", "B"]', '{"x1": 1.5, "y2": 2}', "3", "[0.5, 1]", '{"k": "v"}'), ("CHUNK#2", "c2", "d", None, "no json", None, "x", None, None), ("META", "d", "d", None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "sort_key string, chunk_id string, document_id string, text string, section_path string, bounding_box string, page_number string, embedding_fast string, metadata string")
    got = {r.chunk_id: r for r in store.decoded(df).collect()}
    assert list(got) == ["c1", "c2"]
    a, b = got["c1"], got["c2"]
    assert (a.section_path, a.bounding_box.x1, a.page_number, a.embedding_fast, a.metadata) == (["A", "B"], 1.5, 3, [0.5, 1.0], {"k": "v"})
    assert (b.text, b.section_path, b.bounding_box, b.page_number, b.structural_weight) == ("", [], None, None, 1.0)
    told = json.loads(store.as_json(store.decoded(df).where("chunk_id = 'c2'")).first().json)
    assert told["chunk_id"] == "c2" and "page_number" not in told and told["section_path"] == []


def test_a_limit_warns(spark):
    queries = spark.createDataFrame([(k,) for k in (3, 1, 2)], "query_id int")
    with pytest.warns(UserWarning, match="partial"):
        assert sorted(r.query_id for r in sampling.first(queries, 2).collect()) == [1, 2]
    assert sampling.first(queries, None).count() == 3
