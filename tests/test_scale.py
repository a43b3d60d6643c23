"""What a step may hold or run again, whatever the size of its input."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from lodestone.operators import bm25, cache, chunking, vector, vector_index


def test_scoring_holds_shared_terms_only():
    """1000 chunks for a query of 20,000 terms: no matrix of chunks by terms."""
    asked = [(1, f"w{k}", 1.0) for k in range(20_000)]
    chunks = pa.RecordBatch.from_arrays(
        [pa.array([f"d{k}:p0" for k in range(1000)]), pa.array([f"d{k}" for k in range(1000)]), pa.array([0] * 1000, pa.int32()), pa.array([[f"w{k}", "other"] for k in range(1000)]), pa.array([None] * 1000, pa.int64())],
        ["chunk_id", "document_id", "ordinal", "tokens", "number"],
    )
    find = bm25._finder(asked, 2.0, 5, [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.float64()])
    tracemalloc.start()
    got = pa.Table.from_batches(find(iter([chunks])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40_000_000 and got.num_rows == 5
    assert got.column("chunk_id").to_pylist() == ["d0:p0", "d1:p0", "d10:p0", "d100:p0", "d101:p0"] and np.allclose(got.column("score"), 0.4)


def test_equal_vectors_are_compared_once(spark, monkeypatch):
    """600 entries with 3 vectors and 40 questions with 2 of them: 3 meet 2, and each question gets the tied entry of the greatest key."""
    seen = {}

    def top_k(queries, vectors, *args, **kwargs):
        seen.update(queries=queries.count(), vectors=vectors.count())
        return plain(queries, vectors, *args, **kwargs)

    plain = vector.top_k
    monkeypatch.setattr(vector, "top_k", top_k)
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    angle = F.array(F.col("id") % 3 * 1.0, F.lit(1.0))
    entries = spark.range(600).select(F.format_string("k%03d", "id").alias("cache_key"), angle.alias("query_embedding"), F.lit("").alias("doc_scope_hash"), F.lit("p").alias("provider"), F.col("id").cast("string").alias("payload"), (now + F.expr("interval 1 day")).alias("expires_at"))
    asked = spark.range(40).select(F.col("id").alias("query_id"), F.lit("a").alias("query"), F.array().cast("array<string>").alias("document_ids"), F.array(F.col("id") % 2 * 1.0, F.lit(1.0)).alias("query_vector"), F.lit("p").alias("provider"))
    got = {r.query_id: (r.payload, r.similarity) for r in cache.semantic_hits(asked, entries, now).collect()}
    assert got == {k: (("597", "598")[k % 2], 1.0) for k in range(40)} and seen == {"queries": 2, "vectors": 3}


def test_few_questions_go_to_the_vectors(spark, monkeypatch):
    """The vectors of a table are not shuffled for them; the other way gives the same."""
    rng = np.random.default_rng(5)
    rows = [(k, [float(x) for x in rng.integers(0, 4, 3)] if k % 11 else None) for k in range(300)]
    df = spark.createDataFrame(rows, "chunk_id long, embedding_full array<float>").repartition(3)
    q = df.where("chunk_id % 50 = 1").select(F.col("chunk_id").alias("query_id"), F.col("embedding_full").alias("vector"))
    for last in (False, True):
        few = vector.top_k(q, df, 4, exclude_self=True, last=last)
        assert "CoGroup" not in few._jdf.queryExecution().toString()
        with monkeypatch.context() as m:
            m.setattr(vector, "FEW", 0)
            assert sorted(few.collect()) == sorted(vector.top_k(q, df, 4, exclude_self=True, last=last).collect()) and few.count() == 24


def test_candidates_alone_are_joined(spark):
    """Vectors that are no candidates are left out by id before the join that brings their places along."""
    df = spark.range(100).select(F.col("id").alias("chunk_id"), F.when(F.col("id") != 7, F.array(F.col("id") + 1.0, F.lit(1.0))).alias("embedding_full"))
    q = spark.createDataFrame([(1, [0.0, 1.0])], "query_id long, vector array<double>")
    got = vector.top_k(q, df, 3, candidates=spark.createDataFrame([(1, 10), (1, 20), (1, 7)], "query_id long, chunk_id long"))
    assert [r.chunk_id for r in got.orderBy("rank").collect()] == [10, 20]
    assert "LeftSemi" in got._jdf.queryExecution().optimizedPlan().toString()


def test_resizing_holds_few_documents():
    """4000 documents of 20 chunks in one batch: only some of them are Python objects at a time."""
    rows = pa.array([[{"ordinal": k, "chunk_id": f"{d}:p{k}", "text": "word " * 30, "element_type": "paragraph", "own": None} for k in range(20)] for d in range(4000)])
    batch = pa.RecordBatch.from_arrays([pa.array([str(d) for d in range(4000)]), rows], ["document_id", "rows"])
    schema = from_arrow_schema(pa.schema([("document_id", pa.string()), ("ordinal", pa.int32()), ("chunk_id", pa.string()), ("text", pa.string()), ("element_type", pa.string()), ("n_words", pa.int32())]))
    tracemalloc.start()
    n = sum(b.num_rows for b in chunking._resizer(100, 500, schema)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 4000 * 5 and peak < 10_000_000


def test_recall_curve_searches_once(spark, monkeypatch, tmp_path):
    """Each level is what a search with so many probes gives, but all cells are searched one time."""
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(k, [float(x) for x in rng.normal(size=4)]) for k in range(300)], "chunk_id long, embedding_full array<float>")
    index = vector_index.build(df, str(tmp_path / "i"), cells=6)
    q = df.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding_full").alias("vector"))
    exact = vector_index.top_k(q, index, 5, 6, exclude_self=True)
    want = [(p, vector_index.recall(vector_index.top_k(q, index, 5, p, exclude_self=True), exact).first()[0], vector_index.scanned_share(q, index, p).first()[0]) for p in (1, 2, 4, 6)]
    calls, plain = [], vector.top_k
    monkeypatch.setattr(vector, "top_k", lambda *a, **k: calls.append(1) or plain(*a, **k))
    got = [tuple(r) for r in vector_index.recall_curve(q, index, 5, exclude_self=True).orderBy("probes").collect()]
    assert np.allclose(got, want) and len(calls) == 1
