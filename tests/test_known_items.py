"""Chunks' own questions: which of them lead back, against a plain ranking of all chunks."""

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import bm25, chunking, known_items, sampling
from lodestone.plans import catalog


def documents(seed=3, words=60, lines=150):
    """Lines of few words, so that scores are near: copies, copies with other marks (ties), changed copies, junk; ids are shuffled."""
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(words)]
    made = []
    for k in range(lines):
        size = r.choice([2, 8, 14, 35, 60, 140])
        text = " ".join(r.choice(vocabulary[: r.choice([5, 20, words])]) + ("." if r.random() < 0.06 else "") for _ in range(size))
        made += [text] * r.choice([1, 1, 1, 2, 9]) + [text.replace("w1 ", "w1, ")] * r.choice([0, 1]) + [text.replace("w2 ", "w3 ")] * r.choice([0, 1])
    made += ["- " * 40, "- " * 41 + "x", "w1 " * 50]
    r.shuffle(made)
    return [(k * 7 % 1009, "\n".join(made[4 * k : 4 * k + 4])) for k in range((len(made) + 3) // 4)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s"))


def ranked(chunks):
    """The same by a ranking of all chunks that share a term with the question."""
    q = sampling.synthetic_queries(chunks)
    return {r.chunk_id: r.found for r in sampling.recovered(bm25.top_k(q.select(F.col("chunk_id").alias("query_id"), "query"), chunks), q).collect()}


@pytest.mark.parametrize("held", [40_000, 60])
def test_questions_lead_back_as_in_a_ranking_of_all_chunks(spark, monkeypatch, held):
    """In one block and in several; ties go by corpus order, copies stand before copies."""
    monkeypatch.setattr(known_items, "CHUNKS", held)
    chunks = chunking.paragraph_chunks(frame(spark, documents()).repartition(8))
    got = {r.chunk_id: r.found for r in known_items.recovered(chunks, bm25.statistics(chunks)).collect()}
    assert got == ranked(chunks) and len(set(got.values())) == 2


@pytest.mark.parametrize("texts", [[], ["short"], ["a " * 40] * 9, ["a b " * 20, "b a " * 20, "a c " * 20], ["- " * 40] * 4 + ["x"] * 4 + ["- " * 40] * 2, ["a " * 20 + "b " * 20] * 8])
def test_odd_corpora(spark, texts):
    """No chunk, no question, no term, terms in all chunks (their weight is below 0)."""
    chunks = chunking.paragraph_chunks(frame(spark, [(k, t) for k, t in enumerate(texts)]))
    assert {r.chunk_id: r.found for r in known_items.recovered(chunks, bm25.statistics(chunks)).collect()} == (ranked(chunks) if texts else {})


def test_no_row_for_each_pair(spark, monkeypatch, tmp_path):
    """Many questions are not joined with the postings of their terms."""
    def pairs(*_):
        raise AssertionError("questions are joined with postings")

    frame(spark, documents(lines=20)).write.parquet(str(Path(tmp_path) / "documents.parquet"))
    spark.createDataFrame([(1, "w1")], "item_id long, text string").write.parquet(str(Path(tmp_path) / "benchmark.parquet"))
    want = ranked(chunking.paragraph_chunks(spark.read.parquet(str(tmp_path / "documents.parquet"))))
    monkeypatch.setattr(bm25, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(bm25, "scores", pairs)
    assert {r.chunk_id: r.found for r in catalog.QUERIES["known_item_synthetic"](spark, str(tmp_path)).collect()} == want


def test_equal_texts_come_to_one_block(spark, monkeypatch):
    """However the documents are dealt, a text is looked for once, not once in each block that has a copy."""
    held, write = {}, known_items.written
    monkeypatch.setattr(known_items, "CHUNKS", 60)
    monkeypatch.setattr(known_items, "written", lambda df, name: held.setdefault(name, write(df, name)))
    chunks = chunking.paragraph_chunks(frame(spark, documents(lines=80)).repartition(8))
    known_items.recovered(chunks, bm25.statistics(chunks))
    texts = [(len(r.dl) - 1) // np.dtype(chr(r.dl[0])).itemsize for r in held["blocks"].select("dl").collect()]
    assert len(texts) > 3 and sum(texts) == chunks.select("text").distinct().count()
