"""Operators against hand-computed values."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import schemas
from lodestone.functions import scores, text, vectors
from lodestone.operators import answer, bm25, cache, chunking, evaluate, fusion, knowledge, page_index, sampling, store, vector
from lodestone.plans import pipeline, planner


def chunk_rows(spark, texts, kind="paragraph"):
    rows = [(f"d{k}:p0", f"d{k}", 0, t, kind, 1, ["s"]) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "chunk_id string, document_id string, ordinal int, text string, element_type string, page_number int, section_path array<string>")


def asking(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("v")).first().v


def test_bm25_by_hand(spark):
    chunks = chunk_rows(spark, ["a b", "b c", "c d e"])
    got = {(r.query_id, r.chunk_id): r.score for r in bm25.top_k(asking(spark, "a b", "b b", "zz"), chunks, 5).collect()}
    want = {(0, "d0:p0"): 0.573217, (0, "d1:p0"): 0.027296, (0, "d2:p0"): 0.0, (1, "d0:p0"): 0.054592, (1, "d1:p0"): 0.054592, (1, "d2:p0"): 0.0, **{(2, f"d{k}:p0"): 0.0 for k in range(3)}}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_both_ways_to_score_agree(spark, monkeypatch):
    r = random.Random(2)
    words = [f"w{int(r.random() ** 3 * 60)}" for _ in range(3000)]
    chunks = chunk_rows(spark, [" ".join(words[k * 9 : k * 9 + 1 + k % 9]) for k in range(300)] + ["", "!!"])
    q = asking(spark, "w0 w1 w1 w50", "w3", "zz", "w0 w0 w2 w7 w9 w11", "", "w59 w58")
    monkeypatch.setattr(bm25, "BATCH", 7)
    monkeypatch.setattr(bm25, "BLOCK", 2)
    key = lambda df: sorted(map(tuple, df.select("query_id", "chunk_id", "rank", F.round("score", 5)).collect()))
    few = key(bm25.top_k(q, chunks.repartition(3), 4))
    monkeypatch.setattr(bm25, "BROADCAST_ROWS", 0)
    assert few == key(bm25.top_k(q, chunks, 4)) and len(few) == 24
    counts = bm25.postings(chunk_rows(spark, ["b a b c a b", ""])).collect()
    assert sorted((x.term, x.tf, x.dl) for x in counts) == [("a", 2, 6), ("b", 3, 6), ("c", 1, 6)]


def test_order_of_rows_does_not_matter(spark):
    chunks = chunk_rows(spark, [f"w{k % 5} common w{k % 3}" for k in range(40)])
    q = asking(spark, "w1 common", "w4 w2 w2")
    key = lambda df: sorted(map(tuple, df.select("query_id", "chunk_id", "rank").collect()))
    assert key(bm25.top_k(q, chunks)) == key(bm25.top_k(q.repartition(3), chunks.orderBy(F.rand(1)).repartition(7)))


@pytest.mark.parametrize(("query", "a", "b"), [("What is the refund policy?", "fast", "fast"), ("Compare refund rates between Q1 and Q2", "analytical", "analytical"), ("Why did revenue decrease because of overheating?", "graph", "graph")])
def test_planner(spark, query, a, b):
    assert planner.route(asking(spark, query), planner.FUSED).first().route == a and planner.route(asking(spark, query), planner.SCOPED).first().route == b


def test_planner_scores(spark):
    r = planner.route(asking(spark, "Compare refund rates between Q1 and Q2", "What is the refund policy?")).orderBy("query_id").collect()
    assert r[0].complexity == 0.42 and r[0].entities == ["Compare", "Q1", "Q2"] and r[1].complexity == 0.0 and r[1].stages == ["bm25", "page_index", "vector"]
    assert planner.route(asking(spark, "Compare refund rates between Q1 and Q2"), planner.SCOPED).first().complexity == 1.0


def test_entities_of_a_query(spark):
    assert one(spark, text.query_entities(F.col("q")), q="Who dominates the AUM of Debt MF?") == ["AUM", "Debt", "MF"]
    assert one(spark, text.query_entities(F.col("q")), q='say "hello you" Twice') == ["hello you", "Twice"]
    assert one(spark, text.query_entities(F.col("q")), q="refund policies, of us") == ["refund", "policies"]
    assert one(spark, text.tokens(F.col("q")), q="Étion_1 déjà-vu") == ["étion_1", "déjà", "vu"]


def test_structure_prefers_headings(spark):
    heading = chunk_rows(spark, ["refund terms"], "heading")
    note = chunk_rows(spark, ["refund terms"], "footnote")
    q = asking(spark, "refund")
    score = lambda c: page_index.rank(q, c.withColumn("query_id", F.lit(0).cast("long"))).first().structural_score
    assert math.isclose(score(heading) / score(note), 2.5 / 0.75, rel_tol=1e-5)


def test_fusion(spark):
    lists = [spark.createDataFrame([(0, c, k + 1) for k, c in enumerate(ids)], "query_id long, chunk_id string, rank int") for ids in (["x", "y", "z"], ["x", "w"])]
    got = [(r.chunk_id, r.rrf) for r in fusion.rrf(lists).orderBy("fused_rank").collect()]
    assert [c for c, _ in got] == ["x", "y", "w", "z"] and math.isclose(got[0][1], 2 / 60, abs_tol=1e-8) and math.isclose(got[1][1], 1 / 61, abs_tol=1e-8)


def test_vector_search_against_plain_cosines(spark):
    r = random.Random(1)
    rows = [(k, [float(r.randint(-3, 3)) for _ in range(6)]) for k in range(60)] + [(60, [0.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    q = df.where("vec_id < 4").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / max(math.sqrt(sum(x * x for x in a) * sum(y * y for y in b)), 1e-300)  # noqa: B905, E731
    want = {(i, j) for i in range(4) for j in sorted((k for k in range(61) if k != i), key=lambda k: (-round(cos(rows[i][1], rows[k][1]), 6), k))[:5]}
    assert {(x.query_id, x.vec_id) for x in vector.top_k(q, df, 5, "embedding", "vec_id", exclude_self=True).collect()} == want
    near = vector.top_k(q, df, 61, "embedding", "vec_id", candidates=q.select("query_id").join(df.where("vec_id % 7 = 0").select("vec_id")))
    assert near.count() == 4 * 9
    with pytest.raises(ValueError):
        vector.top_k(q, df, 5, "text")


def test_only_one_vector_column_is_read(spark, tmp_path):
    made = store.with_embeddings(chunk_rows(spark, ["a", "b"]))
    made.write.parquet(str(tmp_path / "c"))
    read = spark.read.parquet(str(tmp_path / "c"))
    q = asking(spark, "a").select("query_id", vectors.hash_embedding(F.col("query"), 384).alias("vector"))
    plan = vector.top_k(q, read, 1, vector.column_for(True))._jdf.queryExecution().toString()
    assert "embedding_fast" in plan and "embedding_full" not in plan.split("== Physical Plan ==")[1]
    assert made.select(F.size("embedding_fast"), F.size("embedding_full")).first()[:] == (384, 1024)
    assert vector.scoped(read, [], None, []).count() == 2 and vector.scoped(read, ["d0"]).count() == 1


def test_splitting_and_merging(spark):
    sentence = " ".join(["w"] * 30) + "."
    rows = [("c0", " ".join([sentence] * 5), "paragraph"), ("c1", "short", "heading"), ("c2", "tail", "paragraph")]
    got = chunking.merged_and_split(rows, 50, 70)
    assert [(i, n, k) for i, _, k, n in got] == [("c0:s0", 60, "paragraph"), ("c0:s1", 60, "paragraph"), ("c0:s2", 32, "paragraph")]
    assert got[2][1].endswith("short tail") and chunking.merged_and_split([], 1, 2) == []
    df = spark.createDataFrame([("d", k, i, t, e) for k, (i, t, e) in enumerate(rows)], "document_id string, ordinal int, chunk_id string, text string, element_type string")
    assert [r.n_words for r in chunking.resize_chunks(df.orderBy(F.desc("ordinal")), 50, 70).orderBy("ordinal").collect()] == [60, 60, 32]


def test_section_stack(spark):
    rows = [("d", 0, 1, "A"), ("d", 1, None, "x"), ("d", 2, 2, "B"), ("d", 3, 3, "C"), ("d", 4, None, "y"), ("d", 5, 2, "D"), ("d", 6, 1, "E"), ("d", 7, None, "z")]
    got = chunking.section_paths(spark.createDataFrame(rows, "document_id string, ordinal int, level int, text string")).orderBy("ordinal").collect()
    assert ["/".join(r.section_path) for r in got] == ["A", "A", "A/B", "A/B/C", "A/B/C", "A/D", "E", "E"]


def test_compression_budget(spark):
    texts = ["alpha beta words here\nnothing else", "gamma delta\nalpha again", "plain first\nsecond"]
    ranked = chunk_rows(spark, texts).select(F.lit(0).alias("query_id"), F.lit("Alpha is what").alias("query"), "text", "chunk_id", (F.substring("document_id", 2, 1).cast("int") + 1).alias("rerank_rank"))
    assert answer.compress(ranked).first().context == "[1] alpha beta words here\n\n[2] alpha again\n\n[3] plain first"
    assert answer.compress(ranked, budget=16).first().context == "[1] alpha beta words"[: len("[1] alpha beta")]


def test_citations_never_lack_a_place(spark):
    c = chunk_rows(spark, ["Some heading text that is longer than thirty characters"], "heading").withColumn("box", F.lit(None).cast("struct<x1:double,y1:double,x2:double,y2:double,page_number:int>"))
    for fmt, kind, page, want in (("docx", "heading", None, "Heading: Some heading text that is long"), ("docx", "paragraph", 4, "Page: 4"), ("csv", "cell", None, "Section: cell")):
        got = c.select(answer.location(F.lit(fmt), F.col("box"), F.lit(""), F.lit(kind), F.lit(page).cast("int"), F.col("text")).alias("p")).first().p
        assert got.location_reference == want
    got = c.select(answer.location(F.lit("pdf"), F.col("box"), F.lit(None).cast("string"), F.lit("p"), F.lit(3), F.col("text")).alias("p")).first().p
    assert got.bounding_box.x2 == 1.0 and got.bounding_box.page_number == 3


@pytest.mark.parametrize(("raw", "said", "cited"), [('{"answer": "a", "citations": [1, "2", "[3]", "x"], "confidence": 1}', "a", [1, 2, 3]), ('```json\n{"answer": "b", "citations": []}\n```', "b", []), ("NOT_FOUND", "NOT_FOUND", []), ('{"citations": [1]}', "NOT_FOUND", [])])
def test_model_outputs(spark, raw, said, cited):
    got = one(spark, answer.parse_output(F.col("raw")), raw=raw)
    assert (got.answer, got.citations) == (said, cited)


@pytest.mark.parametrize(("x", "band"), [(0.75, "HIGH"), (0.7499, "MEDIUM"), (0.5, "MEDIUM"), (0.49, "LOW")])
def test_bands(spark, x, band):
    assert one(spark, scores.band(F.col("x")), x=x) == band


def edges(spark, rows):
    return spark.createDataFrame([(*r, "R") for r in rows], "from_concept_id string, to_concept_id string, relation_weight double, relation_type string")


def test_walks_are_bounded(spark):
    start = spark.createDataFrame([(0, "A")], "query_id long, concept_id string")
    chain = edges(spark, [("A", "B", 0.5), ("B", "C", 0.5), ("C", "D", 0.5), ("A", "X", 0.25), ("B", "A", 0.9)])
    assert sorted((r.concept_id, r.hop) for r in knowledge.walk(start, chain).collect()) == [("A", 2), ("B", 1), ("C", 2)]
    assert knowledge.walk(start, edges(spark, [("A", f"n{k}", 0.5) for k in range(50)])).count() == 40


def test_extraction(spark):
    c = chunk_rows(spark, ["On 2024-01-31 and 1/2/2023 it was 12% or 5.5% of ABC12 and AB."])
    got = sorted((r.property_name, r.property_value) for r in knowledge.extract_properties(c).collect())
    assert got == [("Date", "1/2/2023"), ("Date", "2024-01-31"), ("Identifier", "ABC12"), ("Percentage", "12%"), ("Percentage", "5.5%")]
    assert not [r for r in knowledge.extract_properties(c, strict=True).collect() if r.property_name == "Percentage"]
    c = chunk_rows(spark, ["Heat wave badly affects the old Power grid. Rain causes Rain."])
    got = [(r.from_concept, r.relation_type, r.to_concept) for r in knowledge.extract_relations(c, spark.createDataFrame([("Heat",), ("Heat wave",), ("Power grid",), ("Rain",)], "name string")).collect()]
    assert got == [("Heat wave", "AFFECTS", "Power grid")]


def _greedy(place, merge, review):
    """The fold itself: (canonical, low confidence, review) by name."""
    unit = {n: [x / (sum(y * y for y in v) ** 0.5 or 1) for x in v] for n, v in place.items()}
    heads, out = [], {}
    for n in sorted(place):
        best, at = max(((round(sum(x * y for x, y in zip(unit[n], unit[h])), 9), -k) for k, h in enumerate(heads)), default=(-2, 0))
        if best >= review:
            out[n] = (heads[-at], best < merge, False)
        else:
            heads.append(n)
            out[n] = (n, False, len(heads) > 1)
    return out


def test_clusters(spark, monkeypatch):
    place = {"a": [1.0, 0.0], "b": [0.99, 0.14], "c": [0.88, 0.47], "d": [0.0, 1.0]}
    names = lambda x: spark.createDataFrame([*x.items()], "name string, vector array<double>")
    clusters = lambda df: {r.name: (r.canonical, r.low_confidence, r.review) for r in knowledge.cluster_names(df).collect()}
    assert clusters(names(place).union(names({"a": [1.0, 0.0]}))) == {"a": ("a", False, False), "b": ("a", False, False), "c": ("a", True, False), "d": ("d", False, True)}
    monkeypatch.setattr(vector, "BLOCK", 17)
    rng = np.random.default_rng(3)
    many = {f"n{k:03}": [float(x) for x in rng.normal(size=3)] for k in range(90)}
    got = clusters(names(many))
    assert got == _greedy(many, 0.92, 0.85) and len({c for c, *_ in got.values()}) < 60
    assert clusters(names({"x": None, "y": [1.0]})) == {"x": ("x", False, False), "y": ("y", False, True)}
    assert clusters(names({"x": [0.0]}).limit(0)) == {}


def test_cache_life(spark):
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    rows = [("Refund?", ["b", "a"], [1.0, 0.0], "p", "yes", 0.9), ("Other", [], [0.0, 1.0], "p", "NOT_FOUND", 0.9), ("Third", ["c"], [0.0, 1.0], "p", "maybe", 0.4)]
    answers = spark.createDataFrame(rows, "query string, document_ids array<string>, query_vector array<double>, provider string, answer string, confidence double")
    kept = cache.entries(answers, now)
    assert kept.count() == 1
    ask = spark.createDataFrame([(1, " refund? ", ["a", "b"], [0.0, 1.0], "p"), (2, "refund!", ["a", "b"], [1.0, 0.1], "p"), (3, "refund?", ["a"], [1.0, 0.0], "p")], "query_id long, query string, document_ids array<string>, query_vector array<double>, provider string")
    exact, near = cache.exact_hits(ask, kept, now), cache.semantic_hits(ask, kept, now)
    assert [r.query_id for r in exact.collect()] == [1] and [r.query_id for r in near.collect()] == [2]
    assert [r.query_id for r in cache.misses(ask, exact, near).collect()] == [3]
    assert cache.exact_hits(ask, kept, now + F.expr("interval 25 hours")).count() == 0
    again = spark.createDataFrame([("b",)], "document_id string")
    assert cache.invalidated(kept, again).count() == 0


def test_null_payloads_stay_null_and_come_before_others(spark):
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    later = (now + F.make_interval(hours=F.lit(1))).alias("expires_at")
    rows = [("k1", [1.0, 0.0], None), ("k2", [0.0, 1.0], None), ("k2", [0.0, 1.0], "")]
    kept = spark.createDataFrame(rows, "cache_key string, query_embedding array<double>, payload string").select("*", F.lit("").alias("doc_scope_hash"), F.lit("p").alias("provider"), later)
    ask = spark.createDataFrame([(1, "a", [], [1.0, 0.0], "p"), (2, "b", [], [0.0, 1.0], "p")], "query_id long, query string, document_ids array<string>, query_vector array<double>, provider string")
    assert {r.query_id: r.payload for r in cache.semantic_hits(ask, kept, now).collect()} == {1: None, 2: ""}


@pytest.mark.parametrize("dim", [7, 32, 100, 384])
def test_hash_vectors_are_the_digests_bytes(spark, dim):
    from hashlib import sha256

    from lodestone.functions.vectors import hash_embedding

    texts = ["", "a", "é" * 50, None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", hash_embedding(F.col("t"), dim, normalize=False).alias("v")).collect()
    for r in got:
        digest = sha256((r.t or "").encode()).digest()
        assert r.v == [digest[i % 32] / 127.5 - 1.0 for i in range(dim)]


def test_metrics(spark):
    hits = spark.createDataFrame([(0, k + 1, h) for k, h in enumerate([True, False, True, False, False])] + [(1, k + 1, False) for k in range(5)], "query_id long, rank int, hit boolean")
    got = {r.query_id: r for r in evaluate.per_query(hits).collect()}
    assert (got[0].recall_3, got[0].mrr_5, got[0].ndcg_5, got[0].precision_3) == (1, 1.0, 0.919721, 0.666667)
    assert (got[1].recall_5, got[1].mrr_5, got[1].ndcg_5) == (0, 0.0, 0.0)
    values = spark.createDataFrame([("s", float(k)) for k in range(20)], "stage string, ms double")
    assert evaluate.latency(values, ["stage"], "ms").first().p95 == 19.0
    assert one(spark, evaluate.grounded_numbers(F.col("a"), F.col("c")), a="12 or 13", c="about 12") == 0.5


@pytest.mark.parametrize("config", [pipeline.FUSED, pipeline.SCOPED])
def test_pipeline_answers_every_query_once(spark, config):
    texts = ["Refunds are paid within 30 days of the request.", "Battery failure rate is 12% in Model Nine.", "Overheating leads to Battery failure.", "Unrelated words about nothing."]
    chunks = chunk_rows(spark, texts).transform(store.with_embeddings)
    q = asking(spark, "refunds", "Compare Battery failure with Overheating in 2020", "Why did Battery failure result of Overheating", "Compare Unicorns")
    got = {r.query_id: r for r in pipeline.answers(q, chunks, config).collect()}
    assert sorted(got) == [0, 1, 2, 3] and pipeline.answers(q, chunks, config).count() == 4
    assert got[0].fast_path and got[0].confidence == 0.85 and got[0].band == "HIGH" and "Refunds" in got[0].answer
    assert got[3].answer == "NOT_FOUND" and got[3].confidence == 0.0
    assert all(0 <= r.confidence <= 1 for r in got.values())


def test_known_items(spark):
    sentence = " ".join(f"w{k}" for k in range(12))
    chunks = chunk_rows(spark, [f"{sentence}. {sentence} mid. {sentence} end.", "too short. " * 3, "a. " * 40])
    q = sampling.synthetic_queries(chunks)
    assert [(r.chunk_id, r.query) for r in q.collect()] == [("d0:p0", f"{sentence} mid?")]
    hits = bm25.top_k(q.withColumnRenamed("chunk_id", "query_id"), chunks, 1)
    assert [r.found for r in sampling.recovered(hits, q).collect()] == [True]
    one_ = {r.chunk_id for r in sampling.sample(chunks, 2).collect()}
    assert len(one_) == 2 and one_ == {r.chunk_id for r in sampling.sample(chunks.repartition(3), 2).collect()}


def test_context_falls_back_to_raw_chunks(spark):
    def context(query, *texts):
        ranked = chunk_rows(spark, list(texts)).select(F.lit(0).alias("query_id"), F.lit(query).alias("query"), "text", "chunk_id", (F.substring("document_id", 2, 1).cast("int") + 1).alias("rerank_rank"))
        return answer.compress_or_raw(ranked).first().context

    assert context("about Debt here", "one\nthe Debt now\nlast", "alone", "x\ny") == "[d0:p0] the Debt now\n\n[d1:p0] alone"
    assert context("about Debt and Mars", "one\nthe Debt now\nlast", "x\ny") == "[d0:p0] one\nthe Debt now\nlast\n\n[d1:p0] x\ny"
    assert context("nothing whatever", "x\ny") == "[d0:p0] x\ny"


def test_pipeline_without_hits_and_with_a_graph(spark):
    none = chunk_rows(spark, ["x"]).transform(store.with_embeddings).limit(0)
    q = asking(spark, "refunds", "Why did Paris result of Rome", "Compare Paris with Rome in 2020")
    for config in (pipeline.FUSED, pipeline.SCOPED):
        got = pipeline.answers(q, none, config).collect()
        assert sorted(r.query_id for r in got) == [0, 1, 2] and {(r.answer, r.confidence, tuple(r.citations)) for r in got} == {("NOT_FOUND", 0.0, ())}
    graph = pipeline.Knowledge(
        spark.createDataFrame([("p", "Paris"), ("r", "Rome"), ("o", "Oslo")], "id string, name string"),
        spark.createDataFrame([("p", "size", "big", "c1", 1.0)], "concept_id string, property_name string, property_value string, source_chunk_id string, confidence double"),
        edges(spark, [("p", "o", 0.9), ("o", "x", 0.8), ("o", "y", 0.1)]),
    )
    got = {r.query_id: r for r in pipeline.answers(q, none, pipeline.FUSED, graph).collect()}
    assert got[0].properties is None and got[0].graph is None and got[2].graph is None
    assert [(p.concept, p.property_value) for p in got[1].properties] == [("Paris", "big")] and len(got[2].properties) == 1
    assert [(g.hop, g.concept_id) for g in got[1].graph] == [(1, "o"), (2, "x")]


def test_cached_answers(spark):
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    chunks = chunk_rows(spark, ["Refunds are paid within 30 days.", "Other words."]).transform(store.with_embeddings)
    q = spark.createDataFrame([(1, "refunds", []), (2, "Compare Unicorns", [])], "query_id long, query string, document_ids array<string>")
    empty = spark.createDataFrame([], schemas.CACHE)
    out, new = pipeline.cached_answers(q, chunks, empty, now)
    first = {r.query_id: r for r in out.collect()}
    assert {r.source for r in first.values()} == {"run"} and new.count() == 1
    kept = spark.createDataFrame(new.collect(), new.schema)
    again = q.unionByName(spark.createDataFrame([(3, " REFUNDS", [])], q.schema))
    near = kept.withColumn("cache_key", F.lit("query:other"))
    got = {r.query_id: r for r in pipeline.cached_answers(again, chunks, kept, now)[0].collect()}
    assert [got[k].source for k in (1, 2, 3)] == ["exact", "run", "exact"] and got[1].answer == first[1].answer and got[1].confidence == 0.85
    assert {r.query_id: r.source for r in pipeline.cached_answers(q, chunks, near, now)[0].collect()} == {1: "semantic", 2: "run"}


def test_resized_chunks_keep_their_first_parts_place(spark):
    rows = [("d", 0, "c0", "a " * 30, "heading", 1, ["A"]), ("d", 1, "c1", "b " * 30, "paragraph", 2, ["A", "B"]), ("d", 2, "c2", ("w " * 59 + "w. ") * 3, "paragraph", 3, ["C"])]
    df = spark.createDataFrame(rows, "document_id string, ordinal int, chunk_id string, text string, element_type string, page_number int, section_path array<string>")
    got = chunking.resize_chunks(df, 50, 70).orderBy("ordinal").collect()
    assert [(r.chunk_id, r.page_number, r.section_path) for r in got] == [("c0", 1, ["A"]), ("c2:s0", 3, ["C"]), ("c2:s1", 3, ["C"]), ("c2:s2", 3, ["C"])]


def test_first_similar_cluster(spark):
    place = {"a": [1.0, 0.0], "b": [0.95, 0.3], "c": [0.9, 0.43], "d": [0.0, 1.0]}
    names = spark.createDataFrame([*place.items()], "name string, vector array<double>")
    assert {r.name: r.canonical for r in knowledge.cluster_first(names).collect()} == {"a": "a", "b": "a", "c": "c", "d": "d"}


def test_each_path_reads_its_own_vectors(spark):
    texts = ["first text", "second text", "third text"]
    chunks = chunk_rows(spark, texts)
    line = lambda k, n: F.array(*(F.lit(1.0 if j == k else 0.0) for j in range(n)))
    # the fast vectors favour the first chunk, the full ones the last
    chunks = chunks.withColumn("embedding_fast", F.when(F.col("document_id") == "d0", line(0, 4)).otherwise(line(1, 4))).withColumn("embedding_full", F.when(F.col("document_id") == "d2", line(0, 8)).otherwise(line(1, 8)))
    config = pipeline.Config(vector_k=1, embed=lambda t: line(0, 4), embed_full=lambda t: line(0, 8))
    asked = spark.createDataFrame([(1, "a", True), (2, "b", False)], "query_id long, query string, fast_path boolean")
    assert {r.query_id: (r.chunk_id, r.score) for r in pipeline.near(asked, chunks, config).collect()} == {1: ("d0:p0", 1.0), 2: ("d2:p0", 1.0)}
    plans = [pipeline.near(asked.where("fast_path" if fast else "not fast_path"), chunks.drop("embedding_full" if fast else "embedding_fast").withColumn("embedding_full" if fast else "embedding_fast", F.lit(None).cast("array<double>")), config).count() for fast in (True, False)]
    assert plans == [1, 1]


def test_stages_are_observed(spark):
    chunks = store.with_embeddings(chunk_rows(spark, ["Refunds are paid within 30 days.", "Battery failure rate is 12%.", "Other words."]))
    q = asking(spark, "refunds", "Compare Battery failure with Overheating in 2020")
    stages = pipeline.Stages()
    assert pipeline.answers(q, chunks, pipeline.SCOPED, stages=stages).count() == 2
    rows = {r.stage: r for r in stages.table(spark).collect()}
    assert list(rows) == ["planner", "bm25", "page_index", "vector", "fusion", "reranker"]
    assert rows["planner"].rows == 2 and rows["bm25"].rows == 6 and 0 <= rows["bm25"].confidence <= 1 and rows["fusion"].confidence is None and all(r.ms > 0 for r in rows.values())
    counters = evaluate.provider_counters(stages.table(spark).withColumnRenamed("stage", "provider"))
    assert {r.provider: r.calls for r in counters.collect()} == dict.fromkeys(rows, 1)


def test_engine(spark, tmp_path):
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    engine = pipeline.Engine(spark, str(tmp_path / "engine"))
    assert {r.document_id: r.chunks for r in engine.ingest(chunk_rows(spark, ["Refunds are paid within 30 days.", "Other words."])).collect()} == {"d0": 1, "d1": 1}
    assert engine.get_document("d1").first().chunks[0].text == "Other words." and engine.get_document("none").count() == 0
    q = spark.createDataFrame([(1, "refunds", []), (2, "Compare Unicorns", []), (3, "refunds", ["d1"])], "query_id long, query string, document_ids array<string>")
    first = {r.query_id: r for r in engine.query(q, now).collect()}
    assert {r.source for r in first.values()} == {"run"} and first[2].answer == "NOT_FOUND" and engine.stages.rows
    again = {r.query_id: r for r in engine.query(q, now).collect()}
    assert (again[1].source, again[2].source) == ("exact", "run") and again[1].answer == first[1].answer
    assert engine.chunks().count() == 2 and len(engine.chunks().first().embedding_full) == 1024
    engine.ingest(chunk_rows(spark, ["Refunds are never paid."]))
    assert {r.query_id: r.source for r in engine.query(q, now).collect()}[1] == "run"


@pytest.mark.parametrize("wrong", [{"bm25_k": 0}, {"fused_k": 1.5}, {"page_k": 0}, {"provider": "other"}, {"scope_vectors": True}])
def test_settings_are_checked(wrong):
    with pytest.raises(ValueError):
        pipeline.Config(**wrong)


def test_the_environment_names_the_provider():
    assert pipeline.active_provider({}) == "offline" and pipeline.active_provider({"LODESTONE_PROVIDER": " Prod "}) == "prod"
    for wrong in ({"LODESTONE_PROVIDER": "somebody"}, {"LODESTONE_PROVIDER": "dev", "LODESTONE_ENV": "Production"}):
        with pytest.raises(ValueError, match="provider"):
            pipeline.active_provider(wrong)
    assert pipeline.active_provider({"LODESTONE_PROVIDER": "dev", "LODESTONE_ENV": "test"}) == "dev"
