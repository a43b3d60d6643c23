"""Batches of queries to answers: plan, BM25, structure, vectors, fusion, rerank, compress, gate, answer, cite."""

from __future__ import annotations

import os
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.scores import band, confidence
from ..functions.vectors import hash_embedding
from ..operators import answer, bm25, cache, fusion, knowledge, page_index, vector
from ..operators.store import conformed, get_document, load_chunks, save_chunks, with_embeddings, written
from . import planner


#: Who may answer: nobody outside, a development account, a production one.
PROVIDERS = ("offline", "dev", "prod")


def active_provider(environment: dict[str, str] | None = None) -> str:
    """The provider that LODESTONE_PROVIDER names, offline without it.

    Any but PROVIDERS raises, and so does the development account where LODESTONE_ENV is production.
    """
    told = os.environ if environment is None else environment
    name = told.get("LODESTONE_PROVIDER", "").strip().lower() or "offline"
    if name == "dev" and told.get("LODESTONE_ENV", "").strip().lower() == "production":
        raise ValueError("the development provider must not answer in production")
    if name not in PROVIDERS:
        raise ValueError(f"provider must be one of {', '.join(PROVIDERS)}, not {name!r}")
    return name


class Stages:
    """What each stage of a run gave: rows, mean confidence and seconds, observed while its table is written.

    No job is run for a figure.  ``table`` is (stage, rows, confidence, ms), in order.
    """

    def __init__(self):
        self.rows: list[tuple[str, int, float | None, float]] = []

    def written(self, df: DataFrame, stage: str, confidence: Column | None = None) -> DataFrame:
        """``df`` as a table, noted under ``stage``; ``confidence`` is a column whose mean is noted."""
        seen, began = Observation(stage), time.monotonic()
        mean = F.avg(confidence) if confidence is not None else F.lit(None).cast("double")
        out = written(df.observe(seen, F.count(F.lit(1)).alias("rows"), F.round(mean, 6).alias("confidence")), stage)
        self.rows.append((stage, seen.get["rows"], seen.get["confidence"], round(1000 * (time.monotonic() - began), 3)))
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "stage string, rows long, confidence double, ms double")


@dataclass(frozen=True)
class Config:
    """How the stages are set; ``FUSED`` and ``SCOPED`` are the two presets."""

    rules: planner.Rules = planner.FUSED
    bm25_k: int = 5
    page_k: int | None = None
    vector_k: int = 5
    scope_vectors: bool = False
    fuse: bool = True
    fused_k: int = 4
    fast_k: int = 5
    rerank_k: int = 6
    context_chars: int = 4000
    numbered: bool = True
    raw_fallback: bool = False
    embed: Callable[[Column], Column] = lambda t: hash_embedding(t, 384)
    embed_full: Callable[[Column], Column] = lambda t: hash_embedding(t, 1024, normalize=False)
    generate: Callable[[Column, Column], Column] = answer.extractive_answer
    provider: str = "offline"

    def __post_init__(self):
        for name in ("bm25_k", "vector_k", "fused_k", "fast_k", "rerank_k", "context_chars"):
            if not isinstance(getattr(self, name), int) or getattr(self, name) < 1:
                raise ValueError(f"{name} must be a whole number from 1")
        if self.page_k is not None and self.page_k < 1:
            raise ValueError("page_k must be from 1, or None for all")
        if self.provider not in PROVIDERS:
            raise ValueError(f"provider must be one of {', '.join(PROVIDERS)}, not {self.provider!r}")
        if self.scope_vectors and self.page_k is None:
            raise ValueError("vectors are scoped to the page stage's candidates, which page_k bounds")


FUSED = Config()
SCOPED = Config(rules=planner.SCOPED, bm25_k=20, page_k=10, scope_vectors=True, fuse=False, fast_k=3, context_chars=4800, numbered=False, raw_fallback=True)


def near(asked: DataFrame, chunks: DataFrame, config: Config = FUSED, candidates: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank): vector hits of queries (query_id, query, fast_path).

    A fast question is embedded for, and compared with, embedding_fast; any other one embedding_full.  Each column is
    searched by its own questions alone.
    """
    found = None
    for fast, embed in ((True, config.embed), (False, config.embed_full)):
        own = asked.where(F.col("fast_path") == fast).select("query_id", embed(F.col("query")).alias("vector"))
        hits = vector.top_k(own, chunks, config.vector_k, vector.column_for(fast), candidates=candidates)
        found = hits if found is None else found.unionByName(hits)
    return found


def vectored(chunks: DataFrame, config: Config = FUSED) -> DataFrame:
    """``chunks`` with both vector columns: their own, or computed from their texts where they are read."""
    return chunks if set(vector.COLUMNS) <= set(chunks.columns) else with_embeddings(chunks, config.embed, config.embed_full)


def retrieve(planned: DataFrame, chunks: DataFrame, config: Config = FUSED, stages: Stages | None = None, built: bm25.Index | None = None) -> DataFrame:
    """(query_id, chunk_id, rrf, fused_rank): what the retrieval stages agree on for ``planned`` (query_id, query, fast_path).

    Where ``chunks`` lacks the vector columns they are computed, of scoped questions' candidates alone.  Each stage's
    result is a table.
    ``built`` is the chunks' lexical index, if there is one; else it is made now.
    """
    stages = stages or Stages()
    hits = stages.written(bm25.top_k(planned.select("query_id", "query"), chunks, config.bm25_k, built), "bm25", F.least(F.lit(1.0), F.col("score") / 10))
    scope, searched = None, chunks
    if config.scope_vectors:
        own = hits.select("query_id", "chunk_id").join(chunks.select("chunk_id", "document_id", "ordinal", "text", "element_type", "section_path"), "chunk_id")
        ranked = page_index.rank(planned.select("query_id", "query"), own, config.page_k)
        scope = stages.written(ranked.select("query_id", "chunk_id", "structural_score", "text"), "page_index", F.least(F.lit(1.0), F.col("structural_score") / 10))
        if not set(vector.COLUMNS) <= set(chunks.columns):
            searched = scope.select("chunk_id", "text").dropDuplicates(["chunk_id"])
        scope = scope.select("query_id", "chunk_id")
    found = stages.written(near(planned, vectored(searched, config), config, scope), "vector", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))))
    return fusion.rrf([found, hits] if config.fuse else [found], max(config.fused_k, config.fast_k))


@dataclass(frozen=True)
class Knowledge:
    """Concepts (id, name), properties (concept_id, ...) and relations, where a corpus has them."""

    concepts: DataFrame
    properties: DataFrame
    relations: DataFrame


def known(planned: DataFrame, graph: Knowledge) -> tuple[DataFrame, DataFrame]:
    """What the property and graph stages find: (query_id, properties) of all queries but fast ones, and
    (query_id, graph), at most 40 rows in order, of those routed to the graph."""
    asked = planned.where(~F.col("fast_path"))
    found = knowledge.lookup(asked, graph.concepts, graph.properties)
    properties = found.groupBy("query_id").agg(F.array_sort(F.collect_set(F.struct("concept", "property_name", "property_value", "source_chunk_id"))).alias("properties"))
    walked = knowledge.walk(knowledge.starts(asked.where("use_graph"), graph.concepts), graph.relations)
    return properties, walked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("hop", "concept_id", "relation_type", "relation_weight"))).alias("graph"))


def known_counts(planned: DataFrame, graph: Knowledge) -> tuple[DataFrame, DataFrame]:
    """(query_id, properties) and (query_id, graph): of how many facts the columns of :func:`known` are."""
    asked = planned.where(~F.col("fast_path"))
    walked = knowledge.walk(knowledge.starts(asked.where("use_graph"), graph.concepts), graph.relations)
    found = knowledge.fact_counts(asked, graph.concepts, graph.properties).select("query_id", F.col("facts").alias("properties"))
    return found, walked.groupBy("query_id").agg(F.count("*").alias("graph"))


def answers(queries: DataFrame, chunks: DataFrame, config: Config = FUSED, graph: Knowledge | None = None, stages: Stages | None = None, built: bm25.Index | None = None, counted: bool = False) -> DataFrame:
    """query_id, answer, confidence, band, fast_path, route, citations (chunk ids) for every query.

    Fast ones answer with their best chunks' text at the constant confidence 0.85.  Others are reranked,
    compressed and gated: where the context lacks an entity of the query the answer is NOT_FOUND at
    confidence 0 and nothing is generated.  So is a query for which nothing is found.  With ``graph``
    there are also ``properties`` and ``graph``, the facts on the concepts that a query names: all of them in its row, or
    with ``counted`` their number, where a concept may have more than a row holds.  ``stages`` is told what each stage
    gave; ``built`` is the chunks' lexical index, if there is one.
    """
    fusion.settle(queries)
    stages = stages or Stages()
    planned = stages.written(planner.route(queries, config.rules), "planner")
    fused = stages.written(retrieve(planned, chunks, config, stages, built), "fusion")
    # the few hits meet the chunks first, and once
    texts = fused.join(chunks.select("chunk_id", "document_id", "ordinal", "text"), "chunk_id")
    found = written(texts.join(planned.select("query_id", "query", "route", "fast_path"), "query_id"), "found")

    quick = found.where(F.col("fast_path") & (F.col("fused_rank") <= config.fast_k))
    texts = F.array_sort(F.collect_list(F.struct("fused_rank", "text", "chunk_id")))
    some = planned.where("fast_path").select("query_id", "route").join(quick.groupBy("query_id").agg(texts.alias("own")), "query_id", "left")
    none = F.array().cast("array<string>")
    fast = some.select(
        "query_id", "route", F.lit(True).alias("fast_path"), F.coalesce(F.left(F.array_join(F.col("own.text"), " "), F.lit(500)), F.lit(answer.NOT_FOUND)).alias("answer"),
        F.when(F.col("own").isNotNull(), 0.85).otherwise(0.0).alias("confidence"), F.coalesce(F.col("own.chunk_id"), none).alias("citations"),
    )

    ranked = stages.written(fusion.rerank(found.where(~F.col("fast_path") & (F.col("fused_rank") <= config.fused_k)), config.rerank_k), "reranker", F.col("rerank_score"))
    contexts = answer.compress_or_raw(ranked) if config.raw_fallback else answer.compress(ranked, "rerank_rank", config.context_chars, config.numbered)
    means = ranked.groupBy("query_id").agg(F.avg("rerank_score").alias("mean"), F.array_sort(F.collect_list(F.struct("rerank_rank", "chunk_id"))).alias("own"))
    joined = planned.where(~F.col("fast_path")).select("query_id", "query", "route").join(contexts, "query_id", "left").join(means, "query_id", "left")
    share = F.coalesce(answer.coverage(F.col("query"), F.col("context")), F.lit(0.0))
    said = joined.withColumn("coverage", share).withColumn("said", F.when((share >= 1.0) & F.col("own").isNotNull(), answer.parse_output(config.generate(F.col("query"), F.col("context")))))
    cited = F.transform(F.filter("said.citations", lambda n: (n >= 1) & (n <= F.size("own"))), lambda n: F.element_at(F.col("own"), n)["chunk_id"])
    full = said.select(
        "query_id",
        "route",
        F.lit(False).alias("fast_path"),
        F.coalesce("said.answer", F.lit(answer.NOT_FOUND)).alias("answer"),
        F.when(F.col("said").isNotNull(), F.round(confidence(F.col("mean"), F.col("coverage")), 4)).otherwise(0.0).alias("confidence"),
        F.coalesce(cited, none).alias("citations"),
    )
    out = fast.unionByName(full).withColumn("band", band(F.col("confidence")))
    for facts in (known_counts if counted else known)(planned, graph) if graph else ():
        out = out.join(facts, "query_id", "left")
    return out


def cached_answers(queries: DataFrame, chunks: DataFrame, entries: DataFrame, now: Column, config: Config = FUSED, stages: Stages | None = None, built: bm25.Index | None = None) -> tuple[DataFrame, DataFrame]:
    """Answers by way of the cache, and the entries that are to be added to it.

    ``queries`` has query_id, query and document_ids.  An exact live entry answers first (``source`` exact),
    then a similar one (semantic); what remains is run over the chunks of its scope (run).  Of run answers
    those that are sure and found make new entries.  Answers: query_id, answer, confidence, source.
    """
    asked = queries.withColumn("query_vector", config.embed(F.col("query"))).withColumn("provider", F.lit(config.provider))
    # each layer is used several times by the next ones
    exact = written(cache.exact_hits(asked, entries, now), "exact")
    left = cache.misses(asked, exact)
    near = written(cache.semantic_hits(left, entries, now), "near")
    rest = written(cache.misses(left, near), "rest")
    run = written(answers(rest.select("query_id", "query"), chunks, config, stages=stages, built=built).select("query_id", "answer", "confidence"), "run")
    payload = F.from_json("payload", "answer string, confidence double")
    hits = [df.select("query_id", payload.alias("p")).select("query_id", "p.answer", "p.confidence", F.lit(name).alias("source")) for df, name in ((exact, "exact"), (near, "semantic"))]
    out = hits[0].unionByName(hits[1]).unionByName(run.withColumn("source", F.lit("run")))
    return out, cache.entries(rest.join(run, "query_id"), now)


class Engine:
    """Chunks, cache and answers of one place: what a user ingests, gets and asks.

    Tables lie under ``path``: ``chunks`` by bucket, ``cache`` as entries that are appended.
    """

    def __init__(self, spark: SparkSession, path: str, config: Config = FUSED):
        self.spark, self.path, self.config = spark, path.rstrip("/"), config
        self.stages = Stages()

    def ingest(self, chunks: DataFrame) -> DataFrame:
        """Save chunks with both vectors, replacing their documents, and drop the cached answers that these concern.

        Returns (document_id, chunks), how many each document has.
        """
        new = written(with_embeddings(chunks, self.config.embed, self.config.embed_full), "ingested")
        save_chunks(new, f"{self.path}/chunks")
        documents = new.groupBy("document_id").agg(F.count("*").alias("chunks"))
        if not (entries := self.cache()).isEmpty():
            kept = written(cache.invalidated(entries, documents.select("document_id")), "cache")
            kept.write.mode("overwrite").parquet(f"{self.path}/cache")
        return documents

    def chunks(self, document_ids: list[str] | None = None) -> DataFrame:
        return load_chunks(self.spark, f"{self.path}/chunks", document_ids)

    def get_document(self, document_id: str) -> DataFrame:
        """One row with the document's chunks in order, or none."""
        return get_document(self.spark, f"{self.path}/chunks", document_id)

    def cache(self) -> DataFrame:
        """The cache's entries, none where nothing was asked yet."""
        try:
            return self.spark.read.schema(schemas.CACHE).parquet(f"{self.path}/cache")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schemas.CACHE)

    def query(self, queries: DataFrame, now: Column | None = None) -> DataFrame:
        """Answers (query_id, answer, confidence, source) to queries (query_id, query, document_ids), by way of the cache.

        New entries are appended to it.  ``stages`` then has what the stages of the run gave.
        """
        self.stages = Stages()
        at = F.current_timestamp() if now is None else now
        found, new = cached_answers(queries, self.chunks(), self.cache(), at, self.config, self.stages)
        found = written(found, "answers")
        conformed(new, schemas.CACHE).write.mode("append").parquet(f"{self.path}/cache")
        return found
