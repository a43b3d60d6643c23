"""Answers kept by query and scope: exact and semantic hits, guarded writes, expiry, invalidation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import cache_key, scope_hash
from . import vector

TTL_SECONDS, LEAST_SIMILAR, LEAST_CONFIDENCE = 86_400, 0.95, 0.50


def live(cache: DataFrame, now: Column) -> DataFrame:
    return cache.where(F.col("expires_at") > now)


def keyed(queries: DataFrame) -> DataFrame:
    return queries.withColumn("cache_key", cache_key(F.col("query"), F.col("document_ids"))).withColumn("doc_scope_hash", scope_hash(F.col("document_ids")))


def exact_hits(queries: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """(query_id, payload): the newest live entry with the same key."""
    newest = live(cache, now).groupBy("cache_key").agg(F.max_by("payload", F.struct("created_at", "payload")).alias("payload"))
    return keyed(queries).join(newest, "cache_key").select("query_id", "payload")


def semantic_hits(queries: DataFrame, cache: DataFrame, now: Column, least: float = LEAST_SIMILAR) -> DataFrame:
    """(query_id, payload, similarity): the most similar live entry of the same scope and provider, if similar enough.

    ``queries`` has query_vector and provider; ties go to the greatest key, then payload.  Equal vectors of a scope
    and provider are compared once: of its entries the one that ties prefer stands for all, and questions share
    their answer.  The different ones meet in blocks (:func:`vector.top_k`), so that questions without a scope, mostly
    the usual ones, are no single task's work.
    """
    scope = ("doc_scope_hash", "provider")
    entries = live(cache, now).where(F.col("query_embedding").isNotNull())
    # a null payload comes before all others and stays null
    name = F.concat("cache_key", F.coalesce(F.concat(F.lit("\x00"), "payload"), F.lit("")))
    entries = entries.groupBy(*scope, F.col("query_embedding").alias("embedding")).agg(F.max(name).alias("id"))
    same = F.sha2(F.to_json(F.struct(*scope, F.col("query_vector").cast("string").alias("v"))), 256)
    asked = keyed(queries).where(F.col("query_vector").isNotNull()).select("query_id", F.col("query_vector").alias("vector"), *scope, same.alias("same"))
    distinct = asked.groupBy(*scope, "same").agg(F.first("vector").alias("vector")).withColumnRenamed("same", "query_id")
    best = vector.top_k(distinct, entries, 1, "embedding", "id", scope=scope, last=True).where(F.col("score") >= least)
    own = asked.select("query_id", "same").join(best.select(F.col("query_id").alias("same"), "score", "id"), "same")
    found = own.groupBy("query_id").agg(F.max(F.struct("score", "id")).alias("best"))
    return found.select("query_id", F.get(F.split("best.id", "\x00", 2), F.lit(1)).alias("payload"), F.col("best.score").alias("similarity"))


def misses(queries: DataFrame, *hits: DataFrame) -> DataFrame:
    for h in hits:
        queries = queries.join(h.select("query_id"), "query_id", "left_anti")
    return queries


def entries(answers: DataFrame, now: Column, ttl: int = TTL_SECONDS) -> DataFrame:
    """What may be written of answers (query, document_ids, query_vector, provider, answer, confidence): sure and found ones."""
    sure = answers.where((F.col("confidence") >= LEAST_CONFIDENCE) & (F.col("answer") != "NOT_FOUND"))
    return keyed(sure).select(
        "cache_key",
        F.col("query_vector").alias("query_embedding"),
        "doc_scope_hash",
        "provider",
        "document_ids",
        F.to_json(F.struct("answer", "confidence")).alias("payload"),
        now.alias("created_at"),
        (now + F.make_interval(secs=F.lit(ttl))).alias("expires_at"),
    )


def invalidated(cache: DataFrame, reingested: DataFrame) -> DataFrame:
    """The cache without entries whose scope holds a document (document_id) that was ingested again; those without scope go too."""
    hit = cache.select("cache_key", F.explode("document_ids").alias("document_id")).join(reingested, "document_id").select("cache_key").distinct()
    return cache.where(F.size("document_ids") > 0).join(hit, "cache_key", "left_anti")
