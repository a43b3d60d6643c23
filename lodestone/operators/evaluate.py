"""Retrieval metrics as relations over (query_id, rank, hit) and friends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import EVAL_STOP_WORDS, tokens
from . import affix


#: Stretches to a unit of a measured value, a power of two: what one task puts in order.
STRETCHES = 16


def keywords(answer: Column) -> Column:
    return F.array_except(F.array_distinct(tokens(answer)), F.array(*map(F.lit, EVAL_STOP_WORDS)))


def hit(same_document: Column, page: Column, expected_page: Column, wanted: Column, text: Column) -> Column:
    """The right document within three pages, or over a fifth of the expected answer's words."""
    overlap = F.size(F.array_intersect(wanted, tokens(text))) / F.greatest(F.size(wanted), F.lit(1))
    return (F.coalesce(same_document, F.lit(False)) & F.coalesce(F.abs(page - expected_page) <= 3, F.lit(False))) | (overlap > 0.20)


def expected_documents(queries: DataFrame, documents: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """(query_id, document_id): the document with the query's expected file name, or null where there is none.

    With ``chunks`` (document_id, source_format) a name that no document has is looked for within the chunks' source
    formats, which often hold one; of several documents the least is taken.
    """
    named = documents.select("document_id", F.col("filename").alias("document_filename"))
    found = queries.join(named, "document_filename", "left").select("query_id", "document_filename", "document_id")
    if chunks is None:
        return found.select("query_id", "document_id")
    missed = found.where("document_id is null").select("document_filename")
    formats = chunks.select("document_id", "source_format").distinct()
    inside = affix.containing(missed, formats, "document_filename", "source_format", "document_id")
    least = inside.groupBy(F.col("needle").alias("document_filename")).agg(F.min("id").alias("inside"))
    return found.join(least, "document_filename", "left").select("query_id", F.coalesce("document_id", "inside").alias("document_id"))


def candidate_reduction(kept: Column, candidates: Column) -> Column:
    return 1 - kept / candidates


def cache_hit_rate(queries: DataFrame, *hits: DataFrame) -> DataFrame:
    """One row: the share of queries that one of the ``hits`` (query_id) answers."""
    found = hits[0].select("query_id")
    for h in hits[1:]:
        found = found.union(h.select("query_id"))
    marked = queries.select("query_id").join(found.distinct().withColumn("hit", F.lit(1.0)), "query_id", "left")
    return marked.agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("cache_hit_rate"))


def activation(answers: DataFrame) -> DataFrame:
    """One row: the share of answers (fast_path) that did not take the fast path, none without answers."""
    return answers.agg(F.coalesce(1 - F.sum(F.col("fast_path").cast("int")) / F.count("*"), F.lit(0.0)).alias("activation"), F.count("*").alias("n_queries"))


def provider_counters(calls: DataFrame) -> DataFrame:
    """Per provider the number of calls (provider, ms), their time, and the mean time of a call."""
    return calls.groupBy("provider").agg(F.count("*").alias("calls"), F.round(F.sum("ms"), 4).alias("total_ms"), F.round(F.avg("ms"), 4).alias("mean_ms"))


def per_query(ranked: DataFrame) -> DataFrame:
    """Metrics of each query from (query_id, rank, hit); nDCG's ideal is of the hits retrieved."""
    one, place = F.col("hit").cast("int"), F.col("rank")
    gain = one / F.log2(place + 1.0)
    sums = ranked.where(place <= 5).groupBy("query_id").agg(
        F.max(F.when(place <= 3, one).otherwise(0)).alias("recall_3"),
        F.max(one).alias("recall_5"),
        (F.sum(F.when(place <= 3, one).otherwise(0)) / 3).alias("precision_3"),
        F.min(F.when(F.col("hit"), place)).alias("first"),
        F.sum(gain).alias("dcg"),
        F.sum(one).alias("hits"),
        F.avg(one).alias("context_precision"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("hits"), F.lit(1)).cast("int")), F.lit(0.0), lambda s, k: s + 1 / F.log2(k + 1.0))
    return sums.select("query_id", "recall_3", "recall_5", F.round("precision_3", 6).alias("precision_3"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr_5"), F.round(F.when(F.col("hits") > 0, F.col("dcg") / ideal).otherwise(0.0), 6).alias("ndcg_5"), F.round("context_precision", 6).alias("context_precision"))


def means(metrics: DataFrame) -> DataFrame:
    names = [c for c in metrics.columns if c != "query_id"]
    return metrics.agg(*(F.round(F.avg(c), 6).alias(c) for c in names), F.count("*").alias("n_queries"))


def latency(events: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and the 95th percentile as the value at place int(0.95 n), from 0.

    Equal values are counted first and summed up in stretches; only the distinct values of the one stretch
    that holds the place are put in order, so no task sorts all events of a group.
    """
    from pyspark.sql.window import Window

    counts = events.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("value")).agg(F.count("*").alias("times"))
    counts = counts.withColumn("stretch", F.floor(F.col("value") * STRETCHES))
    ends = Window.partitionBy(*by).orderBy("stretch")
    stretches = counts.groupBy(*by, "stretch").agg(F.sum("times").alias("held"), F.sum(F.col("value") * F.col("times")).alias("sum"))
    placed = stretches.withColumn("before", F.sum("held").over(ends) - F.col("held")).withColumn("n", F.sum("held").over(Window.partitionBy(*by))).withColumn("sum", F.sum("sum").over(Window.partitionBy(*by)))
    wanted = F.floor(F.col("n") * 0.95)
    one = placed.where((F.col("before") <= wanted) & (wanted < F.col("before") + F.col("held"))).select(*by, "stretch", "before", "n", "sum")
    near = counts.join(one, [*by, "stretch"]).withColumn("upto", F.col("before") + F.sum("times").over(Window.partitionBy(*by).orderBy("value")))
    return near.groupBy(*by).agg(F.round(F.first("sum") / F.first("n"), 4).alias("mean"), F.min(F.when(F.col("upto") > wanted, F.col("value"))).alias("p95"))


def mean_positive(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.round(F.avg(F.when(F.col(value) > 0, F.col(value))), 4).alias("mean_positive"))


def keyword_recall(wanted: Column, text: Column) -> Column:
    found = F.size(F.filter(wanted, lambda w: F.contains(F.lower(text), F.lower(w))))
    return found / F.greatest(F.size(wanted), F.lit(1))


def grounded_numbers(answer: Column, context: Column) -> Column:
    """Share of the answer's numbers that the context has too; 1 without numbers."""
    numbers = F.array_distinct(F.regexp_extract_all(answer, F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0)))
    return F.when(F.size(numbers) == 0, 1.0).otherwise(F.size(F.filter(numbers, lambda x: F.contains(context, x))) / F.size(numbers))


def compression_ratio(context: Column, raw_chars: Column) -> Column:
    return 1 - F.length(context) / raw_chars
