"""Reciprocal rank fusion and reranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scores import jaccard

RRF_K = 60


def settle(df: DataFrame) -> None:
    """Keep unions from claiming their children's partitioning: under adaptive execution the children's
    partitions may be coalesced unlike, and then later joins pair rows wrongly."""
    df.sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")


def rrf(lists: list[DataFrame], k: int = 4, id_col: str = "chunk_id") -> DataFrame:
    """Ranked lists (query_id, id, rank from 1) fused: sum of 1 / (60 + rank - 1).

    Ties keep the order of first places, the first list's before the second's.  One shuffle by query and id,
    one by query.
    """
    settle(lists[0])
    places = None
    for n, hits in enumerate(lists):
        own = hits.select("query_id", F.col(id_col).alias("id"), F.col("rank").cast("int").alias("rank"), F.lit(n).alias("list"))
        places = own if places is None else places.unionByName(own)
    fused = places.groupBy("query_id", "id").agg(F.round(F.sum(1.0 / (RRF_K + F.col("rank") - 1)), 9).alias("rrf"), F.min(F.struct("list", "rank")).alias("first"))
    order = Window.partitionBy("query_id").orderBy(F.col("rrf").desc(), "first")
    return fused.withColumn("fused_rank", F.row_number().over(order)).where(F.col("fused_rank") <= k).select("query_id", F.col("id").alias(id_col), "rrf", "fused_rank")


def rerank(candidates: DataFrame, k: int = 6, score: Column | None = None) -> DataFrame:
    """Candidates (query_id, query, chunk_id, text, fused_rank) by Jaccard similarity, or another ``score``."""
    order = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), "fused_rank")
    scored = candidates.withColumn("rerank_score", F.round(jaccard(F.col("query"), F.col("text")) if score is None else score, 6))
    return scored.withColumn("rerank_rank", F.row_number().over(order)).where(F.col("rerank_rank") <= k)
