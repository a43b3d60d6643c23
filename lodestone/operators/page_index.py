"""Structural scoring of candidate chunks, and the pages they are on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scores import structural
from ..functions.text import tokens
from .bm25 import corpus_order


def rank(queries: DataFrame, candidates: DataFrame, k: int | None = 10) -> DataFrame:
    """Candidates (query_id and a chunk's columns) by structural score, the ``k`` best of each query."""
    asked = queries.select("query_id", F.array_distinct(tokens(F.col("query"))).alias("asked"))
    score = structural(F.col("asked"), tokens(F.col("text")), F.col("element_type"), F.size("section_path"))
    order = Window.partitionBy("query_id").orderBy(F.col("structural_score").desc(), *corpus_order())
    ranked = candidates.join(asked, "query_id").withColumn("structural_score", F.round(score, 6)).withColumn("page_rank", F.row_number().over(order)).drop("asked")
    return ranked if k is None else ranked.where(F.col("page_rank") <= k)


def candidate_pages(ranked: DataFrame) -> DataFrame:
    """Distinct pages in order, the chunks' ids, and min(1, mean score / 10)."""
    return ranked.groupBy("query_id").agg(
        F.sort_array(F.collect_set("page_number")).alias("pages"),
        F.sort_array(F.collect_set("chunk_id")).alias("chunk_ids"),
        F.least(F.lit(1.0), F.round(F.avg("structural_score") / 10, 6)).alias("confidence"),
    )
