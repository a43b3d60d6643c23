"""Known-item tests: questions made from chunks, which retrieval should lead back to their chunk."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import word_count


def sample(chunks: DataFrame, n: int = 10, seed: int = 42) -> DataFrame:
    """``n`` chunks, the same for the same seed, whatever the order of rows."""
    return chunks.orderBy(F.xxhash64("chunk_id", F.lit(seed)), "chunk_id").limit(n)


def question(text: Column, least: int = 30, most: int = 150, sentence_words: int = 10) -> Column:
    """Of a text with more than ``least`` and less than ``most`` words the middle one of its sentences (cut at full
    stops) with over ``sentence_words`` words, as a question; null without such a sentence."""
    long = F.filter(F.transform(F.split(text, r"\."), lambda s: F.trim(s)), lambda s: word_count(s) > sentence_words)
    middle = F.element_at(F.transform(F.array(long), lambda s: F.get(s, F.floor(F.size(s) / 2).cast("int"))), 1)
    return F.when((word_count(text) > least) & (word_count(text) < most), F.concat(middle, F.lit("?")))


def synthetic_queries(chunks: DataFrame, least: int = 30, most: int = 150, sentence_words: int = 10) -> DataFrame:
    """(chunk_id, query): the :func:`question` of each chunk that has one."""
    return chunks.select("chunk_id", question(F.col("text"), least, most, sentence_words).alias("query")).where("query is not null")


def recovered(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """(chunk_id, found): whether the hits (query_id, chunk_id) of a chunk's question hold the chunk; query_id is the chunk's."""
    own = hits.where(F.col("query_id") == F.col("chunk_id")).select(F.col("query_id").alias("chunk_id"), F.lit(True).alias("found")).distinct()
    return queries.select("chunk_id").join(own, "chunk_id", "left").select("chunk_id", F.coalesce("found", F.lit(False)).alias("found"))


def first(queries: DataFrame, limit: int | None, order: str = "query_id") -> DataFrame:
    """The first ``limit`` queries by ``order``, with a warning that what is measured on them is partial; all without a limit."""
    if limit is None:
        return queries
    warnings.warn(f"a partial run: at most {limit} queries", stacklevel=2)
    return queries.orderBy(order).limit(limit)
