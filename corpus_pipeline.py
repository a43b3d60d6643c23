"""Documents to token ids: quality rules, near-duplicates, personal data, source mix, encoding.

Each stage is (name, function of (spark, docs, sf_dir)); its result is written as Parquet and read again as
the next one's documents.  All but the last return the columns of documents; further columns pass through them.
Every stage works on whole texts of any length, and turns an empty table into an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import common, mixing, neardup, pieces, pii, quality, queries


def _recounted(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the texts as they are now."""
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and documents that lose too much text or fail the base rules go.

    A null or empty text has no words and goes; rows stand alone, so repeated rows stay or go together.
    """
    return _recounted(quality.passing(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group (five-word shingles, similarity 0.8) the document with the least id stays.

    Of rows that repeat an id and a text one stays; of one id's several texts in a group, the one with the least hash.
    Texts without words, null ones among them, are in no group: they stay, once for each id and text.
    """
    return neardup.deduplicated(docs, size=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes pseudonyms: equal values equal ones, in all documents.

    Null and empty texts stay as they are; rows stand alone, so repeated rows stay equal.
    """
    return _recounted(pii.protect(docs, queries.PII_KEY).drop("pii_found"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight asks for; a copy is a row of its own.

    Null sources are one source; a null or empty text has no words and weighs nothing; repeated rows are drawn each
    for itself.  Ties in length are ordered by a hash of the row, so reruns agree.
    """
    return mixing.mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with an end id, and the text that they decode to: a row for each row, null texts as empty ones."""
    return pieces.encode(docs, queries.tokenizer_file())


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("personal data", personal_data),
    ("source mix", source_mix),
    ("encoding", encoding),
]

#: Sketches, Feistel networks and token merging have no counterpart in SQL; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; what a stage wrote on its way is deleted when its result is written."""
    docs = queries.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.outcome(spark, "pipeline", lambda d=docs, f=stage: f(spark, d, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
