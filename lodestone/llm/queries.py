"""The registered queries over whole tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import htmltext, media, mixing, neardup, negatives, oracles, packing, pieces, pii, quality, sharding, spelling, substrings, urlfilter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = sharding.tree(24)
    out = sharding.assign(table(spark, sf_dir, "documents"), leaves, sharding.grown(leaves))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = media.load(media.store(table(spark, sf_dir, "documents")))
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -32)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.lower(F.hex("phash")).alias("feature"),
    )


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.copies(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.cluster(table(spark, sf_dir, "documents"), size=3, percent=85)


#: Pseudonyms here can be recomputed by whoever reads this; real keys come from the caller.
PII_KEY = "public demonstration key"


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pii.protect(table(spark, sf_dir, "documents"), PII_KEY)
    kinds = F.array_join(F.array_sort(F.array_distinct("pii_found")), ",")
    return done.select("doc_id", "text", F.coalesce(F.size("pii_found"), F.lit(0)).cast("long").alias("n_found"), F.coalesce(kinds, F.lit("")).alias("kinds"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_clean_words")
    return judged.select("doc_id", *(F.col(f"quality.{x}").alias(x) for x in names))


def tokenizer_file(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = pieces.encode(table(spark, sf_dir, "documents"), tokenizer_file())
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


RULES = [
    urlfilter.Rule("com", "/en/", "block"),
    urlfilter.Rule("example.com", "/en/7", "allow"),
    urlfilter.Rule("net", "/de/", "allow"),
    urlfilter.Rule("example.net", "/de/8", "block"),
    urlfilter.Rule("org", "/es/", "block"),
]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes: a page is bad where the label of its number is of low quality or toxic."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad"))
    return urlfilter.judge(table(spark, sf_dir, "pages"), labels, RULES).select("page_id", "host", "path", "rule", "verdict", F.round("bad_rate", 6).alias("bad_rate"), F.round("bad_bound", 6).alias("bad_bound"))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.deduplicate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


#: Tokens of a packed sequence.
SEQUENCE = 2048


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces_ = packing.pieces(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), SEQUENCE)
    return packing.pack(pieces_.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), SEQUENCE)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_media": op2_media,
    "op3_mixing": op3_mixing,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_pii": op5_pii,
    "op6_quality": op6_quality,
    "op7_pieces": op7_pieces,
    "op8_url_filter": op8_url_filter,
    "op9_substrings": op9_substrings,
    "op10_html": op10_html,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_spelling": op12_spelling,
    "op13_packing": op13_packing,
}

ORACLES: dict[str, str] = {
    "op6_quality": oracles.QUALITY,
    "op8_url_filter": oracles.url_filter(RULES),
    "op9_substrings": oracles.SUBSTRINGS,
    "op11_hard_negatives": oracles.HARD_NEGATIVES,
    "op12_spelling": oracles.SPELLING,
}
