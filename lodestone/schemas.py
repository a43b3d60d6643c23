"""Schemas of the tables that the engine reads and writes."""

from pyspark.sql import types as T

BOX = T.StructType([T.StructField(x, T.DoubleType()) for x in ("x1", "y1", "x2", "y2")] + [T.StructField("page_number", T.IntegerType())])
TEXTS = T.ArrayType(T.StringType())

CHUNKS = T.StructType(
    [
        T.StructField("chunk_id", T.StringType(), False),
        T.StructField("document_id", T.StringType(), False),
        T.StructField("source_format", T.StringType(), False),
        T.StructField("text", T.StringType(), False),
        T.StructField("element_type", T.StringType(), False),
        T.StructField("page_number", T.IntegerType()),
        T.StructField("section_path", TEXTS, False),
        T.StructField("bounding_box", BOX),
        T.StructField("location_reference", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("structural_weight", T.DoubleType(), False),
        T.StructField("provider", T.StringType(), False),
        T.StructField("embedding_fast", T.ArrayType(T.FloatType())),
        T.StructField("embedding_full", T.ArrayType(T.FloatType())),
        T.StructField("image_keys", TEXTS, False),
        T.StructField("ordinal", T.IntegerType(), False),
    ]
)
CONCEPTS = T.StructType([T.StructField("id", T.StringType(), False), T.StructField("name", T.StringType(), False), T.StructField("type", T.StringType(), False), T.StructField("document_ids", TEXTS)])
PROPERTIES = T.StructType(
    [T.StructField(x, T.StringType()) for x in ("concept_id", "property_name", "property_value", "value_type", "source_chunk_id")] + [T.StructField("confidence", T.DoubleType()), T.StructField("extraction_tier", T.StringType())]
)
RELATIONS = T.StructType(
    [T.StructField(x, T.StringType()) for x in ("from_concept_id", "to_concept_id", "relation_type")] + [T.StructField("relation_weight", T.DoubleType()), T.StructField("source_chunk_id", T.StringType()), T.StructField("extraction_tier", T.StringType())]
)
CACHE = T.StructType(
    [
        T.StructField("cache_key", T.StringType(), False),
        T.StructField("query_embedding", T.ArrayType(T.DoubleType())),
        T.StructField("doc_scope_hash", T.StringType()),
        T.StructField("provider", T.StringType()),
        T.StructField("document_ids", TEXTS),
        T.StructField("payload", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("expires_at", T.TimestampType()),
    ]
)
EVAL_QUERIES = T.StructType([T.StructField("query", T.StringType()), T.StructField("expected_answer", T.StringType()), T.StructField("source_page", T.IntegerType()), T.StructField("folder", T.StringType()), T.StructField("document_filename", T.StringType())])

#: The types a concept may have.
CONCEPT_TYPES = ("PRODUCT", "PERSON", "ORGANIZATION", "METRIC", "POLICY", "PROCESS", "DATE_PERIOD", "LOCATION", "ISSUE", "REGULATION", "TERM")
