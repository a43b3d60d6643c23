"""A PDF parser's JSON: elements under several names to chunks, and batches that fail in part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import affix
from ..operators.store import written
from ..schemas import BOX, EVAL_QUERIES


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """document_id (from the file's name) and payload, a file's whole JSON."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(path, wholetext=True)
    return files.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1).alias("document_id"), F.col("value").alias("payload"))


def _first(element: Column, *names: str) -> Column:
    return F.coalesce(*(F.nullif(F.trim(F.get_json_object(element, f"$['{n}']")), F.lit("")) for n in names))


def items_of(payload: Column) -> Column:
    """The payload's elements as JSON texts: a list, or a list under kids, pages, text, elements or elements' document."""
    as_list = lambda j: F.from_json(j, "array<string>")
    own = F.when(F.trim(payload).startswith("["), as_list(payload))
    return F.coalesce(own, *(F.when(F.get_json_object(payload, f"$.{n}").startswith("["), as_list(F.get_json_object(payload, f"$.{n}"))) for n in ("kids", "pages", "text", "elements")), F.array().cast("array<string>"))


def normalized(payloads: DataFrame) -> DataFrame:
    """Chunks of payloads (document_id, payload).

    Texts are trimmed, empty ones and images' file names skipped; the page defaults to 1, the type to
    paragraph; a box is a list of four numbers or an object.  Ids count all elements, also skipped ones.
    """
    each = payloads.select("document_id", F.posexplode(items_of(F.col("payload"))).alias("ordinal", "element"))
    e = F.col("element")
    raw_box = _first(e, "bounding box", "bounding_box", "bbox")
    four = F.from_json(raw_box, "array<double>")
    listed = F.when(F.size(four) == 4, F.struct(*(four[k].alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))), F.lit(None).cast("int").alias("page_number")))
    box = F.when(raw_box.startswith("["), listed).when(raw_box.startswith("{"), F.from_json(raw_box, BOX))
    rows = each.select(
        "document_id",
        "ordinal",
        _first(e, "content", "source", "text").alias("text"),
        F.coalesce(_first(e, "type", "element_type"), F.lit("paragraph")).alias("element_type"),
        F.coalesce(_first(e, "page number", "page_number", "page").try_cast("int"), F.lit(1)).alias("page_number"),
        box.cast(BOX).alias("bounding_box"),
    )
    kept = rows.where(F.col("text").isNotNull() & ~((F.col("element_type") == "image") & F.col("text").rlike(r"\.(png|jpe?g)$")))
    return kept.select(
        F.format_string("%s:page:%d:element:%d", "document_id", "page_number", "ordinal").alias("chunk_id"),
        "document_id",
        F.lit("pdf").alias("source_format"),
        "text",
        "element_type",
        "page_number",
        F.array().cast("array<string>").alias("section_path"),
        "bounding_box",
        F.concat(F.lit("Page: "), F.col("page_number").cast("string")).alias("location_reference"),
        "ordinal",
    )


#: What a parser returns for a batch: results, of which elements stay JSON texts, and the ids that failed.
RESPONSE = "results array<struct<document_id: string, markdown: string, elements: string, image_s3_keys: array<string>>>, failed array<string>, corrupt string"


def read_batches(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A parser's responses under ``path`` (JSON, one a file) as good results and failures, from one reading.

    Results: document_id, markdown, payload (its elements' JSON) and image_keys.  Failures: document_id, file, reason
    and raw; a response that is no JSON, a result without an id or without readable elements, and an id that the parser
    names as failed are each a row, and none stops the others.  Files without a byte are not read by Spark: what was asked
    for and is in neither table is found by :func:`failed_documents`.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(path)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"}
    text = F.col("content").cast("string")
    read = files.select(F.regexp_extract("path", "[^/]*$", 0).alias("file"), text.alias("raw"), F.from_json(text, RESPONSE, options).alias("r"))
    broken = F.col("r").isNull() | F.col("r.corrupt").isNotNull() | (F.col("r.results").isNull() & F.col("r.failed").isNull())
    # one row for each outcome, so that both tables come from one table that is written
    bad = lambda reason, document_id, raw: F.struct(F.lit(reason).alias("reason"), document_id.alias("document_id"), raw.alias("raw"), F.lit(None).cast(RESULT).alias("result"))
    nothing = F.lit(None).cast("string")

    def judged(r: Column) -> Column:
        sound = r["document_id"].isNotNull() & (r["elements"].isNull() | F.try_parse_json(r["elements"]).isNotNull())
        good = F.struct(nothing.alias("reason"), r["document_id"].alias("document_id"), nothing.alias("raw"), r.cast(RESULT).alias("result"))
        return F.when(sound, good).otherwise(F.when(r["document_id"].isNull(), bad("no document id", nothing, F.to_json(r))).otherwise(bad("unreadable elements", r["document_id"], r["elements"])))

    found = F.concat(F.coalesce(F.transform("r.results", judged), F.array()), F.coalesce(F.transform("r.failed", lambda x: bad("failed in the parser", x, nothing)), F.array()))
    outcomes = written(read.select("file", F.explode(F.when(broken, F.array(bad("no response", nothing, F.col("raw")))).otherwise(found)).alias("o")).select("file", "o.*"), "responses")
    good = outcomes.where("reason is null").select("document_id", "result.markdown", F.coalesce("result.elements", F.lit("[]")).alias("payload"), F.coalesce("result.image_s3_keys", F.array().cast("array<string>")).alias("image_keys"))
    return good, outcomes.where("reason is not null").select("document_id", "file", "reason", "raw")


RESULT = "struct<document_id: string, markdown: string, elements: string, image_s3_keys: array<string>>"


def with_image_keys(chunks: DataFrame, results: DataFrame) -> DataFrame:
    """``chunks`` with ``image_keys`` of their documents (document_id, image_keys), in their order; none where there are none."""
    own = results.select("document_id", F.col("image_keys").alias("own keys")).dropDuplicates(["document_id"])
    return chunks.drop("image_keys").join(own, "document_id", "left").select(*(c for c in chunks.columns if c != "image_keys"), F.coalesce("own keys", F.array().cast("array<string>")).alias("image_keys"))


def image_documents(images: DataFrame, documents: DataFrame) -> DataFrame:
    """(file, document_id): image files (file) and the document (document_id) whose id their names start with, the longest one.

    Only files with an image's suffix count.  A prefix join by equality: see :func:`affix.prefixed`.
    """
    pictures = images.where(F.lower("file").rlike(r"\.(png|jpe?g|webp)$")).select("file")
    return affix.prefixed(pictures, documents.select("document_id"), "file", "document_id", longest=True).select("file", F.col("prefix").alias("document_id"))


def failed_documents(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Inputs (document_id) of a batch without an output: good ones survive a corrupt one."""
    return inputs.join(outputs.select("document_id"), "document_id", "left_anti")


def require_parsed(responses: DataFrame) -> DataFrame:
    """``responses`` (document_id, failed: array of ids), which raise when read where their id is among the failed."""
    message = F.concat(F.lit("parser failed on "), F.col("document_id"))
    return responses.where(F.when(F.array_contains("failed", F.col("document_id")), F.raise_error(message).cast("boolean")).otherwise(True))


def own_result(results: Column, document_id: Column) -> Column:
    """The result with this id, else the first, of an array of structs with document_id."""
    return F.coalesce(F.try_element_at(F.filter(results, lambda r: r["document_id"] == document_id), F.lit(1)), F.try_element_at(results, F.lit(1)))


def eval_queries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVAL_QUERIES).option("multiLine", "true").json(path)
