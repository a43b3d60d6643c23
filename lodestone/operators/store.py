"""Tables on disk: documents with their chunks, vectors, caches, results."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schemas
from ..functions.vectors import hash_embedding

#: Documents to a bucket, about, where the table's first writer does not say how many buckets there are.
BUCKET_DOCUMENTS = 50_000
TABLES: dict[str, StructType] = {"chunks": schemas.CHUNKS, "concepts": schemas.CONCEPTS, "properties": schemas.PROPERTIES, "relations": schemas.RELATIONS, "cache": schemas.CACHE}


def conformed(df: DataFrame, schema: StructType) -> DataFrame:
    """``df`` with the columns of ``schema``: missing ones null, or empty or a default where null is not allowed."""
    empty = {"array": F.array(), "double": F.lit(0.0), "string": F.lit(""), "integer": F.lit(0)}
    def column(f):
        own = F.col(f.name) if f.name in df.columns else F.lit(None)
        kind = f.dataType.typeName()
        own = own.cast(f.dataType)
        return (own if f.nullable else F.coalesce(own, empty[kind].cast(f.dataType))).alias(f.name)
    return df.select(*map(column, schema.fields))


def decoded(rows: DataFrame, prefix: str = "CHUNK#") -> DataFrame:
    """Chunks of a key-value store's rows: strings in JSON become arrays, maps and boxes, numbers in text numbers.

    ``rows`` has ``sort_key`` and the chunk columns as strings, as far as there are any; only rows whose key starts with
    ``prefix`` are chunks.  What is missing or unreadable is null, or the default where null is not allowed; a missing weight is 1.
    """
    own = rows.where(F.startswith("sort_key", F.lit(prefix)))
    for f in schemas.CHUNKS.fields:
        if f.name in own.columns and own.schema[f.name].dataType.typeName() == "string":
            if f.dataType.typeName() in ("array", "map", "struct"):
                own = own.withColumn(f.name, F.from_json(f.name, f.dataType))
            elif f.dataType.typeName() != "string":
                own = own.withColumn(f.name, F.col(f.name).try_cast(f.dataType))
    weight = F.col("structural_weight") if "structural_weight" in own.columns else F.lit(None).cast("double")
    return conformed(own.withColumn("structural_weight", F.coalesce(weight, F.lit(1.0))), schemas.CHUNKS)


def as_json(df: DataFrame) -> DataFrame:
    """(json): each row as a JSON object without its nulls, nested columns included."""
    return df.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))).alias("json"))


def initialize(spark: SparkSession, database: str) -> None:
    """Create what is missing."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, schema in TABLES.items():
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); a temporary one only in a session of one process."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        place = "file://" + folder
        spark.sparkContext.setCheckpointDir(place)
    return place.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, however often it is used, and cut from its lineage."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def buckets_of(spark: SparkSession, path: str, new: DataFrame, key: str = "document_id") -> int:
    """How many buckets the table has; for a first writer what its keys ask for, 16 at least, a power of two."""
    try:
        return int(spark.read.text(f"{path.rstrip('/')}.buckets").first()[0])
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    n = 16
    keys = new.select(key).distinct().count()
    while n * BUCKET_DOCUMENTS < keys:
        n *= 2
    spark.createDataFrame([(str(n),)], "value string").coalesce(1).write.text(f"{path.rstrip('/')}.buckets")
    return n


def upsert(rows: DataFrame, path: str, key: str, buckets: int | None = None, order: tuple[str, ...] = ()) -> None:
    """Put ``rows`` in the table at ``path`` in place of all that have the same ``key``; others stay.

    Keys are dealt to hashed buckets, one folder each; only the buckets concerned are rewritten, so writing twice
    equals once.  A table's first writer fixes their number (``buckets``, or from its keys): it should expect the
    table's final size.  Rows lie in ``order`` within a bucket, so that a filter on it skips parts of files.  ``rows`` is
    computed once, to be staged beside the table; keys and buckets are then read from there.
    """
    spark, base = rows.sparkSession, path.rstrip("/")
    if buckets:
        spark.createDataFrame([(str(buckets),)], "value string").coalesce(1).write.mode("ignore").text(f"{base}.buckets")
    rows.write.mode("overwrite").parquet(f"{base}.staged")
    new = spark.read.schema(rows.schema).parquet(f"{base}.staged")
    n = buckets_of(spark, path, new, key)
    new = new.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))
    try:
        old = spark.read.schema(new.schema).parquet(path)
        touched = new.select("bucket").distinct()
        rest = old.join(F.broadcast(touched), "bucket", "left_semi").join(new.select(key).distinct(), key, "left_anti")  # a row a bucket
        rest.select(*new.columns).write.mode("overwrite").parquet(f"{base}.kept")
        new = new.unionByName(spark.read.schema(new.schema).parquet(f"{base}.kept"))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    new.repartition("bucket").sortWithinPartitions("bucket", *order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def save_chunks(chunks: DataFrame, path: str, buckets: int | None = None) -> None:
    """Replace the documents in ``chunks`` and leave all others: see :func:`upsert`."""
    upsert(conformed(chunks, schemas.CHUNKS), path, "document_id", buckets)


#: Fixed value: the namespace of object identifiers, in which point ids are named.
NAMESPACE = "6ba7b8129dad11d180b400c04fd430c8"


def uuid5(name: Column, namespace: str = NAMESPACE) -> Column:
    """The UUID of version 5 of ``name`` in ``namespace`` (32 hex digits)."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    part = lambda start, n: F.substring(h, start, n)
    variant = F.translate(part(17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


#: The vector columns and their dimensions, each of which has a table of points.
DIMENSIONS = {"embedding_fast": 384, "embedding_full": 1024}


def save_points(chunks: DataFrame, path: str) -> None:
    """Put the chunks' vectors into the table of their dimension (``path``/384, ``path``/1024), by point id.

    A point has point_id (version 5, from the chunk's id), chunk_id, document_id, page_number and vector.  A chunk without a
    vector has no point there; a vector of another length than its column's raises.  Chunks saved again replace their points.
    """
    for column, dimension in DIMENSIONS.items():
        size = F.size(column)
        wrong = F.raise_error(F.format_string(f"{column} of %s has %d places, not {dimension}", "chunk_id", size))
        own = chunks.where(F.col(column).isNotNull()).select(uuid5(F.col("chunk_id")).alias("point_id"), "chunk_id", "document_id", "page_number", F.when(size == dimension, F.col(column).cast("array<float>")).otherwise(wrong).alias("vector"))
        upsert(own, f"{path.rstrip('/')}/{dimension}", "point_id", order=("document_id", "page_number"))


def points(spark: SparkSession, path: str, dimension: int) -> DataFrame:
    """All points of a dimension."""
    return spark.read.parquet(f"{path.rstrip('/')}/{dimension}").drop("bucket")


def replaced(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame]) -> None:
    """Overwrite the chunk table with ``change`` of all its chunks, whole or not at all.

    The new table is written beside the old one, then two renames exchange them; :func:`recovered` finishes or undoes
    an exchange that was cut off.
    """
    base = path.rstrip("/")
    recovered(spark, base)
    n = int(spark.read.text(f"{base}.buckets").first()[0])
    new = conformed(change(load_chunks(spark, base)), schemas.CHUNKS).withColumn("bucket", F.pmod(F.xxhash64("document_id"), F.lit(n)).cast("int"))
    new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{base}.next")
    _rename(spark, base, f"{base}.before")
    _rename(spark, f"{base}.next", base)
    _delete(spark, f"{base}.before")


def recovered(spark: SparkSession, path: str) -> str:
    """The table at ``path`` after an exchange that may have been cut off: "whole", "finished" or "undone"."""
    base = path.rstrip("/")
    there, before, done = _exists(spark, base), _exists(spark, f"{base}.before"), _exists(spark, f"{base}.next/_SUCCESS")
    if there:
        if before:
            _delete(spark, f"{base}.before")
        return "whole"
    if before and done:
        _rename(spark, f"{base}.next", base)
        _delete(spark, f"{base}.before")
        return "finished"
    if before:
        _rename(spark, f"{base}.before", base)
        return "undone"
    return "whole"


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _exists(spark: SparkSession, path: str) -> bool:
    system, place = _place(spark, path)
    return system.exists(place)


def _rename(spark: SparkSession, path: str, to: str) -> None:
    system, place = _place(spark, path)
    if not system.rename(place, _place(spark, to)[1]):
        raise OSError(f"cannot rename {path} to {to}")


def _delete(spark: SparkSession, path: str) -> None:
    system, place = _place(spark, path)
    system.delete(place, True)


def load_chunks(spark: SparkSession, path: str, document_ids: list[str] | None = None) -> DataFrame:
    """All chunks, or those of some documents; the filter reaches the scan."""
    chunks = spark.read.parquet(path).drop("bucket")
    return chunks.where(F.col("document_id").isin(document_ids)) if document_ids else chunks


def get_document(spark: SparkSession, path: str, document_id: str) -> DataFrame:
    """One row with the document's chunks in order, or none."""
    own = load_chunks(spark, path, [document_id])
    return own.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "chunk_id", "text", "page_number"))).alias("chunks"))


def with_embeddings(chunks: DataFrame, fast: Callable | None = None, full: Callable | None = None) -> DataFrame:
    """Both vector columns, by functions from a text column to a vector; by default hashes of 384 and 1024 places."""
    fast, full = fast or (lambda t: hash_embedding(t, 384)), full or (lambda t: hash_embedding(t, 1024, normalize=False))
    text = F.left(F.col("text"), F.lit(30_000))
    return chunks.withColumn("embedding_fast", fast(text).cast("array<float>")).withColumn("embedding_full", full(text).cast("array<float>"))


def reembedded(chunks: DataFrame, full: Callable) -> DataFrame:
    """Full vectors anew; where the function gives null the old vector stays."""
    return chunks.withColumn("embedding_full", F.coalesce(full(F.col("text")).cast("array<float>"), F.col("embedding_full")))


def write_json(df: DataFrame, path: str) -> None:
    """Rows as JSON; null fields are left out."""
    df.write.mode("overwrite").json(path)
