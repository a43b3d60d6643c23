"""Files as they arrive, delivered again when they fail, and cache entries that expire: extensions over the batch tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.store import save_chunks, written
from ..sources import cells, office
from ..sources.router import route

#: Deliveries of a file at most, then it is a dead letter; seconds that dead letters and others are kept.
RECEIVES, DEAD_SECONDS, PENDING_SECONDS = 3, 14 * 86_400, 3_600
_LOG = "path string, document_id string, error string, at timestamp, delivery string"
_DEAD = "path string, document_id string, error string, receives long, at timestamp, delivery string"


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def receives(spark: SparkSession, target: str) -> DataFrame:
    """(path, document_id, receives, done, error, at) of all files that failed at least once."""
    log = _table(spark, f"{target.rstrip('/')}.receives", _LOG)
    one = log.groupBy("path", "document_id").agg(F.count_distinct("delivery").alias("receives"), F.max(F.col("error").isNull()).alias("done"), F.max_by("error", "at").alias("error"), F.max("at").alias("at"))
    return one


def dead_letters(spark: SparkSession, target: str) -> DataFrame:
    return _table(spark, f"{target.rstrip('/')}.dead", _DEAD).drop("delivery")


def pending(spark: SparkSession, target: str, most: int = RECEIVES) -> DataFrame:
    """The files that failed and are to be delivered again."""
    return receives(spark, target).where(~F.col("done") & (F.col("receives") < most))


def _put(df: DataFrame, path: str, delivery: str) -> None:
    """``df`` as the rows of one delivery; the same delivery done again replaces them."""
    df.withColumn("delivery", F.lit(delivery)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("delivery").parquet(path)


def deliver(files: DataFrame, suffix: str, target: str, delivery: str, gone: DataFrame | None = None, most: int = RECEIVES) -> None:
    """Parse files (path, document_id, content), save their chunks, and log those that failed.

    In a delivery of files that failed before, ``gone`` (path, document_id) are those that are no more; they fail
    again, and files that are read now are logged as done.

    A file whose failed deliveries reach ``most`` goes to the dead letters.  Files that never failed are not logged,
    so log and state grow with failures alone.
    """
    spark, base = files.sparkSession, target.rstrip("/")
    fmt = route(f"x.{suffix}")
    rows = written(cells.recorded(files, cells.parse_csv if fmt == "csv" else office.PARSERS[fmt]), "delivered")
    chunks = rows.where("chunk_id is not null").drop("error")
    if not chunks.isEmpty():
        save_chunks(chunks, target)
    marks = rows.where("chunk_id is null").select("document_id", "error")
    seen = files.select("path", "document_id").join(marks, "document_id").select("path", "document_id", "error")
    seen = seen.where("error is not null") if gone is None else seen.union(gone.select("path", "document_id", F.lit("the file is gone")))
    told = written(seen.withColumn("at", F.current_timestamp()), "told")
    if told.isEmpty():
        return
    _put(told, f"{base}.receives", delivery)
    failed = told.where("error is not null").select("document_id")
    dead = receives(spark, target).join(failed, "document_id", "left_semi").where(~F.col("done") & (F.col("receives") >= most))
    _put(dead.select("path", "document_id", "error", "receives", "at"), f"{base}.dead", delivery)


def ingest_arriving(spark: SparkSession, source: str, suffix: str, target: str, checkpoint: str, files_per_batch: int = 100, most: int = RECEIVES) -> StreamingQuery:
    """Parse files with ``suffix`` that arrive under ``source`` and save their chunks.

    The stream takes a file once; one that does not parse does not stop the rest, and :func:`redeliver` takes it again.
    """
    arriving = spark.readStream.format("binaryFile").option("pathGlobFilter", f"*.{suffix}").option("maxFilesPerTrigger", files_per_batch).schema("path string, modificationTime timestamp, length long, content binary").load(source)
    files = arriving.select("path", F.sha2("path", 256).alias("document_id"), "content")
    write = lambda batch, n: deliver(batch, suffix, target, f"batch-{n}", most=most)
    return files.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def redeliver(spark: SparkSession, suffix: str, target: str, files: int = 100, most: int = RECEIVES) -> int:
    """Deliver up to ``files`` of the files that failed once more, those that waited longest; how many there were."""
    due = pending(spark, target, most).orderBy("at", "path").limit(files).select("path", "document_id").collect()
    if not due:
        return 0
    there = set(_existing(spark, [r.path for r in due]))
    lost = spark.createDataFrame([r for r in due if r.path not in there], "path string, document_id string")
    if there:
        asked = spark.createDataFrame([r for r in due if r.path in there], "path string, document_id string")
        contents = asked.join(spark.read.format("binaryFile").load(sorted(there)).select("path", "content"), "path")
    else:
        contents = lost.limit(0).withColumn("content", F.lit(None).cast("binary"))
    deliver(contents, suffix, target, f"again-{uuid.uuid4().hex}", lost, most)
    return len(due)


def _existing(spark: SparkSession, paths: list[str]) -> list[str]:
    conf, path = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    return [p for p in paths if path(p).getFileSystem(conf).exists(path(p))]


def drain(spark: SparkSession, source: str, suffix: str, target: str, checkpoint: str, files_per_batch: int = 100, most: int = RECEIVES) -> None:
    """Take all that has arrived, then deliver what failed until it is saved or a dead letter."""
    ingest_arriving(spark, source, suffix, target, checkpoint, files_per_batch, most).awaitTermination()
    while redeliver(spark, suffix, target, files_per_batch, most):
        pass


def purge(spark: SparkSession, target: str, now: str, dead_seconds: int = DEAD_SECONDS, pending_seconds: int = PENDING_SECONDS) -> None:
    """Drop dead letters, and logged receives of files that are neither dead nor pending, that are older than their time at ``now``."""
    base, at = target.rstrip("/"), F.lit(now).cast("timestamp")
    older = lambda seconds: F.col("at") < at - F.make_interval(secs=F.lit(seconds))
    dead = written(_table(spark, f"{base}.dead", _DEAD).where(~older(dead_seconds)), "dead")
    waiting = pending(spark, target).select("path")
    log = _table(spark, f"{base}.receives", _LOG)
    young = log.where(~older(pending_seconds))
    held = written(young.unionByName(log.where(older(pending_seconds)).join(waiting.unionByName(dead.select("path")).distinct(), "path", "left_semi")), "receives")
    for name, kept in (("dead", dead), ("receives", held)):
        kept.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("delivery").parquet(f"{base}.{name}")


def expiring(entries: DataFrame, ttl_seconds: int = 86_400, late: str = "0 seconds") -> DataFrame:
    """The life of cache entries (cache_key, payload, created_at) of a stream: (cache_key, payload, live).

    A key's newest entry is given as live when it comes, and once more, not live, when the watermark has passed its time
    of ``ttl_seconds``; an entry that replaces it starts the time anew, an older one that comes late changes nothing.
    """
    millis = ttl_seconds * 1000

    def each(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            payload, _ = state.get
            state.remove()
            yield pd.DataFrame({"cache_key": [key[0]], "payload": [payload], "live": [False]})
            return
        rows = pd.concat(list(batches)).sort_values(["created_at", "payload"])
        newest, at = rows.payload.iloc[-1], int(rows.created_at.iloc[-1].timestamp() * 1000)
        if state.exists and state.get[1] > at:
            return
        state.update((newest, at))
        state.setTimeoutTimestamp(max(at + millis, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"cache_key": [key[0]], "payload": [newest], "live": [True]})

    marked = entries.withWatermark("created_at", late).groupBy("cache_key")
    return marked.applyInPandasWithState(each, "cache_key string, payload string, live boolean", "payload string, at long", "update", GroupStateTimeout.EventTimeTimeout)
