"""Shared helpers: tables cut from their lineage, word patterns and Arrow plumbing."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but the six ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"
ASCII_SPACE = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Where none is set, a session in one process gets a temporary one; on a cluster that is an error, since
    every executor would write to a disk of its own.
    """
    sc = spark.sparkContext
    place = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not place:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        place = "file://" + folder
        sc.setCheckpointDir(place)
    return place.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    The lineage ends here, a lost executor costs no earlier work, and a table that is used
    twice is computed once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _held:
        _held[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Tables written since each call of outcome that is under way.
_held: list[list[str]] = []


def outcome(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` returns, written; the tables that it cut on the way are deleted then."""
    _held.append([])
    try:
        result = make()
        tables = _held[-1]
    finally:
        _held.pop()
    written = cut(result, name)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in tables:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
    return written


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def without(text: Column, characters: str) -> Column:
    """``text`` without these characters: a byte search for each, cheaper than a pattern."""
    for c in characters:
        text = F.replace(text, F.lit(c))
    return text


def _plain(text: Column) -> Column:
    """Whether single spaces and line ends alone separate the words, with none at either end."""
    odd = [text.contains(x) for x in ("  ", " \n", "\n ", "\n\n", "\t", "\x0b", "\x0c", "\r")]
    for x in (" ", "\n"):
        odd += [text.startswith(x), text.endswith(x)]
    any_odd = odd[0]
    for x in odd[1:]:
        any_odd = any_odd | x
    return ~any_odd & (F.octet_length(text) > 0)


def word_count(text: Column) -> Column:
    """Words in ``text``, none in null; counting separators where they are plain, matching words otherwise."""
    count = F.when(_plain(text), F.octet_length(text) - F.octet_length(without(text, " \n")) + 1).otherwise(F.regexp_count(text, F.lit(WORD)))
    return F.coalesce(count, F.lit(0)).cast("long")


def words(text: Column) -> Column:
    """The words of ``text`` in order, none for null."""
    some = F.coalesce(text, F.lit(""))
    return F.when(_plain(some), F.split(F.replace(some, F.lit("\n"), F.lit(" ")), " ")).otherwise(F.regexp_extract_all(some, F.lit(WORD), F.lit(0)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` as a bound variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Rows of one Arrow batch at most, in the JVM and in a worker: texts may be long.
BATCH_ROWS = 1000


def settle(spark: SparkSession) -> None:
    """Session settings that the operators rely on.

    Arrow batches stay small.  A union does not claim its children's partitioning: under adaptive
    execution the children's partitions may be coalesced unlike, and then rows are paired wrongly.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def arrow_map(df: DataFrame, each: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, rows: int = BATCH_ROWS) -> DataFrame:
    """``mapInArrow`` in slices of at most ``rows`` rows, so that long texts do not add up in a worker."""
    settle(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                yield each(batch.slice(start, rows))

    return df.mapInArrow(run, schema)
