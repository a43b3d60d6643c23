"""Files to chunk tables, by suffix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import cells, elements, office

#: Suffixes and their formats.
FORMATS = {"csv": "csv", "xlsx": "xlsx", "docx": "docx", "pptx": "pptx", "pdf": "pdf", "json": "pdf"}


def route(path: str) -> str:
    """The format of ``path``; ValueError for a suffix that has none."""
    suffix = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if suffix not in FORMATS or suffix == "pdf":
        raise ValueError(f"unsupported suffix {suffix!r}: PDF comes as its parser's JSON" if suffix == "pdf" else f"unsupported suffix {suffix!r}")
    return FORMATS[suffix]


def read_files(spark: SparkSession, path: str, suffix: str, recursive: bool = True) -> DataFrame:
    """path, document_id (a hash of the path) and content of the files with ``suffix`` under ``path``."""
    from pyspark.sql import functions as F

    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", f"*.{suffix}")
    return reader.load(path).select("path", F.sha2("path", 256).alias("document_id"), "content")


def read_chunks(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """Chunks of all files with ``suffix`` under ``path``."""
    fmt = route(f"x.{suffix}")
    if fmt == "pdf":
        return elements.normalized(elements.read_json(spark, path))
    files = read_files(spark, path, suffix)
    return cells.csv_chunks(files) if fmt == "csv" else office.chunks(files, fmt)
