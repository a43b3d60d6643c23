"""Files as a Spark data source: ``spark.read.format("office").load(folder)``, one input partition a file.

    datasource.register(spark)
    spark.read.format("office").option("suffixes", "xlsx,csv").option("damaged", "record").load("s3://bucket/reports")

Options: ``path``; ``suffixes``, comma-separated (by default all that are parsed here); ``recursive`` (true); ``damaged``:
``fail`` (the default), ``skip``, or ``record``, which gives a damaged file one row that has its error and no text.
Files are found and read by Arrow's file systems; for a store that Spark alone reads, :func:`router.read_chunks` does.
"""

from __future__ import annotations

import csv
import hashlib
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import cells, office
from .router import route

PARSERS = {"csv": cells.parse_csv, **office.PARSERS}
DAMAGED = (zipfile.BadZipFile, ElementTree.ParseError, csv.Error, KeyError)
ROWS = 5_000


@dataclass
class File(InputPartition):
    """A file to parse: its place for Arrow and for Spark."""

    uri: str
    path: str
    suffix: str


def _find(path: str) -> tuple[fs.FileSystem, str, str]:
    """The file system of ``path``, the place in it, and what Spark writes before a place."""
    system, place = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    head = "file:" if isinstance(system, fs.LocalFileSystem) else path.split("://")[0] + "://"
    return system, place, head


class OfficeReader(DataSourceReader):
    def __init__(self, options: dict[str, str], names: list[str]):
        self.names = names
        self.path = options.get("path") or ""
        if not self.path:
            raise ValueError("a path is needed")
        self.suffixes = [s.strip().lower() for s in options.get("suffixes", ",".join(PARSERS)).split(",")]
        if odd := [s for s in self.suffixes if route(f"x.{s}") not in PARSERS]:
            raise ValueError(f"unsupported suffix {odd[0]!r}")
        self.recursive = options.get("recursive", "true").lower() == "true"
        self.damaged = options.get("damaged", "fail")
        if self.damaged not in ("fail", "skip", "record"):
            raise ValueError("damaged must be fail, skip or record")

    def partitions(self) -> list[File]:
        system, place, head = _find(self.path)
        info = system.get_file_info(place)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(place, recursive=self.recursive))
        files = sorted((x.path, x.path.rsplit(".", 1)[-1].lower()) for x in found if x.type == fs.FileType.File and "." in x.base_name)
        return [File(head + p if head != "file:" else p, head + p, s) for p, s in files if s in self.suffixes]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        system, place, _ = _find(partition.uri)
        document_id = hashlib.sha256(partition.path.encode()).hexdigest()
        with system.open_input_stream(place) as f:
            content = f.read()
        rows: list[tuple] = []
        try:
            for row in PARSERS[partition.suffix](content, document_id):
                rows.append((*row, partition.path, None))
                if len(rows) == ROWS and self.damaged == "fail":  # a damaged file is known at its end alone
                    yield self._batch(rows)
                    rows = []
        except DAMAGED as e:
            if self.damaged == "fail":
                raise
            rows = [] if self.damaged == "skip" else [(None, document_id, partition.suffix, *(None,) * 6, partition.path, f"{type(e).__name__}: {e}")]
        for start in range(0, len(rows), ROWS):
            yield self._batch(rows[start : start + ROWS])

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(),) * 5 + (pa.int32(), pa.list_(pa.string()), pa.string(), pa.int32(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], self.names)


class OfficeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "office"

    def schema(self) -> str:
        return f"{cells.SCHEMA}, path string, error string"

    def reader(self, schema) -> OfficeReader:
        return OfficeReader(dict(self.options), schema.names)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(OfficeSource)
