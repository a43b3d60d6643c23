"""Documents to chunks: paragraphs, and the merging and splitting that evens out their sizes."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions.text import word_count

SENTENCE_END = re.compile(r"(?<=[.!?])\s+")


def paragraph_chunks(documents: DataFrame, page_lines: int = 10) -> DataFrame:
    """A chunk for each line with text: the first is the title, others of up to five words are headings.

    Columns: document_id, ordinal, chunk_id (``<doc>:p<ordinal>``), source_format, text, element_type,
    page_number (``page_lines`` lines to a page), section_path.
    """
    lines = documents.select(F.col("doc_id").cast("string").alias("document_id"), F.col("source").alias("source_format"), F.posexplode(F.split("text", "\n")).alias("ordinal", "line"))
    kind = F.when(F.col("ordinal") == 0, "title").when(word_count(F.col("text")) <= 5, "heading").otherwise("paragraph")
    return (
        lines.withColumn("text", F.trim("line"))
        .where("text != ''")
        .select(
            "document_id",
            "ordinal",
            F.concat("document_id", F.lit(":p"), F.col("ordinal").cast("string")).alias("chunk_id"),
            "source_format",
            "text",
            kind.alias("element_type"),
            (F.floor(F.col("ordinal") / page_lines) + 1).cast("int").alias("page_number"),
            F.when(F.col("ordinal") == 0, F.array(F.lit("title"))).otherwise(F.array(F.lit("title"), F.lit("body"))).alias("section_path"),
        )
    )


def section_paths(paragraphs: DataFrame) -> DataFrame:
    """``section_path`` of paragraphs (document_id, ordinal, level, text): the headings that are open there.

    ``level`` is a heading's level, null for other text.  A heading closes those of its level and below;
    it stands in its own path.  One document's paragraphs are folded at a time, each in the time of its path.
    """
    typed = paragraphs.select("document_id", F.col("ordinal").cast("int").alias("ordinal"), F.col("level").cast("int").alias("level"), "text")
    paths = pa.list_(pa.string())

    def folded(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("ordinal", "ascending"), ("level", "ascending"), ("text", "ascending")])
        open_: list[tuple[int, str]] = []
        out = []
        for level, text in zip(rows.column("level").to_pylist(), rows.column("text").to_pylist(), strict=True):
            if level is not None:
                while open_ and open_[-1][0] >= level:
                    open_.pop()
                open_.append((level, text))
            out.append([t for _, t in open_])
        return rows.append_column("section_path", pa.array(out, paths))

    kind = dict(typed.dtypes)["document_id"]
    return typed.groupBy("document_id").applyInArrow(folded, f"document_id {kind}, ordinal int, level int, text string, section_path array<string>")


def split_text(text: str, most: int) -> list[str]:
    """Sentences packed to at most ``most`` words each, in order; a longer sentence stays whole."""
    out, current, size = [], "", 0
    for sentence in SENTENCE_END.split(text):
        n = len(sentence.split())
        if current and size + n > most:
            out.append(current.strip())
            current, size = sentence, n
        else:
            current, size = f"{current} {sentence}".strip(), size + n
    return out + [current.strip()] if current else out


def merged_and_split(rows: list[tuple[str, str, str]], least: int, most: int) -> list[tuple[str, str, str, int]]:
    """(id, text, type) in order to even sizes: long texts split by sentences, short ones joined to what follows."""
    parts = []
    for chunk_id, text, kind in rows:
        pieces = split_text(text, most) if len(text.split()) > most else None
        parts += [(chunk_id, text, kind)] if pieces is None else [(f"{chunk_id}:s{k}", p, kind) for k, p in enumerate(pieces)]
    out: list[tuple[str, str, str, int]] = []
    held: list[str] = []
    words = 0
    for chunk_id, text, kind in parts:
        if held and words >= least:
            out.append((first, " ".join(held), own if len(held) == 1 else "paragraph", words))
            held, words = [], 0
        if not held:
            first, own = chunk_id, kind
        held.append(text)
        words += len(text.split())
    if held:
        out.append((first, " ".join(held), own if len(held) == 1 else "paragraph", words))
    return out


#: Columns that a resized chunk takes from its first part, where the chunks have them.
OF_FIRST = ("source_format", "page_number", "section_path", "bounding_box", "location_reference")


#: Documents of a batch that are taken apart at once: a batch has thousands.
PART = 50


def resize_chunks(chunks: DataFrame, least: int = 100, most: int = 500) -> DataFrame:
    """Chunks of each document in order, split above ``most`` words and merged while under ``least``.

    A merged chunk keeps its first part's id, format, page, section and box, and is a paragraph; a short last
    one stays.  One document is in memory at a time.
    """
    own = [f for f in chunks.schema if f.name in OF_FIRST]
    schema = StructType([StructField(n, t) for n, t in (("document_id", StringType()), ("ordinal", IntegerType()), ("chunk_id", StringType()), ("text", StringType()), ("element_type", StringType()), ("n_words", IntegerType()))] + [StructField(f.name, f.dataType) for f in own])
    grouped = chunks.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "chunk_id", "text", "element_type", F.struct(*(f.name for f in own)).alias("own") if own else F.lit(None).alias("own")))).alias("rows"))

    return grouped.mapInArrow(_resizer(least, most, schema), schema)


def _resizer(least: int, most: int, schema: StructType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What a task does with documents (document_id, rows), of which some PART are Python objects at a time."""
    kinds = [to_arrow_type(f.dataType) for f in schema]
    own = schema.names[6:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, PART):
                batch = whole.slice(start, PART)
                out: list[tuple] = []
                for doc, rows in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    rows = rows.as_py()
                    first = {r["chunk_id"]: r["own"] or {} for r in rows}
                    for k, made in enumerate(merged_and_split([(r["chunk_id"], r["text"], r["element_type"]) for r in rows], least, most)):
                        kept = first.get(made[0]) or first.get(made[0].rpartition(":s")[0]) or {}
                        out.append((doc, k, *made, *(kept.get(n) for n in own)))
                columns = list(zip(*out, strict=True)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=schema.names)

    return run


def assembled(chunks: DataFrame) -> DataFrame:
    """Documents with their chunks in order."""
    return chunks.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "chunk_id", "text"))).alias("chunks"))
