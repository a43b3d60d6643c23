"""From ranked chunks to answers: compression, the coverage gate, citations, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import band, confidence, covered, word_coverage
from ..functions.text import blank_split, cut_at_word, paragraphs, query_entities, without_fence

CONTEXT_CHARS = 4000
NOT_FOUND = "NOT_FOUND"
CITATION = "struct<chunk_id:string,document_id:string,source_format:string,bounding_box:struct<x1:double,y1:double,x2:double,y2:double,page_number:int>,location_reference:string,text_snippet:string>"


def snippet(query: Column, text: Column) -> Column:
    """The paragraphs with a query word of over three characters, or the first one."""
    asked = F.array_distinct(F.transform(F.filter(blank_split(query), lambda w: F.length(w) > 3), lambda w: F.lower(w)))
    own = paragraphs(text)
    hits = F.filter(own, lambda p: F.exists(asked, lambda w: F.contains(F.lower(p), w)))
    return F.array_join(F.when(F.size(hits) > 0, hits).otherwise(F.slice(own, 1, 1)), " ... ")


def compress(ranked: DataFrame, order: str = "rerank_rank", budget: int = CONTEXT_CHARS, numbered: bool = True) -> DataFrame:
    """(query_id, context): snippets of the ranked chunks within a budget of characters.

    A snippet that exceeds what is left is cut at a word; an entry costs its length and two; nothing
    follows once the budget is used.  One query's few chunks are folded in order.
    """
    name = F.concat(F.lit("["), F.col(order).cast("string"), F.lit("] ")) if numbered else F.concat(F.lit("["), F.col("chunk_id"), F.lit("] "))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), name.alias("name"), snippet(F.col("query"), F.col("text")).alias("snippet"))))

    def step(s: Column, x: Column) -> Column:
        left = F.lit(budget) - s["used"]
        entry = F.concat(x["name"], F.when(F.length(x["snippet"]) > left, cut_at_word(x["snippet"], left)).otherwise(x["snippet"]))
        more = F.struct((s["used"] + F.length(entry) + 2).alias("used"), F.concat(s["parts"], F.array(entry)).alias("parts"))
        return F.when(s["used"] >= budget, s).otherwise(more)

    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("parts"))
    return ranked.groupBy("query_id").agg(F.aggregate(ordered, start, step, lambda s: F.array_join(s["parts"], "\n\n")).alias("context"))


def compress_or_raw(ranked: DataFrame, order: str = "rerank_rank") -> DataFrame:
    """(query_id, context): the paragraphs of the ranked chunks that hold a query word, or stand alone, without a budget.

    Chunks without one are left out.  Where that leaves nothing, or loses an entity of the query, the
    context is the chunks' whole texts.
    """
    asked = F.transform(F.filter(blank_split(F.col("query")), lambda w: F.length(w) > 3), lambda w: F.lower(w))
    own = paragraphs(F.col("text"))
    hits = F.filter(own, lambda p: (F.size(own) == 1) | F.exists(asked, lambda w: F.contains(F.lower(p), w)))
    each = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col("chunk_id").alias("name"), F.array_join(hits, " ... ").alias("kept"), "text")))
    shown = lambda rows, what: F.array_join(F.transform(rows, lambda x: F.concat(F.lit("["), x["name"], F.lit("] "), x[what])), "\n\n")
    made = ranked.groupBy("query_id").agg(F.first("query").alias("asked"), each.alias("own"))
    made = made.select("query_id", F.col("asked").alias("query"), shown(F.filter("own", lambda x: x["kept"] != ""), "kept").alias("kept"), shown(F.col("own"), "text").alias("raw"))
    lost = (F.col("kept") == "") | F.exists(query_entities(F.col("query")), lambda e: ~F.contains(F.lower("kept"), F.lower(e)))
    return made.select("query_id", F.when(lost, F.col("raw")).otherwise(F.col("kept")).alias("context"))


def coverage(query: Column, context: Column) -> Column:
    return covered(query_entities(query), context)


def location(fmt: Column, bbox: Column, reference: Column, element_type: Column, page: Column, text: Column) -> Column:
    """Struct of bounding_box and location_reference, one of which is never null.

    A PDF chunk without a box gets its whole page; others without a reference name heading, page or section.
    """
    whole = F.struct(F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), F.lit(1.0).alias("x2"), F.lit(1.0).alias("y2"), F.coalesce(page, F.lit(1)).alias("page_number"))
    named = F.when(element_type == "heading", F.concat(F.lit("Heading: "), F.left(text, F.lit(30)))).when(F.coalesce(page, F.lit(0)) > 0, F.concat(F.lit("Page: "), page.cast("string"))).otherwise(F.concat(F.lit("Section: "), element_type))
    return F.struct(
        F.when((fmt == "pdf") & bbox.isNull(), whole).otherwise(bbox).alias("bounding_box"),
        F.when((fmt != "pdf") & (F.coalesce(reference, F.lit("")) == ""), named).otherwise(reference).alias("location_reference"),
    )


def citation(fmt: Column, bbox: Column, reference: Column, element_type: Column, page: Column, text: Column) -> Column:
    place = location(fmt, bbox, reference, element_type, page, text)
    return F.struct(F.col("chunk_id"), F.col("document_id"), fmt.alias("source_format"), place["bounding_box"].alias("bounding_box"), place["location_reference"].alias("location_reference"), F.left(text, F.lit(200)).alias("text_snippet")).cast(CITATION)


def fast_answer(ranked: DataFrame, score: str, order: str, top: int = 3) -> DataFrame:
    """(query_id, answer, confidence, band) from the ``top`` chunks: the first 500 characters of their texts."""
    best = ranked.where(F.col(order) <= top).groupBy("query_id").agg(F.first("query").alias("query"), F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col("text")))).alias("own"), F.avg(score).alias("mean"))
    answer = F.left(F.array_join(F.transform("own", lambda x: x["text"]), " "), F.lit(500))
    sure = F.round(confidence(F.col("mean"), word_coverage(F.col("query"), F.col("answer"))), 4)
    return best.withColumn("answer", answer).select("query_id", "answer", sure.alias("confidence")).withColumn("band", band(F.col("confidence")))


def parse_output(raw: Column) -> Column:
    """A model's JSON as struct of answer and citations (integers); what is no JSON is NOT_FOUND without any.

    Only these fields are read, so a confidence that a model claims is never used.
    """
    bare = without_fence(raw)
    parsed = F.from_json(bare, "answer string, citations array<string>")
    numbers = F.filter(F.transform(F.coalesce(parsed["citations"], F.array().cast("array<string>")), lambda c: F.regexp_replace(c, r"[\[\]]", "").try_cast("int")), lambda c: c.isNotNull())
    ok = F.coalesce(parsed["answer"].isNotNull() & bare.startswith("{"), F.lit(False))
    return F.struct(F.when(ok, parsed["answer"]).otherwise(NOT_FOUND).alias("answer"), F.when(ok, numbers).otherwise(F.array().cast("array<int>")).alias("citations"))


def cited(answers: DataFrame, ranked: DataFrame, order: str = "rerank_rank") -> DataFrame:
    """(query_id, chunk_id, place): the chunks that answers (query_id, citations) cite by place, from 1; others are skipped."""
    asked = answers.select("query_id", F.posexplode("citations").alias("place", "number"))
    return asked.join(ranked.select("query_id", F.col(order).alias("number"), "chunk_id"), ["query_id", "number"]).select("query_id", "chunk_id", "place")


def extractive_answer(query: Column, context: Column) -> Column:
    """The offline answer: the context's first sentence with a query word, as a model would give it in JSON."""
    asked = F.transform(F.filter(blank_split(query), lambda w: F.length(w) > 3), lambda w: F.lower(w))
    found = F.filter(F.split(context, r"(?<=[.!?])\s+"), lambda s: F.exists(asked, lambda w: F.contains(F.lower(s), w)))
    return F.to_json(F.struct(F.coalesce(F.try_element_at(found, F.lit(1)), F.lit(NOT_FOUND)).alias("answer"), F.array(F.lit("1")).alias("citations")))
