"""Scores, bands and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank_split

#: What a match in an element of a type is worth.
STRUCTURE = {"title": 3.0, "heading": 2.5, "section": 2.0, "paragraph": 1.0, "cell": 1.0, "caption": 0.8, "footnote": 0.75}


def clamp(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def band(confidence: Column) -> Column:
    return F.when(confidence >= 0.75, "HIGH").when(confidence >= 0.50, "MEDIUM").otherwise("LOW")


def confidence(score: Column, coverage: Column) -> Column:
    return clamp(score * 0.6 + coverage * 0.4)


def structural(query_tokens: Column, text_tokens: Column, element_type: Column, depth: Column) -> Column:
    """Distinct shared tokens, times the element's weight, less a tenth for each level below the first."""
    weight = F.coalesce(*(F.when(element_type == k, v) for k, v in STRUCTURE.items()), F.lit(1.0))
    return F.size(F.array_intersect(query_tokens, text_tokens)) * weight / (1 + 0.1 * F.greatest(depth - 1, F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Of the distinct white-space pieces in lower case; 0 where both are empty."""
    one, two = blank_split(F.lower(a)), blank_split(F.lower(b))
    return F.coalesce(F.size(F.array_intersect(one, two)) / F.nullif(F.size(F.array_union(one, two)), F.lit(0)), F.lit(0.0))


def covered(wanted: Column, text: Column) -> Column:
    """Share of ``wanted`` that ``text`` contains whatever the case; 1 where nothing is wanted."""
    found = F.size(F.filter(wanted, lambda e: F.contains(F.lower(text), F.lower(e))))
    return F.when(F.size(wanted) == 0, 1.0).otherwise(found / F.size(wanted))


def word_coverage(query: Column, answer: Column) -> Column:
    asked = F.array_distinct(blank_split(F.lower(query)))
    return F.size(F.array_intersect(asked, blank_split(F.lower(answer)))) / F.greatest(F.size(asked), F.lit(1))


def scope_hash(document_ids: Column) -> Column:
    """Of the sorted ids; empty for no scope."""
    ids = F.array_join(F.array_sort(document_ids), ",")
    return F.when(F.coalesce(F.size(document_ids), F.lit(0)) <= 0, "").otherwise(F.sha2(ids, 256))


def cache_key(query: Column, document_ids: Column) -> Column:
    return F.concat(F.lit("query:"), F.sha2(F.concat(F.lower(F.trim(query)), scope_hash(document_ids)), 256))
