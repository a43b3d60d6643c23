"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]+"
#: Words that are no entities, matched with their case.
STOP_WORDS = (
    "What Who How Why When Where Is Are Can Do Does Which Did Will Would Should Could The A An In On At To For With "
    "By About From As If It They We He She This That These Those There Here And Or But Of According Based Has Have Had Been Was Were Not No Any All Some Many Much More Most Less "
    "Least Few Fewer Between Among Through During Before After Above Below Under Over Since Until Explain Describe Tell List"
).split()
#: Words that the evaluation leaves out of expected answers.
EVAL_STOP_WORDS = "the a an is are was were and or in on at to for with by of it that this as".split()


def raw_tokens(text: Column) -> Column:
    """Runs of letters, digits and underscores, in order, with their case."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def tokens(text: Column) -> Column:
    return raw_tokens(F.lower(text))


def blank_split(text: Column) -> Column:
    """Pieces between runs of white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != "")


def word_count(text: Column) -> Column:
    return F.size(blank_split(text))


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?])\s+")


def entities(text: Column, stop_words: tuple[str, ...] | list[str] = STOP_WORDS) -> Column:
    """Capitalised words and numbers, each once, in order of first place."""
    found = F.filter(raw_tokens(text), lambda x: x.rlike("^([A-Z][a-z0-9]+|[0-9]+)$"))
    return F.array_except(found, F.array(*map(F.lit, stop_words))) if stop_words else F.array_distinct(found)


def query_entities(text: Column) -> Column:
    """Quoted strings and capitalised words but the first; without any, the words over five letters."""
    quoted = F.regexp_extract_all(text, F.lit('"([^"]*)"'), F.lit(1))
    pieces = blank_split(text)
    bare = lambda x: F.btrim(x, F.lit("?,.!"))
    capitals = F.transform(F.filter(F.slice(pieces, 2, F.greatest(F.size(pieces), F.lit(1))), lambda x: x.rlike(r"^\p{Lu}")), bare)
    found = F.array_distinct(F.concat(quoted, capitals))
    long = F.array_distinct(F.transform(F.filter(pieces, lambda x: F.length(x) > 5), bare))
    return F.when(F.size(found) > 0, found).otherwise(long)


def contains_any(text: Column, phrases: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(text, F.lit(p))
    return out


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")


def cut_at_word(text: Column, limit: Column | int) -> Column:
    """The first ``limit`` characters without the last, perhaps broken, word."""
    head = F.left(text, limit if isinstance(limit, Column) else F.lit(limit))
    return F.regexp_replace(head, " [^ ]*$", "")


def without_fence(text: Column) -> Column:
    """A model's output without the Markdown fence around it."""
    return F.regexp_replace(F.regexp_replace(text, r"^\s*(?:```(?:json)?)?\s*", ""), r"\s*(?:```)?\s*$", "")


def page_of_chunk(chunk_id: Column) -> Column:
    """The page in an id like ``doc:page:3:element:1``, or null."""
    return F.regexp_extract(chunk_id, r":page:(\d+)", 1).try_cast("int")


def canonical_links(text: Column, prefix: str) -> Column:
    """Markdown image links with their file under ``prefix``."""
    return F.regexp_replace(text, r"!\[([^\]]*)\]\((?:[^)\s]*/)?([^)/\s]+\.(?:png|jpe?g))\)", "![$1](" + prefix.replace("$", r"\$") + "$2)")
