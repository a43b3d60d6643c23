"""Line-first cleaning: rules judge lines, failing lines go, and documents that lose too much text go too.

All of it is one projection of built-in functions: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, WORD, let, without, word_count, words

SYMBOLS = "#*$%&|<>"
#: Phrases that mark a line as page boilerplate, matched in lower case.
BOILERPLATE = ("all rights reserved", "click here", "cookie policy", "enable javascript", "log in to", "lorem ipsum", "privacy policy", "read more", "share this", "sign up", "subscribe to", "terms of use")
#: Characters that may end a sentence, a quotation or a list's head.
ENDINGS = ".!?:;…\"'”’»)]"


SEPARATORS = "|>»›·•"


def line_verdict(line: Column, n: Column) -> Column:
    """The first rule that ``line`` with ``n`` words fails, or null.

    ``navigation``: a separator (| > » › · •) for every four words at least, or at most five words without an
    ending.  ``symbols``: over half as many symbols as words.  ``shouting``: three words or more all in
    capitals, or an exclamation run for every second word.  ``repetition``: 20 words or more of which under
    a quarter are distinct.  ``punctuation``: over five words, no ending and no sentence's end inside.  ``boilerplate``: a stock phrase
    in under 30 words.  A line without words fails none.
    """
    def lacks(characters: str) -> Column:
        return F.length(line) - F.length(without(line, characters))

    stock = F.lower(line).contains(BOILERPLATE[0])
    for phrase in BOILERPLATE[1:]:
        stock = stock | F.lower(line).contains(phrase)
    return (
        F.when(n == 0, F.lit(None).cast("string"))
        .when(lacks(SEPARATORS) * 4 >= n, "navigation")
        .when(lacks(SYMBOLS) * 2 > n, "symbols")
        .when(((n >= 3) & ~line.rlike(r"\p{Ll}") & line.rlike(r"\p{Lu}")) | ((F.octet_length(line) - F.octet_length(F.replace(line, F.lit("!!")))) > n), "shouting")
        .when((n >= 20) & (F.size(F.array_distinct(words(line))) * 4 < n), "repetition")
        .when(~F.right(F.rtrim(line), F.lit(1)).isin(*ENDINGS) & ~((n > 5) & line.rlike("[.!?] ")), F.when(n <= 5, "navigation").otherwise("punctuation"))
        .when((n < 30) & stock, "boilerplate")
    )


def judged_lines(text: Column) -> Column:
    """The lines of ``text`` as structs of ``line``, its number of words ``n`` and the rule it ``fails``."""
    counted = F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("line"), word_count(x).alias("n")))
    return F.transform(counted, lambda x: F.struct(x["line"].alias("line"), x["n"].alias("n"), line_verdict(x["line"], x["n"]).alias("fails")))


def repeat_words(tokens: Column) -> Column:
    """Words in 3-word windows that occur twice or more in ``tokens``, the first included.

    Windows are compared by 64-bit hashes.  Only where some hash repeats are (hash, position) pairs
    sorted and the positions of equal neighbours gathered; sorting keeps long texts at n log n.
    """
    def of(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)))
        return F.when(F.size(w) < 4, F.lit(0)).otherwise(let(hashes, repeated))

    def repeated(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs, covered))

    def covered(p: Column) -> Column:
        same = F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], a["i"] + 1, a["i"] + 2, b["i"], b["i"] + 1, b["i"] + 2)))
        return F.size(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull()))))

    return let(tokens, of).cast("long")


def verdict_on(text: Column, min_words: int = 50, max_repeat: int = 50, max_lost: float = 0.4) -> Column:
    """The struct that :func:`judge` adds, of a text."""
    text = F.coalesce(text, F.lit(""))

    def base(lines: Column) -> Column:
        real = F.filter(lines, lambda x: x["n"] > 0)
        good = F.filter(lines, lambda x: x["fails"].isNull())
        total = lambda some: F.aggregate(some, F.lit(0).cast("long"), lambda a, x: a + x["n"])
        return F.struct(
            total(lines).alias("n_words"),
            F.length(without(text, ASCII_SPACE)).cast("long").alias("word_chars"),
            (F.length(text) - F.length(without(text, SYMBOLS))).cast("long").alias("n_symbols"),
            (F.size(real) - F.size(F.array_distinct(real["line"]))).cast("long").alias("n_dup_lines"),
            repeat_words(words(text)).alias("n_repeat_words"),
            F.array_join(good["line"], "\n").alias("clean_text"),
            total(good).alias("n_clean_words"),
        )

    def verdict(q: Column) -> Column:
        failed = (q["n_words"] < min_words) | (q["n_repeat_words"] * 100 > q["n_words"] * max_repeat)
        own = [q[x].alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "clean_text", "n_clean_words")]
        return F.struct(*own, failed.alias("base_failed"), (~failed & (q["n_clean_words"] >= q["n_words"] * (1 - max_lost))).alias("kept"))

    return let(let(judged_lines(text), base), verdict)


def judge(docs: DataFrame, text_col: str = "text", **limits) -> DataFrame:
    """All rows and columns of ``docs`` plus a struct ``quality``.

    Its fields: ``n_words``, ``word_chars`` (code points in words), ``n_symbols``, ``n_dup_lines`` (lines with a
    word that equal an earlier one), ``n_repeat_words``, ``base_failed`` (under ``min_words`` (50) words, or over
    ``max_repeat`` (50) percent of them repeat), ``clean_text`` (without failing lines), ``n_clean_words`` and ``kept``
    (not ``base_failed``, and at most ``max_lost`` (0.4) of the words went with failing lines).
    A null or empty text has no words, so it fails; its ``clean_text`` is empty.  Rows are judged alone, so
    repeated rows get equal verdicts.  A column named ``quality`` in ``docs`` is replaced.
    """
    return docs.withColumn("quality", verdict_on(F.col(text_col), **limits))


def passing(docs: DataFrame, text_col: str = "text", **limits) -> DataFrame:
    """The kept documents with cleaned texts, in the columns of ``docs``.

    Verdicts are filtered inside an array, so that they are computed once for filter and projection.
    """
    own = docs.columns
    kept = F.filter(F.array(verdict_on(F.col(text_col), **limits)), lambda q: q["kept"])
    judged = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("row"), F.explode(kept).alias("quality"))
    return judged.select(*(F.col("quality.clean_text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in own))
