"""Substring and prefix joins as equi joins: by rare grams, and by the lengths that occur."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a gram.
GRAM = 4


def grams(text: Column, size: int) -> Column:
    """The distinct substrings of ``size`` characters."""
    last = F.length(text) - size
    return F.when(last >= 0, F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.substr(text, i + 1, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def containing(needles: DataFrame, texts: DataFrame, needle_col: str = "needle", text_col: str = "text", id_col: str = "text_id") -> DataFrame:
    """(needle, id): the texts that hold each distinct needle as a substring, as written.

    A needle of GRAM characters or more stands under its gram that the fewest texts hold; texts meet it there
    and the substring is verified.  Shorter needles are grams themselves.  So no text is compared with all needles,
    and a gram that most texts have is used only by needles that consist of such grams.  Null or empty needles and
    null texts match nothing; ids that repeat are texts of their own, each pair is returned as often.
    """
    own = needles.where(F.length(needle_col) > 0).select(F.col(needle_col).alias("needle")).distinct()
    held = texts.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("key"))
    short = not own.where(F.length("needle") < GRAM).isEmpty()
    wanted = own.select("needle", F.explode(F.when(F.length("needle") < GRAM, F.array("needle")).otherwise(grams(F.col("needle"), GRAM))).alias("gram"))
    sizes = range(1, GRAM + 1) if short else (GRAM,)
    # postings hold keys of texts, not texts, and only grams that some needle has
    every = held.select("key", F.explode(F.concat(*(grams(F.col("text"), n) for n in sizes))).alias("gram"))
    postings = every.join(wanted.select("gram").distinct(), "gram", "left_semi").distinct()
    spread = postings.groupBy("gram").agg(F.count("*").alias("texts"))
    rarest = wanted.join(spread, "gram").groupBy("needle").agg(F.min(F.struct("texts", "gram"))["gram"].alias("gram"))
    return postings.join(rarest, "gram").join(held, "key").where(F.contains("text", "needle")).select("needle", "id")


def prefixed(texts: DataFrame, prefixes: DataFrame, text_col: str = "text", prefix_col: str = "prefix", longest: bool = False) -> DataFrame:
    """``texts`` with ``prefix``, a row for each distinct prefix that starts the text; ``longest``: the longest alone.

    A text is cut at every length that some prefix has, and meets the prefixes by equality.  The lengths are an
    array of one row, as long as there are different ones.
    """
    own = prefixes.where(F.length(prefix_col) > 0).select(F.col(prefix_col).alias("prefix")).distinct()
    lengths = own.agg(F.sort_array(F.collect_set(F.length("prefix"))).alias("prefix lengths"))
    cut = F.transform(F.filter("prefix lengths", lambda n: n <= F.length(text_col)), lambda n: F.substr(F.col(text_col), F.lit(1), n))
    joined = texts.withColumn("place", F.monotonically_increasing_id()) if longest else texts
    found = joined.join(F.broadcast(lengths)).withColumn("prefix", F.explode(cut)).drop("prefix lengths").join(own, "prefix")
    if not longest:
        return found.select(*texts.columns, "prefix")
    best = F.max_by(F.struct(*(F.col(f"`{c}`") for c in texts.columns), "prefix"), F.length("prefix"))
    return found.groupBy("place").agg(best.alias("best")).select("best.*")
