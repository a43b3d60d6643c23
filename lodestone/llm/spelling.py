"""Spelling variants: words at distance one, by trie self-joins with active nodes.

Two words that differ in one place share what stands before it and what stands after it.  So words are dealt
by their length class and a prefix or a suffix of half the length; each group is a vocabulary trie below its
prefix (of reversed words for suffixes), which one task walks with active-node sets.  Groups that are too large
are split in the same way: by half of what is still open, until one place is.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, lower_ascii, outcome, settle

#: Code points that stand open in a group at most before it is split, where it can be.
GROUP_CHARS = 100_000


def occurrences(docs: DataFrame, letters: str = r"[A-Za-zÀ-ÿ]", least: int = 7, noise: int = 31, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(word, n): maximal runs of ``letters`` in whole texts, A-Z lower-cased, with one letter lost in some.

    Where ``noise`` divides the crc32 h of ``<id>:<run>``, the run loses its code point h % length.  Words of at
    least ``least`` code points are counted, before the shuffle as well.
    """
    runs = F.transform(F.regexp_extract_all(F.col(text_col), F.lit(f"{letters}{{{least},}}"), F.lit(0)), lower_ascii)
    each = docs.select(F.col(id_col).cast("string").alias("id"), F.explode(runs).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    each = each.select("run", h.alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    lost = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = each.select(F.when(F.col("h") % noise == 0, lost).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n"))


class _Trie:
    """Nodes by number, with what the walk needs: children, parent and the word that ends there (-1: none)."""

    def __init__(self, words: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.parent, self.word = [-1], [-1]
        for k, w in enumerate(words):
            at = 0
            for c in w:
                below = self.children[at].get(c)
                if below is None:
                    below = self.children[at][c] = len(self.parent)
                    self.children.append({})
                    self.parent.append(at)
                    self.word.append(-1)
                at = below
            self.word[at] = k

    def near(self) -> Iterator[tuple[int, int]]:
        """Both orders of all pairs of words at distance one.

        The active nodes of a node are those whose strings are at most one edit away.  At distance none that is
        the node itself; at distance one, for a child by c: the c-children of the parent's active nodes, the
        parent (c deleted), the other children of the parent (c replaced) and the child's own children (one inserted).
        """
        children, word = self.children, self.word
        stack = [(0, list(children[0].values()))]
        while stack:
            node, active = stack.pop()
            if (k := word[node]) >= 0:
                for m in active:
                    if word[m] >= 0:
                        yield k, word[m]
            own = children[node]
            for c, child in own.items():
                follow = {x for m in active if (x := children[m].get(c)) is not None}
                follow.discard(child)
                follow.add(node)
                follow.update(own.values())
                follow.discard(child)
                follow.update(children[child].values())
                stack.append((child, follow))


def _parts(pre: Column, suf: Column, size: Column) -> tuple[Column, Column]:
    """What stands before the open part of a word, and what stands after it."""
    return F.substring("word", F.lit(1), pre), F.substring("word", size - suf + 1, suf)


def _keyed(rows: DataFrame) -> DataFrame:
    """``rows`` with the key of their group: class, what is open, and the text around it."""
    before, after = _parts(F.col("pre"), F.col("suf"), F.length("word"))
    return rows.withColumn("key", F.concat_ws(" ", F.col("class"), F.col("pre"), F.col("suf"), F.col("below"), before, after))


def _halves(rows: DataFrame) -> DataFrame:
    """Each row twice: with the first half of what is open in its prefix, and with the second half in its suffix.

    A pair of the class sizes L and L + 1 has its common prefix reach the middle, or else its common suffix; the
    suffix side takes only pairs whose prefixes differ ``below`` the middle, so no pair is found twice.
    """
    middle = F.floor((F.col("pre") + F.col("class") - F.col("suf")) / 2).cast("int")
    ways = F.array(F.struct(middle.alias("pre"), F.col("suf"), F.col("below")), F.struct(F.col("pre"), (F.col("class") - middle).alias("suf"), middle.alias("below")))
    return rows.withColumn("way", F.explode(ways)).select("word", "n", "class", "way.pre", "way.suf", "way.below")


def _groups(words: DataFrame) -> DataFrame:
    """(word, n, class, pre, suf, below, key): the words of all groups of two or more, split where too large."""
    size = F.length("word")
    rows = words.withColumn("class", F.explode(F.array(size, size - 1)))
    rows = rows.select("word", "n", "class", F.lit(0).alias("pre"), F.lit(0).alias("suf"), F.lit(-1).alias("below"))
    done = None
    while True:
        rows = cut(_keyed(_halves(rows)), "spelling-groups")
        sizes = rows.groupBy("key").agg(F.count("*").alias("rows"), F.sum(F.length("word") - F.col("pre") - F.col("suf")).alias("open"), F.min(F.col("class") - F.col("pre") - F.col("suf")).alias("room"))
        sizes = sizes.where("rows > 1").withColumn("large", (F.col("open") > GROUP_CHARS) & (F.col("room") > 1))
        rows = cut(rows.join(sizes.select("key", "large"), "key"), "spelling-groups")
        fit = rows.where("not large").drop("large")
        done = fit if done is None else done.union(fit)
        rows = rows.where("large").drop("large", "key")
        if rows.isEmpty():
            return done


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best): how many ``words`` (word, n; distinct) differ in one place, and the best of them.

    Best is the largest n, then the smallest word by code points, as struct (m, word) with m = -n.  Words
    that are near none have no row.
    """
    rows = _groups(words)
    count = rows.count()
    partitions = max(1, min(4 * words.sparkSession.sparkContext.defaultParallelism, count // 2000), count // 200_000)
    rows = rows.select("key", "word", "n", "class", "pre", "suf", "below").repartition(partitions, "key").sortWithinPartitions("key", "word")

    def group(rows: list[tuple]) -> Iterator[tuple]:
        _, _, size, pre, suf, below = rows[0]
        backward = below >= 0
        inner = [w[pre : len(w) - suf] for w, *_ in rows]
        trie = _Trie([x[::-1] for x in inner] if backward else inner)
        found: dict[int, list] = {}
        for a, b in trie.near():
            v, w = rows[a][0], rows[b][0]
            if min(len(v), len(w)) == size and (below < 0 or v[:below] != w[:below]):
                other = (-rows[b][1], w)
                if (got := found.get(a)) is None:
                    found[a] = [1, other]
                else:
                    got[0] += 1
                    got[1] = min(got[1], other)
        for a, (count, (m, w)) in found.items():
            yield rows[a][0], count, m, w

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, [], []
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for key, *row in zip(keys, *(batch.column(k).to_pylist() for k in range(1, 7)), strict=True):
                if key != now:
                    if len(held) > 1:
                        out += group(held)
                    now, held = key, []
                held.append(tuple(row))
            if out:
                yield _found(out)
                out = []
        if len(held) > 1 and (out := list(group(held))):
            yield _found(out)

    found = rows.mapInArrow(each, "word string, n_near long, m long, near string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("m", F.col("near").alias("word"))).alias("best"))


def _found(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string())], ["word", "n_near", "m", "near"])


def variants(docs: DataFrame, least: int = 7, at_least: int = 2, ratio: int = 10, **options) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words with ``at_least`` occurrences: see :func:`occurrences`.

    A word's form is the near word of the largest n, ties by code points, if its n is ``ratio`` times the word's
    or more; its root is where following forms ends.  Words without near words have n_near 0 and are their own root.

    Null texts have no words; a null id has no hash, so its words lose no letter.  Repeated rows count again; other
    columns are ignored; an empty table gives an empty one.  Long words are words like others.
    """
    settle(docs.sparkSession)
    return outcome(docs.sparkSession, "variants", lambda: _variants(occurrences(docs, least=least, **options), at_least, ratio))


def _variants(counted: DataFrame, at_least: int, ratio: int) -> DataFrame:
    words = cut(counted.where(F.col("n") >= at_least), "spelling-words")
    fits = -F.col("best.m") >= ratio * F.col("n")
    near = words.join(near_words(words), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.word")).alias("form"), F.when(fits, -F.col("best.m")).alias("form_n"))
    near = cut(near, "spelling-near")
    # n grows by ``ratio`` with each form, so that few doublings end every chain
    forms = near.where("form is not null").select("word", F.col("form").alias("up"))
    open_ = forms
    while True:
        above = open_.select(F.col("word").alias("up"), F.col("up").alias("higher"))
        step = cut(open_.join(above, "up", "left").select("word", F.coalesce("higher", "up").alias("up"), F.col("higher").isNotNull().alias("moved")), "spelling-roots")
        open_ = step.drop("moved")
        if step.where("moved").isEmpty():
            break
    return near.join(open_, "word", "left").select("word", "form", F.coalesce("up", "word").alias("root"), "n", "n_near", "form_n")
