"""Substring dedup: repeated word windows, found by suffix trees over prefix-partitioned suffixes.

A suffix counts by its first WINDOW words; a window that occurs earlier too is a repeat, and every word
of such windows goes.  Suffix trees of a whole corpus do not fit anywhere, so suffixes are dealt by prefixes:

1. Anchors.  Of the GRAM-word prefixes of the suffixes in any stretch of WINDOW words, the one with the
   least hash is an anchor (leftmost on ties).  Equal windows have equal anchors at equal places, so a
   window can only repeat if its anchor does.  Anchors are an eighth of all places; those that occur
   once in the corpus are dropped with all their windows.
2. Partitions.  All windows with one anchor stand in one stretch of text around it; the stretches are
   shuffled by the anchor's hash.  Groups of more than GROUP stretches are split by salt.
3. Subtrees.  In a group, suffixes are split by prefixes of growing length, dropping those that are alone,
   down to nodes of WINDOW words.  All leaves below such a node but the first are repeats.
4. The firsts of split groups meet once more, one row for each node and salt.

Texts with equal words are one text up to here: of WINDOW words or more, all but the first are repeats
as a whole.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from hashlib import blake2b
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from .common import arrow_map, cut
from .components import matching

WINDOW = 20
GRAM = 6
GROUP = 1_000
#: Words of one text whose stretches share a salt.
REACH = 4_096
#: Word counts of the prefixes by which a group's suffixes are split.
DEPTHS = (10, 15, 20)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 50_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_hash = _Hashes()


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def anchors_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all GRAM-word prefixes, and for every window the place of its anchor."""
    if len(words) < WINDOW:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    w = np.fromiter(map(_hash.__getitem__, words), np.uint64, len(words))
    n = len(w) - GRAM + 1
    g = np.zeros(n, np.uint64)
    for j in range(GRAM):
        g = (g ^ w[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        g ^= g >> np.uint64(29)
        g *= np.uint64(0xBF58476D1CE4E5B9)
        g ^= g >> np.uint64(32)
    span = WINDOW - GRAM + 1
    at = np.lib.stride_tricks.sliding_window_view(g, span).argmin(axis=1) + np.arange(n - span + 1)
    return g.view(np.int64), at


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*parts, np.empty(0, np.int64)])))


def _signatures(rows: DataFrame) -> DataFrame:
    """row_key, doc_id, text_hash, node (of the words), n_words, anchors (distinct), times (places of each)."""
    kind = dict(rows.dtypes)["doc_id"]

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        nodes, counts, once, often = [], [], [], []
        for text in batch.column(3).to_pylist():
            words = words_of(text)
            grams, at = anchors_of(words)
            values, times = np.unique(grams[np.unique(at)], return_counts=True)
            nodes.append(blake2b(b" ".join(words), digest_size=16).digest())
            counts.append(len(words))
            once.append(values)
            often.append(times)
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(nodes, pa.binary()), pa.array(counts, pa.int64()), _lists(once), _lists(often)], ["row_key", "doc_id", "text_hash", "node", "n_words", "anchors", "times"])

    return arrow_map(rows, each, f"row_key long, doc_id {kind}, text_hash long, node binary, n_words long, anchors array<long>, times array<long>")


def _stretches(texts: DataFrame) -> DataFrame:
    """Of (nid, rank, tie, values, parts, text): a row for each anchor among ``values``, with the words of all
    windows that have it, from the first such window's start, and a salt where its group has several parts.
    ``rank`` is an id of any type that has an order."""
    kind = dict(texts.dtypes)["rank"]

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        nid, rank, tie, values, parts, text = (batch.column(k).to_pylist() for k in range(6))
        out: list[list] = [[] for _ in range(7)]
        for k in range(batch.num_rows):
            words = words_of(text[k])
            grams, at = anchors_of(words)
            # windows with one anchor are neighbours
            starts = np.flatnonzero(np.diff(at, prepend=-1))
            wanted = dict(zip(values[k], parts[k], strict=True))
            ends = [*starts[1:], len(at)]
            for value, a, b in zip(grams[at[starts]].tolist(), starts.tolist(), ends, strict=True):
                if (split := wanted.get(value)) is not None:
                    salt = 0 if split == 1 else 1 + xxhash.xxh64_intdigest(f"{nid[k]} {a // REACH}") % split
                    for column, x in zip(out, (value, salt, nid[k], rank[k], tie[k], a, b" ".join(words[a : b + WINDOW - 1])), strict=True):
                        column.append(x)
        kinds = (pa.int64(), pa.int32(), pa.int64(), batch.schema.field(1).type, pa.int64(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["value", "salt", "nid", "rank", "tie", "start", "words"])

    return arrow_map(texts, each, f"value long, salt int, nid long, rank {kind}, tie long, start int, words binary", 500)


def deep_nodes(suffixes: list[tuple], depth: int = 0) -> Iterator[list[tuple]]:
    """Nodes of WINDOW words of the suffix tree over ``suffixes`` (words, place in words, ...) that have two leaves or more.

    Built from the top, one level of DEPTHS at a time, so only branches that still hold several suffixes
    are followed.
    """
    start, stop = (DEPTHS[depth - 1] if depth else 0), DEPTHS[depth]
    branches = defaultdict(list)
    for s in suffixes:
        branches[b" ".join(s[0][s[1] + start : s[1] + stop])].append(s)
    for branch in branches.values():
        if len(branch) > 1:
            if stop == WINDOW:
                yield branch
            else:
                yield from deep_nodes(branch, depth + 1)


def _earliest(s: tuple) -> tuple:
    """How suffixes (words, place, rank, tie, start, ...) are ordered: by id, null last."""
    return (s[2] is None, *s[2:5])


def _repeats(stretches: DataFrame) -> DataFrame:
    """nid, starts of repeats; from split groups also windows that are first there, with a digest of their words."""
    rank: DataType = stretches.schema["rank"].dataType
    own = to_arrow_type(rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        out: list[list] = [[], [], [], [], []]

        def made() -> pa.RecordBatch:
            kinds = (pa.int64(), own, pa.int64(), pa.list_(pa.int32()), pa.binary())
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["nid", "rank", "tie", "starts", "digest"])
            for c in out:
                c.clear()
            return batch

        for (_, salt), group in groupby(rows(), key=lambda r: r[:2]):
            suffixes, gone = [], defaultdict(list)
            for _, _, nid, rank, tie, start, text in group:
                words = text.split(b" ")
                suffixes += [(words, k, rank, tie, start + k, nid) for k in range(len(words) - WINDOW + 1)]
            lone = not salt  # 0: the group is whole
            for node in deep_nodes(suffixes) if lone else _with_single(suffixes):
                first = min(node, key=_earliest)
                for s in node:
                    if s is not first:
                        gone[s[5]].append(s[4])
                if not lone:
                    for column, x in zip(out, (first[5], first[2], first[3], [first[4]], blake2b(b" ".join(first[0][first[1] : first[1] + WINDOW]), digest_size=16).digest()), strict=True):
                        column.append(x)
            for nid, starts in gone.items():
                for column, x in zip(out, (nid, None, None, starts, None), strict=True):
                    column.append(x)
            if len(out[0]) > 2000:
                yield made()
        yield made()

    return stretches.mapInArrow(run, f"nid long, rank {rank.simpleString()}, tie long, starts array<int>, digest binary")


def _with_single(suffixes: list[tuple]) -> list[list[tuple]]:
    """All nodes of WINDOW words, those with one leaf too: part of the leaves may be in other salts."""
    nodes = defaultdict(list)
    for s in suffixes:
        nodes[b" ".join(s[0][s[1] : s[1] + WINDOW])].append(s)
    return list(nodes.values())


def _spans(texts: DataFrame, kind: str) -> DataFrame:
    """Of (doc_id, text, starts, copy): the outcome of each row."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        totals, gone, kept = [], [], []
        for text, starts, copy in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
            words = words_of(text)
            totals.append(len(words))
            if copy:
                words = []
            elif starts:
                steps = np.zeros(len(words) + 1, np.int64)
                at = np.unique(np.array(starts))
                steps[at] += 1
                steps[at + WINDOW] -= 1
                covered = np.cumsum(steps)[:-1] > 0
                words = [w for w, c in zip(words, covered.tolist(), strict=True) if not c]
            gone.append(totals[-1] - len(words))
            kept.append(b" ".join(words).decode())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(totals, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    return arrow_map(texts, each, f"doc_id {kind}, n_words long, n_removed long, kept_text string")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's words without those in windows of WINDOW words that start earlier too.

    Earlier is a smaller id (of any type that has an order), or an earlier place in the same text; windows
    are judged on the input.
    Returns id, ``n_words``, ``n_removed`` and ``kept_text`` (words joined by one space).  A null text has no
    words; texts under WINDOW words lose none.  Null ids come last.  Rows with one id are ordered by a hash
    of their text; rows with equal id and text are one document and get the same outcome.  An empty table
    gives an empty one; other columns are ignored.
    """
    kind = dict(docs.dtypes)[id_col]
    key, text = docs[id_col], docs[text_col]
    source = docs.select(F.xxhash64(key, text).alias("row_key"), key.alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    rows = cut(_signatures(source), "signatures")

    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash", "row_key")
    long_rows = rows.where(F.col("n_words") >= WINDOW)
    nodes = long_rows.groupBy("node").agg(F.min(place).alias("first"), F.min_by(F.struct("anchors", "times"), place).alias("own"))
    nodes = cut(nodes.select("node", "first.*", "own.*", F.monotonically_increasing_id().alias("nid")), "nodes")

    # anchors that occur again, here or elsewhere, and the number of parts that their groups need
    # (both sides are plain tables, so an anchor of very many texts is a skewed partition that can be split)
    postings = nodes.select("nid", F.inline(F.arrays_zip("anchors", "times"))).select("nid", F.col("anchors").alias("value"), "times")
    totals = cut(postings.groupBy("value").agg(F.sum("times").alias("all")).where(F.col("all") > 1), "anchors")
    shared = postings.join(totals, "value")
    parts = F.ceil(F.col("all") / GROUP).cast("int")
    wanted = shared.groupBy("nid").agg(F.collect_list(F.struct("value", parts.alias("parts"))).alias("at"))
    wanted = cut(wanted.join(nodes, "nid").select("nid", "text_hash", F.col("doc_id").alias("rank"), F.col("text_hash").alias("tie"), F.col("at.value").alias("values"), F.col("at.parts").alias("parts")), "wanted")

    texts = matching(source.select("text_hash", "text"), wanted.select("text_hash").distinct(), "text_hash")
    texts = texts.groupBy("text_hash").agg(F.first("text").alias("text")).join(wanted, "text_hash").select("nid", "rank", "tie", "values", "parts", "text")
    stretches = _stretches(texts)
    dealt = stretches.repartition("value", "salt").sortWithinPartitions("value", "salt")
    found = cut(_repeats(dealt), "repeats")
    firsts = found.where(F.col("digest").isNotNull()).select("digest", "nid", F.struct(F.col("rank").isNull().alias("last"), "rank", "tie", F.element_at("starts", 1).alias("start")).alias("at"))
    earliest = firsts.groupBy("digest").agg(F.min("at").alias("first"))
    late = firsts.join(earliest, "digest").where("at != first").select("nid", F.array("at.start").alias("starts"))
    gone = found.where(F.col("digest").isNull()).select("nid", "starts").unionByName(late).groupBy("nid").agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts"))

    outcome = nodes.select("node", "nid", F.col("row_key").alias("first_key")).join(gone, "nid", "left")
    marked = long_rows.select("row_key", "node").distinct().join(outcome, "node").select("row_key", (F.col("row_key") != F.col("first_key")).alias("copy"), "starts")
    marked = marked.where(F.col("copy") | F.col("starts").isNotNull()).withColumn("starts", F.when(~F.col("copy"), F.col("starts")))
    joined = source.join(marked, "row_key", "left").select("doc_id", "text", "starts", "copy")
    return _spans(joined, kind).withColumnRenamed("doc_id", id_col)
