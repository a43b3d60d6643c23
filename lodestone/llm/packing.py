"""Best-fit packing: token sequences of one length from documents, by a configuration linear program.

A configuration is a multiset of piece lengths that fits into one sequence.  Fractional uses of configurations
must cover the histogram of lengths; multiplicative weights find them, a knapsack by dynamic programming prices
the configurations, and rounding turns them into whole uses.  Only the histogram, which has as many rows as a
sequence has places, comes to the driver; pieces find their places by their rank among those of equal length.
"""

from __future__ import annotations

import os
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_map, cut, outcome, settle

#: The tokenizer's rule for parts, over lower-cased Latin-1 and common punctuation.
SPACE = r"\x09-\x0d \x85\xa0"
LETTER = "a-zªµºß-öø-ÿ"
DIGIT = "0-9²³¹¼½¾"
PARTS = f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{DIGIT}]|[^{SPACE}{LETTER}{DIGIT}]+"
KNOWN = r"[\x00-\xff\u2010-\u2027\u2030-\u205e]*"


class _Parts(dict):
    """Ids of parts, as bytes; a part is encoded when it is first asked for."""

    def __init__(self, library, cache: int):
        super().__init__()
        self.model, self.cache = library.model, cache
        # the library writes a byte as one character: printable Latin-1 as itself, the others from 256 on, in order
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.byte = dict(zip(plain, plain, strict=True)) | {b: 256 + k for k, b in enumerate(sorted({*range(256)} - {*plain}))}

    def __missing__(self, part: str) -> bytes:
        text = part if part.isascii() and part.isalpha() else part.encode().decode("latin-1").translate(self.byte)
        ids = array("I", [x.id for x in self.model.tokenize(text)]).tobytes()
        if len(part) <= 64:
            if len(self) >= self.cache:
                self.clear()
            self[part] = ids
        return ids


class Encoder:
    """Token ids as little-endian unsigned 32-bit numbers, equal to the library's.

    Texts of Latin-1 and common punctuation are split into parts here, whose ids are kept, ``cache`` at most;
    the library encodes all others.  The tokenizer file must have the rules that PARTS states.
    """

    def __init__(self, tokenizer_file: str, cache: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer_file)
        self.special = [x.content for x in self.library.get_added_tokens_decoder().values()]
        self.split, self.simple = re.compile(PARTS).findall, re.compile(KNOWN).fullmatch
        self.parts = _Parts(self.library, cache)
        every = "".join(map(chr, [*range(256), *range(0x2010, 0x2028), *range(0x2030, 0x205F)]))
        for text in (every, "a".join(every), "Ab  c's\t12-x\n É é.", " a", "don't...no 1a2 'sky I'LL", "--'s x''ve"):
            if self.encode(text) != self._whole(text):
                raise ValueError("the tokenizer's rules are not supported")

    def _whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        if not (text.isascii() or self.simple(text)) or any(x in text for x in self.special):
            return self._whole(text)
        return b"".join(map(self.parts.__getitem__, self.split(text.lower())))


@lru_cache(maxsize=2)
def encoder(tokenizer_file: str) -> Encoder:
    return Encoder(tokenizer_file)


def pieces(docs: DataFrame, tokenizer_file: str, limit: int, end_id: int = 0, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, ``piece`` (from 0), ``start``, ``length`` and ``ids`` (binary, little-endian unsigned 32-bit) of each piece.

    A document's ids are the tokenizer's, without special ones added, then ``end_id``; a null text counts as an
    empty one, which is ``end_id`` alone.  What is longer than ``limit`` is cut there; nothing is left out.  Other
    columns are ignored, repeated rows are documents of their own, an empty table gives an empty one.
    """
    kind, end = dict(docs.dtypes)[id_col], np.array([end_id], "<u4").tobytes()
    schema = f"id {kind}, piece int, start long, length long, ids binary"

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = encoder(tokenizer_file).encode
        rows, at, starts, ids = [], [], [], []
        for k, got in enumerate(batch.column(1).to_pylist()):
            got = encode(got or "") + end
            for n, start in enumerate(range(0, len(got), 4 * limit)):
                rows.append(k)
                at.append(n)
                starts.append(start // 4)
                ids.append(got[start : start + 4 * limit])
        columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(at, pa.int32()), pa.array(starts, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["id", "piece", "start", "length", "ids"])

    return arrow_map(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), each, schema, 200).withColumnRenamed("id", id_col)


@dataclass(frozen=True)
class Use:
    """A configuration, as (length, copies) from the longest, and how often it is used."""

    parts: tuple[tuple[int, int], ...]
    times: int


def _knapsack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each capacity the best total of ``values`` (by length, any number of each) and the length put in last, 0 for none."""
    n = len(values)
    best, last = np.zeros(n), np.zeros(n, np.int64)
    for c in range(1, n):
        got = values[1 : c + 1] + best[c - 1 :: -1][:c]
        k = int(got.argmax())
        if got[k] > best[c - 1]:
            best[c], last[c] = got[k], k + 1
        else:
            best[c] = best[c - 1]
    return best, last


def _filled(first: int, limit: int, last: np.ndarray) -> tuple[tuple[int, int], ...]:
    """The best configuration that holds the length ``first``."""
    held, c = Counter([first]), limit - first
    while c > 0:
        if last[c]:
            held[int(last[c])] += 1
            c -= int(last[c])
        else:
            c -= 1
    return tuple(sorted(held.items(), reverse=True))


def fractional(histogram: dict[int, int], limit: int, rounds: int = 120, near: float = 0.02, rate: float = 4.0) -> dict[tuple[tuple[int, int], ...], float]:
    """Configurations and fractional uses that cover the histogram, by multiplicative weights.

    Each length is a constraint with a weight, which falls as the length is covered.  A round prices by
    weight over count: one knapsack gives the best configuration that holds each length, and those within
    ``near`` of the best of all share the round's uses.
    """
    lengths = np.array(sorted(histogram))
    counts = np.array([histogram[n] for n in lengths.tolist()], float)
    total = float((lengths * counts).sum()) / limit
    covered, weight, uses = np.zeros(len(lengths)), np.log(lengths / limit), Counter()
    place = {n: k for k, n in enumerate(lengths.tolist())}
    for done in range(rounds):
        price = np.full(limit + 1, -1.0)
        price[lengths] = np.exp(weight - weight.max())
        best, last = _knapsack(price)
        worth = price[lengths] + best[limit - lengths]
        chosen = {_filled(int(n), limit, last) for n in lengths[worth >= (1 - near) * worth.max()]}
        # a configuration is used no more often than its scarcest length stands in the histogram
        most = [min(histogram[n] / k for n, k in c) for c in chosen]
        share = total / rounds / sum(most)
        for c, often in zip(chosen, most, strict=True):
            uses[c] += share * often
            for n, k in c:
                covered[place[n]] += share * often * k
        weight = np.log(lengths / limit) - rate * (covered / counts - (done + 1) / rounds)
    return dict(uses)


def _fullest(left: dict[int, int], limit: int) -> Counter:
    """The longest length left, and what fills the rest of its sequence best; longer lengths before shorter ones."""
    order = sorted(left, reverse=True)
    held, room = Counter([order[0]]), limit - order[0]
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for n in order:
        for _ in range(min(left[n] - (n == order[0]), room // n)):
            more = (reach | reach << n) & mask
            if more == reach:
                break
            steps.append((n, reach))
            reach = more
        if reach >> room & 1:
            break
    c = reach.bit_length() - 1
    for n, before in reversed(steps):
        if c and not before >> c & 1:
            held[n] += 1
            c -= n
    return held


def plan(histogram: dict[int, int], limit: int, rounds: int = 120) -> list[Use]:
    """Whole uses of configurations that hold exactly the histogram.

    The program's uses are rounded down, as far as lengths are left; what remains, a number of sequences that
    depends on the number of lengths and not on their counts, is filled sequence by sequence, by the longest
    length left and the subset of the others that leaves the least room.
    """
    left, out = dict(histogram), []

    def take(parts: tuple[tuple[int, int], ...], times: int) -> None:
        if times > 0:
            out.append(Use(parts, times))
            for n, k in parts:
                left[n] -= k * times
                if not left[n]:
                    del left[n]

    for n in [n for n in left if 2 * n > limit and n + min(left) > limit]:
        take(((n, 1),), left[n])
    if left:
        for parts, uses in sorted(fractional(left, limit, rounds).items(), key=lambda x: (-sum(n * k for n, k in x[0]), -x[1], x[0])):
            take(parts, min(int(uses), *(left.get(n, 0) // k for n, k in parts)))
    while left:
        held = _fullest(left, limit)
        take(tuple(sorted(held.items(), reverse=True)), min(left[n] // k for n, k in held.items()))
    return out


def _places(uses: list[Use]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, uses, first sequence, offset) of the stretches of ranks, in order of rank.

    A stretch of ``uses`` * copies ranks goes to ``uses`` sequences; copies of one length stand side by side.
    """
    rows, taken, sequence = {}, Counter(), 0
    for use in uses:
        offset = 0
        for n, k in use.parts:
            rows.setdefault(n, []).append((taken[n], use.times, sequence, offset))
            taken[n] += use.times * k
            offset += n * k
        sequence += use.times
    return {n: np.array(x, np.int64) for n, x in rows.items()}


def pack(rows: DataFrame, limit: int, rounds: int = 120, length_col: str = "length") -> DataFrame:
    """``rows`` with ``sequence_id`` and ``offset``: as few sequences of ``limit`` places as rounding leaves.

    Every length must be from 1 to ``limit``.  Offsets in a sequence are gapless from 0.  Other columns are kept
    (``sequence_id`` and ``offset`` are replaced); rows that are equal get places of their own; an empty table
    gives an empty one.  A length's rows are ranked in cells by a random number, so a length that a third of all
    rows have is no task of its own.
    """
    settle(rows.sparkSession)
    return outcome(rows.sparkSession, "packed", lambda: _packed(rows, limit, rounds, length_col))


def _packed(rows: DataFrame, limit: int, rounds: int, length_col: str) -> DataFrame:
    names = [x for x in rows.columns if x not in ("sequence_id", "offset")]
    own = [f"c{k}" for k in range(len(names))]  # no name of the caller's meets one of these steps
    rows = rows.select(*(F.col(f"`{x}`").alias(y) for x, y in zip(names, own, strict=True)), (F.rand(7) * (1 << 30)).cast("int").alias("packing_cell"))
    rows = cut(rows, "pieces")
    cells = max(64, rows.count() // 50_000)
    length, cell = F.col(own[names.index(length_col)]).cast("long").alias("packing_length"), (F.col("packing_cell") % cells).alias("packing_cell")
    counts = cut(rows.groupBy(length, cell).count(), "cells")
    histogram = {n: c for n, c in counts.groupBy("packing_length").agg(F.sum("count")).collect()}  # at most ``limit`` rows
    if any(n is None or not 1 <= n <= limit for n in histogram):
        raise ValueError(f"lengths must be from 1 to {limit}")
    places = _places(plan(histogram, limit, rounds))
    before = Window.partitionBy("packing_length").orderBy("packing_cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("packing_length", "packing_cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("packing_before"))
    within = Window.partitionBy("packing_length", "packing_cell").orderBy("packing_order")
    ranked = rows.select(*own, length, cell, F.monotonically_increasing_id().alias("packing_order"))
    ranked = ranked.withColumn("packing_rank", F.row_number().over(within) - 1).join(counts, ["packing_length", "packing_cell"])
    ranked = ranked.select(*own, "packing_length", (F.col("packing_rank") + F.col("packing_before")).alias("packing_rank"))
    schema = ranked.select(*own, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = (batch.column(len(own) + k).to_numpy() for k in (0, 1))
            sequence, offset = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
            for n in np.unique(size):
                at, table = np.flatnonzero(size == n), places[int(n)]
                row = table[np.searchsorted(table[:, 0], rank[at], "right") - 1]
                copy, use = np.divmod(rank[at] - row[:, 0], row[:, 1])
                sequence[at], offset[at] = row[:, 2] + use, row[:, 3] + copy * n
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], pa.array(sequence), pa.array(offset)], [*own, "sequence_id", "offset"])

    return ranked.mapInArrow(each, schema).toDF(*names, "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the ``ids`` of each sequence's pieces, joined in order of ``offset``."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
