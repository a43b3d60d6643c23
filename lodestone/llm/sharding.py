"""Sharding by a hierarchical weighted hash tree.

A key descends region, rack and shard.  At each level every child draws ``-ln(u) / weight`` with
``u`` hashed from the key and the child's name, and the smallest draw wins, so a child gets its
weight's share of its parent's keys.  A draw depends on nothing but key, child and the child's
weight: when a weight grows, keys can only move into that child's subtree, when it shrinks only out
of it, and every other subtree keeps its keys where they are.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut


#: Rows of a block, which one task sorts, and blocks whose first slots are broadcast at most (some 5 MB).
BLOCK_ROWS, BROADCAST_ROWS = 100_000, 100_000


@dataclass(frozen=True)
class Leaf:
    """A shard with its place in the tree and its weight."""

    region: str
    rack: str
    shard: int
    weight: float = 1.0


def tree(n_shards: int, racks: int = 3, per_rack: int = 4) -> list[Leaf]:
    """``n_shards`` equal shards, ``per_rack`` in a rack and ``racks`` racks in a region."""
    return [Leaf(f"r{i // (per_rack * racks)}", f"r{i // (per_rack * racks)}/k{i // per_rack}", i) for i in range(n_shards)]


def grown(leaves: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """One more shard, in a region of its own: only its own subtree's weight changes, at every level."""
    new = max((x.shard for x in leaves), default=-1) + 1
    return [*leaves, Leaf(f"g{new}", f"g{new}/k", new, weight)]


def reweighted(leaves: list[Leaf], shard: int, weight: float) -> list[Leaf]:
    return [replace(x, weight=weight) if x.shard == shard else x for x in leaves]


def _draw(key: Column, name: Column, weight: Column, seed: int) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(key, name, F.lit(seed)), 11)
    return -F.log((bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))) / weight


def shard_of(key: Column, leaves: list[Leaf], seed: int = 0) -> Column:
    """The shard of ``key``; a null key is a key like any other."""
    if not leaves or any(x.weight <= 0 for x in leaves) or len({x.shard for x in leaves}) < len(leaves):
        raise ValueError("shards must be distinct and weights positive")
    children: dict[str, dict[str, float]] = {}
    for x in leaves:
        for parent, child in (("", x.region), (x.region, x.rack), (x.rack, f"{x.rack}/{x.shard}")):
            at = children.setdefault(parent, {})
            at[child] = at.get(child, 0.0) + x.weight
    listing = F.create_map(
        *(c for parent, own in children.items() for c in (F.lit(parent), F.array(*(F.struct(F.lit(n).alias("name"), F.lit(w).alias("weight")) for n, w in own.items()))))
    )

    def descend(parent: Column) -> Column:
        drawn = F.transform(F.element_at(listing, parent), lambda c: F.struct(_draw(key, c["name"], c["weight"], seed).alias("draw"), c["name"].alias("name")))
        return F.array_min(drawn)["name"]

    leaf = descend(descend(descend(F.lit(""))))
    return F.element_at(F.split(leaf, "/"), -1).cast("int")


def assign(docs: DataFrame, leaves: list[Leaf], after: list[Leaf] | None = None, id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> DataFrame:
    """Place every row and number the rows of each shard.

    Returns id, ``size`` (UTF-8 bytes of the text plus 8; a null text has none), ``text_crc32`` (of no
    bytes for a null text), ``shard``, ``slot`` (0, 1, ... in each shard, ordered by block, id, checksum
    and size) and ``grown_shard`` under ``after`` (null without it).  The id alone decides the shard:
    repeated ids, null ids included, share one.  An empty table gives an empty one; other columns are
    ignored.

    Slots need no sort of a whole shard: rows are numbered in hashed blocks of some BLOCK_ROWS rows each, and
    the blocks' row counts give each block's first slot.
    """
    key, text = F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))
    placed = cut(
        docs.select(
            key.alias(id_col),
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            shard_of(key, leaves, seed).alias("shard"),
            (shard_of(key, after, seed) if after else F.lit(None).cast("int")).alias("grown_shard"),
        ).withColumn("hash", F.xxhash64(id_col, "text_crc32", F.lit(seed + 1))),
        "sharding",
    )
    blocks = max(64, placed.count() // (len(leaves) * BLOCK_ROWS))
    placed = placed.withColumn("block", F.pmod("hash", F.lit(blocks)).cast("int"))
    first = placed.groupBy("shard", "block").count().withColumn("first", F.sum("count").over(Window.partitionBy("shard").orderBy("block")) - F.col("count")).drop("count")
    within = F.row_number().over(Window.partitionBy("shard", "block").orderBy(id_col, "text_crc32", "size"))
    return (
        placed.withColumn("within", within)
        .join(F.broadcast(first) if blocks * len(leaves) <= BROADCAST_ROWS else first, ["shard", "block"])
        .select(id_col, "size", "text_crc32", "shard", (F.col("first") + F.col("within") - 1).cast("long").alias("slot"), "grown_shard")
    )
