"""Connected components of an edge table, and a semi join that broadcasts only behind a size check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, outcome

#: Keys of eight bytes that are broadcast at most: 4 MB, some 20 MB as a hash table.
BROADCAST_ROWS = 500_000


def matching(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """The ``rows`` whose ``on`` (a long) is among ``keys``: by broadcast if few, else by a shuffled join."""
    few = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(keys) if few else keys, on, "left_semi")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes in ``edges`` (a, b); the root is one node of the component.

    Each round every node points to the least of itself and its neighbours, pointers are doubled twice,
    and the graph is contracted to what they point to, until no edge is left: a number of rounds that
    grows with the logarithm of the longest path.  Nothing is collected; each round's tables are written,
    and deleted at the end.
    """
    return outcome(edges.sparkSession, "components", lambda: _components(edges))


def _components(edges: DataFrame) -> DataFrame:
    edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    roots = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = cut(both.groupBy("a").agg(F.min("b").alias("up")).select(F.col("a").alias("node"), F.least("a", "up").alias("up")), "pointers")
        for _ in range(2):
            above = step.select(F.col("node").alias("up"), F.col("up").alias("higher"))
            step = step.join(above, "up", "left").select("node", F.coalesce("higher", "up").alias("up"))
        step = cut(step, "pointers")
        if roots is None:
            roots = step.withColumnRenamed("up", "root")
        else:
            roots = cut(roots.join(step.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("up", "root").alias("root")), "roots")
        a, b = (step.select(F.col("node").alias(x), F.col("up").alias(f"{x}_up")) for x in "ab")
        met = edges.join(a, "a").join(b, "b").select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b"))
        edges = cut(met.where("a < b").distinct(), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")) if roots is None else roots
