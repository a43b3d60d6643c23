"""Exact nearest neighbours of a batch of query vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from ..functions.scores import clamp
from ..functions.vectors import dot, doubles, l2_normalized

#: The two vector columns; a plan reads exactly one.
COLUMNS = ("embedding_fast", "embedding_full")
#: Vectors of a group and queries of a block, about: 64 and 8 MB as doubles at 1024 dimensions, and as much for their products.
GROUP, BLOCK = 8_192, 1_024
#: Queries that go with the tasks at most, and vectors that they meet at once.
FEW, SLICE = 1_024, 2_048
#: A task reads so many bytes of vectors at a time, which it holds several times over.
BATCH_BYTES = "8m"


def column_for(fast: bool) -> str:
    return COLUMNS[0 if fast else 1]


def scoped(chunks: DataFrame, document_ids: list[str] | None = None, pages: list[int] | None = None, chunk_ids: list[str] | None = None) -> DataFrame:
    """Chunks in all the given scopes; an empty or missing scope is no filter."""
    for column, wanted in (("document_id", document_ids), ("page_number", pages), ("chunk_id", chunk_ids)):
        if wanted:
            chunks = chunks.where(F.col(column).isin(wanted))
    return chunks


def _group_best(k: int, exclude_self: bool, last: bool, kinds: list[pa.DataType]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of a group of vectors (id, v) and a block of queries (query_id, q) the ``k`` best of the group for each query."""

    def unit(table: pa.Table, name: str) -> np.ndarray:
        flat = table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(table.num_rows, -1)
        return flat / np.maximum(np.linalg.norm(flat, axis=1, keepdims=True), 1e-300)

    def best(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if vectors.num_rows and queries.num_rows:
            vectors = vectors.sort_by([("id", "descending" if last else "ascending")])
            ids, names = vectors.column("id").to_pylist(), queries.column("query_id").to_pylist()
            place = {x: j for j, x in enumerate(ids)} if exclude_self else {}
            found = np.round(unit(queries, "q") @ unit(vectors, "v").T, 6)
            for name, s in zip(names, found, strict=True):
                if place and name in place:
                    s[place[name]] = -np.inf
                least = np.partition(s, -k)[-k] if len(s) > k else -np.inf
                near = np.flatnonzero((s >= least) & (s > -np.inf))
                near = near[np.argsort(-s[near], kind="stable")][:k]  # ties by id, as sorted
                out[0].extend([name] * len(near))
                out[1].extend(ids[j] for j in near)
                out[2].extend(s[near].tolist())
        return pa.table([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["query_id", "id", "score"])

    return best


def _stream_best(asked: list[tuple], k: int, exclude_self: bool, last: bool, kinds: list[pa.DataType]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of a task's vectors (id, v) the ``k`` best for each of the few queries (query_id, q), SLICE vectors at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [name for name, _ in asked]
        unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        q = unit(np.array([v for _, v in asked], np.float64))
        held: list[list] = [[] for _ in names]
        bar = np.full(len(names), -np.inf)  # the kth score so far
        for whole in batches:
            if whole.column(1).null_count:
                whole = whole.filter(whole.column(1).is_valid())
            for start in range(0, whole.num_rows, SLICE):
                batch = whole.slice(start, SLICE)
                v = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                found = np.round(q @ unit(v).T, 6)
                if exclude_self:
                    place = {x: j for j, x in enumerate(batch.column(0).to_pylist())}
                    for i, name in enumerate(names):
                        if name in place:
                            found[i, place[name]] = -np.inf
                least = bar
                # what is below the slice's own kth score cannot stay; nor can, of a tie, more than k by id
                if batch.num_rows > k:
                    least = np.maximum(bar, np.partition(found, batch.num_rows - k, axis=1)[:, -k])
                hit, at = np.nonzero((found >= least[:, None]) & (found > -np.inf))
                for i in np.unique(hit).tolist():
                    near = at[hit == i]
                    own = held[i] + list(zip(found[i, near].tolist(), batch.column(0).take(pa.array(near)).to_pylist(), strict=True))
                    own.sort(key=lambda x: x[1], reverse=last)
                    own.sort(key=lambda x: -x[0])
                    held[i] = own[:k]
                    if len(own) >= k:
                        bar[i] = held[i][-1][0]
        out = [(name, x, score) for name, own in zip(names, held, strict=True) for score, x in own]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [()] * 3, kinds, strict=True)], ["query_id", "id", "score"])

    return run


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 5, column: str = "embedding_full", id_col: str = "chunk_id", candidates: DataFrame | None = None, exclude_self: bool = False, scope: tuple[str, ...] = (), last: bool = False) -> DataFrame:
    """(query_id, id, score, rank): the ``k`` vectors with the largest cosine for each query; ties by id (``last``: the greatest first).

    ``queries`` has query_id and ``vector``; all vectors have one length.  With ``scope``, columns of both
    tables, a query meets the vectors with equal scopes only.  With ``candidates`` (query_id, id) only those
    few are compared, by equi joins; the other vectors are dropped where they are read, not shuffled.

    Without either, up to FEW queries go with the tasks, by way of the driver (8 MB at 1024 dimensions), and vectors are
    read where they are, BATCH_BYTES at a time (the session's limit from then on): ``k`` rows a query and task are shuffled.  More queries, and scopes, take blocks: vectors are dealt by a hash to groups of some GROUP rows, queries to blocks of some BLOCK, and
    every block meets every group in one matrix product, in a task of its own, which hands on ``k`` rows a
    query.  So a task's memory is bounded, and a scope with most vectors is many groups.  How many groups and blocks a scope has is counted
    within the plan, a row a scope.
    """
    if column not in (*COLUMNS, "embedding"):
        raise ValueError(f"unknown vector column {column}")
    at = [f"scope {j}" for j in range(len(scope))]
    scoped_by = [F.col(c).alias(a) for c, a in zip(scope, at, strict=True)]
    every = vectors.select(F.col(id_col).alias("id"), F.col(column).alias("v"), *scoped_by)
    own = every.where(F.col("v").isNotNull())
    schema = StructType([StructField("query_id", queries.schema["query_id"].dataType), StructField("id", own.schema["id"].dataType), StructField("score", DoubleType())])
    kinds = [to_arrow_type(f.dataType) for f in schema]
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id").desc() if last else F.col("id"))
    if candidates is not None:
        unit = lambda c: l2_normalized(doubles(F.col(c)))
        asked = queries.select("query_id", unit("vector").alias("q"))
        wanted = candidates.select("query_id", F.col(id_col).alias("id"))
        # ids alone choose the vectors, before these are joined; a null one's score is null
        few = every.join(wanted.select("id").distinct(), "id", "left_semi")
        pairs = wanted.join(asked, "query_id").join(few, "id").select("query_id", "id", F.round(dot(F.col("q"), unit("v")), 6).alias("score"))
        pairs = pairs.where(F.col("score").isNotNull())
        if exclude_self:
            pairs = pairs.where(F.col("query_id") != F.col("id"))
    else:
        asked = queries.where(F.col("vector").isNotNull()).select("query_id", doubles(F.col("vector")).alias("q"), *scoped_by)
        sent = [] if at else asked.limit(FEW + 1).collect()
        if not at and len(sent) <= FEW:
            vectors.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
            pairs = every.mapInArrow(_stream_best([(r["query_id"], r["q"]) for r in sent], k, exclude_self, last, kinds), schema) if sent else every.sparkSession.createDataFrame([], schema)
            return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumnRenamed("id", id_col)
        number = lambda df, rows, name: df.groupBy(*at).agg(F.greatest(F.lit(1), F.ceil(F.count("*") / rows)).cast("int").alias(name))
        groups, blocks = number(own, GROUP, "groups"), number(asked, BLOCK, "blocks")
        if at:
            sizes = groups.join(blocks, at)
            left, right = own.join(sizes, at), asked.join(sizes, at)
        else:
            sizes = groups.join(F.broadcast(blocks))  # one row each
            left, right = own.join(F.broadcast(sizes)), asked.join(F.broadcast(sizes))
        all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = left.withColumn("group", F.pmod(F.xxhash64("id"), "groups").cast("int")).withColumn("block", all_of("blocks"))
        right = right.withColumn("block", F.pmod(F.xxhash64("query_id"), "blocks").cast("int")).withColumn("group", all_of("groups"))
        key = [*at, "group", "block"]
        pairs = left.select(*key, "id", "v").groupBy(*key).cogroup(right.select(*key, "query_id", "q").groupBy(*key)).applyInArrow(_group_best(k, exclude_self, last, kinds), schema)
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumnRenamed("id", id_col)


def similar(vectors: DataFrame, least: float, column: str = "embedding_full", id_col: str = "chunk_id") -> DataFrame:
    """(a, b, score): all pairs of ids, a < b, whose cosine is ``least`` or more.  Rows without a vector or an id have none.

    Vectors are dealt by a hash to groups of some BLOCK; each pair of groups meets in one matrix product, in a task
    of its own, which hands on the pairs that are similar.  Ids should be distinct.
    """
    own = vectors.where(F.col(column).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), doubles(F.col(column)).alias("v"))
    groups = own.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / BLOCK)).cast("int").alias("groups"))
    own = own.join(F.broadcast(groups)).withColumn("group", F.pmod(F.xxhash64("id"), "groups").cast("int"))  # one row
    # a pair of groups is (smaller, greater); a group comes to each pair that it stands in
    every = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    dealt = every.select(F.least("group", "other").alias("low"), F.greatest("group", "other").alias("high"), "group", "id", "v")
    schema = StructType([StructField("a", own.schema["id"].dataType), StructField("b", own.schema["id"].dataType), StructField("score", DoubleType())])
    kinds = [to_arrow_type(f.dataType) for f in schema]

    def pairs(table: pa.Table) -> pa.Table:
        low, ids = table.column("low")[0].as_py(), table.column("id").to_pylist()
        flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
        unit = flat / np.maximum(np.linalg.norm(flat, axis=1, keepdims=True), 1e-300)
        same, inside = low == table.column("high")[0].as_py(), table.column("group").to_numpy() == low
        rows, columns = np.flatnonzero(inside), np.flatnonzero(inside if same else ~inside)
        found = np.round(unit[rows] @ unit[columns].T, 9)
        out = [(*sorted((ids[rows[i]], ids[columns[j]])), float(found[i, j])) for i, j in zip(*np.nonzero(found >= least), strict=True) if rows[i] < columns[j] or not same]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else ((), (), ()), kinds, strict=True)], schema.names)

    return dealt.groupBy("low", "high").applyInArrow(pairs, schema)


def stage_confidence(hits: DataFrame) -> DataFrame:
    return hits.groupBy("query_id").agg(F.round(clamp(F.avg("score")), 6).alias("confidence"))
