"""An inverted-file index over vectors: cells around centroids, probed by joins.

Centroids are fitted on a bounded sample; every vector lies in the cell of its nearest one.  A search meets the
vectors of the few cells nearest to each query, by :func:`vector.top_k` within cells; all cells make it exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType
from pyspark.sql.window import Window

from ..functions.vectors import doubles, l2_normalized
from . import vector
from .store import written

#: The centroids see a sample of at most so many vectors, whatever the table's size; there are at most MOST_CELLS,
#: so that their matrix (32 MB at 1024 dimensions) fits every task.
SAMPLE_ROWS, MOST_CELLS = 100_000, 4_096
#: Vectors of one file of a cell, about: a cell that holds a third of all vectors is many files.
FILE_ROWS = 50_000


@dataclass(frozen=True)
class Index:
    """Where the tables are: ``vectors`` by cell, ``centroids`` (cell, centroid) and ``sizes`` (cell, rows)."""

    spark: SparkSession
    path: str

    @property
    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/vectors")

    @property
    def centroids(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/centroids")

    @property
    def sizes(self) -> DataFrame:
        return self.vectors.groupBy("cell").agg(F.count("*").alias("rows"))


def _nearest(rows: DataFrame, centroids: np.ndarray, column: str, n: int) -> DataFrame:
    """``rows`` with ``cells``, the ``n`` nearest centroids' numbers by cosine, nearest first; one matrix product a batch."""
    schema = StructType([*rows.schema.fields, StructField("cells", ArrayType(IntegerType()))])
    at = rows.columns.index(column)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(at).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            score = flat.reshape(batch.num_rows, -1) @ centroids.T if batch.num_rows else np.zeros((0, len(centroids)))
            near = np.argsort(-score, axis=1, kind="stable")[:, :n].astype(np.int32)
            cells = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, near.shape[1]), pa.int32()), pa.array(near.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, cells], [*batch.schema.names, "cells"])

    return rows.mapInArrow(each, schema)


def _matrix(centroids: DataFrame) -> np.ndarray:
    """The centroids as rows of a matrix by cell; MOST_CELLS at most."""
    return np.array([r.centroid for r in centroids.orderBy("cell").collect()], np.float64)


def fit(vectors: DataFrame, cells: int | None = None, column: str = "embedding_full", seed: int = 7) -> DataFrame:
    """(cell, centroid): unit centroids of a sample of SAMPLE_ROWS vectors at most.

    Without ``cells`` there are as many as the root of the number of vectors, a sixteenth of the sample and MOST_CELLS allow.
    The sample is the vectors with the smallest hashes, so it does not depend on the rows' order.
    """
    unit = vectors.where(F.col(column).isNotNull()).select(l2_normalized(doubles(F.col(column))).alias("v"))
    n = unit.count()
    hashed = unit.withColumn("h", F.xxhash64("v"))
    share = min(1.0, 1.2 * SAMPLE_ROWS / max(n, 1))
    sample = (hashed.where(F.pmod("h", F.lit(1 << 20)) < math.ceil(share * (1 << 20))) if share < 1 else hashed).limit(SAMPLE_ROWS).select("v")
    k = max(1, min(cells or math.isqrt(n), max(1, min(n, SAMPLE_ROWS) // 16), MOST_CELLS))
    if k == 1:
        return unit.limit(1).select(F.lit(0).alias("cell"), F.col("v").alias("centroid"))
    model = KMeans(k=k, seed=seed, maxIter=10, distanceMeasure="cosine", featuresCol="f").fit(sample.select(array_to_vector("v").alias("f")))
    found = [(i, c.tolist()) for i, c in enumerate(model.clusterCenters())]
    return vectors.sparkSession.createDataFrame(found, "cell int, centroid array<double>").select("cell", l2_normalized(F.col("centroid")).alias("centroid"))


def _write(vectors: DataFrame, index: Index, column: str) -> None:
    own = _nearest(vectors.where(F.col(column).isNotNull()), _matrix(index.centroids), column, 1)
    own = own.withColumn("cell", F.element_at("cells", 1)).drop("cells")
    # a cell's rows go to files of some FILE_ROWS rows; how many, a row a cell
    own = own.withColumn("file", F.pmod(F.xxhash64(column), F.lit(1 << 20)))
    files = own.groupBy("cell").agg(F.ceil(F.count("*") / FILE_ROWS).alias("files"))
    dealt = own.join(F.broadcast(files), "cell").withColumn("file", F.col("file") % F.col("files"))
    dealt.repartition("cell", "file").drop("file", "files").write.mode("append").partitionBy("cell").parquet(f"{index.path}/vectors")


def build(vectors: DataFrame, path: str, cells: int | None = None, column: str = "embedding_full") -> Index:
    """Fit centroids and write all ``vectors`` with one by cell; vectors without one are left out.

    The index must not exist; further vectors come by :func:`add`.
    """
    index = Index(vectors.sparkSession, path.rstrip("/"))
    fit(vectors, cells, column).coalesce(1).write.parquet(f"{index.path}/centroids")
    _write(vectors, index, column)
    return index


def opened(spark: SparkSession, path: str) -> Index | None:
    """The index at ``path``, or None where there is none."""
    index = Index(spark, path.rstrip("/"))
    try:
        index.centroids.schema  # noqa: B018
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    return index


def add(index: Index, vectors: DataFrame, column: str = "embedding_full") -> None:
    """Put further vectors into the cells there are."""
    _write(vectors, index, column)


def probed(queries: DataFrame, index: Index, probes: int) -> DataFrame:
    """``queries`` (query_id, vector), a row for each of the ``probes`` nearest cells, as ``cell``."""
    asked = queries.where(F.col("vector").isNotNull()).select("query_id", doubles(F.col("vector")).alias("vector"))
    return _nearest(asked, _matrix(index.centroids), "vector", probes).select("query_id", "vector", F.explode("cells").alias("cell"))


def top_k(queries: DataFrame, index: Index, k: int = 5, probes: int = 8, column: str = "embedding_full", id_col: str = "chunk_id", exclude_self: bool = False) -> DataFrame:
    """(query_id, id, score, rank): as :func:`vector.top_k`, among the vectors of the nearest ``probes`` cells.

    Cells are folders, so only those that some query probes are read where they are few.
    """
    asked = probed(queries, index, probes)
    return vector.top_k(asked, index.vectors, k, column, id_col, exclude_self=exclude_self, scope=("cell",))


def scanned_share(queries: DataFrame, index: Index, probes: int) -> DataFrame:
    """One row: the share of all (query, vector) pairs that a search with ``probes`` cells compares."""
    asked = probed(queries, index, probes)
    met = asked.join(F.broadcast(index.sizes), "cell").agg(F.sum("rows").alias("met"))  # MOST_CELLS rows
    every = queries.where(F.col("vector").isNotNull()).agg(F.count("*").alias("asked")).join(index.vectors.agg(F.count("*").alias("all")))
    return met.join(every).select((F.col("met") / (F.col("asked") * F.col("all"))).alias("share"))


def recall(found: DataFrame, exact: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """One row: the mean share of each query's exact neighbours that were found."""
    pairs = exact.select("query_id", id_col).join(found.select("query_id", id_col, F.lit(1.0).alias("hit")), ["query_id", id_col], "left")
    return pairs.groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall")).agg(F.avg("recall").alias("recall"))


def recall_curve(queries: DataFrame, index: Index, k: int = 5, column: str = "embedding_full", id_col: str = "chunk_id", exclude_self: bool = False) -> DataFrame:
    """(probes, recall, share) for 1, 2, 4, ... and all cells: as :func:`top_k`, :func:`recall` and :func:`scanned_share` give them.

    Every cell is searched once, by all queries: a search with few probes is the best of what the nearest cells gave.
    """
    cells = index.centroids.count()
    levels = [1 << j for j in range(cells.bit_length()) if 1 << j < cells] + [cells]
    every = F.array(*map(F.lit, levels))
    asked = queries.where(F.col("vector").isNotNull()).select("query_id", doubles(F.col("vector")).alias("vector"))
    near = written(_nearest(asked, _matrix(index.centroids), "vector", cells).select("query_id", "vector", F.posexplode("cells").alias("place", "cell")), "probed")
    own = near.select(F.struct("query_id", "place").alias("query_id"), "vector", "cell")
    found = vector.top_k(own, index.vectors, k + exclude_self, column, id_col, scope=("cell",)).select("query_id.query_id", "query_id.place", F.col(id_col).alias("id"), "score")
    if exclude_self:
        found = found.where(F.col("query_id") != F.col("id"))
    order = Window.partitionBy("probes", "query_id").orderBy(F.col("score").desc(), "id")
    each = found.withColumn("probes", F.explode(F.filter(every, lambda p: p > F.col("place")))).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    each = written(each.select("probes", "query_id", "id"), "found")
    exact = each.where(F.col("probes") == cells).select("query_id", "id", F.explode(every).alias("probes"))
    pairs = exact.join(each.withColumn("hit", F.lit(1.0)), ["probes", "query_id", "id"], "left")
    recalls = pairs.groupBy("probes", "query_id").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall")).groupBy("probes").agg(F.avg("recall").alias("recall"))
    sizes = written(index.sizes, "sizes")
    met = near.groupBy("place", "cell").agg(F.count("*").alias("queries")).join(F.broadcast(sizes), "cell")  # MOST_CELLS rows
    met = met.withColumn("probes", F.explode(F.filter(every, lambda p: p > F.col("place")))).groupBy("probes").agg(F.sum(F.col("rows") * F.col("queries")).alias("met"))
    total = asked.agg(F.count("*").alias("asked")).join(sizes.agg(F.sum("rows").alias("all")))  # one row each
    shares = met.join(F.broadcast(total)).select("probes", (F.col("met") / (F.col("asked") * F.col("all"))).alias("share"))
    return recalls.join(shares, "probes")


def calibrated(queries: DataFrame, index: Index, k: int = 5, least: float = 0.95, column: str = "embedding_full", id_col: str = "chunk_id", exclude_self: bool = False) -> int:
    """The first number of probes (1, 2, 3, 5, 8, each half as many again) with which these queries reach the recall ``least``.

    ``queries`` should be some hundreds: each step searches all of them, the first one exactly.
    """
    cells = index.centroids.count()
    exact = top_k(queries, index, k, cells, column, id_col, exclude_self).select("query_id", id_col).cache()
    try:
        probes = 1
        while probes < cells and recall(top_k(queries, index, k, probes, column, id_col, exclude_self), exact, id_col).first()[0] < least:
            probes += (probes + 1) // 2
    finally:
        exact.unpersist()
    return min(probes, cells)
