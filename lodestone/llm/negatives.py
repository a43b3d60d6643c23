"""Hard negatives by norm-bucketed search over integer vectors.

Rows are sorted by norm and dealt, longest first, into buckets; anchors form blocks.  A bucket whose longest
norm times the block's longest stays below what every search of the block still needs is never sent to it
(Cauchy-Schwarz); a task that meets the rest in order of norm skips what its running kth scores rule out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, outcome, settle

#: Anchors of a block and rows of a bucket, about; bytes of the components of one packed row, at most.
BLOCK, BUCKET, PACKED_BYTES = 2048, 8192, 1 << 16
#: Rows scored at a time.
CHUNK = 4096
_LEAST = np.iinfo(np.int64).min


def quantised(vectors: DataFrame, is_anchor: Column, scale: int, vector_col: str, label_col: str, id_col: str) -> DataFrame:
    """(id, label, v, norm2, dim, anchor) of the rows that take part: v holds floor(scale * x) of each component x.

    Rows with a null id, label, vector or component, or a component that is not finite, take no part; neither
    do vectors whose squared norm may reach 2**62, as their scores need not fit in a long.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("x"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    finite = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    norm2 = F.aggregate("x", F.lit(0.0), lambda a, x: a + F.pow(F.abs(F.lit(float(scale)) * x.cast("double")) + 1, F.lit(2.0)))
    rows = rows.where("id is not null and label is not null and x is not null").where(finite).where(norm2 < float(1 << 62))
    rows = rows.select("id", "label", F.transform("x", lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("v"), "anchor")
    return rows.select("id", "label", "v", F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x).alias("norm2"), F.size("v").alias("dim"), "anchor")


_PACKED = "dim int, box int, part int, top double, ids binary, labels binary, v binary, more binary"


def _packed(rows: DataFrame, size: int, more: list[str]) -> DataFrame:
    """``rows`` by norm, longest first, in boxes of about ``size`` rows, each as packed rows of PACKED_BYTES at most.

    ``box`` counts from 0 with falling norm.  ``more`` are further columns of longs, kept side by side.
    """
    boxes = max(1, min(10_000, -(-rows.count() // size)))
    order = [F.col("norm2").desc(), "id", "place"]
    rows = rows.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(boxes, *order)
    rows = rows.withColumn("box", F.spark_partition_id()).sortWithinPartitions("dim", *order).select("dim", "box", "id", "label", "norm2", "v", *more)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = 0
        for batch in batches:
            dim = batch.column(0).to_numpy()
            start = 0
            while start < len(dim):
                end = min(int(np.searchsorted(dim, dim[start], "right")), start + max(1, PACKED_BYTES // max(8 * int(dim[start]), 8)))
                cut_out = batch.slice(start, end - start)
                longs = lambda k, x=cut_out: x.column(k).to_numpy().astype("<i8").tobytes()
                flat = cut_out.column(5).flatten().to_numpy(zero_copy_only=False).astype("<i8")
                yield pa.RecordBatch.from_pylist(
                    [{"dim": int(dim[start]), "box": cut_out.column(1)[0].as_py(), "part": part, "top": float(np.sqrt(float(cut_out.column(4).to_numpy().max()))), "ids": longs(2), "labels": longs(3), "v": flat.tobytes(), "more": b"".join(longs(6 + k) for k in range(len(more)))}],
                    schema=pa.schema([("dim", pa.int32()), ("box", pa.int32()), ("part", pa.int32()), ("top", pa.float64()), ("ids", pa.binary()), ("labels", pa.binary()), ("v", pa.binary()), ("more", pa.binary())]),
                )
                part += 1
                start = end

    return rows.mapInArrow(each, _PACKED)


class _Searches:
    """The best ``k`` rows of every search of one block so far; a search has an anchor and bounds for its scores."""

    def __init__(self, anchors: list[dict], k: int, same: bool):
        self.k, self.same = k, same
        self.ids, self.labels = (np.concatenate([np.frombuffer(a[x], "<i8") for a in anchors]) for x in ("ids", "labels"))
        self.v = np.concatenate([np.frombuffer(a["v"], "<i8").reshape(len(a["ids"]) // 8, -1) for a in anchors])
        self.norm = np.sqrt((self.v.astype(float) ** 2).sum(1))
        columns = [np.frombuffer(a["more"], "<i8").reshape(-1, len(a["ids"]) // 8) for a in anchors]
        self.more = np.concatenate(columns, axis=1)
        n = len(self.ids)
        # one search without bounds for each anchor, or one for each anchor and positive: (key, positive, low, high)
        self.low = np.full(n, _LEAST) if same else self.more[2]
        self.high = np.full(n, np.iinfo(np.int64).max) if same else self.more[3]
        self.floor = self.low.copy()  # what a new row must reach
        self.of, self.id, self.score = (np.zeros(0, np.int64) for _ in range(3))

    def open(self, top: float) -> np.ndarray:
        """Searches that rows of this norm or a shorter one can still change, a little rounding allowed."""
        return np.flatnonzero(self.norm * top * (1 + 1e-12) + 1 >= self.floor)

    def meet(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, top: float) -> None:
        at = self.open(top)
        if not len(at):
            return
        # anchors that stand in several searches are multiplied once
        key, back = (at, np.arange(len(at))) if self.same else np.unique(self.more[0][at], return_inverse=True)
        first = at if self.same else at[np.unique(back, return_index=True)[1]]
        bound = float(self.norm[at].max()) * float(np.sqrt((v.astype(float) ** 2).sum(1)).max(initial=0))
        # sums of products stay below this bound, so they are exact in the type chosen
        kind = np.float32 if bound < 1 << 23 else np.float64 if bound < 1 << 52 else np.int64
        product = self.v[first].astype(kind) @ v.astype(kind).T
        found_of, found_at, found_score = [], [], []
        for start in range(0, len(at), 512):  # bounds the memory of the comparisons
            some = at[start : start + 512]
            score = product[back[start : start + 512]]
            fits = (score >= self.floor[some, None].astype(kind)) & (score <= self.high[some, None].astype(kind)) if not self.same else score >= self.floor[some, None].astype(kind)
            fits &= (labels[None, :] == self.labels[some, None]) if self.same else (labels[None, :] != self.labels[some, None])
            if self.same:
                fits &= ids[None, :] != self.ids[some, None]
            if fits.sum() > 64 * len(some) and score.shape[1] > self.k:  # first the kth of this chunk alone
                least = np.where(fits, score, -np.inf if kind != np.int64 else _LEAST)
                kth = np.partition(least, -self.k, axis=1)[:, -self.k]
                fits &= score >= kth[:, None]
            row, col = np.nonzero(fits)
            found_of.append(some[row])
            found_at.append(col)
            found_score.append(score[row, col].astype(np.int64))
        of, col = np.concatenate([self.of, *found_of]), np.concatenate(found_at)
        if len(of) == len(self.of):
            return
        id_, score = np.concatenate([self.id, ids[col]]), np.concatenate([self.score, *found_score])
        order = np.lexsort((id_, -score, of))
        of, id_, score = of[order], id_[order], score[order]
        begin = np.searchsorted(of, of)
        keep = np.arange(len(of)) - begin < self.k
        self.of, self.id, self.score = of[keep], id_[keep], score[keep]
        full = np.flatnonzero((np.arange(len(of)) - begin)[keep] == self.k - 1)
        self.floor[self.of[full]] = np.maximum(self.floor[self.of[full]], self.score[full])


def _search(blocks: DataFrame, buckets: DataFrame, k: int, same: bool) -> DataFrame:
    """Rows (key, positive_id, positive_score, id, score): per search the best ``k`` of each stripe of buckets.

    ``blocks`` are packed anchors with ``need``, the score that every search of the box needs at least.
    A bucket goes to the blocks whose need it can reach.  A stripe is every nth bucket, in order of norm.
    """
    spark = blocks.sparkSession
    boxes = blocks.groupBy("dim", "box").agg(F.max("top").alias("block_top"), F.min("need").alias("need"))
    n_boxes = max(1, boxes.count())
    tops = buckets.groupBy("dim", F.col("box").alias("bucket")).agg(F.max("top").alias("bucket_top"))
    stripes = max(1, min(tops.count(), -(-4 * spark.sparkContext.defaultParallelism // n_boxes)))
    stripe = (F.col("bucket") % stripes).alias("stripe")
    # one row for each block and bucket that can meet: a few bytes, and an equality of dimensions
    pairs = boxes.join(tops, "dim").where(F.col("block_top") * F.col("bucket_top") * (1 + 1e-12) + 1 >= F.col("need")).select("dim", "box", "bucket", stripe)
    pairs = cut(pairs, "pairs")
    order = [F.lit(0).alias("side"), F.lit(0.0).alias("rank"), "part", "top", "ids", "labels", "v", "more"]
    left = blocks.join(pairs.select("dim", "box", "stripe").distinct(), ["dim", "box"]).select("dim", "box", "stripe", *order)
    right = buckets.withColumnRenamed("box", "bucket").join(pairs, ["dim", "bucket"])
    right = right.select("dim", "box", "stripe", F.lit(1).alias("side"), (-F.col("top")).alias("rank"), "part", "top", "ids", "labels", "v", "more")
    both = left.union(right)
    both = both.repartition(max(1, min(10_000, n_boxes * stripes)), "dim", "box", "stripe").sortWithinPartitions("dim", "box", "stripe", "side", "rank", "part")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, anchors, searches, waiting, rows = None, [], None, [], 0

        def met():
            nonlocal searches, waiting, rows
            if searches is None and anchors:
                searches = _Searches(anchors, k, same)
            if waiting and searches:
                ids, labels = (np.concatenate([np.frombuffer(w[x], "<i8") for w in waiting]) for x in ("ids", "labels"))
                v = np.concatenate([np.frombuffer(w["v"], "<i8").reshape(len(w["ids"]) // 8, -1) for w in waiting])
                searches.meet(ids, labels, v, max(w["top"] for w in waiting))
            waiting, rows = [], 0

        def done():
            met()
            if searches:
                of = searches.of
                key, positive, score = (searches.more[0][of], searches.more[1][of], searches.more[4][of]) if not same else (searches.more[0][of], np.zeros(len(of), np.int64), np.zeros(len(of), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, positive, score, searches.id, searches.score)], ["key", "positive_id", "positive_score", "id", "score"])

        for batch in batches:
            for n in range(batch.num_rows):
                row = {x: batch.column(x)[n].as_py() for x in ("dim", "box", "stripe", "side", "top", "ids", "labels", "v", "more")}
                if now != (here := (row["dim"], row["box"], row["stripe"])):
                    yield from done()
                    now, anchors, searches, waiting, rows = here, [], None, [], 0
                if row["side"] == 0:
                    anchors.append(row)
                    continue
                waiting.append(row)
                rows += len(row["ids"]) // 8
                if rows >= CHUNK:
                    met()
        yield from done()

    return both.mapInArrow(each, "key long, positive_id long, positive_score long, id long, score long")


def _best(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The best ``k`` of the stripes' rows for each search, with ``rank``; some ``k`` rows a stripe."""
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "id", "nth")
    return found.withColumn("nth", F.monotonically_increasing_id()).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("nth")


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256, vector_col: str = "embedding", label_col: str = "label", id_col: str = "vec_id") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of all anchors.

    A score is the inner product of two vectors' floor(scale * x).  Higher scores come first, ties by the smaller
    id.  An anchor's positives are the first ``positives`` rows of its label with other ids; for each, the first
    ``negatives`` rows of other labels follow whose score is from ``low`` to ``high`` percent of the positive's.
    Exact: bounds leave out only what cannot be among them.

    Rows that take no part: see :func:`quantised`.  Vectors meet vectors of their own length only.  Repeated rows
    each count; an anchor that stands twice is mined once for each of its rows.  Other columns are ignored;
    an anchor without positives or without fitting negatives has no row; an empty table gives an empty one.
    """
    spark = vectors.sparkSession
    settle(spark)
    return outcome(spark, "negatives", lambda: _mined(quantised(vectors, is_anchor, scale, vector_col, label_col, id_col), positives, negatives, low, high))


def _mined(rows: DataFrame, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    rows = cut(rows, "vectors")
    buckets = cut(_packed(rows, BUCKET, []), "buckets")
    anchors = cut(rows.where("anchor").withColumn("key", F.monotonically_increasing_id()), "anchors")
    any_score = F.lit(-float("inf")).alias("need")
    blocks = cut(_packed(anchors, BLOCK, ["key"]).select("*", any_score), "blocks")
    chosen = cut(_best(_search(blocks, buckets, positives, True), ["key"], positives).select("key", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # low * positive <= 100 * score <= high * positive, in whole numbers; decimals, as products may pass a long
    percent = lambda n: (F.col("positive_score").cast("decimal(20,0)") * F.lit(n).cast("decimal(5,0)"))
    windows = chosen.withColumn("low", F.ceil(percent(low) / 100).cast("long")).withColumn("high", F.floor(percent(high) / 100).cast("long")).where("low <= high")
    searches = cut(anchors.join(windows, "key"), "searches")
    packed = _packed(searches, BLOCK, ["key", "positive_id", "low", "high", "positive_score"])
    needs = lambda b: np.frombuffer(b, "<i8").reshape(5, -1)[2].min()

    def need(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("need", pa.array([float(needs(b)) for b in batch.column("more").to_pylist()]))

    windows_blocks = cut(packed.mapInArrow(need, f"{_PACKED}, need double"), "windows")
    found = _best(_search(windows_blocks, buckets, negatives, False), ["key", "positive_id", "positive_score"], negatives)
    return found.join(anchors.select("key", F.col("id").alias("anchor_id")), "key").select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
