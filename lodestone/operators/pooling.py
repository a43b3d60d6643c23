"""Token vectors to one vector: the mean under a mask, of unit length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

#: Tokens of a text that count at most: what the embedding model reads.
TOKENS = 512


def _pooled(vectors: pa.ListArray, masks: pa.ListArray, limit: int) -> pa.ListArray:
    """One mean for each row of ragged token vectors and masks."""
    out: list[np.ndarray | None] = []
    for vector, mask in zip(vectors, masks, strict=True):
        if not vector.is_valid or not len(vector):
            out.append(None)
            continue
        tokens = vector.values.slice(0, limit)
        n = len(tokens)
        flat = tokens.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
        weight = np.ones(n) if not mask.is_valid else np.zeros(n)
        if mask.is_valid:
            own = np.nan_to_num(mask.values.to_numpy(zero_copy_only=False).astype(np.float64))[:n]
            weight[: len(own)] = own != 0
        mean = weight @ flat / max(weight.sum(), 1e-9)
        size = np.linalg.norm(mean)
        out.append(mean / size if size > 0 else mean)
    return pa.array(out, pa.list_(pa.float64()))


def masked_mean(rows: DataFrame, vectors_col: str = "vectors", mask_col: str = "mask", limit: int = TOKENS) -> DataFrame:
    """``rows`` with ``pooled``: the mean of the first ``limit`` token vectors whose mask is not 0, of length one.

    A row's vectors have one length; rows may differ in the number of tokens.  Without a mask all tokens count, places that
    a mask does not reach or has null at do not.  Where none counts the mean is zeros; without tokens it is null.
    """
    at = rows.columns.index(vectors_col), rows.columns.index(mask_col)
    schema = StructType([*rows.schema.fields, StructField("pooled", ArrayType(DoubleType()))])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _pooled(batch.column(at[0]), batch.column(at[1]), limit)], schema.names)

    return rows.mapInArrow(each, schema)
