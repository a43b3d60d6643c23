"""Vectors as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def l2_normalized(v: Column) -> Column:
    """``v`` of length one; a zero vector stays as it is.  The length is computed once for a vector."""
    return F.element_at(F.transform(F.array(norm(v)), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)), 1)


def cosine(a: Column, b: Column) -> Column:
    both = norm(a) * norm(b)
    return F.when(both > 0, dot(a, b) / both).otherwise(0.0)


def hash_embedding(text: Column, dim: int, normalize: bool = True) -> Column:
    """A vector from the SHA-256 of ``text``, its 32 bytes repeated to ``dim``: byte / 127.5 - 1."""
    hexed = F.sha2(F.coalesce(text, F.lit("")), 256)
    byte = lambda h, i: F.conv(F.substr(h, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 127.5 - 1.0
    repeated = lambda v: F.slice(F.flatten(F.array_repeat(v, -(-dim // 32))), 1, dim)
    # one digest a text: inside the lambda of a higher-order function it would be taken again for each place
    raw = F.element_at(F.transform(F.array(hexed), lambda h: repeated(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: byte(h, i)))), 1)
    if not normalize:
        return raw
    return F.element_at(F.transform(F.array(raw), lambda v: l2_normalized(v)), 1)


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))
