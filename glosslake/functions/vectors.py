"""Vector arithmetic on array columns; elements are doubles before they multiply."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(_doubles(a), 1, n), F.slice(_doubles(b), 1, n), lambda x, y: x * y)
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    norm = l2_norm(v)
    return F.when(norm == 0, _doubles(v)).otherwise(F.transform(_doubles(v), lambda x: x / norm))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for empty vectors, other lengths and zero vectors."""
    norms = l2_norm(a) * l2_norm(b)
    usable = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (norms > 0)
    return F.when(usable, dot(a, b) / norms).otherwise(F.lit(0.0))


def head(v: Column, n: int = 8) -> Column:
    return F.slice(v, 1, n)
