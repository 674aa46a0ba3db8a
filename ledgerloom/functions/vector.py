"""Vectors as arrays of numbers; all arithmetic in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 where the lengths differ or a norm is 0."""
    lengths = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (lengths == 0), F.lit(0.0)).otherwise(F.try_divide(dot(a, b), lengths))


def cosine_distance(a: Column, b: Column) -> Column:
    """0 to 2; null for a null vector."""
    return F.when(a.isNotNull() & b.isNotNull(), 1 - cosine_similarity(a, b))


def normalize(v: Column) -> Column:
    """Length 1; unchanged if the norm is 0."""
    n = norm(v)
    return F.when(n == 0, doubles(v)).otherwise(F.transform(doubles(v), lambda x: F.try_divide(x, n)))


def literal(values: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])
