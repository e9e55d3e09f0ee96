"""Vector expressions on array<float>, reduced in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 for unequal lengths, empty and zero vectors."""
    product = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (F.size(a) == 0) | (product == 0), 0.0).otherwise(dot(a, b) / product)


def l2(a: Column, b: Column) -> Column:
    """1e10 for unequal lengths."""
    square = F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) != F.size(b), 1e10).otherwise(F.sqrt(square))


def inner_distance(a: Column, b: Column) -> Column:
    return 1.0 - dot(a, b)


def normalize(a: Column) -> Column:
    """Unit length; the zero vector stays."""
    return F.when(norm(a) == 0, a.cast("array<double>")).otherwise(F.transform(a, lambda x: x.cast("double") / norm(a)))


def literal(vector) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))
