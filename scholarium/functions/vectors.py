"""Column expressions on ``array<float>`` vectors, computed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x))


def unit(a: Column) -> Column:
    """Vector of length one; a zero vector stays zero."""
    length = norm(a)
    return F.when(length == 0, a).otherwise(F.transform(a, lambda x: x / length))


def euclidean(a: Column, b: Column) -> Column:
    """Euclidean distance."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x))


def similarity(distance: Column) -> Column:
    """Cosine distance to similarity, and back."""
    return F.lit(1.0) - distance


def standardise(a: Column, mean: Column, std: Column) -> Column:
    """Shift and scale per dimension; dimensions without spread are only shifted."""
    centred = F.zip_with(a, mean, lambda x, m: x - m)
    return F.zip_with(centred, std, lambda x, s: x / F.when(s == 0, F.lit(1.0)).otherwise(s))
