"""Vector columns: inner product, norm, cosine of unit vectors, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def inner(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(inner(a, a))


def l2_normalised(a: Column | str) -> Column:
    """A zero vector stays as it is."""
    return F.when(norm(a) == 0, F.col(a) if isinstance(a, str) else a).otherwise(F.transform(a, lambda x: x / norm(a)))
