"""Vector arithmetic on array columns, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where either vector is all zeros or null."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def guarded_cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where the lengths differ or a vector is all zeros or null."""
    return F.coalesce(F.when(F.size(a) == F.size(b), cosine(a, b)), F.lit(0.0))


def constant(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])
