"""Vectors of whole numbers: what whitening and code compression work on."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest sum of products that float64, and int64, hold exactly.
FLOAT_EXACT, LONG_EXACT = 1 << 53, 1 << 62


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return vector.isNotNull() & F.coalesce(F.forall(vector, fine), F.lit(False))


def whole(vector: Column, scale: int) -> Column:
    """floor(scale * c) of each entry c, as longs; beyond the range of a long its end."""
    return F.transform(vector, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))


def whole_vectors(df: DataFrame, column: str, scale: int, name: str) -> DataFrame:
    """The rows whose vector is usable, with the vector of whole numbers as column ``name``."""
    return df.filter(usable(F.col(column))).withColumn(name, whole(F.col(column), scale))


def dimension(df: DataFrame, name: str) -> int:
    """The length that most vectors have, the longest of those; 0 without rows."""
    sizes = df.groupBy(F.size(name).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return sizes["d"] if sizes else 0


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """An Arrow column of lists of ``width`` numbers as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def exact(x: np.ndarray, bound: int) -> np.ndarray:
    """x as int64 where results up to ``bound`` fit it, else as Python's whole numbers."""
    return x.astype(np.int64) if bound < LONG_EXACT else x.astype(object)


def largest(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0
