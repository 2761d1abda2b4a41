"""Whitening of embeddings: moments by partition, merged pairwise, checked by a second pass.

Each partition of the fit list (the distinct vectors) computes count, local mean and centred scatter; two of these
merge by the formula of Chan, Golub and LeVeque, within a partition and then in a ``treeReduce``. The driver, which
sees a d x d matrix only, takes the eigenvectors of the covariance. A second pass over the fit list whitens it and
measures how far the result's covariance is from the identity, by the same moments.

Sums of the whole-number vectors are kept exactly beside the moments.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut
from tessera.llm.vectors import dimension, exact, largest, matrix, whole_vectors

SCALE, COMPONENTS = 256, 4
#: count, exact sums, mean, scatter
Moments = tuple[int, list[int], np.ndarray, np.ndarray]


def moments(x: np.ndarray, sums: list[int]) -> Moments:
    """Of the rows of a matrix of floats; ``sums`` goes along."""
    mean = x.mean(axis=0)
    centred = x - mean
    mean, centred = mean + centred.mean(axis=0), centred - centred.mean(axis=0)  # what rounding left of the mean
    return len(x), sums, mean, centred.T @ centred


def merge(a: Moments, b: Moments) -> Moments:
    """Moments of both parts' rows together."""
    if not a[0] or not b[0]:
        return a if a[0] else b
    n = a[0] + b[0]
    apart = b[2] - a[2]
    mean = a[2] + apart * (b[0] / n)
    return n, [x + y for x, y in zip(a[1], b[1])], mean, a[3] + b[3] + np.outer(apart, apart) * (a[0] * b[0] / n)


PART = "n long, sums array<decimal(38,0)>, mean binary, scatter binary"


def moments_of(vectors: DataFrame, d: int, seen: Callable[[np.ndarray], np.ndarray], width: int) -> Moments:
    """Moments of ``seen`` of the vectors (column x, d long), which has ``width`` columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: Moments = (0, [0] * d, np.zeros(width), np.zeros((width, width)))
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0), d)
                sums = [int(v) for v in exact(x, len(x) * largest(x)).sum(axis=0)]
                out = merge(out, moments(seen(x), sums))
        columns = [pa.array([out[0]]), pa.array([[Decimal(v) for v in out[1]]], pa.list_(pa.decimal128(38, 0))), pa.array([out[2].tobytes()]), pa.array([out[3].tobytes()])]
        yield pa.RecordBatch.from_arrays(columns, names=["n", "sums", "mean", "scatter"])

    # written first, so that a task of the reduction runs one Python worker
    parts = cut(vectors.select("x").mapInArrow(run, PART), "moments").rdd
    if not parts.getNumPartitions():
        return 0, [0] * d, np.zeros(width), np.zeros((width, width))
    read = lambda r: (r["n"], [int(v) for v in r["sums"]], np.frombuffer(r["mean"]), np.frombuffer(r["scatter"]).reshape(width, width))
    return parts.map(read).treeReduce(merge)


@dataclass
class Whitening:
    """n vectors of the fit list, their sums, and unit eigenvectors of their covariance with falling eigenvalues."""

    n: int
    sums: list[int]
    values: np.ndarray
    axes: np.ndarray
    trace: float
    identity_error: float = 0.0

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whole vectors centred, on the axes, in units of the standard deviation there."""
        centre = np.array([v / self.n for v in self.sums])
        return (x - centre) @ self.axes.T / np.sqrt(self.values)


def fit(vectors: DataFrame, d: int, components: int = COMPONENTS) -> Whitening | None:
    """From a table of distinct vectors (column x); None without rows.

    Axes whose variance is 0 up to rounding are left out, as nothing can be divided by it: there may be fewer than
    ``components``, or none.
    """
    n, sums, _, scatter = moments_of(vectors, d, lambda x: x.astype(np.float64), d)
    if not n or not d:
        return None
    values, axes = np.linalg.eigh((scatter + scatter.T) / (2 * n))
    values, axes = values[::-1], axes.T[::-1]
    keep = [i for i in range(min(components, d)) if values[i] > d * np.finfo(float).eps * max(values[0], 0.0)]
    model = Whitening(n, sums, values[keep], axes[keep], float(np.trace(scatter) / n))
    if keep:
        _, _, _, again = moments_of(vectors, d, model.project, len(keep))
        model.identity_error = float(np.abs(again / n - np.eye(len(keep))).max())
    return model


def whiten(df: DataFrame, column: str = "embedding", scale: int = SCALE, components: int = COMPONENTS) -> DataFrame:
    """The rows with a usable vector, with n, deviation, whitened, explained and identity_error.

    A vector is made of whole numbers x, floor(scale * c) of its entries c; the fit list has each distinct one once.
    ``whitened`` and ``explained`` (share of the variance) are arrays with an entry for each axis, by falling variance;
    ``deviation`` is the sum of (n * x - S)^2 over the dimensions, exact, S the sums of the fit list.

    Vectors that are null, hold null or numbers that are not finite, or are of another length than most, are dropped;
    repeated rows all stay. If all vectors are equal the arrays are empty. An empty table gives an empty one. Other columns
    stay; those of the names above are replaced.
    """
    rows = whole_vectors(df.drop("n", "deviation", "whitened", "explained", "identity_error"), column, scale, "x__")
    vectors = cut(rows.select(F.col("x__").alias("x")).distinct(), "fit_list")
    d = dimension(vectors, "x")
    rows = rows.filter(F.size("x__") == d)
    model = fit(vectors.filter(F.size("x") == d), d, components)
    if model is None:
        model = Whitening(0, [0] * d, np.zeros(0), np.zeros((0, d)), 1.0)
    shared = df.sparkSession.sparkContext.broadcast(model)  # components x d numbers

    @F.arrow_udf("struct<deviation: decimal(38,0), whitened: array<double>>")
    def place(x: pa.Array) -> pa.Array:
        m = shared.value
        values, sums = matrix(x, d), np.array(m.sums, dtype=object)
        bound = d * (m.n * largest(values) + max((abs(v) for v in m.sums), default=0)) ** 2
        off = exact(values, bound) * m.n - exact(sums, bound)
        deviation = [Decimal(int(v)) for v in (off * off).sum(axis=1)]
        out = m.project(values) if len(m.values) else np.zeros((len(values), 0))
        offsets = pa.array(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1])
        lists = pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))
        return pa.StructArray.from_arrays([pa.array(deviation, pa.decimal128(38, 0)), lists], names=["deviation", "whitened"])

    out = rows.withColumn("n", F.lit(model.n).cast("long")).withColumn("p__", place("x__"))
    out = out.withColumn("deviation", F.col("p__.deviation")).withColumn("whitened", F.col("p__.whitened"))
    out = out.withColumn("explained", F.array(*[F.lit(float(v / model.trace)) for v in model.values]).cast("array<double>"))
    return out.withColumn("identity_error", F.lit(model.identity_error)).drop("x__", "p__")
