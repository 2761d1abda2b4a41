"""Operators on ordered rows: runs, sessions, neighbours, running figures, windows over media time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def run_ids(df: DataFrame, keys: list[str], order: list[str], value: str, out: str = "run") -> DataFrame:
    """Numbers the runs of equal ``value`` within each key from 1 (gaps and islands)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    change = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("change_", change).withColumn(out, F.sum("change_").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("change_")


def gap_sessions(df: DataFrame, keys: list[str], at: str, gap: int, out: str = "session") -> DataFrame:
    """Numbers sessions that part where the time to the row before is above ``gap``."""
    w = Window.partitionBy(*keys).orderBy(at)
    fresh = F.when(F.col(at) - F.lag(at).over(w) > gap, 1).otherwise(0)
    return df.withColumn("fresh_", fresh).withColumn(out, F.sum("fresh_").over(w.rangeBetween(Window.unboundedPreceding, 0))).drop("fresh_")


def repeats_within(df: DataFrame, keys: list[str], order: list[str], value: str, last: int, out: str = "repeats") -> DataFrame:
    """Whether ``value`` occurs among the ``last`` rows before."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-last, -1)
    return df.withColumn(out, F.coalesce(F.array_contains(F.collect_list(value).over(w), F.col(value)), F.lit(False)))


def uses_before(df: DataFrame, keys: list[str], order: list[str], out: str = "used") -> DataFrame:
    """How many rows of the same keys come before."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def ema(df: DataFrame, keys: list[str], order: str, value: str, alpha: float, out: str = "ema") -> DataFrame:
    """Exponential moving average per key at its last row; the first value seeds it. Keys hold bounded series."""
    series = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v"))))
    rolled = F.aggregate(
        F.col("s"), F.lit(None).cast("double"), lambda acc, x: F.when(acc.isNull(), x["v"]).otherwise(alpha * x["v"] + (1 - alpha) * acc)
    )
    return df.groupBy(*keys).agg(series.alias("s")).select(*keys, rolled.alias(out))


def tumbling(df: DataFrame, length: Column, width: int) -> DataFrame:
    """A row for each window of ``width`` units that covers [0, length): number, w_start, w_end; the last may be short."""
    n = F.ceil(length / width).cast("long")
    rows = df.filter(length > 0).withColumn("number", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    start = F.col("number") * width
    return rows.withColumn("w_start", start).withColumn("w_end", F.least(start + width, length))


def hopping(df: DataFrame, start: Column, end: Column, widths: list[int], most: int) -> DataFrame:
    """Sub-windows of the given widths, laid end to end within [start, end), at most ``most`` a row, by (h_start, h_end)."""
    parts = []
    for w in widths:
        n = F.floor((end - start) / w).cast("long")
        parts.append(F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.struct((start + i * w).alias("h_start"), (start + (i + 1) * w).alias("h_end")))))
    none = F.expr("cast(array() as array<struct<h_start:bigint,h_end:bigint>>)")
    every = F.array_sort(F.array_distinct(F.concat(*[F.coalesce(p, none) for p in parts])))
    return df.withColumn("h_", F.explode(F.slice(every, 1, most))).select(*df.columns, "h_.*")


def shares_to_bounds(df: DataFrame, keys: list[str], order: list[str], weight: str, total: Column) -> DataFrame:
    """Cumulative bounds (b_start, b_end) that part ``total`` of each key in proportion to ``weight``."""
    w = Window.partitionBy(*keys)
    run = F.sum(weight).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    whole = F.sum(weight).over(w)
    return df.withColumn("b_start", total * (run - F.col(weight)) / whole).withColumn("b_end", total * run / whole)


def before_in_order(df: DataFrame, keys: list[str], order: str, value: str, out: str, chunk: int = 4096) -> DataFrame:
    """Adds the ``value`` of the row before in each key, by a whole-number ``order``, null at the first.

    For keys that hold a large part of all rows: rows are windowed by steps of ``chunk`` of the order, and only the last
    row of each step goes into a window over the whole key.
    """
    rows = df.withColumn("chunk_", F.floor(F.col(order) / chunk))
    last = rows.groupBy(*keys, "chunk_").agg(F.max_by(F.struct(F.col(value).alias("v")), order).alias("l_"))
    held = last.withColumn("held_", F.lag("l_").over(Window.partitionBy(*keys).orderBy("chunk_"))).drop("l_")
    w = Window.partitionBy(*keys, "chunk_").orderBy(order)
    rows = rows.withColumn("first_", F.row_number().over(w) == 1).withColumn(out, F.lag(value).over(w))
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"h.{k}")) for k in (*keys, "chunk_")]
    joined = rows.alias("r").join(held.alias("h"), same, "left")
    return joined.select(*[F.col(f"r.{c}") for c in df.columns], F.when(F.col("r.first_"), F.col("h.held_.v")).otherwise(F.col(f"r.{out}")).alias(out))
