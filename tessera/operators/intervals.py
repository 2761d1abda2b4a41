"""Operators on intervals [start, end) in whole time units.

Overlap joins go through time buckets: an interval is listed in each bucket that it touches, rows join on
key and bucket, and a pair is reported in the first bucket that both touch. The join is an equi-join, so
it is shuffled and split like any other, and no pair of rows far apart is ever compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _buckets(start: Column, end: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(start / width).cast("long"), F.floor(F.greatest(start, end - 1) / width).cast("long")))


def islands(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """The union of the intervals of each key as disjoint intervals; touching ones merge, empty ones go."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0)
    marked = df.filter(F.col(end) > F.col(start)).withColumn("fresh_", fresh)
    marked = marked.withColumn("island_", F.sum("fresh_").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "island_").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("island_")


def union_length(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Length of the union of the intervals of each key."""
    return islands(df, keys, start, end).groupBy(*keys).agg(F.sum(F.col(end) - F.col(start)).alias("covered"))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], width: int, min_overlap: int = 0) -> DataFrame:
    """Pairs of equal keys whose intervals overlap by more than ``min_overlap``, with the shared part (lo, hi).

    ``left`` has l_start, l_end and ``right`` r_start, r_end; other columns must differ.
    """
    lb = left.withColumn("bucket_", _buckets(F.col("l_start"), F.col("l_end"), width))
    rb = right.withColumn("bucket_", _buckets(F.col("r_start"), F.col("r_end"), width))
    lo, hi = F.greatest("l_start", "r_start"), F.least("l_end", "r_end")
    both = lb.join(rb, [*keys, "bucket_"]).filter((hi - lo > min_overlap) & (F.floor(lo / width) == F.col("bucket_")))
    return both.withColumn("lo", lo).withColumn("hi", hi).drop("bucket_")


def best_overlap(left: DataFrame, right: DataFrame, keys: list[str], width: int, left_id: str, prefer: list[Column]) -> DataFrame:
    """For each left row the right row that overlaps it longest; ties by ``prefer``."""
    pairs = overlap_join(left, right, keys, width)
    order = Window.partitionBy(left_id).orderBy((F.col("hi") - F.col("lo")).desc(), *prefer)
    return pairs.withColumn("rank_", F.row_number().over(order)).filter("rank_ = 1").drop("rank_")


def points_in(points: DataFrame, spans: DataFrame, keys: list[str], width: int, point_id: str, prefer: list[Column], slack: int = 0, closed: bool = False) -> DataFrame:
    """Each point (column ``at``) with the first span (s_start, s_end) that holds it; points without one stay with nulls.

    Spans are half-open, widened by ``slack`` at both ends; ``closed`` includes the end itself.
    """
    end = F.col("s_end") + slack + (1 if closed else 0)
    start = F.col("s_start") - slack
    sb = spans.withColumn("bucket_", _buckets(start, F.greatest(end, start + 1), width))
    pb = points.withColumn("bucket_", F.floor(F.col("at") / width).cast("long"))
    hit = pb.join(sb, [*keys, "bucket_"]).filter((F.col("at") >= start) & (F.col("at") < end))
    order = Window.partitionBy(point_id).orderBy(*prefer)
    first = hit.withColumn("rank_", F.row_number().over(order)).filter("rank_ = 1")
    extra = [c for c in spans.columns if c not in keys]
    return points.join(first.select(point_id, *extra), point_id, "left")


def within_tolerance(left: DataFrame, right: DataFrame, keys: list[str], tolerance: int, anti: bool = False) -> DataFrame:
    """Left rows (column ``at``) with (or, ``anti``, without) a right row (``r_at``) of the same keys nearer than ``tolerance``."""
    near = right.withColumn("bucket_", F.explode(F.sequence(F.floor(F.col("r_at") / tolerance) - 1, F.floor(F.col("r_at") / tolerance) + 1)))
    near = near.select(*keys, "bucket_", "r_at")
    rows = left.withColumn("bucket_", F.floor(F.col("at") / tolerance))
    cond = [rows[k] == near[k] for k in [*keys, "bucket_"]] + [F.abs(rows["at"] - near["r_at"]) < tolerance]
    return rows.join(near, cond, "left_anti" if anti else "left_semi").drop("bucket_")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, r_at: str, carry: list[str], forward: bool = False) -> DataFrame:
    """Each left row with the last right row at or before it (``forward``: first at or after), or nulls.

    Both sides are sorted together once; no pairs are made. Equal times match; among right rows of
    equal time the one with the largest carried values wins (``forward``: the smallest).
    """
    lhs = left.select("*", F.col(at).alias("time_"), F.lit(1 if not forward else 0).alias("side_"), *[F.lit(None).cast(right.schema[c].dataType).alias(f"r_{c}_") for c in carry], F.lit(None).cast(right.schema[r_at].dataType).alias("r_time_"))
    empty = [F.lit(None).cast(f.dataType).alias(f.name) if f.name not in keys else F.col(f.name) for f in left.schema]
    rhs = right.select(*empty, F.col(r_at).alias("time_"), F.lit(0 if not forward else 1).alias("side_"), *[F.col(c).alias(f"r_{c}_") for c in carry], F.col(r_at).alias("r_time_"))
    order = Window.partitionBy(*keys)
    by = ["time_", "side_", *[f"r_{c}_" for c in carry]]
    frame = order.orderBy(*by).rowsBetween(Window.unboundedPreceding, 0) if not forward else order.orderBy(*by).rowsBetween(0, Window.unboundedFollowing)
    pick = (lambda c: F.last(c, True)) if not forward else (lambda c: F.first(c, True))
    both = lhs.unionByName(rhs)
    whole = F.struct(F.col("r_time_").alias("t"), *[F.col(f"r_{c}_").alias(c) for c in carry])
    both = both.withColumn("hit_", pick(F.when(F.col("r_time_").isNotNull(), whole)).over(frame))
    out = both.filter(F.col("side_") == (1 if not forward else 0))
    return out.select(*left.columns, F.col("hit_.t").alias(f"matched_{r_at}"), *[F.col(f"hit_.{c}").alias(f"matched_{c}") for c in carry])
