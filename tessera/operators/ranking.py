"""Ranking, top-k, fallback tiers, first-available pools."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str | None = None) -> DataFrame:
    """The first k rows of each key; per key at most k rows leave a task, as Spark limits the window early."""
    r = rank or "rank_"
    out = df.withColumn(r, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(r) <= k)
    return out if rank else out.drop(r)


def first_tier(df: DataFrame, keys: list[str], tiers: list[Column], out: str = "tier") -> DataFrame:
    """Rows of the first tier (condition) that any row of the key meets; rows that meet none are dropped."""
    tier = F.coalesce(*[F.when(c, F.lit(i)) for i, c in enumerate(tiers)])
    rows = df.withColumn(out, tier).filter(F.col(out).isNotNull())
    return rows.withColumn("least_", F.min(out).over(Window.partitionBy(*keys))).filter(F.col(out) == F.col("least_")).drop("least_")


def cascade(df: DataFrame, keys: list[str], rules: list[Column]) -> DataFrame:
    """Applies rules one after another per key, each only if it leaves a row; adds ``kept_rules``, the rules that held.

    A row's rules are bits of a number. One window gathers the distinct numbers of a key, at most 2 to the power of the rules, and a fold over the rules
    finds the bits that a row must have. At most 62 rules.
    """
    if len(rules) > 62:
        raise ValueError("at most 62 rules")
    if not rules:
        return df.withColumn("kept_rules", F.lit(0))
    mask = reduce(lambda a, b: a + b, [F.when(F.coalesce(r, F.lit(False)), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, r in enumerate(rules)])
    rows = df.withColumn("mask_", mask).withColumn("masks_", F.collect_set("mask_").over(Window.partitionBy(*keys)))
    none = F.struct(F.lit(0).cast("long").alias("must"), F.lit(0).alias("kept"))

    def step(acc, bit):
        more = acc["must"].bitwiseOR(bit)
        left = F.exists("masks_", lambda m: m.bitwiseAND(more) == more)
        return F.when(left, F.struct(more.alias("must"), (acc["kept"] + 1).alias("kept"))).otherwise(acc)

    bits = F.array(*[F.lit(1 << i).cast("long") for i in range(len(rules))])
    rows = rows.withColumn("held_", F.aggregate(bits, none, step))
    rows = rows.filter(F.col("mask_").bitwiseAND(F.col("held_.must")) == F.col("held_.must"))
    return rows.withColumn("kept_rules", F.col("held_.kept")).drop("mask_", "masks_", "held_")


def dealt(df: DataFrame, keys: list[str], shares: int = 4) -> DataFrame:
    """Rows dealt by key to ``shares`` partitions for each one that they are read in, so what a task sorts is bounded by the size of the parts
    that files are read in, not by a share of all rows. For rows read without a shuffle before."""
    return df.repartition(shares * max(1, df.rdd.getNumPartitions()), *keys)


def floor_or_best(df: DataFrame, keys: list[str], score: str, floor: float, k: int, order: list[Column]) -> DataFrame:
    """Rows with at least ``floor``; for keys without any, the first k instead."""
    w = Window.partitionBy(*keys)
    rows = df.withColumn("ok_", F.col(score) >= floor).withColumn("any_", F.max("ok_").over(w))
    rows = rows.withColumn("n_", F.row_number().over(w.orderBy(*order)))
    return rows.filter(F.when(F.col("any_"), F.col("ok_")).otherwise(F.col("n_") <= k)).drop("ok_", "any_", "n_")


def even_sample(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """n rows of each key spread evenly, first and last included; all rows of shorter keys."""
    w = Window.partitionBy(*keys)
    rows = df.withColumn("at_", F.row_number().over(w.orderBy(*order)) - 1).withColumn("of_", F.count(F.lit(1)).over(w))
    if n < 2:
        return rows.filter("at_ = 0").drop("at_", "of_")
    # row at_ is taken if some i of n - 1 steps rounds to it
    step = (F.col("of_") - 1) / F.lit(float(n - 1))
    i = F.round(F.col("at_") / step)
    hit = F.exists(F.array(i - 1, i, i + 1), lambda j: (j >= 0) & (j <= n - 1) & (F.floor(j * step + 0.5) == F.col("at_")))
    return rows.filter((F.col("of_") <= n) | hit).drop("at_", "of_")


def banded(score: Column, width: float) -> Column:
    """A score cut to bands, which makes near ties equal and keeps the order total."""
    return F.floor(score / width)


def any_of(conditions: list[Column]) -> Column:
    """Whether one condition holds; false without conditions."""
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """Name of the first rule whose condition holds, null if none does."""
    return F.coalesce(*[F.when(c, F.lit(name)) for name, c in rules]) if rules else F.lit(None).cast("string")


def sent_if_small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """The side of a join: sent to all tasks if it has at most ``most`` rows, else left to be shuffled."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


#: Size of the quantile sketches, even shares of the rows that they are asked for, and how many of these lie to both sides of a place (over six times the
#: sketch's error).
SKETCH, GRID, MARGIN = 1024, 500, 10


def at_rank(df: DataFrame, keys: list[str], value: str, rank) -> DataFrame:
    """(keys, value): the value at place ``rank(n)`` (from 1) of each key's n rows in order; nulls and NaN do not count.

    Exact, from two passes and no sort of a key's rows: mergeable quantile sketches give cuts close around the place, whatever the values' distribution;
    then rows below them are only counted, those between are counted by step and value, and the step that holds the place by value. So a task sees a
    small share of a key's distinct values. A place outside of the sketch's cuts, which is all but impossible, raises an error.
    """
    rows = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*keys, F.col(value).alias("v_"), F.col(value).cast("double").alias("d_"))
    per = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_"), F.min("d_").alias("lo_"), F.max("d_").alias("hi_"), F.kll_sketch_agg_double("d_", F.lit(SKETCH)).alias("s_"))
    per = per.withColumn("at_", F.least(F.greatest(rank(F.col("n_")), F.lit(1)), F.col("n_")).cast("long"))
    first = F.greatest(F.lit(0), F.floor(F.col("at_") * GRID / F.col("n_")) - MARGIN)
    last = F.least(F.lit(GRID), F.floor(F.col("at_") * GRID / F.col("n_")) + MARGIN + 1)
    grid = F.kll_sketch_get_quantile_double("s_", F.array(*[F.lit(i / GRID) for i in range(GRID + 1)]))
    # cuts at the ends are the ends
    grid = F.transform(grid, lambda c, i: F.when(i == 0, F.col("lo_")).when(i == GRID, F.col("hi_")).otherwise(c))
    per = per.select(*keys, "at_", F.slice(grid, (first + 1).cast("int"), (last - first + 1).cast("int")).alias("cuts_"))
    step = F.when(F.col("d_") < F.get("cuts_", F.lit(0)), -1).otherwise(F.size(F.filter("cuts_", lambda c: c < F.col("d_"))))
    near = rows.join(sent_if_small(per), keys).filter(F.col("d_") <= F.element_at("cuts_", -1)).withColumn("step_", step)
    counts = near.groupBy(*keys, "at_", "step_", F.when(F.col("step_") >= 0, F.col("v_")).alias("v_")).agg(F.count(F.lit(1)).alias("c_"))
    run = Window.partitionBy(*keys).orderBy("step_").rowsBetween(Window.unboundedPreceding, 0)
    steps = counts.groupBy(*keys, "at_", "step_").agg(F.sum("c_").alias("c_")).withColumn("upto_", F.sum("c_").over(run))
    held = steps.filter((F.col("upto_") >= F.col("at_")) & (F.col("upto_") - F.col("c_") < F.col("at_")))
    held = held.select(*keys, F.col("step_").alias("held_"), (F.col("at_") - F.col("upto_") + F.col("c_")).alias("left_"))
    inside = counts.join(sent_if_small(held), keys).filter(F.col("step_") == F.col("held_"))
    run = Window.partitionBy(*keys).orderBy("v_").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("upto_", F.sum("c_").over(run)).filter(F.col("upto_") >= F.col("left_"))
    out = per.select(*keys).join(inside.groupBy(*keys).agg(F.min("v_").alias(value), F.max("held_").alias("held_")), keys, "left")
    missed = F.col("held_").isNull() | (F.col("held_") < 0)
    return out.select(*keys, F.when(missed, F.raise_error(F.lit("the sketch missed the place")).cast(df.schema[value].dataType)).otherwise(F.col(value)).alias(value))


def allowed_or_pools(df: DataFrame, keys: list[str], hard: Column, rules: list[Column], pools: list[Column], order: list[Column], most: int = 12) -> DataFrame:
    """Rows that pass ``hard``, narrowed by ``rules`` one after another as long as rows are left; for keys without any the
    first of the ``pools`` that has rows, its first ``most`` in ``order``. Adds ``pool``: 0, or the pool's number from 1."""
    w = Window.partitionBy(*keys)
    rows = df.withColumn("hard_", F.coalesce(hard, F.lit(False))).withColumn("some_", F.max("hard_").over(w))
    passed = cascade(rows.filter("hard_").drop("hard_", "some_"), keys, rules).drop("kept_rules").withColumn("pool", F.lit(0))
    rest = first_tier(rows.filter("NOT some_").drop("hard_", "some_"), keys, pools, "pool").withColumn("pool", F.col("pool") + 1)
    return passed.unionByName(top_k(rest, keys, order, most))
