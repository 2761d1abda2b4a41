"""Progressive confirmation and re-matching of scenes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def until_target(df: DataFrame, keys: list[str], order: list[Column | str], confirmed: Column, seconds: Column, target: float, shots: int, batch: int, batches: int) -> DataFrame:
    """The rows that are looked at before the goal of each key is met: whole batches of ``batch`` rows in ``order``, until
    those confirmed before last ``target`` seconds and number ``shots``, ``batches`` at most.

    One window of running sums; adds ``batch`` from 0. Keys without a goal (0 and 0) look at nothing.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = df.withColumn("batch", F.floor((F.row_number().over(w) - 1) / batch).cast("long")).withColumn("ok_", confirmed)
    sums = rows.groupBy(*keys, "batch").agg(F.sum(F.when(F.col("ok_"), F.greatest(seconds, F.lit(0.0))).otherwise(0.0)).alias("s_"), F.count_if("ok_").alias("c_"))
    before = Window.partitionBy(*keys).orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)
    have = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    sums = sums.filter(F.col("batch") < batches).withColumn("open_", (have("s_") < target) | (have("c_") < shots))
    return rows.join(sums.filter("open_").select(*keys, "batch"), [*keys, "batch"]).drop("ok_")


def rematch(current: DataFrame, pool: DataFrame, scene: str, bad: Column, fits: Column, score: str) -> DataFrame:
    """Replaces shots of scenes from a pool: (scene, shot, state).

    ``current`` and ``pool``: scene, shot, score and the columns of ``bad`` (a shot that breaks the brief) and ``fits``. Of
    each scene the shots that are bad are replaced, all if none is, each by the best unused shot of the scene's pool that
    is not one of them. A scene is changed only if there is an alternative for each, all fit, and the sum of scores is no
    worse; state is replaced or the reason why not.
    """
    own = Window.partitionBy(scene)
    now = current.withColumn("bad_", bad).withColumn("any_", F.max("bad_").over(own))
    now = now.withColumn("out_", F.col("bad_") | ~F.col("any_"))
    out = now.filter("out_").withColumn("n_", F.row_number().over(own.orderBy(F.desc(score), "shot")))
    free = pool.join(current.select(scene, "shot"), [scene, "shot"], "left_anti").withColumn("fits_", fits)
    free = free.withColumn("n_", F.row_number().over(own.orderBy(F.desc("fits_"), F.desc(score), "shot")))
    new = free.select(scene, "n_", F.col("shot").alias("new_"), F.col(score).alias("new_score_"), "fits_")
    met = out.select(scene, "n_", "shot", F.col(score).alias("old_score_")).join(new, [scene, "n_"], "left")
    all_ = F.bool_and(F.col("new_").isNotNull())
    verdict = met.groupBy(scene).agg(
        F.when(~all_, "no alternative").when(~F.bool_and(F.coalesce("fits_", F.lit(False))), "breaks the brief").when(F.sum("new_score_") < F.sum("old_score_"), "worse").otherwise("replaced").alias("state")
    )
    kept = now.filter("NOT out_").select(scene, "shot")
    moved = met.join(verdict, scene).select(scene, F.when(F.col("state") == "replaced", F.col("new_")).otherwise(F.col("shot")).alias("shot"))
    return kept.unionByName(moved).join(verdict, scene).select(scene, "shot", "state")
