"""Queries that run the greedy solvers; their results are tested against plain Python and by invariants."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators.sequences import shares_to_bounds
from tessera.session import table
from tessera.solvers import allocation as A


def _words(spark, sf_dir):
    """Words of each turn with times: 60 seconds parted by length."""
    rows = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"), F.posexplode(F.filter(F.split(F.coalesce("text", F.lit("")), "[ \\t\\r\\n]+"), lambda w: w != "")).alias("i", "word")
    )
    timed = shares_to_bounds(rows.withColumn("n", F.length("word")), ["turn_id"], ["i"], "n", F.lit(60.0))
    return timed.select("turn_id", "i", "word", F.col("b_start").alias("start"), F.col("b_end").alias("end"))


def _shots(spark, sf_dir):
    """Lines as shots of their supplier, numbered by order and line; parts are the media."""
    l = table(spark, sf_dir, "lineitem")
    shot = F.col("l_orderkey") * 10_000_000 + F.col("l_linenumber").cast("long") * 1_000_000 + F.col("l_partkey") % 1_000_000
    return l.withColumn("shot", shot).dropDuplicates(["l_suppkey", "shot"])


def k01_allocation(spark, sf_dir):
    """Each supplier's lines allotted to return flags up to 2000 units of quantity; each part used once."""
    tier = F.when(F.col("l_returnflag") == "N", 0).otherwise(1)
    rows = _shots(spark, sf_dir).select(
        "l_suppkey", F.col("l_returnflag").alias("requirement"), F.lit(2000.0).alias("target"), tier.alias("tier"), (1 - F.col("l_discount")).alias("similarity"),
        "shot", F.col("l_partkey").alias("media"), F.col("l_quantity").alias("seconds"),
    )
    return A.allocate(rows, "l_suppkey")


def k02_slots(spark, sf_dir):
    """Seven slots of each supplier (line numbers), each filled from the lines of its number, relaxing on part and flag."""
    rows = _shots(spark, sf_dir).select("l_suppkey", F.col("l_linenumber").cast("long").alias("slot"), "shot", F.col("l_partkey").alias("media"), F.col("l_extendedprice").alias("score"), F.col("l_returnflag").alias("family"))
    return A.fill_slots(rows, "l_suppkey")


def k03_timeline(spark, sf_dir):
    """Seven slots of each supplier, planned from its lines by hard rules, contract and diversity."""
    rows = _shots(spark, sf_dir).select(
        "l_suppkey", F.col("l_linenumber").cast("long").alias("slot"), "shot", F.col("l_partkey").alias("media"), F.col("l_returnflag").alias("signature"),
        F.round(1 - F.col("l_discount") * 5, 6).alias("score"), (F.col("l_quantity") > 5).alias("allowed"), (F.col("l_quantity") > 25).alias("fits"),
    )
    return A.plan_timeline(rows, "l_suppkey")


def k08_apportion(spark, sf_dir):
    """60 seconds of each conversation among its turns by length, 1 to 20 seconds each."""
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("id"), F.length("text").cast("double").alias("weight"), F.lit(1.0).alias("least"), F.lit(20.0).alias("most"), F.lit(60.0).alias("total"))
    return A.apportion(c, "conv_id")


def e06_cues(spark, sf_dir):
    return A.cues(_words(spark, sf_dir), "turn_id").select("turn_id", "cue", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "line")


def e05_scene_chunks(spark, sf_dir):
    return A.chunks(_words(spark, sf_dir), "turn_id", 8.0, 25.0).select("turn_id", "chunk", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "words")


QUERIES = {f.__name__: f for f in (k01_allocation, k02_slots, k03_timeline, k08_apportion, e05_scene_chunks, e06_cues)}
ORACLE: dict[str, str] = {}
