"""Vector top-k with a prefilter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.vector import constant, cosine


def prefiltered_topk(
    df: DataFrame, query: list[float], *, k: int, where: str | None = None, id_col: str = "id", vec_col: str = "embedding"
) -> DataFrame:
    """The k rows most similar to ``query`` among those that pass ``where``; ties go to the smaller id.

    The predicate reaches the scan, and sort plus limit become one top-k per task.
    """
    if where:
        df = df.where(where)
    scored = df.withColumn("score", cosine(F.col(vec_col), constant(query)))
    return scored.filter("score IS NOT NULL").orderBy(F.desc("score"), id_col).limit(k)


#: Bank rows that are sent to all tasks, and beyond that the rows of a block.
BANK_ROWS = 10_000


def best_of_bank(df: DataFrame, bank: DataFrame, key: str, value: Column, vec_col: str = "embedding") -> DataFrame:
    """(key, best, s): for each vector the bank_label with the largest ``value``, a column of the cosine ``s`` and of the
    bank's columns; ties go to the smaller label. The bank (bank_label, mean, ...) is a stated query set.

    A bank within BANK_ROWS is sent to all tasks; a larger one meets the vectors block by block through an equi-join.
    """
    n = bank.count()
    vectors = df.select(key, vec_col)
    if n <= BANK_ROWS:
        pairs = vectors.join(F.broadcast(bank))
    else:
        blocks = -(-n // BANK_ROWS)
        numbered = bank.withColumn("block_", F.pmod(F.xxhash64("bank_label"), F.lit(blocks)))
        pairs = vectors.withColumn("block_", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).join(numbered, "block_")
    pairs = pairs.withColumn("s", cosine(F.col(vec_col), F.col("mean"))).withColumn("s", value)
    best = pairs.groupBy(key).agg(F.max(F.struct("s", (-F.col("bank_label")).alias("l"))).alias("m"))
    return best.select(key, (-F.col("m.l")).alias("best"), F.col("m.s").alias("s"))
