"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source is a stream of words: its documents in a hashed order, repeated without end. The
stream is cut into blocks of equal size. Slots of the mix get the golden-ratio points i * phi mod 1;
a point falls into the interval of one source on the cumulative weights, and the rank of the slot
among those of its source says which block it takes. Every prefix of the schedule is
therefore mixed nearly in proportion.

Scale: prefix sums run in two steps, in small chunks of the hash order (or of the slots) and then
over chunk totals, so no source passes through one task. Only per-source figures reach the driver. Each step is written as
a table, so that the driver plans few joins at once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, words

PHI = 0.6180339887498949
BLOCK = 1024
ROWS_PER_CHUNK = 256
MAX_CHUNKS = 65536
BUCKETS = 4096
MAX_BROADCAST_ROWS = 100_000


def water_fill(sources: DataFrame, total: float) -> tuple[DataFrame, float]:
    """Adds ``target``: ``total`` shared by ``weight``, no source above ``cap``, the excess reshared.

    ``total`` must not be above the sum of the caps. Each round is one aggregate; only sums reach the driver.
    """
    level, capped = 0.0, None
    while True:
        over = F.lit(False) if capped is None else (F.col("weight") * F.lit(level) > F.col("cap"))
        held, free, n = sources.select(
            F.sum(F.when(over, F.col("cap")).otherwise(0.0)),
            F.sum(F.when(over, 0).otherwise(F.col("weight"))),
            F.count(F.when(over, 1)),
        ).first()
        if n == capped:
            break
        capped = n
        if not free:
            break
        level = (total - (held or 0.0)) / free
    target = F.least(F.col("weight") * F.lit(level), F.col("cap"))
    return sources.withColumn("target", target), level


def source_plan(rows: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per source: source, source_size, sid (rank by code point, null last), weight, cap, target, quota.

    The rank needs the sources in one task: one row per source, not per document.
    """
    spark = rows.sparkSession
    sized = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), F.pmod("sid", F.lit(len(weights))).cast("int") + 1)
    plan = cut(
        sized.withColumn("sid", rank).withColumn("weight", pick).withColumn("cap", F.col("source_size") * F.lit(float(cap))),
        "sources",
    )
    total = plan.agg(F.sum("source_size")).first()[0] or 0
    plan, _ = water_fill(plan, total * share)
    return plan.withColumn("quota", F.floor("target").cast("long"))


def _small(df: DataFrame) -> DataFrame:
    """A broadcast hint if the table is within the bound, else the table for a shuffled join."""
    return F.broadcast(df) if df.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS else df


def schedule(plan: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix as rows (slot, sid, rank): slot takes block ``rank`` of the source's stream.

    Each source has exactly ceil(quota / block) slots: what the points give beyond that is left out and
    the few that they lack come last.
    """
    spark = plan.sparkSession
    need = cut(plan.select("sid", F.ceil(F.col("quota") / F.lit(block)).cast("long").alias("need")), "need")
    slots = need.agg(F.sum("need")).first()[0] or 0
    part = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    bounds = need.filter("need > 0").withColumn("hi_n", F.sum("need").over(part))
    lo, hi = (F.col("hi_n") - F.col("need")) / F.lit(float(max(1, slots))), F.col("hi_n") / F.lit(float(max(1, slots)))
    first, last = F.floor(F.col("lo") * BUCKETS).cast("long"), F.least(F.floor(F.col("hi") * BUCKETS).cast("long"), F.lit(BUCKETS - 1).cast("long"))
    ranges = cut(bounds.select("sid", lo.alias("lo"), hi.alias("hi")).withColumn("bucket", F.explode(F.sequence(first, last))), "ranges")
    x = F.col("slot") * F.lit(PHI)
    points = spark.range(slots).withColumnRenamed("id", "slot").withColumn("u", x - F.floor(x))
    points = points.withColumn("bucket", F.floor(F.col("u") * BUCKETS).cast("long"))
    placed = points.join(_small(ranges), "bucket").filter("u >= lo AND u < hi")
    placed = cut(placed.select("slot", "sid", F.floor(F.col("slot") / F.lit(BUCKETS)).alias("chunk")), "slots")
    totals = placed.groupBy("sid", "chunk").count()
    before = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("sid", "chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot")) - 1
    ranked = placed.withColumn("inside", inside).join(offsets, ["sid", "chunk"]).withColumn("rank", F.col("offset") + F.col("inside"))
    kept = ranked.join(_small(need), "sid")
    kept = kept.filter("rank < need").select("slot", "sid", "rank")
    had = totals.groupBy("sid").agg(F.sum("count").alias("had"))
    lacking = (
        need.join(had, "sid", "left")
        .withColumn("had", F.coalesce("had", F.lit(0).cast("long")))
        .filter("had < need")
        .withColumn("rank", F.explode(F.sequence(F.col("had"), F.col("need") - 1)))
        .select((F.lit(slots) + F.col("rank")).alias("slot"), "sid", "rank")
    )
    return cut(kept.unionByName(lacking), "schedule")


def placed_documents(docs: DataFrame, plan: DataFrame, size: Column, seed: str = "") -> DataFrame:
    """Each document's place in the stream of its source: start, and a row key (sid, chunk, ordinal)."""
    n = docs.count()
    chunks = max(16, min(MAX_CHUNKS, math.ceil(n / ROWS_PER_CHUNK)))
    order = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    rows = docs.select("doc_id", "source", size.alias("size")).withColumn("order", order)
    rows = rows.withColumn("chunk", F.floor(F.conv(F.substring("order", 1, 8), 16, 10).cast("long") * F.lit(chunks) / F.lit(2**32)))
    rows = rows.join(_small(plan.select(F.col("source").alias("s_"), "sid", "source_size", "target", "quota")), F.col("source").eqNullSafe(F.col("s_"))).drop("s_")
    inside = Window.partitionBy("sid", "chunk").orderBy("order", "doc_id", "size")
    rows = rows.withColumn("ordinal", F.row_number().over(inside)).withColumn(
        "inside", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    )
    before = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("sid", "chunk").agg(F.sum("size").alias("t"))
    offsets = totals.select("sid", "chunk", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("offset"))
    return rows.join(offsets, ["sid", "chunk"]).withColumn("start", F.col("offset") + F.col("inside"))


def mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, block: int = BLOCK, seed: str = "") -> DataFrame:
    """The mix as pieces of documents: slot, doc_id, source, from_word, n_words in schedule order of ``slot``.

    Null or empty texts have size 0 and are never taken; null is a source of its own; repeated rows
    are separate documents. An empty table gives an empty mix.
    """
    return _pieces(*_prepared(docs, weights, share, cap, seed), block).select(
        "slot", "doc_id", "source", (F.col("lo") - F.col("begin")).alias("from_word"), (F.col("hi") - F.col("lo")).alias("n_words")
    )


def _prepared(docs, weights, share, cap, seed):
    sized = cut(docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size")), "sizes")
    plan = cut(source_plan(sized, weights, share, cap), "plan")
    return placed_documents(sized, plan, F.col("size"), seed), plan


def _pieces(placed: DataFrame, plan: DataFrame, block: int) -> DataFrame:
    epochs = placed.filter("size > 0 AND quota > 0").withColumn(
        "begin", F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.col("quota") - 1) / F.col("source_size")).cast("int")), lambda e: F.col("start") + e * F.col("source_size")))
    )
    epochs = epochs.withColumn("end", F.least(F.col("begin") + F.col("size"), F.col("quota"))).filter("begin < end")
    blocks = epochs.withColumn("rank", F.explode(F.sequence(F.floor(F.col("begin") / block).cast("long"), F.floor((F.col("end") - 1) / block).cast("long"))))
    blocks = blocks.withColumn("lo", F.greatest("begin", F.col("rank") * block)).withColumn("hi", F.least("end", (F.col("rank") + 1) * block))
    return blocks.join(schedule(plan, block), ["sid", "rank"])


def mix_totals(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, block: int = BLOCK, seed: str = "") -> DataFrame:
    """What the mix takes of each document: doc_id, source, size, source_size, target, taken."""
    placed, plan = _prepared(docs, weights, share, cap, seed)
    placed = cut(placed, "placed")
    key = ["doc_id", "source", "sid", "chunk", "ordinal", "size", "source_size", "target"]
    took = _pieces(placed, plan, block).select(*key, (F.col("hi") - F.col("lo")).alias("taken"))
    none = placed.select(*key, F.lit(0).cast("long").alias("taken"))
    return took.unionByName(none).groupBy(*key).agg(F.sum("taken").alias("taken")).select("doc_id", "source", "size", "source_size", "target", "taken")
