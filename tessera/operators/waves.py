"""Deficits filled in waves: each wave takes from the next group of providers, is committed to a versioned store, and is skipped by a rerun."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.versioned import VersionedStore

TAKEN = "item long, entity string, seconds double, tier int, wave int"


@dataclass
class Report:
    """How the waves ended: covered, exhausted (a round of all tiers added nothing) or limit; the number of waves that ran or had run."""

    reason: str
    waves: int


def deficits(required: DataFrame, taken: DataFrame) -> DataFrame:
    """(entity, deficit) of the entities that lack seconds."""
    have = taken.groupBy("entity").agg(F.sum("seconds").alias("have"))
    gap = F.col("required") - F.coalesce("have", F.lit(0.0))
    return required.join(have, "entity", "left").select("entity", gap.alias("deficit")).filter("deficit > 0")


def one_wave(lacking: DataFrame, offers: DataFrame, taken: DataFrame, most: int) -> DataFrame:
    """The rows (item, entity, seconds) that a wave takes of the ``offers`` (entity, item, seconds, place) for the ``lacking`` entities.

    Items that are taken stay out. One that several entities are offered goes to the worst deficit (then by name). An entity takes its items by place, then
    id, until its deficit is met; the wave takes ``most`` items at most, worst deficits first.
    """
    fresh = offers.join(taken.select("item"), "item", "left_anti").join(lacking, "entity")
    mine = Window.partitionBy("item").orderBy(F.desc("deficit"), "entity", "place")
    own = fresh.withColumn("k", F.row_number().over(mine)).filter("k = 1")
    before = Window.partitionBy("entity").orderBy("place", "item").rowsBetween(Window.unboundedPreceding, -1)
    wanted = own.withColumn("sum", F.coalesce(F.sum("seconds").over(before), F.lit(0.0))).filter("sum < deficit")
    return wanted.orderBy(F.desc("deficit"), "entity", "place", "item").limit(most).select("item", "entity", "seconds")


def fill(store: VersionedStore, required: DataFrame, offers: DataFrame, tiers: int, max_waves: int = 8, most: int = 10_000) -> Report:
    """Runs waves until all ``required`` (entity, required) are covered by ``offers`` (entity, item, seconds, tier, place), a round of all tiers adds nothing, or
    ``max_waves`` have run. Wave w takes from tier w modulo ``tiers``.

    ``store`` holds TAKEN by item. Each wave is one commit with a token of its own, also an empty one, so a run that was cut off goes on after its last wave
    and a finished one changes nothing. The driver sees counts only.
    """
    idle = 0
    for wave in range(max_waves):
        taken = store.read()
        if f"wave-{wave}" not in store.manifest()["tokens"]:
            lacking = deficits(required, taken)
            if lacking.isEmpty():
                return Report("covered", wave)
            rows = one_wave(lacking, offers.filter(F.col("tier") == wave % tiers).drop("tier"), taken, most)
            store.commit(rows.withColumns({"tier": F.lit(wave % tiers), "wave": F.lit(wave)}), token=f"wave-{wave}")
        idle = idle + 1 if store.read().filter(F.col("wave") == wave).isEmpty() else 0
        if idle >= tiers:
            return Report("covered" if deficits(required, store.read()).isEmpty() else "exhausted", wave + 1)
    return Report("covered" if deficits(required, store.read()).isEmpty() else "limit", max_waves)


def store_of(spark, folder: str) -> VersionedStore:
    """A store for ``fill``."""
    return VersionedStore(spark, folder, TAKEN, ["item"], {"entity": "first", "seconds": "least", "tier": "least", "wave": "least"})
