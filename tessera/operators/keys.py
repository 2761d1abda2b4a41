"""Identity: keep-first, latest-wins, upserts, replaced partitions, cache splits, orphans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key; rows with a null in the key are dropped."""
    rows = df.dropna(subset=key)
    return rows.withColumn("n_", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("n_ = 1").drop("n_")


def latest_wins(log: DataFrame, key: list[str], version: list[str]) -> DataFrame:
    """Current rows of an append log: the last version of each key, ties by the columns of ``version`` in turn."""
    return keep_first(log, key, [F.col(c).desc() for c in version])


def upsert(current: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``changes`` replace those of equal key; the others stay. Keys are unique on both sides."""
    return current.join(changes.select(*key), key, "left_anti").unionByName(changes)


def merge_sets(current: DataFrame, changes: DataFrame, key: list[str], union: list[str], greatest: list[str], both: list[str]) -> DataFrame:
    """Full outer merge: arrays united, numbers by maximum, flags by AND; ``times_seen`` counts the sides."""
    a, b = current.alias("a"), changes.alias("b")
    joined = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key], "full_outer")
    side = lambda c: (F.col(f"a.{c}"), F.col(f"b.{c}"))
    out = [F.coalesce(*side(k)).alias(k) for k in key]
    for c in union:
        x, y = side(c)
        out.append(F.array_sort(F.when(x.isNull(), y).when(y.isNull(), x).otherwise(F.array_union(x, y))).alias(c))
    out += [F.greatest(*side(c)).alias(c) for c in greatest]
    for c in both:
        x, y = side(c)
        out.append((F.coalesce(x, F.lit(True)) & F.coalesce(y, F.lit(True))).alias(c))
    seen = F.col(f"a.{key[0]}").isNotNull().cast("int") + F.col(f"b.{key[0]}").isNotNull().cast("int")
    return joined.select(*out, seen.alias("times_seen"))


def replace_partitions(existing: DataFrame, new: DataFrame, part: list[str]) -> DataFrame:
    """Partitions that ``new`` holds are replaced as a whole; the others stay."""
    return existing.join(new.select(*part).distinct(), part, "left_anti").unionByName(new)


def split_by_cache(wanted: DataFrame, cache: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(hits with the cached columns, misses)."""
    return wanted.join(cache, key), wanted.join(cache.select(*key), key, "left_anti")


def orphans(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, with the side that has them."""
    a = left.select(key).distinct().join(right.select(key), key, "left_anti").withColumn("side", F.lit("left"))
    b = right.select(key).distinct().join(left.select(key), key, "left_anti").withColumn("side", F.lit("right"))
    return a.unionByName(b)


def surrogate(*parts: Column) -> Column:
    """Deterministic 16-digit key of the parts; a null part counts as empty."""
    return F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary")), 1, 16)


def near_hashes(df: DataFrame, key: str, hash_: str, most: int) -> DataFrame:
    """Pairs (key, other_id, distance) of 64-bit hashes that differ in ``most`` bits or fewer, once each, the smaller key first.

    The hash is cut into ``most`` + 1 parts: one of them is equal, so pairs come from an equi-join on the parts. A
    part of about 64 / (most + 1) bits leaves few chance pairs while that is large against the rows' logarithm.
    """
    n = most + 1
    cuts = [64 * i // n for i in range(n + 1)]
    part = lambda a, b: F.shiftrightunsigned(hash_, a).bitwiseAND(F.lit((1 << b - a) - 1))
    parts = [F.struct(F.lit(i).alias("p"), part(cuts[i], cuts[i + 1]).alias("v")) for i in range(n)]
    keyed = df.select(key, F.col(hash_).alias("h"), F.inline(F.array(*parts)))
    other = keyed.select(F.col(key).alias("other_id"), F.col("h").alias("oh"), "p", "v")
    distance = F.bit_count(F.col("h").bitwiseXOR(F.col("oh")))
    pairs = keyed.join(other, ["p", "v"]).filter((F.col(key) < F.col("other_id")) & (distance <= most))
    return pairs.select(key, "other_id", distance.cast("long").alias("distance")).distinct()


def enrich(current: DataFrame, changes: DataFrame, key: list[str], first: list[str]) -> DataFrame:
    """Insert-or-enrich: new keys are added; of known ones a null or empty column is filled, columns ``first`` stay as they
    were, others take the newer value where it is not null. Keys are unique on both sides."""
    a, b = current.alias("a"), changes.alias("b")
    joined = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key], "full_outer")
    out = [F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in key]
    for c in [c for c in current.columns if c not in key]:
        old, new = F.col(f"a.{c}"), F.col(f"b.{c}")
        old, new = (F.when(x.cast("string") != "", x) for x in (old, new))
        out.append((F.coalesce(old, new) if c in first else F.coalesce(new, old)).alias(c))
    return joined.select(*out)
