"""Deficits of brands filled from three groups of listings, wave by wave."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import waves as W
from tessera.plans.streams import scratch
from tessera.session import table

TIERS, WAVES = 3, 3


def i09_waves(spark, sf_dir):
    """Brands need seconds of parts, which are offered to their own brand and one other: large ones by the first group, cheap ones by the second, all
    by the third. What each wave took for each brand, run twice with one store."""
    p = table(spark, sf_dir, "part")
    tier = F.when(F.col("p_size") > 40, 0).when(F.col("p_retailprice") < 1200, 1).otherwise(2)
    row = [F.col("p_partkey").alias("item"), F.col("p_size").cast("double").alias("seconds"), tier.alias("tier"), (F.col("p_size") % 7).cast("long").alias("place")]
    other = F.concat(F.lit("Brand#"), (F.col("p_partkey") % 25 + 1).cast("string"))
    offers = p.select(F.col("p_brand").alias("entity"), *row).unionByName(p.filter(F.col("p_brand") != other).select(other.alias("entity"), *row))
    number = F.regexp_extract("p_brand", "([0-9]+)$", 1).cast("double")
    required = p.select(F.col("p_brand").alias("entity"), (100.0 + 15.0 * number).alias("required")).distinct()
    store = W.store_of(spark, scratch(spark, "waves"))
    W.fill(store, required, offers, TIERS, 1)
    W.fill(store, required, offers, TIERS, WAVES)
    W.fill(store, required, offers, TIERS, WAVES)
    return store.read().groupBy("entity", "wave").agg(F.count(F.lit(1)).alias("items"), F.sum("seconds").alias("seconds"), F.sum("item").alias("ids")).withColumn("wave", F.col("wave").cast("long"))


QUERIES = {"i09_waves": i09_waves}


def _sql() -> str:
    """The waves one after another, each over what those before took."""
    out = [
        """WITH p AS (SELECT p_partkey AS item, p_size::DOUBLE AS seconds, CASE WHEN p_size > 40 THEN 0 WHEN p_retailprice < 1200 THEN 1 ELSE 2 END AS tier, p_size % 7 AS place, p_brand, 'Brand#' || (p_partkey % 25 + 1) AS other FROM part),
        o AS (SELECT p_brand AS entity, item, seconds, tier, place FROM p UNION ALL SELECT other, item, seconds, tier, place FROM p WHERE other <> p_brand),
        n AS (SELECT DISTINCT p_brand AS entity, 100 + 15 * CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS DOUBLE) AS required FROM part),
        t0 AS (SELECT NULL::VARCHAR AS entity, NULL::BIGINT AS item, NULL::DOUBLE AS seconds, NULL::INT AS wave WHERE false)"""
    ]
    for w in range(WAVES):
        out.append(f"""d{w} AS (SELECT entity, required - coalesce((SELECT sum(seconds) FROM t{w} t WHERE t.entity = n.entity), 0) AS deficit FROM n),
        f{w} AS (SELECT o.*, deficit, row_number() OVER (PARTITION BY item ORDER BY deficit DESC, entity, place) AS k FROM o JOIN d{w} USING (entity) WHERE deficit > 0 AND tier = {w % TIERS} AND item NOT IN (SELECT item FROM t{w})),
        g{w} AS (SELECT *, coalesce(sum(seconds) OVER (PARTITION BY entity ORDER BY place, item ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f{w} WHERE k = 1),
        t{w + 1} AS (SELECT * FROM t{w} UNION ALL SELECT entity, item, seconds, {w} FROM g{w} WHERE before < deficit)""")
    return ",\n".join(out) + f" SELECT entity, wave::BIGINT AS wave, count(*) AS items, sum(seconds) AS seconds, CAST(sum(item) AS BIGINT) AS ids FROM t{WAVES} GROUP BY 1, 2"


ORACLE = {"i09_waves": _sql()}
