"""Candidates of scenes: scores of all nine terms, and the five rules of a moment's contract."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import selection as S
from tessera.session import table


def _terms(key, *lists):
    """One of some lists of terms by the remainder of a key."""
    out = F.expr("cast(array() as array<string>)")
    for i, terms in enumerate(lists):
        if terms:
            out = F.when(F.col(key) % len(lists) == i, F.array(*[F.lit(t) for t in terms])).otherwise(out)
    return out


def f03_entity_scores(spark, sf_dir):
    """Lines as candidates of their order: the best score of each order, how many score above zero, and the sum of all."""
    l = table(spark, sf_dir, "lineitem")
    uses = l.groupBy("l_partkey").agg((F.count(F.lit(1)) / 50).alias("uses"))
    sources = F.count(F.lit(1)).over(Window.partitionBy("l_orderkey", "l_suppkey")) - 1
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("places"), F.col("p_brand").alias("landmarks"))
    rows = l.withColumn("source_uses", sources).join(uses, "l_partkey").join(p, "l_partkey")
    rows = rows.select("l_orderkey", (F.col("l_quantity") / 50).alias("similarity"), (F.col("l_tax") * 100).alias("quality"), "uses", "source_uses", "places", "landmarks", (F.col("l_returnflag") == "A").alias("confirmed"), _terms("l_orderkey", ["RED", " "], [], ["brand#1", "ring"]).alias("entities"), _terms("l_orderkey", ["blue"], []).alias("excluded"))
    rows = rows.withColumn("score", S.entity_score())
    return rows.groupBy("l_orderkey").agg(F.round(F.max("score"), 6).alias("best"), F.count_if(F.round("score", 6) > 0).alias("above"), F.round(F.sum("score"), 4).alias("total"))


def b10_contract_filter(spark, sf_dir):
    """Lines as candidates for the moment of their order: rules broken, and how many lines break each set of them."""
    l = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey")
    truth = F.element_at(F.array(*[F.lit(x) for x in ("Exact", "regional", "weak")]), (F.col("l_linenumber") % 3 + 1).cast("int"))
    c = l.select("l_orderkey", F.when(F.col("l_returnflag") == "R", "Metadata_Fallback").otherwise("vision").alias("source"), F.array(F.upper("p_type"), F.when(F.col("l_quantity") > 40, S.SIGHTS)).alias("categories"), (F.col("l_discount") * 10).alias("confidence"), truth.alias("truth"))
    o = table(spark, sf_dir, "orders")
    m = o.select(F.col("o_orderkey").alias("l_orderkey"), (F.substring("o_orderpriority", 1, 1) <= "2").alias("critical"), _terms("o_orderkey", ["promo "], ["economy", "small"], []).alias("forbidden"), F.when(F.col("o_orderstatus") != "P", F.lit(0.3)).alias("least"), (F.col("o_orderkey") % 5 > 0).alias("takes_sights"))
    rows = S.by_contract(c, m, "l_orderkey")
    return rows.groupBy(F.array_join("broken", ",").alias("broken")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_orderkey").alias("orders"))


QUERIES = {k: v for k, v in list(globals().items()) if k[0] in "bf" and k[1:3].isdigit()}
_W = {k: f"{v}::DOUBLE" for k, v in S.WEIGHTS.items()}
ORACLE = {
    "f03_entity_scores": f"""WITH u AS (SELECT l_partkey, count(*) / 50 AS uses FROM lineitem GROUP BY 1),
        r AS (SELECT l_orderkey, {_W['similarity']} * l_quantity / 50 + {_W['quality']} * l_tax * 100 - {_W['usage']} * uses - {_W['source']} * (count(*) OVER (PARTITION BY l_orderkey, l_suppkey) - 1)
          + CASE l_orderkey % 3 WHEN 0 THEN CASE WHEN contains(lower(p_brand), 'red') THEN {_W['landmark']} WHEN contains(lower(p_name), 'red') THEN {_W['place']} ELSE -{_W['missed']} END WHEN 1 THEN 0
              ELSE CASE WHEN contains(lower(p_brand), 'brand#1') OR contains(lower(p_brand), 'ring') THEN {_W['landmark']} WHEN contains(lower(p_name), 'brand#1') OR contains(lower(p_name), 'ring') THEN {_W['place']} ELSE -{_W['missed']} END END
          + CASE WHEN l_returnflag = 'A' THEN {_W['confirmed']} ELSE 0 END - CASE WHEN l_orderkey % 2 = 0 AND contains(lower(p_name || ',' || p_brand), 'blue') THEN {_W['geography']} ELSE 0 END AS score
          FROM lineitem JOIN part ON l_partkey = p_partkey JOIN u USING (l_partkey))
        SELECT l_orderkey, round(max(score), 6) AS best, count(*) FILTER (round(score, 6) > 0) AS above, round(sum(score), 4) AS total FROM r GROUP BY 1""",
    "b10_contract_filter": """WITH r AS (SELECT l_orderkey, l_returnflag = 'R' AS weak, lower(p_type) AS kind, l_quantity > 40 AS sight, l_discount * 10 AS confidence, l_linenumber % 3 = 2 AS unsure,
          coalesce(o_orderpriority[1] <= '2', false) AS critical, o_orderkey % 3 AS f, CASE WHEN o_orderstatus <> 'P' THEN 0.3 ELSE 0.6 END AS least, o_orderkey % 5 = 0 AS nosight FROM lineitem JOIN part ON l_partkey = p_partkey LEFT JOIN orders ON l_orderkey = o_orderkey),
        b AS (SELECT l_orderkey, array_to_string(list_filter([CASE WHEN critical AND weak THEN 'weak_source' END, CASE WHEN (f = 0 AND kind = 'promo') OR (f = 1 AND kind IN ('economy', 'small')) THEN 'forbidden_category' END,
          CASE WHEN nosight AND sight THEN 'sight_not_taken' END, CASE WHEN critical AND confidence < least THEN 'low_confidence' END, CASE WHEN critical AND unsure THEN 'truth_not_firm' END], lambda x: x IS NOT NULL), ',') AS broken FROM r)
        SELECT broken, count(*) AS n, count(DISTINCT l_orderkey) AS orders FROM b GROUP BY 1""",
}
