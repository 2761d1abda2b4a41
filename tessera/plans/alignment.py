"""Alignment of segments with their scenes' entities, as violations and as a report by kind."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import alignment as A
from tessera.session import table


def _violations(spark, sf_dir):
    """Lines as segments of their order, orders as scenes that ask for an entity, flags of lines as spans, one coverage row for each flag."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("places"), F.col("p_brand").alias("landmarks"), F.col("p_type").alias("foods"))
    l = table(spark, sf_dir, "lineitem").withColumn("t", F.col("l_linenumber") * 6.0)
    seg = (F.col("l_linenumber") * 100_000_000 + F.col("l_partkey")).cast("long").alias("seg")
    segments = l.join(p, "l_partkey").select(F.col("l_orderkey").alias("video"), F.col("l_orderkey").alias("scene"), seg, F.col("t").alias("t_in"), (F.col("t") + F.col("l_quantity") / 5).alias("t_out"), "places", "landmarks", "foods", (F.col("l_tax") > 0.02).alias("confirmed"))
    spans = l.select(F.col("l_orderkey").alias("video"), F.col("l_returnflag").alias("entity"), (F.col("t") + 3).alias("t_in"), (F.col("t") + 8).alias("t_out"), (F.col("l_linestatus") == "F").alias("strict"))
    o = table(spark, sf_dir, "orders")
    entity = F.element_at(F.array(*[F.lit(x) for x in ("red", "Brand#1", "PROMO", "")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    kind = F.create_map(*[F.lit(x) for x in ("1", "food", "2", "landmark", "3", "building", "4", "place")])[F.substring("o_orderpriority", 1, 1)]
    briefs = o.select(F.col("o_orderkey").alias("scene"), entity.alias("entity"), kind.alias("kind"), (F.col("o_orderstatus") == "F").alias("strict"))
    cover = l.groupBy(F.col("l_returnflag").alias("entity")).agg((25.6 * F.count(F.lit(1)) - F.sum("l_quantity")).alias("deficit")).withColumn("strict", F.lit(True))
    return A.violations(segments, briefs, spans, cover)


def k05_alignment(spark, sf_dir):
    """Every violation with its segment, kind, severity and what was expected."""
    return _violations(spark, sf_dir)


def k05_report(spark, sf_dir):
    """Violations by kind: how many, strict ones, scenes concerned, the expectation met most often."""
    v = _violations(spark, sf_dir).groupBy("violation", "expected").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("severity") == "strict").alias("strict"))
    return v.groupBy("violation").agg(F.sum("n").alias("n"), F.sum("strict").alias("strict"), F.max(F.struct("n", "expected"))["expected"].alias("most"))


QUERIES = {k: v for k, v in list(globals().items()) if k[0] == "k" and k[1:3].isdigit()}
_PLAIN = "trim(regexp_replace(strip_accents(lower(coalesce({0}, ''))), '[^a-z0-9]+', ' ', 'g'))"
_IN = lambda c: f"contains(' ' || {_PLAIN.format(c)} || ' ', ' ' || {_PLAIN.format('entity')} || ' ')"
_SQL = f"""WITH s AS (SELECT l_orderkey AS scene, l_linenumber * 100000000 + l_partkey AS seg, l_linenumber * 6.0::DOUBLE AS t_in, l_linenumber * 6.0::DOUBLE + l_quantity / 5 AS t_out, p_name AS places, p_brand AS landmarks, p_type AS foods, l_tax > 0.02 AS confirmed FROM lineitem JOIN part ON l_partkey = p_partkey),
    b AS (SELECT o_orderkey AS scene, ['red', 'Brand#1', 'PROMO', ''][o_orderkey % 4 + 1] AS entity, CASE o_orderpriority[1] WHEN '1' THEN 'food' WHEN '2' THEN 'landmark' WHEN '3' THEN 'building' WHEN '4' THEN 'place' END AS kind FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 4 < 3),
    r AS (SELECT s.*, entity, kind FROM s JOIN b USING (scene)),
    c AS (SELECT scene, seg, string_agg(DISTINCT lower(l_returnflag), ',' ORDER BY lower(l_returnflag)) AS names, count(DISTINCT l_returnflag) AS k FROM r JOIN lineitem ON scene = l_orderkey AND l_linestatus = 'F'
          WHERE least(t_out, l_linenumber * 6.0::DOUBLE + 8) - greatest(t_in, l_linenumber * 6.0::DOUBLE + 3) > 0.5 GROUP BY 1, 2),
    v AS (SELECT scene, seg, 'segment_crosses_entity_boundary' AS violation, 'strict' AS severity, names AS expected FROM r JOIN c USING (scene, seg) WHERE k > 1
          UNION ALL SELECT scene, seg, CASE WHEN kind = 'food' THEN 'wrong_food_entity' WHEN kind IN ('landmark', 'building') THEN 'wrong_landmark_entity' WHEN trim(places || landmarks || foods) = '' THEN 'generic_for_strict_entity' ELSE 'missing_required_entity' END, 'strict', entity FROM r
            WHERE NOT CASE WHEN kind = 'food' THEN {_IN('foods')} WHEN kind IN ('landmark', 'building') THEN {_IN('landmarks')} OR {_IN('places')} ELSE {_IN('places')} OR {_IN('landmarks')} OR {_IN('foods')} END
          UNION ALL SELECT scene, seg, 'unconfirmed_entity', 'warning', entity FROM r WHERE NOT confirmed
          UNION ALL SELECT NULL, -1, 'entity_coverage_gap', 'warning', l_returnflag FROM lineitem GROUP BY l_returnflag HAVING 25.6::DOUBLE * count(*) - sum(l_quantity) > 0)
"""
ORACLE = {
    "k05_alignment": _SQL + "SELECT * FROM v",
    "k05_report": _SQL + """, g AS (SELECT violation, expected, count(*) AS n, count(*) FILTER (severity = 'strict') AS strict FROM v GROUP BY 1, 2)
    SELECT violation, CAST(sum(n) AS BIGINT) AS n, CAST(sum(strict) AS BIGINT) AS strict, arg_max(expected, (n, expected)) AS most FROM g GROUP BY 1""",
}
