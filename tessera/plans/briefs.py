"""Briefs of the turns of conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import briefs as B
from tessera.session import table


def j05_briefs(spark, sf_dir):
    """Turns as scenes: every other one names its first word as entity; the third ones have a location, which those after it take on. Benchmark words stand for
    food and monuments."""
    c = table(spark, sf_dir, "conversations")
    first = F.regexp_extract("text", "^(\\S+)", 1)
    kind = F.element_at(F.array(*[F.lit(k) for k in ("food", "landmark", "place", "")]), (F.col("conv_id") % 4 + 1).cast("int"))
    spoken = F.concat_ws(" ", F.col("text"), F.when(F.col("conv_id") % 3 == 0, "o Café"), F.when(F.col("conv_id") % 5 == 0, "uma torre."))
    scenes = c.select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, first).alias("entity"), kind.alias("kind"), (F.col("turn") % 4 == 0).alias("strict"), F.when(F.col("turn") % 3 == 1, F.concat(F.lit("place "), F.col("turn").cast("string"))).alias("location"), spoken.alias("text"))
    lists = lambda c: F.array_join(c, ",").alias(c)
    return B.briefs(scenes, "conv_id", "turn").select("conv_id", "turn", "subject", lists("must_have"), lists("must_not"), "shot", "mood", "entity", "kind", "strict", "location")


QUERIES = {"j05_briefs": j05_briefs}
_SAYS = lambda t, words: "regexp_matches(lower(" + t + "), '(^|[^\\p{L}0-9_])(" + "|".join(words) + ")($|[^\\p{L}0-9_])')"
_SPOKEN = "concat_ws(' ', text, CASE WHEN conv_id % 3 = 0 THEN 'o Café' END, CASE WHEN conv_id % 5 = 0 THEN 'uma torre.' END)"
ORACLE = {
    "j05_briefs": rf"""WITH s AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN nullif(regexp_extract(text, '^(\S+)', 1), '') END AS entity, coalesce(nullif(['food', 'landmark', 'place', ''][conv_id % 4 + 1], ''), 'other_visual') AS kind, turn % 4 = 0 AS strict,
          last_value(CASE WHEN turn % 3 = 1 THEN 'place ' || turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS location, {_SAYS(_SPOKEN, B.FOOD)} AS food, {_SAYS(_SPOKEN, B.MONUMENTS)} AS mon FROM conversations),
        g AS (SELECT *, CASE WHEN entity IS NOT NULL THEN 'own' WHEN food AND NOT mon THEN 'food' WHEN mon AND NOT food THEN 'mon' ELSE 'street' END AS g FROM s)
        SELECT conv_id, turn, CASE g WHEN 'own' THEN 'close-up cinematic shot of ' || entity || ' in Porto Portugal' WHEN 'food' THEN 'close-up of traditional portuguese food dish' WHEN 'mon' THEN 'wide shot of historic portuguese monument' ELSE 'cinematic street scene in Porto portugal' END AS subject,
          CASE g WHEN 'own' THEN kind WHEN 'food' THEN 'food' WHEN 'mon' THEN 'landmark' ELSE '' END AS must_have, CASE WHEN g = 'own' AND kind = 'landmark' THEN 'people' WHEN g = 'food' THEN 'landmark' WHEN g = 'mon' THEN 'food' ELSE '' END AS must_not,
          CASE WHEN g = 'food' OR g = 'own' AND kind IN ('food', 'landmark') THEN 'close-up' WHEN g = 'mon' THEN 'wide' ELSE 'medium' END AS shot,
          CASE WHEN g <> 'own' THEN '' WHEN kind = 'landmark' THEN 'referência cultural' WHEN kind = 'food' THEN 'gastronomia local' ELSE 'ambiente local' END AS mood,
          coalesce(entity, '') AS entity, CASE WHEN g = 'own' THEN kind ELSE '' END AS kind, g = 'own' AND strict AS strict, coalesce(location, '') AS location FROM g""",
}
