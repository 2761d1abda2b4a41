"""Confirmation, needs, feature blends, recuts and re-matching."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import evidence as E
from tessera.functions import text
from tessera.operators import evidence as O
from tessera.session import table


def _families(found, title):
    """Families of evidence beside the model's own: text read in the image, title of the source."""
    return F.array_compact(F.array(F.when(found, F.lit("read")), F.when(title, F.lit("title"))))


def j03_confirmation(spark, sf_dir):
    """Lines as shots of their part: status by confidence and families, looked at in batches of three until 60 seconds and two shots are confirmed."""
    l = table(spark, sf_dir, "lineitem").withColumn("confidence", 1 - F.col("l_discount") * 4).withColumn("families", _families(F.col("l_tax") > 0.03, F.col("l_quantity") % 2 == 0))
    status = E.confirmation(F.col("confidence"), F.col("families"), F.col("l_returnflag") == "R", F.col("l_tax") == 0)
    rows = l.withColumn("status", status)
    done = F.col("status").isin("confirmed", "corroborated")
    order = [F.desc("l_quantity"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey"), F.col("l_extendedprice"), F.col("confidence"), F.col("status")]
    looked = O.until_target(rows, ["l_partkey"], order, done, F.col("l_quantity").cast("double"), 60.0, 2, 3, 5)
    return looked.groupBy("l_partkey", "status").agg(F.count(F.lit(1)).alias("n"), F.max("batch").alias("last_batch"))


def h25_needs(spark, sf_dir):
    """Need and roles of each turn and part name."""
    c = table(spark, sf_dir, "conversations").select(E.visual_need(F.col("text"), F.lit("")).alias("v"))
    p = table(spark, sf_dir, "part").select(E.visual_need(F.col("p_name"), F.when(F.col("p_size") % 3 == 0, F.lit("wine")).when(F.col("p_size") % 3 == 1, F.lit("market")).otherwise("x")).alias("v"))
    return c.unionByName(p).groupBy("v.need", "v.roles").agg(F.count(F.lit(1)).alias("n"))


def _window_score():
    actions = F.array_compact(F.array(F.when(F.col("l_returnflag") != "N", F.lit("walk")), F.when(F.col("l_linenumber") > 2, F.lit("show"))))
    wanted = F.when(F.col("l_quantity") > 40, F.expr("cast(array() as array<string>)")).otherwise(F.array(F.lit("walk"), F.lit("show")))
    return E.window_score(F.col("l_tax") < 0.07, F.col("l_discount") * 10, actions, wanted, F.lit(0.8), F.col("l_quantity").cast("double"), F.lit(20.0))


def h33_window_score(spark, sf_dir):
    """Blended score of each line as a window of 20 seconds; -1 where it is not safe."""
    l = table(spark, sf_dir, "lineitem").withColumn("score", _window_score())
    return l.groupBy("l_suppkey").agg(F.count_if(F.col("score") < 0).alias("unsafe"), F.round(F.sum("score"), 3).alias("total"), F.max("score").alias("best"))


def h35_features(spark, sf_dir):
    """Feature scalars of suppliers as candidates for the block of their nation's first supplier: city, entity and specificity."""
    s = table(spark, sf_dir, "supplier")
    block = s.groupBy("s_nationkey").agg(F.min_by(F.col("s_suppkey") % 5, "s_suppkey").cast("string").alias("expected"))
    rows = s.join(block, "s_nationkey").withColumn("city", F.when(F.col("s_suppkey") % 3 > 0, (F.col("s_suppkey") % 5).cast("string")))
    neutral = F.col("s_acctbal") > 3000
    overlap = F.col("s_suppkey") % 8
    same = F.coalesce(F.col("city") == F.col("expected"), F.lit(False))
    return rows.select(
        "s_suppkey",
        E.block_match(F.when(F.col("expected") == "0", F.lit("")).otherwise(F.col("expected")), F.col("city"), neutral).alias("block"),
        F.round(E.entity_match(same, F.col("s_suppkey") % 2, F.col("s_suppkey") % 4 == 0, overlap), 6).alias("entity"),
        F.round(E.specificity(F.col("city"), F.col("s_suppkey") % 2, F.when(F.col("s_acctbal") < 0, F.lit("general")).otherwise("beach"), overlap, F.col("s_nationkey") < 5), 6).alias("special"),
    )


def k09_recuts(spark, sf_dir):
    """For the first line of each part the best other line of the part, if it scores 0.08 more and 0.3 at least."""
    l = table(spark, sf_dir, "lineitem").withColumn("score", _window_score())
    id_ = F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    rows = l.withColumn("n", F.row_number().over(Window.partitionBy("l_partkey").orderBy(id_)))
    first = rows.filter("n = 1").select("l_partkey", F.col("score").alias("now"))
    best = rows.filter("n > 1 AND score >= 0").groupBy("l_partkey").agg(F.min_by(F.struct("n", "score"), F.struct(-F.col("score"), F.col("n"))).alias("b"))
    met = first.join(best, "l_partkey").select("l_partkey", "now", F.col("b.n").cast("long").alias("window"), F.col("b.score").alias("score"))
    return met.filter(F.col("score") >= F.greatest(F.lit(0.3), F.round(F.col("now") + 0.08, 6)))


def k04_rematch(spark, sf_dir):
    """Orders as scenes of five lines at most; returned ones break the brief and are replaced from lines of the same customer's other orders."""
    l = table(spark, sf_dir, "lineitem").filter("l_orderkey % 4 = 0")
    shot = F.col("l_orderkey") * 10_000_000 + F.col("l_linenumber").cast("long") * 1_000_000 + F.col("l_partkey") % 1_000_000
    l = l.select("l_orderkey", shot.alias("shot"), F.col("l_quantity").cast("double").alias("score"), "l_returnflag")
    l = l.groupBy("l_orderkey", "shot").agg(F.max("score").alias("score"), F.max("l_returnflag").alias("l_returnflag"))
    now = l.select(F.floor(F.col("l_orderkey") / 40).alias("scene"), "shot", "score", "l_returnflag")
    pool = now.withColumn("scene", F.col("scene") + 1).unionByName(now)
    return O.rematch(now, pool, "scene", F.col("l_returnflag") == "R", F.col("l_returnflag") != "R", "score").groupBy("scene", "state").agg(F.count(F.lit(1)).alias("n"), F.sum("shot").alias("shots"))


def h04_squeezed(spark, sf_dir):
    """Part brand and name as a slug without separators."""
    return table(spark, sf_dir, "part").select("p_partkey", text.squeezed(F.concat_ws(" ", "p_brand", "p_name", F.lit("É½ñ"))).alias("slug"))


def h13_quoted(spark, sf_dir):
    """Part names with quotes doubled."""
    return table(spark, sf_dir, "part").select("p_partkey", text.quoted(F.concat("p_name", F.lit("'s"))).alias("quoted"))


def h16_slug_titles(spark, sf_dir):
    """Titles from the slugs of part pages."""
    url = F.concat(F.lit("https://example.org/video/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("_"), F.col("p_partkey").cast("string"), F.when(F.col("p_size") % 2 == 0, F.lit("/")).otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", text.slug_title(F.when(F.col("p_size") > 3, url)).alias("title"))


QUERIES = {k: v for k, v in list(globals().items()) if k[0] in "hjk" and k[1:3].isdigit()}
_NEED = " ".join(f"WHEN regexp_matches(t || ' ' || i, '{p}') THEN '{n}|{r}'" for n, p, r in E.NEEDS)
_SCORE = """CASE WHEN l_tax < 0.07 THEN round(0.58::DOUBLE * (l_discount * 10)::DOUBLE + 0.24::DOUBLE * CASE WHEN l_quantity > 40 THEN 0.5::DOUBLE ELSE ((l_returnflag <> 'N')::INT + (l_linenumber > 2)::INT) / 2 END
    + 0.12::DOUBLE * 0.8::DOUBLE + 0.06::DOUBLE * greatest(0::DOUBLE, 1 - abs(l_quantity::DOUBLE - 20) / 20), 3) ELSE -1 END"""
ORACLE = {
    "j03_confirmation": """WITH l AS (SELECT *, 1 - l_discount * 4 AS confidence FROM lineitem),
        s AS (SELECT *, CASE WHEN l_returnflag <> 'R' AND confidence >= 0.85 THEN 'confirmed' WHEN l_returnflag <> 'R' AND confidence >= 0.7 AND l_tax > 0.03 AND l_quantity % 2 = 0 THEN 'corroborated' WHEN l_tax = 0 THEN 'retry' ELSE 'rejected' END AS status FROM l),
        b AS (SELECT *, (row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber, l_suppkey, l_extendedprice, confidence, status) - 1) // 3 AS batch FROM s),
        g AS (SELECT l_partkey, batch, sum(CASE WHEN status IN ('confirmed', 'corroborated') THEN l_quantity ELSE 0 END) AS s, count(*) FILTER (status IN ('confirmed', 'corroborated')) AS c FROM b GROUP BY 1, 2),
        o AS (SELECT l_partkey, batch, coalesce(sum(s) OVER w, 0) AS s, coalesce(sum(c) OVER w, 0) AS c FROM g WINDOW w AS (PARTITION BY l_partkey ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        SELECT l_partkey, status, count(*) AS n, max(batch) AS last_batch FROM b JOIN o USING (l_partkey, batch) WHERE batch < 5 AND (o.s < 60 OR o.c < 2) GROUP BY 1, 2""",
    "h25_needs": f"""WITH t AS (SELECT coalesce(text, '') AS t, '' AS i FROM conversations UNION ALL SELECT p_name, CASE p_size % 3 WHEN 0 THEN 'wine' WHEN 1 THEN 'market' ELSE 'x' END FROM part),
        n AS (SELECT CASE {_NEED} WHEN i = 'market' THEN 'food_closeup|proof_exact,detail_cutaway' WHEN i = 'wine' THEN 'wine_pouring|proof_exact,closing_payoff' ELSE 'street_level|context_regional,detail_cutaway' END AS v FROM t)
        SELECT split_part(v, '|', 1) AS need, split_part(v, '|', 2) AS roles, count(*) AS n FROM n GROUP BY 1, 2""",
    "h33_window_score": f"SELECT l_suppkey, count(*) FILTER (s < 0) AS unsafe, round(sum(s), 3) AS total, max(s) AS best FROM (SELECT l_suppkey, {_SCORE} AS s FROM lineitem) GROUP BY 1",
    "h35_features": """WITH b AS (SELECT s_nationkey, CAST(arg_min(s_suppkey % 5, s_suppkey) AS VARCHAR) AS e FROM supplier GROUP BY 1), r AS (SELECT s.*, e, CASE WHEN s_suppkey % 3 > 0 THEN CAST(s_suppkey % 5 AS VARCHAR) END AS city FROM supplier s JOIN b USING (s_nationkey))
        SELECT s_suppkey, CAST(CASE WHEN e = '0' THEN CASE WHEN s_acctbal > 3000 THEN 0.85 WHEN city IS NULL THEN 0.65 ELSE 0.45 END WHEN city = e THEN 1 WHEN city IS NULL AND s_acctbal > 3000 THEN 0.45 ELSE 0 END AS DOUBLE) AS block,
          round(CAST(least(1, CASE WHEN city = e THEN 0.55 ELSE 0 END + CASE WHEN s_suppkey % 2 > 0 THEN 0.45 WHEN s_suppkey % 4 = 0 THEN 0.25 ELSE 0 END + least(0.25, s_suppkey % 8 * 0.05)) AS DOUBLE), 6) AS entity,
          round(CAST(least(1, 0.25 + CASE WHEN city IS NOT NULL THEN 0.25 ELSE 0 END + CASE WHEN s_suppkey % 2 > 0 THEN 0.2 ELSE 0 END + CASE WHEN s_acctbal < 0 THEN 0 ELSE 0.15 END + CASE WHEN s_suppkey % 8 >= 4 THEN 0.1 ELSE 0 END + CASE WHEN s_nationkey < 5 THEN 0.15 ELSE 0 END) AS DOUBLE), 6) AS special FROM r""",
    "k09_recuts": f"""WITH r AS (SELECT l_partkey, {_SCORE} AS s, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS n FROM lineitem),
        b AS (SELECT l_partkey, n AS "window", s AS score FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY s DESC, n) AS k FROM r WHERE n > 1 AND s >= 0) WHERE k = 1)
        SELECT l_partkey, f.s AS now, "window", score FROM b JOIN r f USING (l_partkey) WHERE f.n = 1 AND score >= greatest(0.3::DOUBLE, round(f.s + 0.08::DOUBLE, 6))""",
    "k04_rematch": """WITH l AS (SELECT l_orderkey // 40 AS scene, l_orderkey * 10000000 + l_linenumber::BIGINT * 1000000 + l_partkey % 1000000 AS shot, max(l_quantity) AS score, max(l_returnflag) = 'R' AS bad FROM lineitem WHERE l_orderkey % 4 = 0 GROUP BY 1, 2),
        c AS (SELECT *, bad OR NOT max(bad) OVER (PARTITION BY scene) AS gone FROM l),
        o AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY score DESC, shot) AS n FROM c WHERE gone),
        f AS (SELECT scene, shot, score, NOT bad AS fits, row_number() OVER (PARTITION BY scene ORDER BY NOT bad DESC, score DESC, shot) AS n FROM (SELECT scene + 1 AS scene, shot, score, bad FROM l)),
        m AS (SELECT o.scene, o.shot, o.score, f.shot AS new, f.score AS new_score, f.fits FROM o LEFT JOIN f ON f.scene = o.scene AND f.n = o.n),
        v AS (SELECT scene, CASE WHEN NOT bool_and(new IS NOT NULL) THEN 'no alternative' WHEN NOT bool_and(coalesce(fits, false)) THEN 'breaks the brief' WHEN sum(new_score) < sum(score) THEN 'worse' ELSE 'replaced' END AS state FROM m GROUP BY 1),
        r AS (SELECT scene, shot FROM c WHERE NOT gone UNION ALL SELECT scene, CASE WHEN state = 'replaced' THEN new ELSE shot END FROM m JOIN v USING (scene))
        SELECT scene, state, count(*) AS n, CAST(sum(shot) AS BIGINT) AS shots FROM r JOIN v USING (scene) GROUP BY 1, 2""",
    "h04_squeezed": "SELECT p_partkey, regexp_replace(strip_accents(lower(p_brand || ' ' || p_name || ' Éñ')), '[^a-z0-9]+', '', 'g') AS slug FROM part",
    "h13_quoted": "SELECT p_partkey, p_name || chr(39) || chr(39) || 's' AS quoted FROM part",
    "h16_slug_titles": "SELECT p_partkey, CASE WHEN p_size > 3 THEN trim(p_name || ' ' || p_partkey) ELSE '' END AS title FROM part",
}
