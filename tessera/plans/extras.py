"""Further scalar, evidence and planning queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import scoring, text, vector
from tessera.functions import time as T
from tessera.functions.time import micros
from tessera.operators import ranking as R
from tessera.operators.sequences import before_in_order
from tessera.plans.solvers import _words
from tessera.session import table
from tessera.solvers import alignment


def b20_proof_safe(spark, sf_dir):
    """Lines safe as proof: status, origin and a score that counts as passed where it is 0."""
    l = table(spark, sf_dir, "lineitem")
    score = F.coalesce(F.nullif(F.col("l_discount") * 10, F.lit(0.0)), F.lit(1.0))
    safe = F.col("l_returnflag").isin("A", "N") & (F.col("l_linestatus") == "F") & (score >= 0.55)
    return l.groupBy("l_suppkey").agg(F.count_if(safe).alias("safe"))


def c16_sentence_alignment(spark, sf_dir):
    """Times of each turn's sentences by a cursor over its timed words."""
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"), F.posexplode(text.sentences(F.col("text"))).alias("n", "s"))
    w = F.filter(F.split("s", "[ \\t\\r\\n]+"), lambda x: x != "")
    s = c.select("turn_id", F.col("n").cast("long").alias("n"), F.element_at(w, 1).alias("first"), F.size(w).alias("size"))
    return alignment.align(s, _words(spark, sf_dir), "turn_id").select("turn_id", "n", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


def c27_keep_unlike(spark, sf_dir):
    """Vectors of each scene of fifty whose sign hash is not near to a kept one's."""
    bits = F.aggregate(F.transform("embedding", lambda x, i: F.when(x > 0, F.expr("1L")).otherwise(F.expr("0L"))), F.lit(0).cast("long"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b))
    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 50).alias("scene"), F.col("vec_id").alias("id"), bits.alias("h"))
    return alignment.keep_unlike(rows, "scene")


def c29_unused(spark, sf_dir):
    """Suppliers that no returned line uses."""
    used = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' AND l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey"))
    return table(spark, sf_dir, "supplier").join(used, "s_suppkey", "left_anti").select("s_suppkey")


def e17_split_blocks(spark, sf_dir):
    """Each order's price split into even slots of at most 100000; a short tail joins the last slot."""
    o = table(spark, sf_dir, "orders").withColumn("n", F.greatest(F.lit(1), F.floor(F.col("o_totalprice") / 100000 + 0.6)).cast("long"))
    return o.select("o_orderkey", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("slot"), "o_totalprice").select("o_orderkey", "slot", F.round(F.col("o_totalprice") / F.col("n"), 6).alias("length"))


def f10_rotation(spark, sf_dir):
    """Backups to delete: all but a user's newest 20 events."""
    w = Window.partitionBy("user_id").orderBy(F.desc("at"), F.desc("event_id"))
    e = table(spark, sf_dir, "events").withColumn("at", micros(F.col("ts"))).withColumn("n", F.row_number().over(w))
    return e.filter("n > 20").select("event_id")


def g08_landmarks(spark, sf_dir):
    """Explicit and found license names of a document, once each by plain form."""
    names = F.array(F.lit("Apache License"), F.lit("General Public License"), F.lit("CC BY-NC"))
    found = F.filter(names, lambda n: F.lower("text").contains(F.lower(n)))
    explicit = F.array_compact(F.array(F.when(F.col("text").contains("Apache License"), F.lit("APACHE license"))))
    every = F.array_sort(F.array_distinct(F.transform(F.concat(explicit, found), lambda n: text.plain(n))))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(every, ",").alias("names")).filter("names <> ''")


def g15_required_topics(spark, sf_dir):
    """Required types with their aliases: which alias of each a user has first, those unresolved as null."""
    need = spark.createDataFrame([("buying", "purchase"), ("buying", "signup"), ("looking", "view"), ("trouble", "crash")], "topic string, alias string")
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("alias")).distinct()
    users = e.select("user_id").distinct().join(F.broadcast(need))
    return users.join(e.withColumn("there", F.lit(True)), ["user_id", "alias"], "left").groupBy("user_id", "topic").agg(F.min(F.when(F.col("there"), F.col("alias"))).alias("alias"))


def h03_slugs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.slug(F.col("text"), "_", 40).alias("slug"))


def h07_best_alias(spark, sf_dir):
    """The alias of highest confidence in each document: explicit 0.95, long 0.9, short 0.78."""
    alias = spark.createDataFrame([("gpl", "general public license", 0.9), ("gpl", "gnu", 0.78), ("apache", "apache license", 0.95), ("all", "rights reserved", 0.9), ("cc", "cc", 0.78)], "name string, alias string, confidence double")
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit(" "), text.plain(F.col("text")), F.lit(" ")).alias("t"))
    hit = d.join(F.broadcast(alias), F.col("t").contains(F.concat(F.lit(" "), F.col("alias"), F.lit(" "))))
    return hit.groupBy("doc_id").agg(F.max_by("name", F.struct("confidence", "alias")).alias("name"), F.max("confidence").alias("confidence"))


def h23_intent(spark, sf_dir):
    """Intent of each turn: first rule that holds, questions first, with a downgrade of short ones."""
    rules = {"question": "\\?$", "list": "\\n", "long": ".{400,}"}
    intent = F.when(F.length("text") < 20, "short").otherwise(text.first_label(F.col("text"), rules, "plain"))
    return table(spark, sf_dir, "conversations").groupBy("role", intent.alias("intent")).agg(F.count(F.lit(1)).alias("n"))


def h24_evidence(spark, sf_dir):
    """Evidence of each user: wanted types found and missing, forbidden ones found, and a clamped score."""
    e = table(spark, sf_dir, "events").filter("value > 12").groupBy("user_id").agg(F.collect_set("event_type").alias("t"))
    want, bad = F.array(F.lit("purchase"), F.lit("view")), F.array(F.lit("error"))
    found, forbidden = F.size(F.array_intersect("t", want)), F.size(F.array_intersect("t", bad))
    return e.select("user_id", F.array_join(F.array_sort(F.array_except(want, "t")), ",").alias("missing"), F.round(scoring.clamp(found / 2 - 0.4 * forbidden), 6).alias("score"))


def h26_guarded_cosine(spark, sf_dir):
    """Cosine of each vector with the one before; the first has none, a zero vector counts 0."""
    e = before_in_order(table(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding"), ["label"], "vec_id", "embedding", "before").filter("before IS NOT NULL")
    return e.select("vec_id", F.round(vector.guarded_cosine(F.col("embedding"), F.col("before")), 5).alias("cosine"))


def h28_normalised(spark, sf_dir):
    """Length of each vector before and after scaling to 1."""
    e = table(spark, sf_dir, "embeddings").withColumn("n", vector.norm(F.col("embedding")))
    unit = F.transform("embedding", lambda x: x.cast("double") / F.greatest(F.col("n"), F.lit(1e-8)))
    return e.withColumn("u", unit).select("vec_id", F.round("n", 5).alias("before"), F.round(vector.norm(F.col("u")), 6).alias("after"))


def h29_batches(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.groupBy(scoring.batch_count(5000 - F.col("c_acctbal"), F.lit(1500.0), 5).cast("long").alias("batches")).agg(F.count(F.lit(1)).alias("n"))


def h32_hint_score(spark, sf_dir):
    """Parts by share of hints met, with the tier of their type."""
    hints = F.array(F.col("p_name").contains("red"), F.col("p_size") > 20, F.col("p_retailprice") < 1500)
    tier = F.when(F.col("p_type").isin("ECONOMY", "PROMO"), "own").when(F.col("p_type") == "STANDARD", "stock").otherwise("web")
    return table(spark, sf_dir, "part").groupBy(tier.alias("tier"), F.size(F.filter(hints, lambda h: h)).cast("long").alias("met")).agg(F.count(F.lit(1)).alias("n"))


def h36_identity(spark, sf_dir):
    """Identity of lines by anchor, scale and function, as a histogram."""
    scale = F.when(F.col("l_quantity") >= 35, "wide").when(F.col("l_quantity") >= 15, "middle").otherwise("close")
    return table(spark, sf_dir, "lineitem").groupBy(F.concat_ws("|", F.coalesce("l_returnflag", F.lit("none")), scale, "l_linestatus").alias("identity")).agg(F.count(F.lit(1)).alias("n"))


def h40_month_hooks(spark, sf_dir):
    """Orders by hook of their month; months without one are left out."""
    hooks = spark.createDataFrame([(1, "new year"), (6, "summer"), (12, "holidays")], "month int, hook string")
    o = table(spark, sf_dir, "orders").withColumn("month", F.month("o_orderdate"))
    return o.join(F.broadcast(hooks), "month").groupBy("hook").agg(F.count(F.lit(1)).alias("n"))


def h45_percentages(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.round(F.avg(scoring.percent(F.col("value"))), 6).alias("mean"))


def h48_metadata_score(spark, sf_dir):
    """Score of each order: 2 for a line of flag N, -3 for R, -5 for a discount over 0.09."""
    l = table(spark, sf_dir, "lineitem")
    score = F.when(F.col("l_returnflag") == "N", 2).when(F.col("l_returnflag") == "R", -3).otherwise(0) + F.when(F.col("l_discount") > 0.09, -5).otherwise(0)
    return l.groupBy("l_orderkey").agg(F.sum(score).alias("score"))


def h38_srt_stamps(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", T.stamp(F.col("s_acctbal")).alias("stamp"))


def j04_mentions(spark, sf_dir):
    """Words of each turn that begin with a capital after the first one: how many, and the first one's place."""
    words = F.transform(F.filter(F.split("text", "\\s+"), lambda w: w != ""), lambda w, i: F.struct(i.alias("at"), w.alias("w")))
    found = F.filter(words, lambda x: (x["at"] > 0) & x["w"].rlike("^\\p{Lu}\\p{Ll}"))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", found.alias("m")).filter("size(m) > 0")
    return c.groupBy("conv_id", "turn").agg(F.sum(F.size("m")).alias("n"), F.min(F.get("m", F.lit(0))["at"]).alias("first"))


def j07_sample_points(spark, sf_dir):
    """Three sample points of each part's size, from 5 to 95 percent."""
    p = table(spark, sf_dir, "part")
    points = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.round(F.col("p_size") * (0.05 + 0.9 * i / 2), 6))
    return p.select("p_partkey", F.posexplode(points).alias("i", "at")).withColumn("i", F.col("i").cast("long"))


def k10_packages(spark, sf_dir):
    """Packages of each conversation: mode of the role (first seen on a tie), turns, slots from a template with more for long ones."""
    c = table(spark, sf_dir, "conversations")
    mode = R.top_k(c.groupBy("conv_id", "role").agg(F.count(F.lit(1)).alias("n"), F.min("turn").alias("f")), ["conv_id"], [F.desc("n"), F.col("f")], 1).select("conv_id", F.col("role").alias("mode"))
    sums = c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.sum(F.length("text")).alias("chars"))
    template = spark.createDataFrame([("user", 2), ("assistant", 3), ("system", 1)], "mode string, slots int")
    return sums.join(mode, "conv_id").join(F.broadcast(template), "mode").select("conv_id", "mode", "turns", (F.col("slots") + F.when(F.col("chars") > 1500, 1).otherwise(0)).cast("long").alias("slots"))


def k12_contracts(spark, sf_dir):
    """Contract rows of conversation turns: need by role, whether critical, and seconds by length."""
    c = table(spark, sf_dir, "conversations")
    need = F.when(F.col("role") == "user", "context").when(F.length("text") > 300, "proof").otherwise("detail")
    return c.select("conv_id", "turn", need.alias("need"), (F.col("turn") == 0).alias("critical"), F.round(scoring.clamp(F.length("text") / 15, 1.8, 20.0), 6).alias("seconds"))


QUERIES = {k: v for k, v in list(globals().items()) if k[0] in "bcefghjk" and k[1:3].isdigit()}
_P = "trim(regexp_replace(strip_accents(lower({0})), '[^a-z0-9]+', ' ', 'g'))"
_DOT = "list_dot_product({0}::DOUBLE[], {1}::DOUBLE[])"
_CAPITALS = r"list_filter(list_transform(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''), lambda x, i: CASE WHEN i > 1 AND regexp_matches(x, '^\p{Lu}\p{Ll}') THEN i - 1 END), lambda x: x IS NOT NULL)"
ORACLE = {
    "j04_mentions": f"SELECT conv_id, turn, sum(len(m))::BIGINT AS n, min(m[1])::INT AS first FROM (SELECT conv_id, turn, {_CAPITALS} AS m FROM conversations) WHERE len(m) > 0 GROUP BY ALL",
    "b20_proof_safe": "SELECT l_suppkey, count(*) FILTER (l_returnflag IN ('A', 'N') AND l_linestatus = 'F' AND CASE WHEN l_discount * 10 = 0 THEN 1 ELSE l_discount * 10 END >= 0.55) AS safe FROM lineitem GROUP BY 1",
    "c29_unused": "SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 49)",
    "e17_split_blocks": """WITH n AS (SELECT o_orderkey, o_totalprice, CAST(greatest(1, floor(o_totalprice / 100000 + 0.6::DOUBLE)) AS BIGINT) AS n FROM orders)
        SELECT o_orderkey, slot, round(o_totalprice / n, 6) AS length FROM n, LATERAL (SELECT unnest(generate_series(0, n - 1)) AS slot) s""",
    "f10_rotation": "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) DESC, event_id DESC) AS n FROM events) WHERE n > 20",
    "g08_landmarks": """SELECT doc_id, concat_ws(',', CASE WHEN contains(lower(text), 'apache license') THEN 'apache license' END, CASE WHEN contains(lower(text), 'cc by-nc') THEN 'cc by nc' END,
        CASE WHEN contains(lower(text), 'general public license') THEN 'general public license' END) AS names FROM documents WHERE names <> ''""",
    "g15_required_topics": """SELECT u.user_id, topic, min(CASE WHEN e.event_type IS NOT NULL THEN alias END) AS alias FROM (SELECT DISTINCT user_id FROM events) u
        CROSS JOIN (VALUES ('buying', 'purchase'), ('buying', 'signup'), ('looking', 'view'), ('trouble', 'crash')) n(topic, alias)
        LEFT JOIN (SELECT DISTINCT user_id, event_type FROM events) e ON e.user_id = u.user_id AND e.event_type = alias GROUP BY 1, 2""",
    "h03_slugs": f"SELECT doc_id, regexp_replace(replace({_P.format('text')}, ' ', '_')[1:40], '_+$', '') AS slug FROM documents",
    "h07_best_alias": f"""WITH d AS (SELECT doc_id, ' ' || {_P.format('text')} || ' ' AS t FROM documents), h AS (SELECT * FROM d, (VALUES ('gpl', 'general public license', 0.9), ('gpl', 'gnu', 0.78), ('apache', 'apache license', 0.95), ('all', 'rights reserved', 0.9), ('cc', 'cc', 0.78)) a(name, alias, c)
        WHERE contains(t, ' ' || alias || ' ')) SELECT doc_id, arg_max(name, (c, alias)) AS name, CAST(max(c) AS DOUBLE) AS confidence FROM h GROUP BY 1""",
    "h23_intent": """SELECT role, CASE WHEN length(text) < 20 THEN 'short' WHEN regexp_matches(text, '\\?$') THEN 'question' WHEN contains(text, chr(10)) THEN 'list' WHEN length(text) >= 400 THEN 'long' ELSE 'plain' END AS intent, count(*) AS n FROM conversations GROUP BY 1, 2""",
    "h24_evidence": """WITH t AS (SELECT user_id, bool_or(event_type = 'purchase') AS p, bool_or(event_type = 'view') AS v, bool_or(event_type = 'error') AS e FROM events WHERE value > 12 GROUP BY 1)
        SELECT user_id, concat_ws(',', CASE WHEN NOT p THEN 'purchase' END, CASE WHEN NOT v THEN 'view' END) AS missing, round(least(1, greatest(0, (p::INT + v::INT) / 2 - 0.4::DOUBLE * e::INT)), 6) AS score FROM t""",
    "h26_guarded_cosine": f"""WITH b AS (SELECT vec_id, embedding, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings)
        SELECT vec_id, round({_DOT.format('embedding', 'b')} / (sqrt({_DOT.format('embedding', 'embedding')}) * sqrt({_DOT.format('b', 'b')})), 5) AS cosine FROM b WHERE b IS NOT NULL""",
    "h28_normalised": f"SELECT vec_id, round(sqrt({_DOT.format('embedding', 'embedding')}), 5) AS before, 1.0::DOUBLE AS after FROM embeddings",
    "h29_batches": "SELECT CAST(CASE WHEN c_acctbal >= 5000 THEN 0 ELSE least(5, greatest(1, ceil((5000 - c_acctbal) / 1500))) END AS BIGINT) AS batches, count(*) AS n FROM customer GROUP BY 1",
    "h32_hint_score": """SELECT CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN 'own' WHEN p_type = 'STANDARD' THEN 'stock' ELSE 'web' END AS tier, CAST((p_name LIKE '%red%')::INT + (p_size > 20)::INT + (p_retailprice < 1500)::INT AS BIGINT) AS met, count(*) AS n FROM part GROUP BY 1, 2""",
    "h36_identity": "SELECT l_returnflag || '|' || CASE WHEN l_quantity >= 35 THEN 'wide' WHEN l_quantity >= 15 THEN 'middle' ELSE 'close' END || '|' || l_linestatus AS identity, count(*) AS n FROM lineitem GROUP BY 1",
    "h38_srt_stamps": """WITH m AS (SELECT s_suppkey, CAST(round(greatest(s_acctbal, 0) * 1000) AS BIGINT) AS ms FROM supplier) SELECT s_suppkey, format('{:02d}:{:02d}:{:02d},{:03d}', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS stamp FROM m""",
    "h40_month_hooks": "SELECT CASE month(o_orderdate) WHEN 1 THEN 'new year' WHEN 6 THEN 'summer' ELSE 'holidays' END AS hook, count(*) AS n FROM orders WHERE month(o_orderdate) IN (1, 6, 12) GROUP BY 1",
    "h45_percentages": "SELECT event_type, round(avg(least(1, greatest(0, CASE WHEN value > 1 THEN value / 100 ELSE value END))), 6) AS mean FROM events GROUP BY 1",
    "h48_metadata_score": "SELECT l_orderkey, CAST(sum(CASE l_returnflag WHEN 'N' THEN 2 WHEN 'R' THEN -3 ELSE 0 END + CASE WHEN l_discount > 0.09 THEN -5 ELSE 0 END) AS BIGINT) AS score FROM lineitem GROUP BY 1",
    "j07_sample_points": "SELECT p_partkey, i, round(p_size * (0.05::DOUBLE + 0.9::DOUBLE * i / 2), 6) AS at FROM part, (VALUES (0), (1), (2)) v(i)",
    "k10_packages": """WITH r AS (SELECT conv_id, role, count(*) AS n, min(turn) AS f FROM conversations GROUP BY 1, 2), m AS (SELECT conv_id, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, f) AS i FROM r) WHERE i = 1),
        s AS (SELECT conv_id, count(*) AS turns, sum(length(text)) AS chars FROM conversations GROUP BY 1)
        SELECT conv_id, role AS mode, turns, CAST(CASE role WHEN 'user' THEN 2 WHEN 'assistant' THEN 3 ELSE 1 END + CASE WHEN chars > 1500 THEN 1 ELSE 0 END AS BIGINT) AS slots FROM s JOIN m USING (conv_id)""",
    "k12_contracts": "SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'context' WHEN length(text) > 300 THEN 'proof' ELSE 'detail' END AS need, turn = 0 AS critical, round(least(20, greatest(1.8, length(text) / 15)), 6) AS seconds FROM conversations",
}
