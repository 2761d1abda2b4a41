"""Filter, ranking, fallback and lookup queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import scoring
from tessera.functions.text import contains_words, plain
from tessera.functions.time import micros
from tessera.operators import ranking as R
from tessera.operators.dictionary import matches
from tessera.session import table


def b01_hard_filter(spark, sf_dir):
    """Parts of some size, of no excluded type, with a wanted word in name or brand."""
    p = table(spark, sf_dir, "part")
    wanted = R.any_of([F.col(c).like(f"%{t}%") for t in ("red", "Brand#1") for c in ("p_name", "p_brand")])
    return p.filter((F.col("p_size") >= 10) & ~F.col("p_type").like("%PROMO%") & wanted).select("p_partkey")


def b02_recall_predicate(spark, sf_dir):
    """Recall by kind: names for kind 'name', brands for others; no usable term finds nothing."""
    p = table(spark, sf_dir, "part")
    found = [p.filter(R.any_of([F.col(c).contains(t) for t in terms])).select("p_partkey", F.lit(kind).alias("kind")) for kind, c, terms in (("name", "p_name", ["ring", "bolt"]), ("brand", "p_brand", ["#2"]), ("none", "p_name", []))]
    return found[0].unionByName(found[1]).unionByName(found[2])


def b03_precision_match(spark, sf_dir):
    """Documents whose text holds the name of a language's function words as whole words."""
    d = table(spark, sf_dir, "documents")
    return d.filter(contains_words(F.col("text"), F.lit("all rights reserved")) | contains_words(F.col("text"), F.lit("general public license"))).select("doc_id")


def b04_reject_reason(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    reason = R.first_reason([("missing", F.col("text").isNull()), ("tiny", F.length("text") < 40), ("junk", F.col("text").rlike("[#$%*]{3}")), ("license", F.col("text").rlike("(?i)rights reserved")), ("short", F.length("text") < 200)])
    return d.select("doc_id", reason.alias("reason")).filter("reason IS NOT NULL")


def b07_allow_list(spark, sf_dir):
    """Orders by an allow-list of priority and status with derived flags; others go to quarantine."""
    allow = spark.createDataFrame([("1-URGENT", "F", True), ("1-URGENT", "O", False), ("2-HIGH", "F", True), ("5-LOW", "P", False)], "o_orderpriority string, o_orderstatus string, share boolean")
    o = table(spark, sf_dir, "orders").join(F.broadcast(allow), ["o_orderpriority", "o_orderstatus"], "left")
    return o.groupBy(F.when(F.col("share").isNull(), "quarantine").when(F.col("share"), "open").otherwise("limited").alias("state")).agg(F.count(F.lit(1)).alias("n"))


def b08_excluded_terms(spark, sf_dir):
    """Customers of other regions than each segment's first one, by an exclusion table."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, sf_dir, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    home = c.groupBy("c_mktsegment").agg(F.min("r_name").alias("home"))
    return c.join(F.broadcast(home), "c_mktsegment").filter("r_name <> home").groupBy("c_mktsegment", "r_name").agg(F.count(F.lit(1)).alias("n"))


def b09_filter_cascade(spark, sf_dir):
    """Per order: lines that pass the hard rules, narrowed by rules as long as one is left; else the first pool with lines, twelve at most."""
    c = F.col
    hard = (c("l_quantity") >= 10) & (c("l_returnflag") != "R") & ~((c("l_linestatus") == "O") & (c("l_suppkey") % 5 == 0))
    role = F.array_contains(F.array(F.lit("A"), F.lit("N")), c("l_returnflag"))
    rules = [c("l_quantity") >= 25, role, c("l_tax") <= 0.06, c("l_linenumber") <= 4, c("l_discount") <= 0.04, c("l_suppkey") % 3 == 0, c("l_linestatus") == "F", c("l_partkey") % 2 == 0]
    pools = [(c("l_quantity") >= 40) & (c("l_linestatus") == "F"), c("l_quantity") >= 40, (c("l_discount") == 0) & (c("l_returnflag") == "N"), c("l_tax") == 0, c("l_returnflag") != "R", F.lit(True)]
    order = [F.desc("l_quantity"), c("l_partkey"), c("l_suppkey"), c("l_linenumber"), c("l_extendedprice")]
    out = R.allowed_or_pools(table(spark, sf_dir, "lineitem"), ["l_orderkey"], hard, rules, pools, order)
    return out.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.max("pool").cast("long").alias("pool"), F.sum("l_partkey").alias("parts"))


def b11_recent_diversity(spark, sf_dir):
    """Events that repeat a type too often among the user's last four, and users where none is allowed."""
    w = Window.partitionBy("user_id").orderBy("at", "event_id").rowsBetween(-4, -1)
    e = table(spark, sf_dir, "events").withColumn("at", micros(F.col("ts")))
    same = F.size(F.filter(F.collect_list("event_type").over(w), lambda x: x == F.col("event_type")))
    rows = e.withColumn("violations", F.array_compact(F.array(F.when(same >= 2, F.lit("recent")), F.when(F.col("value") < 1, F.lit("weak")))))
    return rows.groupBy("user_id").agg(F.count_if(F.size("violations") == 0).alias("allowed"), F.count_if(F.array_contains("violations", "recent")).alias("recent"), F.bool_and(F.size("violations") > 0).alias("bypass"))


def b12_quotas(spark, sf_dir):
    """Lines of an order beyond two of one return flag, or over 60 percent of it."""
    w = Window.partitionBy("l_orderkey", "l_returnflag")
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    rows = l.withColumn("i", F.row_number().over(w.orderBy("l_linenumber", "l_partkey"))).withColumn("share", F.count(F.lit(1)).over(w) / F.count(F.lit(1)).over(Window.partitionBy("l_orderkey")))
    return rows.groupBy("l_returnflag").agg(F.count_if(F.col("i") > 2).alias("over_count"), F.count_if(F.col("share") > 0.6).alias("over_share"))


def b13_null_tolerant(spark, sf_dir):
    """Documents not known to be of another language than English, of a known size of 100 characters or more; an unknown language passes."""
    d = table(spark, sf_dir, "documents").withColumn("known", F.when(F.col("doc_id") % 10 > 0, F.col("lang")))
    return d.filter(~(F.col("known").isNotNull() & (F.lower("known") != "en")) & (F.col("n_chars") >= 100)).select("doc_id")


def b15_weighted_prefilter(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    score = 5 * F.col("p_name").contains("red").cast("int") + 4 * (F.col("p_type") == "ECONOMY").cast("int") + 3 * (F.col("p_size") > 20).cast("int") - 12 * (F.col("p_retailprice") > 1800).cast("int")
    reason = R.first_reason([("price", F.col("p_retailprice") > 1800), ("weak", score < 3)])
    return p.select("p_partkey", score.cast("long").alias("score"), reason.alias("reason"))


def b16_threshold_gates(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    gates = (F.col("l_quantity") >= 20) & (F.col("l_discount") <= 0.05) & (F.col("l_tax") <= 0.04) & F.array_contains(F.array(F.lit("A"), F.lit("N")), F.col("l_returnflag"))
    return l.groupBy("l_suppkey").agg(F.count_if(gates).alias("passed"), F.count(F.lit(1)).alias("n"))


def b17_floor_or_best(spark, sf_dir):
    """Lines of an order with a quantity of 45 or more; for orders without any the best two."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    out = R.floor_or_best(R.dealt(l, ["l_orderkey"]), ["l_orderkey"], "l_quantity", 45, 2, [F.desc("l_quantity"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")])
    return out.select("l_orderkey", "l_partkey", "l_quantity")


def b18_any_violation(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bool_or((F.col("l_discount") > 0.09) | (F.col("l_quantity") < 2)).alias("violates"))


def b19_like_search(spark, sf_dir):
    """Case-blind search of one allowed term over three columns, the term as a parameter."""
    table(spark, sf_dir, "part").createOrReplaceTempView("part_search")
    return spark.sql("SELECT p_partkey FROM part_search WHERE lower(p_name) LIKE :t OR lower(p_brand) LIKE :t OR lower(p_type) LIKE :t ORDER BY p_partkey LIMIT 50", args={"t": "%ring%"})


def b25_valid_queries(spark, sf_dir):
    """Part names of two words or more that are not generic."""
    p = table(spark, sf_dir, "part")
    return p.filter((F.size(F.split("p_name", " ")) >= 2) & ~F.col("p_name").rlike("^(small|large) ")).select("p_partkey")


def f01_fallback_search(spark, sf_dir):
    """Per segment: customers of the first stage that has any (scene, block, all), by confidence, use and age, the best three by
    the composite score."""
    c = table(spark, sf_dir, "customer").withColumn("uses", F.col("c_custkey") % 12).withColumn("confidence", F.round((F.col("c_acctbal") + 1000) / 11000, 6))
    rows = R.first_tier(c, ["c_mktsegment"], [(F.col("c_acctbal") > 9990) & (F.col("c_nationkey") == 3), F.col("c_acctbal") > 9900, F.lit(True)])
    rows = R.top_k(rows, ["c_mktsegment"], [F.desc("confidence"), F.col("uses"), F.desc("c_custkey")], 10)
    boost = F.when(F.col("tier") == 0, 0.3).when(F.col("tier") == 1, 0.15).otherwise(0.0)
    score = boost + 0.55 * (F.col("c_custkey") % 10) / 10 + 0.4 * F.col("confidence") - F.least(F.lit(0.15), F.col("uses") * 0.015)
    rows = rows.withColumn("score", F.round(score, 6))
    return R.top_k(rows, ["c_mktsegment"], [F.desc("score"), F.col("c_custkey")], 3).select("c_mktsegment", "c_custkey", F.col("tier").cast("long").alias("tier"), "score")


def f02_hint_rank(spark, sf_dir):
    """Parts by hits of hints: 10 for a canonical phrase, 8 for a specific alias, 0.5 for each shared word; ties stay in order of key."""
    hints, aliases = ["red ring", "steel"], ["blue rod", "large widget"]
    words = F.array(*[F.lit(w) for h in hints + aliases for w in h.split()])
    phrase = lambda h, gain: F.when(contains_words(F.col("p_name"), F.lit(h)), gain).otherwise(0.0)
    score = sum((phrase(h, 10.0) for h in hints), F.lit(0.0)) + sum((phrase(h, 8.0) for h in aliases), F.lit(0.0)) + 0.5 * F.size(F.array_intersect(F.split(plain(F.col("p_name")), " "), words))
    return table(spark, sf_dir, "part").select("p_partkey", score.alias("score")).filter("score > 0").orderBy(F.desc("score"), "p_partkey").limit(20)


def _features():
    """Features of a line as a candidate of its order."""
    c = F.col
    reuse = F.least(F.lit(1.0), (c("uses") - 1) / 4.0)
    return {
        "semantic": c("l_quantity") / 50, "intent": (c("l_returnflag") == "N").cast("int"), "required": 1 - c("l_discount") * 10, "block": F.when(c("l_linestatus") == "F", 1.0).otherwise(0.45),
        "entity": (c("l_suppkey") % 4) / 4, "specific": F.lit(0.25) + (c("l_partkey") % 3) / 4, "theme": (c("l_partkey") % 5 == 0).cast("int"), "source": c("l_tax") * 10, "editorial": F.when(c("l_discount") < 0.03, 1.0).when(c("l_discount") < 0.06, 0.72).otherwise(0.28),
        "binding": F.lit(0.5), "resolution": F.lit(0.5), "motion": (c("l_linenumber") % 2).cast("double"), "confidence": 1 - c("l_tax") * 5, "intro": (c("l_linenumber") == 1).cast("int") * 0.75,
        "forbidden": (c("l_quantity") < 3).cast("int"), "source_reuse": reuse, "asset_reuse": (c("uses") > 6).cast("int"), "window_reuse": F.lit(0.0), "signature_reuse": reuse / 2, "block_mismatch": (c("l_linestatus") == "O").cast("int") * (c("l_partkey") % 7 == 0).cast("int"),
        "cross_scene": F.lit(0.0), "generic": (c("l_discount") > 0.08).cast("int"), "uncertain": (c("l_tax") > 0.07).cast("int"), "fallback": F.lit(0.0), "dark": (c("l_quantity") % 10 == 0).cast("int") * 0.6, "off_theme": F.lit(0.0),
    }


def f04_linear_rank(spark, sf_dir):
    """Best line of each order by the full score, with its reasons; returned lines are blocked."""
    l = table(spark, sf_dir, "lineitem")
    uses = l.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("uses"))
    f, blocked = _features(), F.col("l_returnflag") == "R"
    rows = l.join(uses, "l_partkey").withColumn("score", scoring.candidate_score(f, blocked)).withColumn("reasons", scoring.candidate_reasons(f, [("returned", blocked)]))
    best = R.top_k(rows, ["l_orderkey"], [F.desc("score"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber"), F.col("l_quantity"), F.col("l_extendedprice")], 1)
    return best.select("l_orderkey", "l_partkey", "score", F.array_join("reasons", ",").alias("reasons"))


def f05_banded_order(spark, sf_dir):
    """Order of parts by price bands of 50, then size, then key: the first 5 of each type."""
    p = table(spark, sf_dir, "part").withColumn("band", R.banded(F.col("p_retailprice"), 50.0))
    return R.top_k(p, ["p_type"], [F.desc("band"), F.desc("p_size"), F.col("p_partkey")], 5, "rank").select("p_type", "p_partkey", F.col("rank").cast("long").alias("rank"))


def f06_tier_budget(spark, sf_dir):
    """Lines of an order by return flag tier and price; at most one of tier R is allowed."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_extendedprice")
    tier = F.when(F.col("l_returnflag") == "N", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    used = F.sum(F.when(tier == 2, 1).otherwise(0)).over(Window.partitionBy("l_orderkey").orderBy(tier, F.desc("l_extendedprice"), "l_partkey", "l_suppkey", "l_linenumber").rowsBetween(Window.unboundedPreceding, 0))
    return l.withColumn("used", used).filter((tier < 2) | (F.col("used") <= 1)).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


def f07_worst_deficit(spark, sf_dir):
    """Per nation the customer with the largest deficit to 5000 times the segment's priority."""
    c = table(spark, sf_dir, "customer")
    weight = F.when(F.col("c_mktsegment") == "BUILDING", 3).when(F.col("c_mktsegment") == "MACHINERY", 2).otherwise(1)
    need = F.round((5000 - F.col("c_acctbal")) * weight, 2)
    rows = c.withColumn("need", need).filter("need > 0")
    return rows.groupBy("c_nationkey").agg(F.max_by("c_custkey", F.struct("need", -F.col("c_custkey"))).alias("c_custkey"), F.max("need").alias("need"))


def f08_bucket_order(spark, sf_dir):
    """Parts in three buckets by size, numbered within each by price."""
    p = table(spark, sf_dir, "part")
    bucket = F.when(F.col("p_size") >= 35, "long").when(F.col("p_size") >= 15, "short").otherwise("image")
    return p.withColumn("bucket", bucket).withColumn("n", F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("p_retailprice"), "p_partkey"))).filter("n <= 10").select("bucket", F.col("n").cast("long").alias("n"), "p_partkey")


def f09_newest_groups(spark, sf_dir):
    """Per user the three newest days with events."""
    e = table(spark, sf_dir, "events").withColumn("day", F.floor(micros(F.col("ts")) / 86_400_000_000))
    return R.top_k(e.groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("n")), ["user_id"], [F.desc("day")], 3)


def f13_first_pool(spark, sf_dir):
    """Per conversation the longest turn of the first pool that is not empty: system, assistant, user."""
    c = table(spark, sf_dir, "conversations")
    rows = R.first_tier(c, ["conv_id"], [F.col("role") == r for r in ("system", "assistant", "user")])
    return R.top_k(rows, ["conv_id"], [F.desc(F.length("text")), F.col("turn")], 1).select("conv_id", "turn", "role")


def f14_even_sample(spark, sf_dir):
    """Five events of each user spread evenly over their order."""
    e = table(spark, sf_dir, "events").withColumn("at", micros(F.col("ts")))
    return R.even_sample(e, ["user_id"], ["at", "event_id"], 5).select("user_id", "event_id")


def f17_token_recall(spark, sf_dir):
    """Parts by share of the query's words in the name plus bonuses for type and size, best five."""
    words = F.array(F.lit("red"), F.lit("ring"), F.lit("steel"))
    p = table(spark, sf_dir, "part")
    score = F.size(F.array_intersect(F.split("p_name", " "), words)) / 3 + F.when(F.col("p_type") == "ECONOMY", 0.3).otherwise(0.0) + F.when(F.col("p_size") > 25, 0.1).otherwise(0.0)
    return p.select("p_partkey", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "p_partkey").limit(5)


def f20_scoped_pool(spark, sf_dir):
    """Customers of a nation with over 9000 if there are any, else all, counted."""
    rows = R.first_tier(table(spark, sf_dir, "customer"), ["c_nationkey"], [F.col("c_acctbal") > 9000, F.lit(True)])
    return rows.groupBy("c_nationkey", F.col("tier").cast("long").alias("tier")).agg(F.count(F.lit(1)).alias("n"))


def c18_metadata_lookup(spark, sf_dir):
    """Lines with their part's and supplier's nation, dimension tables joined as Spark sees fit."""
    l = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"), "left")
    l = l.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return l.groupBy("n_name", "p_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def c19_containment_join(spark, sf_dir):
    """Words of part names that contain, or are contained in, a word of the vocabulary."""
    vocab = spark.createDataFrame([("ring",), ("widgets",), ("steel rod",), ("gear",)], "term string")
    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct().filter("length(word) >= 4")
    return words.join(F.broadcast(vocab), F.col("word").contains(F.col("term")) | F.col("term").contains(F.col("word")))


def c20_approval(spark, sf_dir):
    """Customers, their orders and lines: approved lines (not returned, of finished orders) per customer and coverage."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    ok = (F.col("o_orderstatus") == "F") & (F.col("l_returnflag") != "R")
    rows = o.groupBy("o_custkey").agg(F.count_if(ok).alias("approved"), F.count("l_orderkey").alias("lines"))
    return table(spark, sf_dir, "customer").join(rows, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("approved", F.lit(0)).alias("approved"), (F.coalesce("approved", F.lit(0)) >= 3).alias("covered"))


def c25_keyed_left_joins(spark, sf_dir):
    """Users with their counts of purchases, errors and views, zeros where there are none."""
    e = table(spark, sf_dir, "events")
    out = e.select("user_id").distinct()
    for k in ("purchase", "error", "view"):
        out = out.join(e.filter(F.col("event_type") == k).groupBy("user_id").agg(F.count(F.lit(1)).alias(k)), "user_id", "left")
    return out.select("user_id", *[F.coalesce(k, F.lit(0)).alias(k) for k in ("purchase", "error", "view")])


def c30_retention(spark, sf_dir):
    """Orders that are neither among a customer's newest two nor have a large line."""
    o = R.top_k(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 2)
    big = table(spark, sf_dir, "lineitem").filter("l_quantity >= 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(o.select("o_orderkey"), "o_orderkey", "left_anti").join(big, "o_orderkey", "left_anti").select("o_orderkey")


def c32_gazetteer(spark, sf_dir):
    """Documents that hold terms of a gazetteer as whole words, terms joined; the gazetteer is a fixed list."""
    terms = spark.createDataFrame(list(enumerate(["apache license", "general public license", "all rights reserved", "cc by"])), "k long, term string")
    hit = matches(table(spark, sf_dir, "documents"), "doc_id", "text", terms, "k", "term").select(F.col("doc").alias("doc_id"), F.col("term").alias("term_")).join(F.broadcast(terms), F.col("k") == F.col("term_"))
    return hit.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("term")), ",").alias("terms"))


QUERIES = {k: v for k, v in list(globals().items()) if k[0] in "bcf" and k[1:3].isdigit()}
_PLAIN = "trim(regexp_replace(strip_accents(lower({0})), '[^a-z0-9]+', ' ', 'g'))"
_HOLDS = "contains(' ' || " + _PLAIN + " || ' ', ' {1} ')"
_CASCADE = ["l_quantity >= 25", "l_returnflag IN ('A', 'N')", "l_tax <= 0.06", "l_linenumber <= 4", "l_discount <= 0.04", "l_suppkey % 3 = 0", "l_linestatus = 'F'", "l_partkey % 2 = 0"]
_RULES = " ".join(
    f"v{i} AS (SELECT * EXCLUDE (ok, left_), CASE WHEN left_ THEN ok AND {rule} ELSE ok END AS ok FROM (SELECT *, bool_or(ok AND {rule}) OVER (PARTITION BY l_orderkey) AS left_ FROM v{i - 1}))," for i, rule in enumerate(_CASCADE, 1)
)
ORACLE = {
    "b01_hard_filter": "SELECT p_partkey FROM part WHERE p_size >= 10 AND p_type NOT LIKE '%PROMO%' AND (p_name LIKE '%red%' OR p_brand LIKE '%red%' OR p_name LIKE '%Brand#1%' OR p_brand LIKE '%Brand#1%')",
    "b02_recall_predicate": "SELECT p_partkey, 'name' AS kind FROM part WHERE p_name LIKE '%ring%' OR p_name LIKE '%bolt%' UNION ALL SELECT p_partkey, 'brand' FROM part WHERE p_brand LIKE '%#2%'",
    "b03_precision_match": f"SELECT doc_id FROM documents WHERE {_HOLDS.format('text', 'all rights reserved')} OR {_HOLDS.format('text', 'general public license')}",
    "b04_reject_reason": """SELECT * FROM (SELECT doc_id, CASE WHEN text IS NULL THEN 'missing' WHEN length(text) < 40 THEN 'tiny' WHEN regexp_matches(text, '[#$%*]{3}') THEN 'junk' WHEN regexp_matches(text, '(?i)rights reserved') THEN 'license'
        WHEN length(text) < 200 THEN 'short' END AS reason FROM documents) WHERE reason IS NOT NULL""",
    "b07_allow_list": """SELECT CASE WHEN share IS NULL THEN 'quarantine' WHEN share THEN 'open' ELSE 'limited' END AS state, count(*) AS n FROM orders LEFT JOIN
        (VALUES ('1-URGENT', 'F', true), ('1-URGENT', 'O', false), ('2-HIGH', 'F', true), ('5-LOW', 'P', false)) a(p, s, share) ON o_orderpriority = p AND o_orderstatus = s GROUP BY 1""",
    "b08_excluded_terms": """WITH c AS (SELECT c_mktsegment, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
        SELECT c_mktsegment, r_name, count(*) AS n FROM c JOIN (SELECT c_mktsegment, min(r_name) AS home FROM c GROUP BY 1) h USING (c_mktsegment) WHERE r_name <> home GROUP BY 1, 2""",
    "b09_filter_cascade": f"""WITH h AS (SELECT *, l_quantity >= 10 AND l_returnflag <> 'R' AND NOT (l_linestatus = 'O' AND l_suppkey % 5 = 0) AS hard FROM lineitem), v0 AS (SELECT *, true AS ok FROM h WHERE hard),
        {_RULES}
        o AS (SELECT *, 0 AS pool FROM v{len(_CASCADE)} WHERE ok),
        q AS (SELECT *, CASE WHEN l_quantity >= 40 AND l_linestatus = 'F' THEN 1 WHEN l_quantity >= 40 THEN 2 WHEN l_discount = 0 AND l_returnflag = 'N' THEN 3 WHEN l_tax = 0 THEN 4 WHEN l_returnflag <> 'R' THEN 5 ELSE 6 END AS pool FROM h
              WHERE l_orderkey NOT IN (SELECT l_orderkey FROM h WHERE hard)),
        m AS (SELECT *, min(pool) OVER (PARTITION BY l_orderkey) AS first FROM q),
        t AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS n FROM m WHERE pool = first)
        SELECT l_orderkey, count(*) AS n, CAST(max(pool) AS BIGINT) AS pool, CAST(sum(l_partkey) AS BIGINT) AS parts FROM (SELECT l_orderkey, l_partkey, pool FROM o UNION ALL SELECT l_orderkey, l_partkey, pool FROM t WHERE n <= 12) GROUP BY 1""",
    "b11_recent_diversity": """WITH e AS (SELECT *, len(list_filter(list(event_type) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), lambda x: x = event_type)) AS same FROM events),
        v AS (SELECT user_id, coalesce(same, 0) >= 2 AS r, value < 1 AS w FROM e)
        SELECT user_id, count(*) FILTER (NOT r AND NOT w) AS allowed, count(*) FILTER (r) AS recent, bool_and(r OR w) AS bypass FROM v GROUP BY user_id""",
    "b12_quotas": """SELECT l_returnflag, count(*) FILTER (i > 2) AS over_count, count(*) FILTER (share > 0.6) AS over_share FROM (SELECT l_returnflag, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey) AS i,
        count(*) OVER (PARTITION BY l_orderkey, l_returnflag) / count(*) OVER (PARTITION BY l_orderkey) AS share FROM lineitem) GROUP BY 1""",
    "b13_null_tolerant": "SELECT doc_id FROM documents WHERE (doc_id % 10 = 0 OR lang IS NULL OR lower(lang) = 'en') AND n_chars >= 100",
    "b15_weighted_prefilter": """WITH s AS (SELECT p_partkey, p_retailprice, CAST(5 * (p_name LIKE '%red%')::INT + 4 * (p_type = 'ECONOMY')::INT + 3 * (p_size > 20)::INT - 12 * (p_retailprice > 1800)::INT AS BIGINT) AS score FROM part)
        SELECT p_partkey, score, CASE WHEN p_retailprice > 1800 THEN 'price' WHEN score < 3 THEN 'weak' END AS reason FROM s""",
    "b16_threshold_gates": "SELECT l_suppkey, count(*) FILTER (l_quantity >= 20 AND l_discount <= 0.05 AND l_tax <= 0.04 AND l_returnflag IN ('A', 'N')) AS passed, count(*) AS n FROM lineitem GROUP BY 1",
    "b17_floor_or_best": """WITH r AS (SELECT *, max(l_quantity) OVER (PARTITION BY l_orderkey) AS m, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_partkey, l_suppkey, l_linenumber) AS n FROM lineitem)
        SELECT l_orderkey, l_partkey, l_quantity FROM r WHERE CASE WHEN m >= 45 THEN l_quantity >= 45 ELSE n <= 2 END""",
    "b18_any_violation": "SELECT l_orderkey, bool_or(l_discount > 0.09 OR l_quantity < 2) AS violates FROM lineitem GROUP BY 1",
    "b19_like_search": "SELECT p_partkey FROM part WHERE lower(p_name) LIKE '%ring%' OR lower(p_brand) LIKE '%ring%' OR lower(p_type) LIKE '%ring%' ORDER BY p_partkey LIMIT 50",
    "b25_valid_queries": "SELECT p_partkey FROM part WHERE len(string_split(p_name, ' ')) >= 2 AND NOT regexp_matches(p_name, '^(small|large) ')",
    "f01_fallback_search": """WITH t AS (SELECT *, c_custkey % 12 AS uses, round((c_acctbal + 1000) / 11000, 6) AS confidence, CASE WHEN c_acctbal > 9990 AND c_nationkey = 3 THEN 0 WHEN c_acctbal > 9900 THEN 1 ELSE 2 END AS tier FROM customer), m AS (SELECT *, min(tier) OVER (PARTITION BY c_mktsegment) AS best FROM t),
        r AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY confidence DESC, uses, c_custkey DESC) AS n FROM m WHERE tier = best),
        s AS (SELECT *, round(CASE tier WHEN 0 THEN 0.3::DOUBLE WHEN 1 THEN 0.15::DOUBLE ELSE 0 END + 0.55::DOUBLE * (c_custkey % 10) / 10 + 0.4::DOUBLE * confidence - least(0.15::DOUBLE, uses * 0.015::DOUBLE), 6) AS score FROM r WHERE n <= 10),
        k AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY score DESC, c_custkey) AS i FROM s) SELECT c_mktsegment, c_custkey, tier, score FROM k WHERE i <= 3""",
    "f02_hint_rank": f"""SELECT * FROM (SELECT p_partkey, CASE WHEN {_HOLDS.format('p_name', 'red ring')} THEN 10.0 ELSE 0 END + CASE WHEN {_HOLDS.format('p_name', 'steel')} THEN 10.0 ELSE 0 END + CASE WHEN {_HOLDS.format('p_name', 'blue rod')} THEN 8.0 ELSE 0 END + CASE WHEN {_HOLDS.format('p_name', 'large widget')} THEN 8.0 ELSE 0 END
        + 0.5 * len(list_intersect(list_distinct(string_split({_PLAIN.format('p_name')}, ' ')), ['red', 'ring', 'steel', 'blue', 'rod', 'large', 'widget'])) AS score FROM part) WHERE score > 0 ORDER BY score DESC, p_partkey LIMIT 20""",
    "f04_linear_rank": """WITH u AS (SELECT *, count(*) OVER (PARTITION BY l_partkey) AS uses FROM lineitem), x AS (SELECT *, least(1, (uses - 1) / 4.0::DOUBLE) AS reuse, (uses > 6)::INT AS asset, (l_linestatus = 'O' AND l_partkey % 7 = 0)::INT AS wrong, (l_discount > 0.08)::INT AS generic, (l_tax > 0.07)::INT AS unsure, (l_quantity % 10 = 0)::INT * 0.6::DOUBLE AS dark FROM u),
        s AS (SELECT *, CASE WHEN l_returnflag = 'R' THEN -1.0::DOUBLE ELSE round(l_quantity / 50 * 8 + (l_returnflag = 'N')::INT * 3 + (1 - l_discount * 10) * 5 + CASE WHEN l_linestatus = 'F' THEN 1.0::DOUBLE ELSE 0.45::DOUBLE END * 3 + (l_suppkey % 4) / 4 * 3.5::DOUBLE + (0.25::DOUBLE + (l_partkey % 3) / 4) * 3 + (l_partkey % 5 = 0)::INT * 3
            + l_tax * 10 * 2.5::DOUBLE + CASE WHEN l_discount < 0.03 THEN 1.0::DOUBLE WHEN l_discount < 0.06 THEN 0.72::DOUBLE ELSE 0.28::DOUBLE END * 3 + 0.5::DOUBLE * 3.5::DOUBLE + 0.5::DOUBLE + l_linenumber % 2 + (1 - l_tax * 5) + (l_linenumber = 1)::INT * 0.75::DOUBLE
            - (l_quantity < 3)::INT * 10 - reuse * 4 - asset * 4 - reuse / 2 * 3.5::DOUBLE - wrong * 8 - generic * 7 - unsure * 5 - dark * 4, 3) END AS score,
            concat_ws(',', CASE WHEN l_returnflag = 'R' THEN 'returned' END, CASE WHEN wrong >= 1 THEN 'wrong_block' END, CASE WHEN asset >= 1 THEN 'reused_asset' END, CASE WHEN reuse >= 1 THEN 'reused_source_url' END, CASE WHEN reuse / 2 >= 0.5 THEN 'repeated_visual_signature' END,
              CASE WHEN generic >= 1 THEN 'generic_asset' END, CASE WHEN unsure >= 1 THEN 'uncertain_asset' END, CASE WHEN dark >= 0.5 THEN 'dark_frame_risk' END, CASE WHEN l_quantity / 50 < 0.2 THEN 'low_semantic_score' END) AS reasons FROM x)
        SELECT l_orderkey, l_partkey, score, reasons FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) AS n FROM s) WHERE n = 1""",
    "f05_banded_order": """SELECT p_type, p_partkey, n AS rank FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY floor(p_retailprice / 50) DESC, p_size DESC, p_partkey) AS n FROM part) WHERE n <= 5""",
    "f06_tier_budget": """WITH t AS (SELECT *, CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS tier FROM lineitem),
        u AS (SELECT *, sum((tier = 2)::INT) OVER (PARTITION BY l_orderkey ORDER BY tier, l_extendedprice DESC, l_partkey, l_suppkey, l_linenumber ROWS UNBOUNDED PRECEDING) AS used FROM t)
        SELECT l_orderkey, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM u WHERE tier < 2 OR used <= 1 GROUP BY l_orderkey""",
    "f07_worst_deficit": """WITH n AS (SELECT *, round((5000 - c_acctbal) * CASE c_mktsegment WHEN 'BUILDING' THEN 3 WHEN 'MACHINERY' THEN 2 ELSE 1 END, 2) AS need FROM customer)
        SELECT c_nationkey, arg_max(c_custkey, (need, -c_custkey)) AS c_custkey, max(need) AS need FROM n WHERE need > 0 GROUP BY 1""",
    "f08_bucket_order": """SELECT bucket, n, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY p_retailprice DESC, p_partkey) AS n FROM
        (SELECT *, CASE WHEN p_size >= 35 THEN 'long' WHEN p_size >= 15 THEN 'short' ELSE 'image' END AS bucket FROM part)) WHERE n <= 10""",
    "f09_newest_groups": """SELECT user_id, day, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS i FROM (SELECT user_id, epoch_us(ts) // 86400000000 AS day, count(*) AS n FROM events GROUP BY 1, 2)) WHERE i <= 3""",
    "f13_first_pool": """WITH t AS (SELECT *, CASE role WHEN 'system' THEN 0 WHEN 'assistant' THEN 1 WHEN 'user' THEN 2 END AS tier FROM conversations), m AS (SELECT *, min(tier) OVER (PARTITION BY conv_id) AS best FROM t)
        SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS n FROM m WHERE tier = best) WHERE n = 1""",
    "f14_even_sample": """WITH o AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
        SELECT DISTINCT user_id, event_id FROM o, (VALUES (0), (1), (2), (3), (4)) j(j) WHERE n <= 5 OR i = floor(j * ((n - 1) / 4.0::DOUBLE) + 0.5)""",
    "f17_token_recall": """SELECT p_partkey, round(len(list_intersect(list_distinct(string_split(p_name, ' ')), ['red', 'ring', 'steel'])) / 3 + CASE WHEN p_type = 'ECONOMY' THEN 0.3 ELSE 0 END + CASE WHEN p_size > 25 THEN 0.1 ELSE 0 END, 6) AS score
        FROM part ORDER BY score DESC, p_partkey LIMIT 5""",
    "f20_scoped_pool": """WITH t AS (SELECT c_nationkey, CASE WHEN c_acctbal > 9000 THEN 0 ELSE 1 END AS tier FROM customer), m AS (SELECT *, min(tier) OVER (PARTITION BY c_nationkey) AS best FROM t)
        SELECT c_nationkey, tier, count(*) AS n FROM (SELECT c_nationkey, CASE WHEN best = 0 THEN tier ELSE 1 END AS tier, best FROM m) WHERE tier = best GROUP BY 1, 2""",
    "c18_metadata_lookup": """SELECT n_name, p_type, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2""",
    "c19_containment_join": """SELECT word, term FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part), (VALUES ('ring'), ('widgets'), ('steel rod'), ('gear')) v(term) WHERE length(word) >= 4 AND (contains(word, term) OR contains(term, word))""",
    "c20_approval": """WITH r AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F' AND l_returnflag <> 'R') AS approved FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)
        SELECT c_custkey, coalesce(approved, 0) AS approved, coalesce(approved, 0) >= 3 AS covered FROM customer LEFT JOIN r ON c_custkey = o_custkey""",
    "c25_keyed_left_joins": "SELECT user_id, count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY 1",
    "c30_retention": """WITH r AS (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders)
        SELECT o_orderkey FROM r WHERE n > 2 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 45)""",
    "c32_gazetteer": f"""SELECT doc_id, string_agg(term, ',' ORDER BY term) AS terms FROM (SELECT doc_id, ' ' || {_PLAIN.format('text')} || ' ' AS t FROM documents), (VALUES ('apache license'), ('general public license'), ('all rights reserved'), ('cc by')) v(term)
        WHERE contains(t, ' ' || term || ' ') GROUP BY doc_id""",
}
