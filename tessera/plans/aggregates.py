"""Aggregate queries: term counts, coverage, gates, quotas, quality figures."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import scoring
from tessera.functions.text import sentences
from tessera.functions.time import micros
from tessera.operators.intervals import union_length
from tessera.operators import ranking as R
from tessera.operators.ranking import top_k
from tessera.plans.intervals import _ISLANDS, SPANS, spans
from tessera.session import table


def d01_term_counts(spark, sf_dir):
    """Counts of the words of part names and of the parts' types, one scan."""
    p = table(spark, sf_dir, "part")
    kinds = F.array(F.struct(F.lit("name").alias("kind"), F.split("p_name", " ").alias("terms")), F.struct(F.lit("type").alias("kind"), F.array("p_type").alias("terms")))
    rows = p.select(F.inline(kinds)).select("kind", F.explode("terms").alias("term"))
    return rows.filter("term <> ''").groupBy("kind", "term").agg(F.count(F.lit(1)).alias("n"))


def d02_top_terms(spark, sf_dir):
    """Per kind the five commonest terms with at least two uses, as one line of text."""
    rows = d01_term_counts(spark, sf_dir).filter("n >= 2")
    best = top_k(rows, ["kind"], [F.desc("n"), F.col("term")], 5, "i")
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "term", "n"))), lambda x: F.concat_ws(":", x["term"], x["n"].cast("string"))), ", ")
    return best.groupBy("kind").agg(line.alias("line"))


def d04_coverage(spark, sf_dir):
    """Per event type: covered time of users summed, events, users, mean value."""
    s = spans(spark, sf_dir)
    covered = union_length(s, ["event_type", "user_id"]).groupBy("event_type").agg(F.sum("covered").alias("covered"))
    rest = s.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.avg("value"), 6).alias("mean_value"))
    return covered.join(rest, "event_type")


def d05_filler_coverage(spark, sf_dir):
    """Covered time by views of users that have no purchase."""
    s = spans(spark, sf_dir)
    buyers = s.filter("event_type = 'purchase' AND value > 60").select("user_id").distinct()
    return union_length(s.filter("event_type = 'view'").join(buyers, "user_id", "left_anti"), ["user_id"])


def d07_importance(spark, sf_dir):
    """Event types by share of all value and of users, with a rank."""
    e = table(spark, sf_dir, "events")
    total = e.agg(F.sum("value").alias("all_value"), F.countDistinct("user_id").alias("all_users"))
    rows = e.groupBy("event_type").agg(F.sum("value").alias("v"), F.countDistinct("user_id").alias("u")).join(F.broadcast(total))
    score = F.round(0.6 * F.col("v") / F.col("all_value") + 0.4 * F.col("u") / F.col("all_users"), 6)
    return rows.select("event_type", score.alias("score")).withColumn("rank", F.rank().over(Window.orderBy(F.desc("score"))))


def d08_two_thresholds(spark, sf_dir):
    """Suppliers whose returned lines reach a quantity and a number of parts."""
    l = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'")
    rows = l.groupBy("l_suppkey").agg(F.sum("l_quantity").alias("quantity"), F.countDistinct("l_partkey").alias("parts"))
    return rows.withColumn("covered", (F.col("quantity") >= 3000) & (F.col("parts") >= 100))


def d09_status_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))


def d10_readiness(spark, sf_dir):
    """Sources whose labelled documents all meet a quality floor: counts and verdict."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    rows = d.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("quality = 1 AND toxic = 0")).alias("good"))
    return rows.withColumn("ready", F.col("good") >= 0.6 * F.col("n"))


def d11_coverage_state(spark, sf_dir):
    """State of each customer's balance against a target of 5000."""
    c = table(spark, sf_dir, "customer")
    state = scoring.state(F.col("c_acctbal") / 5000, [(1.5, "ample"), (1.0, "covered"), (0.4, "partial")], "missing")
    return c.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def d12_catalogue_stats(spark, sf_dir):
    """The three commonest sources, languages and their counts."""
    d = table(spark, sf_dir, "documents")
    rows = d.select(F.inline(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("item")) for c in ("source", "lang")]))).groupBy("kind", "item").agg(F.count(F.lit(1)).alias("n"))
    return top_k(rows, ["kind"], [F.desc("n"), F.col("item")], 3)


def d13_group_stats(spark, sf_dir):
    """Orders by status and priority: count, sum, and three smallest keys."""
    o = table(spark, sf_dir, "orders")
    best = top_k(o, ["o_orderstatus", "o_orderpriority"], [F.col("o_orderkey")], 3)
    some = best.groupBy("o_orderstatus", "o_orderpriority").agg(F.array_join(F.array_sort(F.collect_list("o_orderkey")).cast("array<string>"), ",").alias("examples"))
    sums = o.groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return sums.join(some, ["o_orderstatus", "o_orderpriority"])


def d16_cost_rollup(spark, sf_dir):
    """Revenue by return flag and line status, with subtotals, and the largest line of each group."""
    l = table(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    out = l.rollup("l_returnflag", "l_linestatus").agg(F.round(F.sum(price), 2).alias("revenue"), F.count(F.lit(1)).alias("n"), F.max("l_extendedprice").alias("largest"))
    return out


def d18_topic_sets(spark, sf_dir):
    """Event types that each user has, those that are missing, and whether all are there."""
    e = table(spark, sf_dir, "events")
    kinds = F.array(*[F.lit(k) for k in ("click", "error", "purchase", "signup", "view")])
    rows = e.groupBy("user_id").agg(F.collect_set("event_type").alias("has"))
    missing = F.array_join(F.array_sort(F.array_except(kinds, F.col("has"))), ",")
    return rows.select("user_id", F.size("has").cast("long").alias("n"), missing.alias("missing"), (F.size("has") == 5).alias("complete"))


def d19_conditional_counts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy("o_orderpriority").agg(
        F.count_if(F.expr("o_orderstatus = 'F'")).alias("finished"),
        F.count_if(F.expr("o_orderstatus = 'O'")).alias("open"),
        F.round(F.count_if(F.expr("o_orderstatus = 'F'")) / F.count(F.lit(1)), 6).alias("share"),
    )


def d20_average_by_key(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.lower("l_returnflag").alias("flag")).agg(F.round(F.avg("l_discount"), 3).alias("mean_discount"))


def d21_blended_scores(spark, sf_dir):
    """Mean value of each user's earlier and later events, blended 0.65 to 0.35; a side that is missing counts as 50."""
    e = table(spark, sf_dir, "events").withColumn("late", micros(F.col("ts")) >= 1705276800000000)
    old = e.filter("NOT late").groupBy("user_id").agg(F.avg("value").alias("a"))
    new = e.filter("late").groupBy("user_id").agg(F.avg("value").alias("b"))
    blend = 0.65 * F.coalesce("a", F.lit(50.0)) + 0.35 * F.coalesce("b", F.lit(50.0))
    return old.join(new, "user_id", "full_outer").select("user_id", F.round(blend, 6).alias("score"))


def d22_incremental_mean(spark, sf_dir):
    """New mean of each event type from a prior mean and weight of 10, and quality three quarters old."""
    e = table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("n"))
    mean = (F.lit(500.0) + F.col("s")) / (F.col("n") + 10)
    return e.select("event_type", F.round(mean, 6).alias("mean"), F.round(0.75 * 50.0 + 0.25 * mean, 6).alias("quality"))


def d23_block_coverage(spark, sf_dir):
    """Per conversation: turns by length level, share of long ones, status and the commonest level."""
    c = table(spark, sf_dir, "conversations").withColumn("level", F.when(F.length("text") >= 400, "long").when(F.length("text") >= 150, "middle").otherwise("short"))
    rows = c.groupBy("conv_id").agg(*[F.count_if(F.col("level") == k).alias(k) for k in ("long", "middle", "short")], F.count(F.lit(1)).alias("n"))
    share = F.col("long") / F.col("n")
    status = F.when(share >= 0.5, "STRONG").when(F.col("long") + F.col("middle") >= 0.5 * F.col("n"), "PARTIAL").otherwise("INSUFFICIENT")
    most = F.greatest("long", "middle", "short")
    main = F.when(F.col("long") == most, "long").when(F.col("middle") == most, "middle").otherwise("short")
    return rows.select("conv_id", F.round(share, 6).alias("share"), status.alias("status"), main.alias("main"))


def d24_repeated_keys(spark, sf_dir):
    """Texts that stand in more than two documents: digest and count."""
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("digest")).agg(F.count(F.lit(1)).alias("n"))
    return d.filter("n > 2")


def d25_latency(spark, sf_dir):
    """Per event type: exposure (time to the user's next event, at most a day), average, nearest-rank p95 and maximum."""
    w = Window.partitionBy("user_id").orderBy("at", "event_id")
    e = table(spark, sf_dir, "events").withColumn("at", micros(F.col("ts")))
    rows = e.withColumn("wait", F.least(F.lead("at").over(w) - F.col("at"), F.lit(86_400_000_000))).filter("wait IS NOT NULL")
    sums = rows.groupBy("event_type").agg(F.sum("wait").alias("exposure"), F.round(F.avg("wait"), 3).alias("mean"), F.max("wait").alias("longest"))
    p95 = R.at_rank(rows, ["event_type"], "wait", lambda n: F.ceil(n * 95 / 100)).withColumnRenamed("wait", "p95")
    return sums.join(p95, "event_type").select("event_type", "exposure", "mean", "p95", "longest")


def d27_diversity(spark, sf_dir):
    """Diversity of each customer's orders: distinct priorities and statuses against orders, and share of finished ones."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.countDistinct("o_orderpriority").alias("p"), F.countDistinct("o_orderstatus").alias("s"), F.count(F.lit(1)).alias("n"), F.count_if(F.expr("o_orderstatus = 'F'")).alias("f"))
    score = scoring.clamp(0.45 * F.col("p") / F.col("n") + 0.45 * F.col("s") / F.col("n") + 0.1 * (1 - F.col("f") / F.col("n")))
    return o.select("o_custkey", F.round(score, 3).alias("score"))


def d28_share_quotas(spark, sf_dir):
    """Shares of part types per brand and whether each is within 10 to 25 percent."""
    p = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("p_brand"))
    return p.select("p_brand", "p_type", F.round(share, 6).alias("share"), share.between(0.1, 0.25).alias("within"))


def d29_block_audit(spark, sf_dir):
    """Per conversation: roles, neighbouring repeats, roles that are missing."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").withColumn("same", F.coalesce(F.lag("role").over(w) == F.col("role"), F.lit(False)))
    rows = c.groupBy("conv_id").agg(F.collect_set("role").alias("r"), F.count_if("same").alias("repeats"))
    gone = F.array_except(F.array(F.lit("assistant"), F.lit("system"), F.lit("user")), F.col("r"))
    return rows.select("conv_id", F.size("r").cast("long").alias("roles"), "repeats", F.array_join(gone, ",").alias("missing"))


def d30_top_reasons(spark, sf_dir):
    """The three commonest reasons for which lines are not the largest of their order."""
    l = table(spark, sf_dir, "lineitem")
    top = F.max("l_extendedprice").over(Window.partitionBy("l_orderkey"))
    reasons = F.array_compact(F.array(F.when(F.col("l_discount") > 0.05, F.lit("discount")), F.when(F.col("l_quantity") < 10, F.lit("small")), F.when(F.col("l_returnflag") == "R", F.lit("returned")), F.when(F.col("l_tax") == 0, F.lit("untaxed"))))
    rows = l.withColumn("top", top).filter("l_extendedprice < top").select(F.explode(reasons).alias("reason"))
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason").limit(3)


def d31_mode_first_seen(spark, sf_dir):
    """Each user's commonest event type; on a tie the one seen first."""
    e = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))
    return top_k(e, ["user_id"], [F.desc("n"), F.col("first")], 1).select("user_id", "event_type", "n")


def d32_pivot(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).select("o_orderpriority", *[F.coalesce(c, F.lit(0)).alias(f"n_{c.lower()}") for c in ("F", "O", "P")])


def d34_consolidated(spark, sf_dir):
    """Per user: mean value, the type of the largest value, distinct types joined."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.round(F.avg("value"), 6).alias("mean"), F.max_by("event_type", F.struct("value", "event_id")).alias("main"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("types")
    )
    return e


def d35_text_figures(spark, sf_dir):
    """Sentence count, mean, population deviation and maximum of sentence lengths in words, per document."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(sentences(F.col("text"))).alias("s"))
    n = F.size(F.filter(F.split("s", "[ \\t\\r\\n]+"), lambda w: w != ""))
    return d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sentences"), F.round(F.avg(n), 6).alias("mean"), F.round(F.stddev_pop(n), 6).alias("deviation"), F.max(n).cast("long").alias("longest"))


def d36_keywords(spark, sf_dir):
    """The three commonest words over four letters of each language."""
    d = table(spark, sf_dir, "documents").select("lang", F.explode(F.split(F.lower("text"), "[^\\p{L}]+")).alias("word")).filter("length(word) > 4")
    return top_k(d.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")), ["lang"], [F.desc("n"), F.col("word")], 3)


def d39_required_slots(spark, sf_dir):
    """Conversations that have each required role, by counts of roles."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(*[F.count_if(F.col("role") == r).alias(r) for r in ("user", "assistant")])
    missing = F.array_join(F.array_compact(F.array(*[F.when(F.col(r) == 0, F.lit(r)) for r in ("assistant", "user")])), ",")
    return c.select("conv_id", missing.alias("missing"), ((F.col("user") > 0) & (F.col("assistant") > 0)).alias("covered"))


def d41_gate(spark, sf_dir):
    """Per source: share of good labels, whether any is toxic, whether all are good."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.groupBy("source").agg(F.round(F.avg("quality"), 6).alias("share"), F.bool_or(F.col("toxic") == 1).alias("any_toxic"), F.bool_and(F.col("quality") == 1).alias("all_good"))


def d42_feasible(spark, sf_dir):
    """Orders all of whose lines ship within 120 days, and the share of quantity that does not."""
    l = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    late = F.datediff("l_shipdate", "o_orderdate") > 60
    rows = l.groupBy("o_orderkey").agg(F.sum(F.when(late, F.col("l_quantity")).otherwise(0.0)).alias("late"), F.sum("l_quantity").alias("all"), F.bool_and(~late).alias("feasible"))
    return rows.select("o_orderkey", F.round(F.col("late") / F.col("all"), 6).alias("late_share"), "feasible")


def d43_weighted_score(spark, sf_dir):
    """Weighted score of parts from size, price and name, with a default for missing parts."""
    p = table(spark, sf_dir, "part")
    score = scoring.weighted([(F.col("p_size") / 50, 0.24), (F.col("p_retailprice") / 2000, 0.2), (F.length("p_name") / 20, 0.24), (F.when(F.col("p_type") == "ECONOMY", 1.0), 0.32)], missing=0.5)
    return p.select("p_partkey", F.round(score, 6).alias("score"))


def d15_stage_ledger(spark, sf_dir):
    """Two levels of totals: price per customer and status, and the customer's sum beside each."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.round(F.sum("o_totalprice"), 2).alias("cost"))
    return o.withColumn("total", F.round(F.sum("cost").over(Window.partitionBy("o_custkey")), 2))


def d14_profile(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("category")).agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("value"), 4).alias("seconds"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("items"))


QUERIES = {k: v for k, v in list(globals().items()) if k[0] == "d" and k[1:3].isdigit()}
_WORDS = "list_filter(string_split_regex({0}, '[ \\t\\r\\n]+'), lambda x: x <> '')"
ORACLE = {
    "d01_term_counts": """SELECT kind, term, count(*) AS n FROM (SELECT 'name' AS kind, unnest(string_split(p_name, ' ')) AS term FROM part UNION ALL SELECT 'type', p_type FROM part) WHERE term <> '' GROUP BY kind, term""",
    "d02_top_terms": """WITH t AS (SELECT kind, term, count(*) AS n FROM (SELECT 'name' AS kind, unnest(string_split(p_name, ' ')) AS term FROM part UNION ALL SELECT 'type', p_type FROM part) WHERE term <> '' GROUP BY kind, term),
        r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, term) AS i FROM t WHERE n >= 2) SELECT kind, string_agg(term || ':' || n, ', ' ORDER BY i) AS line FROM r WHERE i <= 5 GROUP BY kind""",
    "d04_coverage": SPANS.replace("FROM events)", "FROM events)") + """, r AS (SELECT *, max("end") OVER (PARTITION BY event_type, user_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s WHERE "end" > "start"),
        g AS (SELECT *, sum(CASE WHEN reach IS NULL OR "start" > reach THEN 1 ELSE 0 END) OVER (PARTITION BY event_type, user_id ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS island FROM r),
        i AS (SELECT event_type, max("end") - min("start") AS len FROM g GROUP BY event_type, user_id, island)
        SELECT event_type, covered, n, users, mean_value FROM (SELECT event_type, CAST(sum(len) AS BIGINT) AS covered FROM i GROUP BY event_type)
        JOIN (SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(avg(value), 6) AS mean_value FROM s GROUP BY event_type) USING (event_type)""",
    "d05_filler_coverage": SPANS + """, v AS (SELECT * FROM s WHERE event_type = 'view' AND user_id NOT IN (SELECT user_id FROM s WHERE event_type = 'purchase' AND value > 60))""" + _ISLANDS.format(src="v")
    + 'SELECT user_id, CAST(sum("end" - "start") AS BIGINT) AS covered FROM i GROUP BY user_id',
    "d07_importance": """WITH s AS (SELECT event_type, round(0.6 * sum(value) / (SELECT sum(value) FROM events) + 0.4 * count(DISTINCT user_id) / (SELECT count(DISTINCT user_id) FROM events), 6) AS score FROM events GROUP BY event_type)
        SELECT event_type, score, rank() OVER (ORDER BY score DESC) AS rank FROM s""",
    "d08_two_thresholds": """SELECT *, quantity >= 3000 AND parts >= 100 AS covered FROM (SELECT l_suppkey, sum(l_quantity) AS quantity, count(DISTINCT l_partkey) AS parts FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_suppkey)""",
    "d09_status_counts": "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1",
    "d10_readiness": "SELECT *, good >= 0.6 * n AS ready FROM (SELECT source, count(*) AS n, count(*) FILTER (quality = 1 AND toxic = 0) AS good FROM documents JOIN labels USING (doc_id) GROUP BY source)",
    "d11_coverage_state": """SELECT CASE WHEN c_acctbal / 5000 >= 1.5 THEN 'ample' WHEN c_acctbal / 5000 >= 1 THEN 'covered' WHEN c_acctbal / 5000 >= 0.4 THEN 'partial' ELSE 'missing' END AS state, count(*) AS n FROM customer GROUP BY 1""",
    "d12_catalogue_stats": """SELECT kind, item, n FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, item) AS i FROM
        (SELECT 'source' AS kind, source AS item, count(*) AS n FROM documents GROUP BY source UNION ALL SELECT 'lang', lang, count(*) FROM documents GROUP BY lang)) WHERE i <= 3""",
    "d13_group_stats": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_orderkey) AS i FROM orders)
        SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) FILTER (i <= 3) AS examples FROM r GROUP BY 1, 2""",
    "d14_profile": "SELECT event_type AS category, count(*) AS calls, round(sum(value), 4) AS seconds, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS items FROM events GROUP BY 1",
    "d15_stage_ledger": """WITH o AS (SELECT o_custkey, o_orderstatus, round(sum(o_totalprice), 2) AS cost FROM orders GROUP BY 1, 2) SELECT *, round(sum(cost) OVER (PARTITION BY o_custkey), 2) AS total FROM o""",
    "d16_cost_rollup": """SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n, max(l_extendedprice) AS largest FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""",
    "d18_topic_sets": """WITH u AS (SELECT user_id, list(DISTINCT event_type) AS has FROM events GROUP BY user_id)
        SELECT user_id, len(has) AS n, array_to_string(list_filter(['click', 'error', 'purchase', 'signup', 'view'], lambda x: NOT list_contains(has, x)), ',') AS missing, len(has) = 5 AS complete FROM u""",
    "d19_conditional_counts": """SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS finished, count(*) FILTER (o_orderstatus = 'O') AS open, round(count(*) FILTER (o_orderstatus = 'F') / count(*), 6) AS share FROM orders GROUP BY 1""",
    "d20_average_by_key": "SELECT lower(l_returnflag) AS flag, round(avg(l_discount), 3) AS mean_discount FROM lineitem GROUP BY 1",
    "d21_blended_scores": """WITH o AS (SELECT user_id, avg(value) AS a FROM events WHERE epoch_us(ts) < 1705276800000000 GROUP BY 1), n AS (SELECT user_id, avg(value) AS b FROM events WHERE epoch_us(ts) >= 1705276800000000 GROUP BY 1)
        SELECT coalesce(o.user_id, n.user_id) AS user_id, round(0.65 * coalesce(a, 50) + 0.35 * coalesce(b, 50), 6) AS score FROM o FULL JOIN n ON o.user_id = n.user_id""",
    "d22_incremental_mean": """SELECT event_type, round(m, 6) AS mean, round(37.5 + 0.25 * m, 6) AS quality FROM (SELECT event_type, (500 + sum(value)) / (count(*) + 10) AS m FROM events GROUP BY 1)""",
    "d23_block_coverage": """WITH l AS (SELECT conv_id, CASE WHEN length(text) >= 400 THEN 'long' WHEN length(text) >= 150 THEN 'middle' ELSE 'short' END AS level FROM conversations),
        c AS (SELECT conv_id, count(*) FILTER (level = 'long') AS a, count(*) FILTER (level = 'middle') AS b, count(*) FILTER (level = 'short') AS c, count(*) AS n FROM l GROUP BY conv_id)
        SELECT conv_id, round(a / n, 6) AS share, CASE WHEN a / n >= 0.5 THEN 'STRONG' WHEN a + b >= 0.5 * n THEN 'PARTIAL' ELSE 'INSUFFICIENT' END AS status,
          CASE greatest(a, b, c) WHEN a THEN 'long' WHEN b THEN 'middle' ELSE 'short' END AS main FROM c""",
    "d24_repeated_keys": "SELECT sha256(text) AS digest, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 2",
    "d25_latency": """WITH w AS (SELECT event_type, least(lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) - epoch_us(ts), 86400000000) AS wait FROM events)
        SELECT event_type, CAST(sum(wait) AS BIGINT) AS exposure, round(avg(wait), 3) AS mean, quantile_disc(wait, 0.95) AS p95, max(wait) AS longest FROM w WHERE wait IS NOT NULL GROUP BY 1""",
    "d27_diversity": """SELECT o_custkey, round(least(1, greatest(0, 0.45 * p / n + 0.45 * s / n + 0.1 * (1 - f / n))), 3) AS score FROM
        (SELECT o_custkey, count(DISTINCT o_orderpriority)::DOUBLE AS p, count(DISTINCT o_orderstatus)::DOUBLE AS s, count(*)::DOUBLE AS n, (count(*) FILTER (o_orderstatus = 'F'))::DOUBLE AS f FROM orders GROUP BY 1)""",
    "d28_share_quotas": """SELECT p_brand, p_type, round(share, 6) AS share, share BETWEEN 0.1 AND 0.25 AS within FROM (SELECT p_brand, p_type, count(*) / sum(count(*)) OVER (PARTITION BY p_brand) AS share FROM part GROUP BY 1, 2)""",
    "d29_block_audit": """WITH c AS (SELECT conv_id, role, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = role THEN 1 ELSE 0 END AS same FROM conversations),
        r AS (SELECT conv_id, list(DISTINCT role) AS r, CAST(sum(same) AS BIGINT) AS repeats FROM c GROUP BY conv_id)
        SELECT conv_id, len(r) AS roles, repeats, array_to_string(list_filter(['assistant', 'system', 'user'], lambda x: NOT list_contains(r, x)), ',') AS missing FROM r""",
    "d30_top_reasons": """WITH t AS (SELECT *, max(l_extendedprice) OVER (PARTITION BY l_orderkey) AS top FROM lineitem), l AS (SELECT * FROM t WHERE l_extendedprice < top)
        SELECT reason, count(*) AS n FROM (SELECT 'discount' AS reason FROM l WHERE l_discount > 0.05 UNION ALL SELECT 'small' FROM l WHERE l_quantity < 10 UNION ALL SELECT 'returned' FROM l WHERE l_returnflag = 'R' UNION ALL SELECT 'untaxed' FROM l WHERE l_tax = 0)
        GROUP BY 1 ORDER BY n DESC, reason LIMIT 3""",
    "d31_mode_first_seen": """SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS i FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1, 2)) WHERE i = 1""",
    "d32_pivot": "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'O') AS n_o, count(*) FILTER (o_orderstatus = 'P') AS n_p FROM orders GROUP BY 1",
    "d34_consolidated": "SELECT user_id, round(avg(value), 6) AS mean, arg_max(event_type, (value, event_id)) AS main, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types FROM events GROUP BY user_id",
    "d35_text_figures": """WITH s AS (SELECT doc_id, trim(unnest(string_split(regexp_replace(text, '([.!?])[ \\t\\r\\n]+', '\\1' || chr(10), 'g'), chr(10)))) AS s FROM documents),
        n AS (SELECT doc_id, len(""" + _WORDS.format("s") + """) AS n FROM s WHERE s <> '')
        SELECT doc_id, count(*) AS sentences, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS deviation, max(n) AS longest FROM n GROUP BY doc_id""",
    "d36_keywords": """SELECT lang, word, n FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS i FROM
        (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(string_split_regex(lower(text), '[^\\p{L}]+')) AS word FROM documents) WHERE length(word) > 4 GROUP BY 1, 2)) WHERE i <= 3""",
    "d39_required_slots": """SELECT conv_id, concat_ws(',', CASE WHEN a = 0 THEN 'assistant' END, CASE WHEN u = 0 THEN 'user' END) AS missing, a > 0 AND u > 0 AS covered FROM
        (SELECT conv_id, count(*) FILTER (role = 'assistant') AS a, count(*) FILTER (role = 'user') AS u FROM conversations GROUP BY conv_id)""",
    "d41_gate": "SELECT source, round(avg(quality), 6) AS share, bool_or(toxic = 1) AS any_toxic, bool_and(quality = 1) AS all_good FROM documents JOIN labels USING (doc_id) GROUP BY source",
    "d42_feasible": """SELECT o_orderkey, round(sum(CASE WHEN late THEN l_quantity ELSE 0 END) / sum(l_quantity), 6) AS late_share, bool_and(NOT late) AS feasible FROM
        (SELECT o_orderkey, l_quantity, date_diff('day', o_orderdate::DATE, l_shipdate::DATE) > 60 AS late FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY o_orderkey""",
    "d43_weighted_score": """SELECT p_partkey, round(p_size / 50 * 0.24::DOUBLE + p_retailprice / 2000 * 0.2::DOUBLE + length(p_name) / 20 * 0.24::DOUBLE + CASE WHEN p_type = 'ECONOMY' THEN 1 ELSE 0.5 END * 0.32::DOUBLE, 6) AS score FROM part""",
}
