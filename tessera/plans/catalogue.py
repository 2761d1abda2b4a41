"""Catalogue queries: scans with governance, sidecars, caches, states, ledgers, configuration."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import jsontext, scoring, text
from tessera.functions.time import micros
from tessera.operators import keys as K
from tessera.operators import ranking as R
from tessera.operators.sequences import before_in_order
from tessera.plans.streams import scratch
from tessera.session import table


def a02_point_lookup(spark, sf_dir):
    """One order by key; the predicate reaches the scan."""
    return table(spark, sf_dir, "orders").filter("o_orderkey = 42").select("o_orderkey", "o_custkey", "o_totalprice").limit(1)


def a03_existence(spark, sf_dir):
    """Which of some keys exist."""
    wanted = spark.range(5).select((F.col("id") * 400).alias("key"))
    there = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.lit(True).alias("there"))
    return wanted.join(there, "key", "left").select("key", F.coalesce("there", F.lit(False)).alias("there"))


def a04_governed_scan(spark, sf_dir):
    """Customers by predicate behind a view that leaves out restricted ones (negative balance)."""
    table(spark, sf_dir, "customer").filter("c_acctbal >= 0").createOrReplaceTempView("governed_customer")
    return spark.sql("SELECT c_custkey FROM governed_customer WHERE c_mktsegment = :s AND c_acctbal < :b", args={"s": "BUILDING", "b": 5000.0})


def a05_count(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(F.count(F.lit(1)).alias("n"))


def a08_append_log(spark, sf_dir):
    """Cache marks appended in two loads, reasons cut to 20 characters, read back: rows and longest reason."""
    folder = scratch(spark, "cache_log")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.substring(F.concat_ws(" ", "p_name", "p_type", "p_brand"), 1, 20).alias("reason"))
    for part in (rows.filter("p_partkey % 2 = 0"), rows.filter("p_partkey % 2 = 1")):
        part.write.mode("append").parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder).agg(F.count(F.lit(1)).alias("n"), F.max(F.length("reason")).cast("long").alias("longest"))


def a16_keyed_index(spark, sf_dir):
    """An index document with arrays of items, written as JSON and read back as rows."""
    folder = scratch(spark, "index")
    rows = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.sort_array(F.collect_list("s_suppkey")).alias("items"))
    rows.write.json(folder)
    back = spark.read.schema("s_nationkey int, items array<bigint>").json(folder)
    return back.select("s_nationkey", F.explode("items").alias("s_suppkey"))


def a18_progress(spark, sf_dir):
    """Customers with their orders by state: topics with hits and all orders."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    o = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    topics = o.groupBy("o_custkey").agg(F.collect_list(F.struct("o_orderstatus", "n")).alias("t"))
    hits = F.coalesce(F.size(F.filter("t", lambda x: x["n"] > 2)), F.lit(0))
    total = F.coalesce(F.aggregate("t", F.lit(0).cast("long"), lambda a, x: a + x["n"]), F.lit(0))
    return c.join(topics, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.greatest(hits, F.lit(0)).cast("long").alias("hits"), total.alias("total"))


def a23_sidecars(spark, sf_dir):
    """Documents with their label as sidecar, null where there is none, and the kind by length."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    kind = F.when(F.length("text") >= 1000, "article").when(F.length("text") >= 100, "note").otherwise("line")
    return d.groupBy(kind.alias("kind"), "quality").agg(F.count(F.lit(1)).alias("n"))


def a27_state_patch(spark, sf_dir):
    """A user's state: values by type from the first half of the month, patched by those of the second."""
    e = table(spark, sf_dir, "events").withColumn("at", micros(F.col("ts")))
    base = K.latest_wins(e.filter("at < 1705276800000000"), ["user_id", "event_type"], ["at", "event_id"])
    patch = K.latest_wins(e.filter("at >= 1705276800000000"), ["user_id", "event_type"], ["at", "event_id"])
    cols = ["user_id", "event_type", "value"]
    return K.upsert(base.select(*cols), patch.select(*cols), ["user_id", "event_type"])


def a30_tag_lists(spark, sf_dir):
    """Distinct plain tags from names split at blanks, per brand."""
    p = table(spark, sf_dir, "part").select("p_brand", F.explode(F.split(F.concat_ws(",", F.regexp_replace("p_name", " ", ","), "p_type"), "[\n,]")).alias("tag"))
    return p.groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set(text.plain(F.col("tag")))), ",").alias("tags"))


def a31_text_cache(spark, sf_dir):
    """Cache of results by digest of the plain text: computations saved by repeats."""
    d = table(spark, sf_dir, "documents").select(F.sha1(text.plain(F.col("text")).cast("binary")).alias("key"))
    return d.groupBy("key").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("computed"), F.sum(F.col("n") - 1).alias("saved"))


def a33_cost_ledger(spark, sf_dir):
    """Ledger of calls: tokens times price, with a note on long ones, summed by kind."""
    e = table(spark, sf_dir, "events").withColumn("tokens", F.get_json_object("props", "$.k").cast("long") * 4000)
    cost = F.col("tokens") * F.when(F.col("tokens") > 200_000, 0.0000025).otherwise(0.00000125)
    return e.groupBy("event_type").agg(F.round(F.sum(cost), 6).alias("cost"), F.count_if(F.col("tokens") > 200_000).alias("long_calls"))


def a42_tail(spark, sf_dir):
    """The last 20 errors, newest first."""
    e = table(spark, sf_dir, "events").filter("event_type = 'error'").withColumn("at", micros(F.col("ts")))
    return e.orderBy(F.desc("at"), F.desc("event_id")).limit(20).select("event_id", "value")


def a43_validity(spark, sf_dir):
    """Validity of parts as probed media: size, price and name in order of the checks."""
    p = table(spark, sf_dir, "part")
    error = R.first_reason([("short", F.col("p_size") < 3), ("cheap", F.col("p_retailprice") < 905), ("codec", ~F.col("p_type").isin("ECONOMY", "STANDARD", "PROMO", "SMALL", "LARGE", "MEDIUM"))])
    return p.groupBy(F.coalesce(error, F.lit("valid")).alias("state")).agg(F.count(F.lit(1)).alias("n"))


def a44_coerced_config(spark, sf_dir):
    """Requirements from JSON with defaults: a target not above 0 becomes 30, a missing name the key's."""
    raw = F.to_json(F.struct(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice").cast("long")).otherwise(F.lit(-1)).alias("target"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("name")))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.from_json(raw, "target long, name string").alias("c"))
    return o.select("o_orderkey", F.when(F.col("c.target") <= 0, 30).otherwise(F.col("c.target")).alias("target"), F.coalesce("c.name", F.concat(F.lit("r"), F.col("o_orderkey").cast("string"))).alias("name"))


def b05_image_reasons(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    reason = R.first_reason([("scheme", ~F.col("url").startswith("https://")), ("small", F.length("html") < 1000), ("host", F.col("url").contains("example.net"))])
    return p.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def b06_late_reasons(spark, sf_dir):
    """Watermark-like text first, then a place that is known and wrong."""
    d = table(spark, sf_dir, "documents")
    reason = R.first_reason([("mark", F.col("text").rlike("(?i)licensed under|rights reserved")), ("place", F.col("lang").isNotNull() & (F.col("lang") != "en") & (F.length("text") > 500))])
    return d.select("doc_id", reason.alias("reason")).filter("reason IS NOT NULL")


def b10_contract_rules(spark, sf_dir):
    """Users none of whose types is forbidden and whose value is high enough where it counts."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(F.when(F.col("value") > 40, F.col("event_type"))).alias("strong"), F.avg("value").alias("mean"))
    ok = ~F.arrays_overlap("strong", F.array(F.lit("error"))) & ((F.col("mean") >= 9.5) | ~F.array_contains("strong", "purchase"))
    return e.select("user_id", ok.alias("allowed"))


def b14_reject_cascade(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    reason = R.first_reason([("returned", F.col("l_returnflag") == "R"), ("discount", F.col("l_discount") > 0.08), ("tax", F.col("l_tax") > 0.07), ("small", F.col("l_quantity") < 3), ("cheap", F.col("l_extendedprice") < 1000)])
    return l.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def b22_projection(spark, sf_dir):
    """Vectors without the vector: length, label, similarity to the first axis."""
    e = table(spark, sf_dir, "embeddings").withColumn("similarity", F.round(F.get("embedding", F.lit(0)).cast("double"), 5))
    return e.drop("embedding")


def b23_row_defaults(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long, tags array<string>, title string").alias("p"), "event_type")
    return e.select("event_id", F.coalesce("p.k", F.lit(0)).alias("k"), F.coalesce(F.array_join("p.tags", ","), F.lit("")).alias("tags"), F.concat_ws(" ", "event_type", "p.title").alias("semantic"))


def b24_publishable(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    blank = text.strip_markup(F.col("html")) == ""
    return p.groupBy((~blank & F.col("url").rlike("^https?://")).alias("publishable")).agg(F.count(F.lit(1)).alias("n"))


def c23_pool_union(spark, sf_dir):
    """Orders found by price or by priority, once each."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    return o.filter("o_totalprice > 450000").unionByName(o.filter("o_orderpriority = '1-URGENT' AND o_totalprice > 400000")).dropDuplicates(["o_orderkey"]).select("o_orderkey")


def c24_block_lookup(spark, sf_dir):
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return o.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("price"))


def c28_anchors(spark, sf_dir):
    """Per turn the first word of five letters or more as anchor, made monotone within the conversation."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.filter(F.split(F.coalesce("text", F.lit("")), "[ \\t\\r\\n]+"), lambda w: w != "").alias("w"))
    first = F.array_position(F.transform("w", lambda x: F.length(x) >= 5), True) - 1
    run = F.max(first).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    return c.select("conv_id", "turn", run.alias("anchor"))


def c31_block_reason(spark, sf_dir):
    """Pages whose title repeats words of the link text, by overlap of token sets."""
    p = table(spark, sf_dir, "pages").select("page_id", text.tokens(F.regexp_extract("html", "<title>([^<]*)</title>", 1), 2).alias("a"), text.tokens(F.regexp_extract("html", "<h1>([^<]*)</h1>", 1), 2).alias("b"))
    return p.select("page_id", F.when(F.arrays_overlap("a", "b"), "same").otherwise("other").alias("state"), F.round(text.jaccard(F.col("a"), F.col("b")), 6).alias("similarity"))


def d06_persisted_coverage(spark, sf_dir):
    """Coverage from an index where it has rows, else measured: users' purchase values, or all values."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sum(F.when((F.col("event_type") == "purchase") & (F.col("value") > 30), F.col("value"))).alias("indexed"), F.sum("value").alias("measured"))
    return e.select("user_id", F.round(F.coalesce("indexed", "measured"), 4).alias("coverage"), F.col("indexed").isNotNull().alias("from_index"))


def d17_state_counts(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_linestatus", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))


def d26_sync_issues(spark, sf_dir):
    """Neighbouring events of a user more than two days apart, with the type of gap."""
    w = Window.partitionBy("user_id").orderBy("at", "event_id")
    e = table(spark, sf_dir, "events").withColumn("at", micros(F.col("ts"))).withColumn("gap", F.col("at") - F.lag("at").over(w))
    return e.filter("gap > 172800000000").select("event_id", "gap", F.when(F.col("gap") > 259_200_000_000, "break").otherwise("lag").alias("issue"))


def e15_even_bounds(spark, sf_dir):
    """Words of each turn spread evenly over 30 seconds: count and the last start."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "[ \\t\\r\\n]+"), lambda w: w != "")).alias("n"))
    return c.select("conv_id", "turn", F.col("n").cast("long").alias("words"), F.round(30.0 * (F.col("n") - 1) / F.col("n"), 6).alias("last_start")).filter("words > 0")


def e26_context(spark, sf_dir):
    """Three words on either side of the turn's middle word."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.filter(F.split(F.coalesce("text", F.lit("")), "[ \\t\\r\\n]+"), lambda w: w != "").alias("w")).filter("size(w) > 0")
    mid = F.floor(F.size("w") / 2).cast("int")
    return c.select("conv_id", "turn", F.array_join(F.slice("w", F.greatest(mid - 2, F.lit(1)), F.lit(7) - F.greatest(F.lit(3) - mid, F.lit(0))), " ").alias("context"))


def f03_penalised_score(spark, sf_dir):
    """Parts by price less penalties for uses in lines, best 20."""
    used = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    p = table(spark, sf_dir, "part").join(used, F.col("p_partkey") == F.col("l_partkey"), "left")
    score = F.round(F.col("p_retailprice") / 2000 - F.least(F.lit(0.5), F.coalesce("n", F.lit(0)) * 0.01), 6)
    return p.select("p_partkey", score.alias("score")).orderBy(F.desc("score"), "p_partkey").limit(20)


def f11_topic_score(spark, sf_dir):
    """Types by demand, breadth and coverage."""
    e = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("u"), F.avg("value").alias("v"))
    score = 0.3 * F.col("n") / 100 + 0.3 * F.col("v") + 0.4 * F.least(F.lit(100.0), F.col("u") / 1.5)
    return e.select("event_type", F.round(score, 6).alias("score"))


def f12_ideas(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    score = scoring.weighted([(F.col("c_acctbal") / 10000, 0.7), (F.when(F.col("c_mktsegment") == "MACHINERY", 1.0), 0.3)], missing=0.2)
    return c.select("c_custkey", F.round(score, 6).alias("total")).orderBy(F.desc("total"), "c_custkey").limit(5)


def f16_query_levels(spark, sf_dir):
    """Query levels of each part: name with brand and type, name with type, name, last word; distinct, in order."""
    levels = F.array_distinct(F.array(F.concat_ws(" ", "p_name", "p_brand", "p_type"), F.concat_ws(" ", "p_name", "p_type"), F.col("p_name"), F.element_at(F.split("p_name", " "), -1)))
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(levels).alias("level", "query")).withColumn("level", F.col("level").cast("long"))


def f18_tag_hits(spark, sf_dir):
    """Parts with tags that hold, or are held by, one of the terms, best five."""
    terms = F.array(F.lit("ring"), F.lit("wid"), F.lit("economy"))
    tags = F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")
    hits = F.size(F.filter(terms, lambda t: F.exists(tags, lambda g: F.contains(g, t) | F.contains(t, g))))
    return table(spark, sf_dir, "part").select("p_partkey", hits.cast("long").alias("hits")).filter("hits > 0").orderBy(F.desc("hits"), "p_partkey").limit(5)


def f21_provider_order(spark, sf_dir):
    order = F.when(F.col("o_orderpriority") == "1-URGENT", F.array(F.lit("own"), F.lit("stock"))).when(F.col("o_orderstatus") == "F", F.array(F.lit("stock"))).otherwise(F.array(F.lit("own"), F.lit("web"), F.lit("stock")))
    return table(spark, sf_dir, "orders").groupBy(F.array_join(order, ">").alias("providers")).agg(F.count(F.lit(1)).alias("n"))


def g03_match_names(spark, sf_dir):
    """Distinct plain names of each type: the type, and part names of two words or more."""
    p = table(spark, sf_dir, "part").select("p_type", F.explode(F.array("p_type", "p_name")).alias("name"))
    rows = p.filter((F.col("name") == F.col("p_type")) | (F.size(F.split("name", " ")) >= 2)).select("p_type", text.plain(F.col("name")).alias("name")).distinct()
    return rows.groupBy("p_type").agg(F.count(F.lit(1)).alias("names"))


def g09_identities(spark, sf_dir):
    """Three content identities that never join: whole, head and tail with size, head."""
    raw = F.col("html").cast("binary")
    n = F.octet_length("html")
    head, tail = F.substring(raw, 1, 256), F.substring(raw, F.greatest(n - 255, F.lit(1)), F.lit(256))
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.sha2(raw, 256).alias("sha_full"), F.sha2(F.concat(head, tail, n.cast("string").cast("binary")), 256).alias("sha_headtail"), F.sha2(head, 256).alias("sha_head"))


def h02_distinctive(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", text.distinctive(F.concat_ws(" ", "p_name", "p_type"), ["ring", "large", "small"]).alias("w"))
    return p.select("p_partkey", F.array_join("w", " ").alias("words"))


def h08_aliases(spark, sf_dir):
    """Nation names through an alias table, equality after it; unknown names stay."""
    alias = F.create_map(*[F.lit(x) for x in ("NATION_1", "NATION_2", "NATION_7", "NATION_8")])
    n = table(spark, sf_dir, "nation").select(F.coalesce(F.element_at(alias, F.col("n_name")), F.col("n_name")).alias("name"))
    return n.groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def h09_scrubbed(spark, sf_dir):
    t = text.scrub(F.col("text"), {"all rights reserved": "", "idiot": "person", "!!": "!"})
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(t.cast("binary"), 256).alias("digest"))


def h18_sentences(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", text.sentences(F.col("text")).alias("s"))
    return d.select("doc_id", F.size("s").cast("long").alias("n"), F.element_at("s", -1).alias("last"))


def h31_decision_list(spark, sf_dir):
    """State, confidence and reasons of each line, from one decision list and weights less penalties."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity", "l_discount", "l_tax")
    state = F.when(F.col("l_returnflag") == "R", "refuted").when((F.col("l_quantity") >= 30) & (F.col("l_discount") <= 0.03), "proven").when(F.col("l_quantity") >= 15, "likely").when(F.col("l_tax") > 0.06, "doubtful").otherwise("open")
    score = scoring.clamp(0.4 + F.col("l_quantity") / 100 - F.col("l_discount") * 2 - F.when(F.col("l_returnflag") == "R", 0.3).otherwise(0.0))
    return l.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(score), 6).alias("confidence"))


def h34_expected(spark, sf_dir):
    """Expected against found language of the neighbouring document by number: match, partial or miss."""
    d = before_in_order(table(spark, sf_dir, "documents").select("source", "doc_id", "lang"), ["source"], "doc_id", "lang", "e")
    match = F.when(F.col("e").isNull(), "none").when(F.col("e") == F.col("lang"), "match").when(F.substring("e", 1, 1) == F.substring("lang", 1, 1), "partial").otherwise("miss")
    return d.groupBy(match.alias("match")).agg(F.count(F.lit(1)).alias("n"))


def h41_costs(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return e.groupBy("event_type").agg((F.sum("k") * F.lit(0.00000125)).alias("cost"))


def h43_validated(spark, sf_dir):
    """Payloads that hold a number in range; others are reported as broken."""
    k = jsontext.read_object(F.col("props"), "k long").k
    return table(spark, sf_dir, "events").groupBy(F.when(k.between(0, 79), "valid").otherwise("broken").alias("state")).agg(F.count(F.lit(1)).alias("n"))


def h47_query_plan(spark, sf_dir):
    """Regions times terms, with a validity filter, once each."""
    terms = spark.createDataFrame([("harbour",), ("old town",), ("food",)], "term string")
    rows = table(spark, sf_dir, "region").select("r_name").join(F.broadcast(terms))
    q = F.lower(F.concat_ws(" ", "r_name", "term"))
    return rows.select(q.alias("query"), F.when(F.size(F.split(q, " ")) >= 3, "wide").otherwise("plain").alias("kind")).filter("query NOT LIKE 'africa food%'").distinct()


def k05_violations(spark, sf_dir):
    """Violation rows of several kinds per order, from one pass over its lines."""
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_suppkey").alias("s"), F.max("l_discount").alias("d"), F.sum("l_quantity").alias("q"))
    found = F.array_compact(F.array(F.when(F.col("s") < F.col("n"), F.lit("reused")), F.when(F.col("d") >= 0.1, F.lit("discount")), F.when(F.col("q") < 20, F.lit("short"))))
    return l.select("l_orderkey", F.explode(found).alias("violation"))


def k07_repair_hints(spark, sf_dir):
    """Causes per order turned into hints by a small table, collected per order."""
    hints = spark.createDataFrame([("reused", "other supplier"), ("discount", "lower discount"), ("short", "more lines"), ("short", "longer lines")], "violation string, hint string")
    rows = k05_violations(spark, sf_dir).join(F.broadcast(hints), "violation")
    return rows.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("hint")), ";").alias("hints"))


def k09_better_window(spark, sf_dir):
    """For each line the best other line of the same part, if its quantity is at least 8 higher."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    best = l.groupBy("l_partkey").agg(F.max("l_quantity").alias("best"))
    rows = l.join(best, "l_partkey").filter("best >= l_quantity + 8")
    return rows.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), F.max("best").alias("best"))


def k11_replacements(spark, sf_dir):
    """Lines to replace: returned ones, lines of short orders and the smallest of each supplier, once each."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_quantity", "l_discount")
    a = l.filter("l_returnflag = 'R' AND l_discount > 0.09").select("l_orderkey", "l_linenumber")
    b = l.join(l.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q")).filter("q < 20"), "l_orderkey").select("l_orderkey", "l_linenumber")
    return a.union(b).distinct()


QUERIES = {k: v for k, v in list(globals().items()) if k[0] in "abcdefghk" and k[1:3].isdigit()}
_P = "trim(regexp_replace(strip_accents(lower({0})), '[^a-z0-9]+', ' ', 'g'))"
_W = "list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\r\\n]+'), lambda x: x <> '')"
_SENT = "list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \\t\\r\\n]+', '\\1' || chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '')"
_VIOL = """WITH g AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_suppkey) AS s, max(l_discount) AS d, sum(l_quantity) AS q FROM lineitem GROUP BY 1),
    v AS (SELECT l_orderkey, 'reused' AS violation FROM g WHERE s < n UNION ALL SELECT l_orderkey, 'discount' FROM g WHERE d >= 0.1 UNION ALL SELECT l_orderkey, 'short' FROM g WHERE q < 20)
"""
ORACLE = {
    "a02_point_lookup": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 42",
    "a03_existence": "SELECT k AS key, k IN (SELECT p_partkey FROM part) AS there FROM (VALUES (0), (400), (800), (1200), (1600)) v(k)",
    "a04_governed_scan": "SELECT c_custkey FROM customer WHERE c_acctbal >= 0 AND c_mktsegment = 'BUILDING' AND c_acctbal < 5000",
    "a05_count": "SELECT count(*) AS n FROM lineitem",
    "a08_append_log": "SELECT count(*) AS n, max(length((p_name || ' ' || p_type || ' ' || p_brand)[1:20])) AS longest FROM part",
    "a16_keyed_index": "SELECT s_nationkey, s_suppkey FROM supplier",
    "a18_progress": """WITH o AS (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2), t AS (SELECT o_custkey, count(*) FILTER (n > 2) AS hits, CAST(sum(n) AS BIGINT) AS total FROM o GROUP BY 1)
        SELECT c_custkey, coalesce(hits, 0) AS hits, coalesce(total, 0) AS total FROM customer LEFT JOIN t ON c_custkey = o_custkey""",
    "a23_sidecars": "SELECT CASE WHEN length(text) >= 1000 THEN 'article' WHEN length(text) >= 100 THEN 'note' ELSE 'line' END AS kind, quality, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2",
    "a27_state_patch": "SELECT user_id, event_type, arg_max(value, (epoch_us(ts), event_id)) AS value FROM events GROUP BY 1, 2",
    "a30_tag_lists": f"SELECT p_brand, string_agg(DISTINCT {_P.format('tag')}, ',' ORDER BY {_P.format('tag')}) AS tags FROM (SELECT p_brand, unnest(string_split(replace(p_name, ' ', ',') || ',' || p_type, ',')) AS tag FROM part) GROUP BY 1",
    "a31_text_cache": f"SELECT count(*) AS computed, CAST(sum(n - 1) AS BIGINT) AS saved FROM (SELECT count(*) AS n FROM documents GROUP BY {_P.format('text')})",
    "a33_cost_ledger": """SELECT event_type, round(sum(t * CASE WHEN t > 200000 THEN 0.0000025::DOUBLE ELSE 0.00000125::DOUBLE END), 6) AS cost, count(*) FILTER (t > 200000) AS long_calls FROM
        (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) * 4000 AS t FROM events) GROUP BY 1""",
    "a42_tail": "SELECT event_id, value FROM events WHERE event_type = 'error' ORDER BY epoch_us(ts) DESC, event_id DESC LIMIT 20",
    "a43_validity": """SELECT CASE WHEN p_size < 3 THEN 'short' WHEN p_retailprice < 905 THEN 'cheap' WHEN p_type NOT IN ('ECONOMY', 'STANDARD', 'PROMO', 'SMALL', 'LARGE', 'MEDIUM') THEN 'codec' ELSE 'valid' END AS state, count(*) AS n FROM part GROUP BY 1""",
    "a44_coerced_config": """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN CASE WHEN CAST(trunc(o_totalprice) AS BIGINT) <= 0 THEN 30 ELSE CAST(trunc(o_totalprice) AS BIGINT) END ELSE 30 END AS target,
        CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority ELSE 'r' || o_orderkey END AS name FROM orders""",
    "b05_image_reasons": "SELECT CASE WHEN NOT starts_with(url, 'https://') THEN 'scheme' WHEN length(html) < 1000 THEN 'small' WHEN contains(url, 'example.net') THEN 'host' END AS reason, count(*) AS n FROM pages GROUP BY 1",
    "b06_late_reasons": """SELECT * FROM (SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)licensed under|rights reserved') THEN 'mark' WHEN lang <> 'en' AND length(text) > 500 THEN 'place' END AS reason FROM documents) WHERE reason IS NOT NULL""",
    "b10_contract_rules": """SELECT user_id, NOT coalesce(bool_or(event_type = 'error') FILTER (value > 40), false) AND (avg(value) >= 9.5 OR NOT coalesce(bool_or(event_type = 'purchase') FILTER (value > 40), false)) AS allowed FROM events GROUP BY 1""",
    "b14_reject_cascade": """SELECT CASE WHEN l_returnflag = 'R' THEN 'returned' WHEN l_discount > 0.08 THEN 'discount' WHEN l_tax > 0.07 THEN 'tax' WHEN l_quantity < 3 THEN 'small' WHEN l_extendedprice < 1000 THEN 'cheap' END AS reason, count(*) AS n FROM lineitem GROUP BY 1""",
    "b22_projection": "SELECT vec_id, label, round(embedding[1]::DOUBLE, 5) AS similarity FROM embeddings",
    "b23_row_defaults": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '' AS tags, event_type AS semantic FROM events",
    "b24_publishable": """SELECT trim(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '<[^>]*>', '', 'g')) <> '' AND regexp_matches(url, '^https?://') AS publishable, count(*) AS n FROM pages GROUP BY 1""",
    "c23_pool_union": "SELECT o_orderkey FROM orders WHERE o_totalprice > 450000 OR (o_orderpriority = '1-URGENT' AND o_totalprice > 400000)",
    "c24_block_lookup": "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS price FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1",
    "c28_anchors": f"""WITH w AS (SELECT conv_id, turn, coalesce(list_position(list_transform({_W}, lambda x: length(x) >= 5), true), 0) - 1 AS a FROM conversations)
        SELECT conv_id, turn, max(a) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS anchor FROM w""",
    "c31_block_reason": f"""WITH t AS (SELECT page_id, list_distinct(list_filter(string_split({_P.format("regexp_extract(html, '<title>([^<]*)</title>', 1)")}, ' '), lambda x: length(x) >= 2)) AS a,
        list_distinct(list_filter(string_split({_P.format("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")}, ' '), lambda x: length(x) >= 2)) AS b FROM pages)
        SELECT page_id, CASE WHEN len(list_intersect(a, b)) > 0 THEN 'same' ELSE 'other' END AS state, round(CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 6) AS similarity FROM t""",
    "d06_persisted_coverage": """SELECT user_id, round(coalesce(i, m), 4) AS coverage, i IS NOT NULL AS from_index FROM (SELECT user_id, sum(value) FILTER (event_type = 'purchase' AND value > 30) AS i, sum(value) AS m FROM events GROUP BY 1)""",
    "d17_state_counts": "SELECT l_linestatus, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2",
    "d26_sync_issues": """SELECT event_id, gap, CASE WHEN gap > 259200000000 THEN 'break' ELSE 'lag' END AS issue FROM (SELECT event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS gap FROM events) WHERE gap > 172800000000""",
    "e15_even_bounds": f"SELECT conv_id, turn, n AS words, round(30.0::DOUBLE * (n - 1) / n, 6) AS last_start FROM (SELECT conv_id, turn, len({_W}) AS n FROM conversations) WHERE n > 0",
    "e26_context": f"""WITH w AS (SELECT conv_id, turn, {_W} AS w FROM conversations), m AS (SELECT *, len(w) // 2 AS mid FROM w WHERE len(w) > 0)
        SELECT conv_id, turn, array_to_string(w[greatest(mid - 2, 1) : greatest(mid - 2, 1) + 6 - greatest(3 - mid, 0)], ' ') AS context FROM m""",
    "f03_penalised_score": """SELECT p_partkey, round(p_retailprice / 2000 - least(0.5, coalesce(n, 0) * 0.01), 6) AS score FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON p_partkey = l_partkey ORDER BY score DESC, p_partkey LIMIT 20""",
    "f11_topic_score": "SELECT event_type, round(0.3::DOUBLE * count(*) / 100 + 0.3::DOUBLE * avg(value) + 0.4::DOUBLE * least(100, count(DISTINCT user_id) / 1.5::DOUBLE), 6) AS score FROM events GROUP BY 1",
    "f12_ideas": "SELECT c_custkey, round(c_acctbal / 10000 * 0.7::DOUBLE + CASE WHEN c_mktsegment = 'MACHINERY' THEN 1 ELSE 0.2 END * 0.3::DOUBLE, 6) AS total FROM customer ORDER BY total DESC, c_custkey LIMIT 5",
    "f16_query_levels": """WITH l AS (SELECT p_partkey, p_name || ' ' || p_brand || ' ' || p_type AS a, p_name || ' ' || p_type AS b, p_name AS c, string_split(p_name, ' ')[-1] AS d FROM part)
        SELECT p_partkey, 0 AS level, a AS query FROM l UNION ALL SELECT p_partkey, 1, b FROM l UNION ALL SELECT p_partkey, 2, c FROM l UNION ALL SELECT p_partkey, 3, d FROM l WHERE d <> c""",
    "f18_tag_hits": """SELECT p_partkey, len(list_filter(['ring', 'wid', 'economy'], lambda t: len(list_filter(string_split(lower(p_name || ' ' || p_type), ' '), lambda g: contains(g, t) OR contains(t, g))) > 0)) AS hits FROM part WHERE hits > 0 ORDER BY hits DESC, p_partkey LIMIT 5""",
    "f21_provider_order": "SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 'own>stock' WHEN o_orderstatus = 'F' THEN 'stock' ELSE 'own>web>stock' END AS providers, count(*) AS n FROM orders GROUP BY 1",
    "g03_match_names": f"""SELECT p_type, count(*) AS names FROM (SELECT DISTINCT p_type, {_P.format('name')} AS name FROM (SELECT p_type, p_type AS name FROM part UNION SELECT p_type, p_name FROM part WHERE len(string_split(p_name, ' ')) >= 2)) GROUP BY 1""",
    "g09_identities": """SELECT page_id, sha256(html) AS sha_full, sha256(encode(html)[1:256] || encode(html)[greatest(strlen(html) - 255, 1):] || encode(strlen(html)::VARCHAR)) AS sha_headtail, sha256(encode(html)[1:256]) AS sha_head FROM pages""",
    "h02_distinctive": f"""SELECT p_partkey, array_to_string(list_sort(list_filter(list_distinct(string_split({_P.format("p_name || ' ' || p_type")}, ' ')), lambda x: length(x) >= 4 AND x NOT IN ('ring', 'large', 'small'))), ' ') AS words FROM part""",
    "h08_aliases": "SELECT CASE n_name WHEN 'NATION_1' THEN 'NATION_2' WHEN 'NATION_7' THEN 'NATION_8' ELSE n_name END AS name, count(*) AS n FROM nation GROUP BY 1",
    "h09_scrubbed": """SELECT doc_id, sha256(trim(regexp_replace(replace(regexp_replace(regexp_replace(text, '(?i)all rights reserved', '', 'g'), '(?i)idiot', 'person', 'g'), '!!', '!'), ' +', ' ', 'g'))) AS digest FROM documents""",
    "h18_sentences": f"SELECT doc_id, len(s) AS n, s[-1] AS last FROM (SELECT doc_id, {_SENT} AS s FROM documents)",
    "h31_decision_list": """SELECT CASE WHEN l_returnflag = 'R' THEN 'refuted' WHEN l_quantity >= 30 AND l_discount <= 0.03 THEN 'proven' WHEN l_quantity >= 15 THEN 'likely' WHEN l_tax > 0.06 THEN 'doubtful' ELSE 'open' END AS state, count(*) AS n,
        round(avg(least(1, greatest(0, 0.4::DOUBLE + l_quantity / 100 - l_discount * 2 - CASE WHEN l_returnflag = 'R' THEN 0.3::DOUBLE ELSE 0 END))), 6) AS confidence FROM lineitem GROUP BY 1""",
    "h34_expected": """SELECT CASE WHEN e IS NULL THEN 'none' WHEN e = lang THEN 'match' WHEN e[1] = lang[1] THEN 'partial' ELSE 'miss' END AS match, count(*) AS n FROM (SELECT lang, lag(lang) OVER (PARTITION BY source ORDER BY doc_id) AS e FROM documents) GROUP BY 1""",
    "h41_costs": "SELECT event_type, sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) * 0.00000125::DOUBLE AS cost FROM events GROUP BY 1",
    "h43_validated": "SELECT CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) BETWEEN 0 AND 79 THEN 'valid' ELSE 'broken' END AS state, count(*) AS n FROM events GROUP BY 1",
    "h47_query_plan": """SELECT q AS query, CASE WHEN len(string_split(q, ' ')) >= 3 THEN 'wide' ELSE 'plain' END AS kind FROM (SELECT DISTINCT lower(r_name || ' ' || term) AS q FROM region, (VALUES ('harbour'), ('old town'), ('food')) t(term)) WHERE q NOT LIKE 'africa food%'""",
    "k05_violations": _VIOL + "SELECT * FROM v",
    "k07_repair_hints": _VIOL + """SELECT l_orderkey, string_agg(DISTINCT hint, ';' ORDER BY hint) AS hints FROM v JOIN (VALUES ('reused', 'other supplier'), ('discount', 'lower discount'), ('short', 'more lines'), ('short', 'longer lines')) h(violation, hint) USING (violation) GROUP BY 1""",
    "k09_better_window": """SELECT l_partkey, count(*) AS n, max(best) AS best FROM lineitem JOIN (SELECT l_partkey, max(l_quantity) AS best FROM lineitem GROUP BY 1) USING (l_partkey) WHERE best >= l_quantity + 8 GROUP BY 1""",
    "k11_replacements": """SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE (l_returnflag = 'R' AND l_discount > 0.09) OR l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING sum(l_quantity) < 20)""",
}
