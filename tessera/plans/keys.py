"""Identity, upsert, cache, text and vector queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import jsontext, scoring, text, vector
from tessera.functions import time as T
from tessera.functions.time import micros
from tessera.operators import dictionary
from tessera.operators import keys as K
from tessera.operators.ranking import at_rank, top_k
from tessera.operators.vector import best_of_bank
from tessera.session import table



def a07_latest_cache(spark, sf_dir):
    """Latest event of each user and type: a cache of which the last entry counts."""
    e = table(spark, sf_dir, "events").withColumn("at", micros(F.col("ts")))
    return K.latest_wins(e, ["user_id", "event_type"], ["at", "event_id"]).select("user_id", "event_type", "event_id", "value")


def a09_ttl(spark, sf_dir):
    """Events kept after a time to live of 10 days before the newest one, and pruned, by type."""
    e = table(spark, sf_dir, "events").withColumn("at", micros(F.col("ts")))
    newest = e.agg(F.max("at").alias("newest"))
    rows = e.join(F.broadcast(newest)).withColumn("live", F.col("at") >= F.col("newest") - 10 * 86_400_000_000)
    return rows.groupBy("event_type").agg(F.count_if("live").alias("kept"), F.count_if(~F.col("live")).alias("pruned"))


def a10_usage_counts(spark, sf_dir):
    """Parts' uses from appended facts; parts of revoked suppliers are left out."""
    revoked = table(spark, sf_dir, "supplier").filter("s_acctbal < 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return table(spark, sf_dir, "lineitem").join(revoked, "l_suppkey", "left_anti").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("uses"))


def a11_upsert(spark, sf_dir):
    """Customers' balances after those with orders over 400000 are set to 0."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    big = table(spark, sf_dir, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return K.upsert(c, big.join(c, "c_custkey").select("c_custkey", F.lit(0.0).alias("c_acctbal")), ["c_custkey"])


def a13_tried_queries(spark, sf_dir):
    """Part names, normalised, that no part of type ECONOMY has."""
    p = table(spark, sf_dir, "part").select(text.plain(F.col("p_name")).alias("q"), "p_type")
    return p.select("q").distinct().join(p.filter("p_type = 'ECONOMY'").select("q"), "q", "left_anti")


def a15_offset_read(spark, sf_dir):
    """Events after offset 5000 in order of their number, with a field of the payload."""
    e = table(spark, sf_dir, "events").filter("event_id > 5000")
    return e.select("event_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))


def c21_orphans(spark, sf_dir):
    """Parts never ordered and ordered parts that are unknown; customers without orders likewise."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"))
    l = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"))
    return K.orphans(p, l, "key")


def g01_first_writer(spark, sf_dir):
    """First document of each text."""
    d = table(spark, sf_dir, "documents").withColumn("sha", F.sha2(F.col("text").cast("binary"), 256))
    return K.keep_first(d, ["sha"], ["doc_id"]).select("doc_id", "sha")


def g02_not_taken(spark, sf_dir):
    """Customers of whom no order is in the cache of finished ones."""
    done = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(done, "c_custkey", "left_anti").select("c_custkey")


def g04_ordered_distinct(spark, sf_dir):
    """Distinct words of part names, case ignored, per type in alphabetical order."""
    p = table(spark, sf_dir, "part").select("p_type", F.explode(F.split(F.lower("p_name"), " ")).alias("w"))
    return p.groupBy("p_type").agg(F.array_join(F.array_sort(F.collect_set("w")), " ").alias("words"))


def g05_keep_first_by_url(spark, sf_dir):
    """First page of each host and title."""
    p = table(spark, sf_dir, "pages").withColumn("host", F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1))
    return K.keep_first(p, ["host"], ["page_id"]).select("page_id", "host")


def g06_near_hash(spark, sf_dir):
    """Pairs of vectors whose 64-bit sign hashes differ in 6 bits or fewer."""
    bits = F.aggregate(F.transform("embedding", lambda x, i: F.when(x > 0, F.expr("1L")).otherwise(F.expr("0L"))), F.lit(0).cast("long"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b))
    return K.near_hashes(table(spark, sf_dir, "embeddings").select("vec_id", bits.alias("h")), "vec_id", "h", 6)


def g07_replace_partitions(spark, sf_dir):
    """Orders by priority after the partitions 1-URGENT and 2-HIGH are replaced by their finished orders."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    new = o.filter("o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus = 'F'")
    return K.replace_partitions(o, new, ["o_orderpriority"]).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


def g12_merge_sets(spark, sf_dir):
    """Users' types, largest value and whether all are valuable, merged from the first and second half of January."""
    e = table(spark, sf_dir, "events").withColumn("late", micros(F.col("ts")) >= 1705276800000000)
    half = lambda c: e.filter(c).groupBy("user_id").agg(F.collect_set("event_type").alias("types"), F.max("value").alias("top"), F.bool_and(F.col("value") > 1).alias("fine"))
    out = K.merge_sets(half(~F.col("late")), half(F.col("late")), ["user_id"], ["types"], ["top"], ["fine"])
    return out.withColumn("types", F.array_join("types", ",")).withColumn("times_seen", F.col("times_seen").cast("long"))


def g13_map_merge(spark, sf_dir):
    """Latest non-empty value per key wins: users' maps of type to value, later events over earlier ones."""
    e = table(spark, sf_dir, "events").withColumn("at", micros(F.col("ts")))
    last = K.latest_wins(e.filter("value > 0"), ["user_id", "event_type"], ["at", "event_id"])
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("event_type", F.round("value", 2).cast("decimal(10,2)").alias("v")))), lambda x: F.concat_ws("=", x["event_type"], x["v"].cast("string")))
    return last.groupBy("user_id").agg(F.array_join(pairs, ";").alias("merged"))


def g14_missing_topics(spark, sf_dir):
    """Topics that no part name holds: neither the phrase nor all its words."""
    topics = spark.createDataFrame([("red ring",), ("blue whale",), ("small widget",), ("green moon",)], "topic string")
    p = table(spark, sf_dir, "part").select("p_name").distinct()
    there = (F.col("p_name").contains(F.col("topic"))) | F.forall(F.split("topic", " "), lambda w: F.array_contains(F.split("p_name", " "), w))
    return F.broadcast(topics).join(p, there, "left_anti")


def g16_cache_split(spark, sf_dir):
    """Documents with labels (hits) and without (misses), both kept."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    hits, misses = K.split_by_cache(d, table(spark, sf_dir, "labels").select("doc_id", "quality"), ["doc_id"])
    rows = hits.select("lang", F.lit("hit").alias("state"), "quality").unionByName(misses.select("lang", F.lit("miss").alias("state"), F.lit(0).alias("quality")))
    return rows.groupBy("lang", "state").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").cast("long").alias("quality"))


def g17_surrogate_keys(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", K.surrogate(F.col("o_custkey"), F.col("o_orderstatus"), F.col("o_orderpriority")).alias("key"))


def g19_slug_hash(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    key = F.concat_ws("-", text.slug(F.concat_ws(" ", "p_brand", "p_name")), F.substring(F.sha2(F.concat("p_name", "p_type").cast("binary"), 256), 1, 10))
    return p.select("p_partkey", key.alias("key"))


def h01_plain_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.plain(F.col("text")).cast("binary"), 256).alias("digest"))


def h05_token_jaccard(spark, sf_dir):
    """Similarity of the words of neighbouring turns of a conversation."""
    c = table(spark, sf_dir, "conversations").withColumn("t", text.tokens(F.col("text"), 3))
    rows = c.withColumn("before", F.lag("t").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("before IS NOT NULL")
    return rows.select("conv_id", "turn", F.round(text.jaccard(F.col("t"), F.col("before")), 6).alias("similarity"))


def h10_visible_text(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    t = text.strip_markup(F.col("html"))
    return p.select("page_id", F.sha2(t.cast("binary"), 256).alias("digest"), F.length(t).cast("long").alias("chars"))


def h10_spoken(spark, sf_dir):
    """Part names dressed in Markdown, HTML and emoji, as they are read out."""
    dressed = F.concat(F.lit("### **"), "p_name", F.lit("** \U0001f600 [see](http://x/y) `code`\n\n\n<b>"), "p_type", F.lit("</b>  ```\nx\n``` "))
    return table(spark, sf_dir, "part").select("p_partkey", text.spoken(dressed).alias("spoken"))


def h11_redaction(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.redact(F.col("url")).alias("url"))


def h14_license_codes(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(text.license_code(F.col("text")).alias("code"))
    return d.groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def h15_url_titles(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.url_title(F.col("url")).alias("title"))


def h17_truncated(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.truncate(F.col("text"), 120).alias("short"))


def h19_chunks(spark, sf_dir):
    """Sentences of each turn packed to chunks of 200 characters: how many and the longest."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.pack(text.sentences(F.col("text")), 200).alias("c"))
    return c.select("conv_id", "turn", F.size("c").cast("long").alias("chunks"), F.array_max(F.transform("c", lambda x: F.length(x))).cast("long").alias("longest"))


def h22_labels(spark, sf_dir):
    rules = {"licensed": "(?i)licen[sc]ed", "numbers": "[0-9]{6}", "table": " \\| ", "shouting": "[A-Z]{3,}!!"}
    d = table(spark, sf_dir, "documents").select(F.array_join(text.labels(F.col("text"), rules), ",").alias("labels"), text.first_label(F.col("text"), rules, "plain").alias("main"))
    return d.groupBy("labels", "main").agg(F.count(F.lit(1)).alias("n"))


def h30_reuse_penalty(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("at", micros(F.col("ts")))
    w = Window.partitionBy("user_id", "event_type").orderBy("at", "event_id")
    hours = (F.col("at") - F.lag("at").over(w)) / 3_600_000_000
    times = F.row_number().over(w) - 1
    return e.select("event_id", F.round(scoring.reuse_penalty(times > 0, hours, F.col("value") > 50, times), 6).alias("penalty"))


def h37_stamps(spark, sf_dir):
    s = F.col("o_totalprice") / 7
    return table(spark, sf_dir, "orders").select("o_orderkey", T.stamp(s).alias("srt"), T.stamp(s, False).alias("vtt"), T.centi_stamp(s).alias("ass"), T.clock(s).alias("clock"))


def h42_json_objects(spark, sf_dir):
    """Payload objects read from text with remarks around them; a broken one is null."""
    props = F.when(F.col("event_type") == "click", F.concat(F.lit("["), "props", F.lit("]"))).otherwise(F.col("props"))
    raw = F.concat(F.lit("```json\n"), props, F.when(F.col("event_type") == "error", F.lit("")).otherwise(F.lit("\n``` done")))
    e = table(spark, sf_dir, "events").select("event_type", jsontext.read_object(raw, "k long, missing string").alias("o"))
    return e.groupBy("event_type").agg(F.sum("o.k").alias("k"), F.count("o.missing").alias("missing"))


def h12_redacted_keys(spark, sf_dir):
    raw = F.to_json(F.struct("event_id", F.struct(F.col("event_type").alias("token"), F.array(F.struct(F.col("event_type").alias("Secret"), F.lit("x").alias("y"))).alias("items")).alias("inner")))
    return table(spark, sf_dir, "events").select("event_id", jsontext.redact_keys(raw, ["token", "secret"]).alias("redacted"))


def h44_json_columns(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.to_json(F.array_sort(F.collect_set("event_type"))).alias("j"))
    return rows.select("user_id", "j", F.size(F.from_json("j", "array<string>")).cast("long").alias("n"))


def c02_prompt_bank(spark, sf_dir):
    """Vectors against a bank of label means: best label, similarity, state by floor; those of their own label are decided and left out."""
    e = table(spark, sf_dir, "embeddings")
    best = best_of_bank(e, _means(e), "vec_id", F.col("s"))
    best = best.join(e.select("vec_id", "label"), "vec_id").filter("best <> label")
    return best.select("vec_id", "best", F.round("s", 5).alias("similarity"), (F.col("s") >= 0.2).alias("strict"))


def _means(e):
    long = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    series = F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"])
    return long.groupBy(F.col("label").alias("bank_label")).agg(series.alias("mean"))


def c03_gain_rank(spark, sf_dir):
    """The 20 vectors of highest gain: similarity to the best label mean times the label's deficit to 60 vectors."""
    e = table(spark, sf_dir, "embeddings")
    size = e.groupBy(F.col("label").alias("bank_label")).agg(F.count(F.lit(1)).alias("n"))
    need = _means(e).join(size, "bank_label").withColumn("need", F.greatest(F.lit(0.0), (60 - F.col("n")) / 60))
    best = best_of_bank(e, need, "vec_id", F.round(F.greatest(F.lit(0.0), F.col("s")) * F.col("need"), 6))
    return best.select("vec_id", F.col("s").alias("gain")).orderBy(F.desc("gain"), "vec_id").limit(20)


def d33_mean_pool(spark, sf_dir):
    """Length of each label's mean vector and its first value after scaling to length 1."""
    m = _means(table(spark, sf_dir, "embeddings"))
    return m.select(F.col("bank_label").alias("label"), F.round(vector.norm(F.col("mean")), 6).alias("length"), F.round(F.get("mean", F.lit(0)) / vector.norm(F.col("mean")), 6).alias("first"))


def e11_triage(spark, sf_dir):
    """Tier of each vector by similarity to its label's mean against the label's upper median: keep, review, drop."""
    e = table(spark, sf_dir, "embeddings")
    s = e.join(_means(e), F.col("label") == F.col("bank_label")).withColumn("s", F.round(vector.cosine(F.col("embedding"), F.col("mean")), 6))
    median = at_rank(s, ["label"], "s", lambda n: F.floor(n / 2) + 1).select("label", F.col("s").alias("median"))
    rows = s.join(median, "label")
    tier = F.when(F.col("s") >= F.col("median"), "keep").when(F.col("s") >= F.col("median") * 0.6, "review").otherwise("drop")
    return rows.groupBy("label", tier.alias("tier")).agg(F.count(F.lit(1)).alias("n"))


def f19_best_match(spark, sf_dir):
    """For each vector the other one nearest to it in its scene; scenes are fifty vectors in order of id."""
    e = table(spark, sf_dir, "embeddings").withColumn("scene", F.floor(F.col("vec_id") / 50))
    o = e.select("scene", F.col("vec_id").alias("other_id"), F.col("embedding").alias("o"))
    pairs = e.join(o, "scene").filter("vec_id <> other_id").withColumn("s", F.round(vector.cosine(F.col("embedding"), F.col("o")), 6))
    return top_k(pairs, ["vec_id"], [F.desc("s"), F.col("other_id")], 1).select("vec_id", "other_id", "s")


def c15_phrase_match(spark, sf_dir):
    """Benchmark items whose normal form stands word for word in a document: items are looked for by their rarest word."""
    found = dictionary.matches(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")
    return found.select(F.col("doc").alias("doc_id"), F.col("term").alias("item_id")).distinct()


QUERIES = {k: v for k, v in list(globals().items()) if k[0] in "acdefgh" and k[1:3].isdigit()}
_P = "trim(regexp_replace(strip_accents(lower({0})), '[^a-z0-9]+', ' ', 'g'))"
_COS = "list_dot_product({0}, {1}) / (sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1})))"
_MEANS = """WITH x AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), m0 AS (SELECT label, i, avg(x) AS m FROM x GROUP BY 1, 2),
    m AS (SELECT label AS bank_label, list(m ORDER BY i) AS mean FROM m0 GROUP BY label)
"""
_MASKED = """regexp_replace(url, '(?i)([?&](?:api_?key|key|token|access_token|secret|utm_source)=)[^&\\s"]+', '\\1***', 'g')"""
for _ in range(4):  # a pass masks the last token that is still readable
    _MASKED = f"""regexp_replace({_MASKED}, '(https?://[^\\s?"]*/)[A-Za-z0-9_-]{{24,}}', '\\1***', 'g')"""
_SENT = "list_filter(list_transform(string_split(regexp_replace({0}, '([.!?])[ \\t\\r\\n]+', '\\1' || chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '')"
ORACLE = {
    "a07_latest_cache": "SELECT user_id, event_type, arg_max(event_id, (epoch_us(ts), event_id)) AS event_id, arg_max(value, (epoch_us(ts), event_id)) AS value FROM events GROUP BY 1, 2",
    "a09_ttl": "SELECT event_type, count(*) FILTER (live) AS kept, count(*) FILTER (NOT live) AS pruned FROM (SELECT event_type, epoch_us(ts) >= (SELECT max(epoch_us(ts)) FROM events) - 864000000000 AS live FROM events) GROUP BY 1",
    "a10_usage_counts": "SELECT l_partkey, count(*) AS uses FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY 1",
    "a11_upsert": "SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer",
    "a13_tried_queries": f"SELECT DISTINCT q FROM (SELECT {_P.format('p_name')} AS q FROM part) WHERE q NOT IN (SELECT {_P.format('p_name')} FROM part WHERE p_type = 'ECONOMY')",
    "a15_offset_read": "SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id > 5000",
    "c21_orphans": "SELECT p_partkey AS key, 'left' AS side FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem) UNION ALL SELECT DISTINCT l_partkey, 'right' FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)",
    "g01_first_writer": "SELECT min(doc_id) AS doc_id, sha256(text) AS sha FROM documents WHERE text IS NOT NULL GROUP BY 2",
    "g02_not_taken": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
    "g04_ordered_distinct": "SELECT p_type, string_agg(DISTINCT w, ' ' ORDER BY w) AS words FROM (SELECT p_type, unnest(string_split(lower(p_name), ' ')) AS w FROM part) GROUP BY 1",
    "g05_keep_first_by_url": "SELECT min(page_id) AS page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM pages WHERE url IS NOT NULL GROUP BY 2",
    "g06_near_hash": """WITH h AS (SELECT vec_id, list_transform(embedding, lambda x: (x > 0)::INT) AS b FROM embeddings)
        SELECT a.vec_id, o.vec_id AS other_id, CAST(list_sum(list_transform(list_zip(a.b, o.b), lambda p: abs(p[1] - p[2]))) AS BIGINT) AS distance FROM h a JOIN h o ON a.vec_id < o.vec_id
        WHERE list_sum(list_transform(list_zip(a.b, o.b), lambda p: abs(p[1] - p[2]))) <= 6""",
    "g07_replace_partitions": "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH') OR o_orderstatus = 'F' GROUP BY 1",
    "g12_merge_sets": """WITH e AS (SELECT *, epoch_us(ts) >= 1705276800000000 AS late FROM events) SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types, max(value) AS top, bool_and(value > 1) AS fine, count(DISTINCT late) AS times_seen FROM e GROUP BY user_id""",
    "g13_map_merge": """WITH l AS (SELECT user_id, event_type, arg_max(value, (epoch_us(ts), event_id)) AS v FROM events WHERE value > 0 GROUP BY 1, 2)
        SELECT user_id, string_agg(event_type || '=' || CAST(CAST(round(v, 2) AS DECIMAL(10, 2)) AS VARCHAR), ';' ORDER BY event_type) AS merged FROM l GROUP BY 1""",
    "g14_missing_topics": """SELECT topic FROM (VALUES ('red ring'), ('blue whale'), ('small widget'), ('green moon')) t(topic) WHERE NOT EXISTS
        (SELECT 1 FROM part WHERE contains(p_name, topic) OR len(list_intersect(string_split(topic, ' '), string_split(p_name, ' '))) = len(string_split(topic, ' ')))""",
    "g16_cache_split": "SELECT lang, CASE WHEN l.doc_id IS NULL THEN 'miss' ELSE 'hit' END AS state, count(*) AS n, CAST(sum(coalesce(quality, 0)) AS BIGINT) AS quality FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1, 2",
    "g17_surrogate_keys": "SELECT o_orderkey, sha1(o_custkey || '|' || o_orderstatus || '|' || o_orderpriority)[1:16] AS key FROM orders",
    "g19_slug_hash": f"SELECT p_partkey, regexp_replace(replace({_P.format(chr(40) + chr(112) + '_brand || ' + chr(39) + ' ' + chr(39) + ' || p_name' + chr(41))}, ' ', '-')[1:60], '-+$', '') || '-' || sha256(p_name || p_type)[1:10] AS key FROM part",
    "h01_plain_text": f"SELECT doc_id, sha256({_P.format('text')}) AS digest FROM documents",
    "h05_token_jaccard": f"""WITH t AS (SELECT conv_id, turn, list_distinct(list_filter(string_split({_P.format('text')}, ' '), lambda x: length(x) >= 3)) AS t FROM conversations), b AS (SELECT *, lag(t) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM t)
        SELECT conv_id, turn, round(CASE WHEN len(list_distinct(list_concat(t, b))) = 0 THEN 0 ELSE len(list_intersect(t, b)) / len(list_distinct(list_concat(t, b))) END, 6) AS similarity FROM b WHERE b IS NOT NULL""",
    "h10_visible_text": """WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g') AS t FROM pages),
        b AS (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '[ \\t\\r\\n]+', ' ', 'g')) AS t FROM a)
        SELECT page_id, sha256(t) AS digest, length(t) AS chars FROM b""",
    "h10_spoken": "SELECT p_partkey, p_name || ' see code' || chr(10) || chr(10) || p_type AS spoken FROM part",
    "h11_redaction": f"""SELECT page_id, {_MASKED} AS url FROM pages""",
    "h14_license_codes": """SELECT CASE WHEN regexp_matches(lower(text), 'cc[ -]by-nc') THEN 'cc-by-nc' WHEN regexp_matches(lower(text), 'cc[ -]by-sa|sharealike') THEN 'cc-by-sa' WHEN regexp_matches(lower(text), 'cc[ -]by|creative commons attribution') THEN 'cc-by'
        WHEN regexp_matches(lower(text), 'cc0|cc-zero') THEN 'cc0' WHEN regexp_matches(lower(text), 'public domain') THEN 'pd' ELSE '' END AS code, count(*) AS n FROM documents GROUP BY 1""",
    "h15_url_titles": """WITH u AS (SELECT page_id, url_decode(regexp_replace(regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]+/?([^?#]*)', 1), '([^/]*)/?$', 1), '\\.[A-Za-z0-9]+$', '')) AS last, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM pages)
        SELECT page_id, trim(regexp_replace(CASE WHEN last <> '' THEN last ELSE host END, '[-_+%. ]+', ' ', 'g')) AS title FROM u""",
    "h17_truncated": """WITH f AS (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g')) AS f FROM documents), p AS (SELECT *, list_max(list_filter(range(1, 120), lambda i: f[i:i] IN ('.', ';', ',') AND f[i + 1:i + 1] = ' ')) AS cut FROM f)
        SELECT doc_id, CASE WHEN length(f) <= 120 THEN f WHEN cut - 1 >= 80 THEN trim(f[1:cut - 1]) || '...' ELSE trim(f[1:120]) || '...' END AS short FROM p""",
    "h22_labels": """WITH r AS (SELECT regexp_matches(text, '(?i)licen[sc]ed') AS l, regexp_matches(text, '[0-9]{6}') AS n, regexp_matches(text, ' \\| ') AS t, regexp_matches(text, '[A-Z]{3,}!!') AS s FROM documents)
        SELECT concat_ws(',', CASE WHEN l THEN 'licensed' END, CASE WHEN n THEN 'numbers' END, CASE WHEN s THEN 'shouting' END, CASE WHEN t THEN 'table' END) AS labels,
          CASE WHEN l THEN 'licensed' WHEN n THEN 'numbers' WHEN t THEN 'table' WHEN s THEN 'shouting' ELSE 'plain' END AS main, count(*) AS n FROM r GROUP BY 1, 2""",
    "h30_reuse_penalty": """WITH o AS (SELECT *, row_number() OVER w - 1 AS times, (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 3600000000 AS hours FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY epoch_us(ts), event_id))
        SELECT event_id, round(CASE WHEN times > 0 THEN 1.5 ELSE 0 END + CASE WHEN hours < 12 THEN 0.8 ELSE 0 END + CASE WHEN value > 50 THEN 1.2 ELSE 0 END + least(1.2, times * 0.08), 6) AS penalty FROM o""",
    "h37_stamps": """WITH m AS (SELECT o_orderkey, CAST(round(o_totalprice / 7 * 1000) AS BIGINT) AS ms, CAST(round(o_totalprice / 7 * 100) AS BIGINT) AS cs, CAST(floor(o_totalprice / 7) AS BIGINT) AS s FROM orders)
        SELECT o_orderkey, format('{:02d}:{:02d}:{:02d},{:03d}', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS srt, format('{:02d}:{:02d}:{:02d}.{:03d}', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS vtt,
          format('{:d}:{:02d}:{:02d}.{:02d}', cs // 360000, cs // 6000 % 60, cs // 100 % 60, cs % 100) AS ass, format('{:d}:{:02d}', s // 60, s % 60) AS clock FROM m""",
    "h42_json_objects": "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k, 0::BIGINT AS missing FROM events GROUP BY 1",
    "h12_redacted_keys": """SELECT event_id, '{"event_id":' || event_id || ',"inner":{"token":"***","items":[{"Secret":"***","y":"x"}]}}' AS redacted FROM events""",
    "h44_json_columns": """SELECT user_id, '["' || string_agg(DISTINCT event_type, '","' ORDER BY event_type) || '"]' AS j, count(DISTINCT event_type) AS n FROM events GROUP BY 1""",
    "c02_prompt_bank": _MEANS + f""", p AS (SELECT e.vec_id, e.label, m.bank_label, {_COS.format('e.embedding::DOUBLE[]', 'm.mean')} AS s FROM embeddings e, m),
        b AS (SELECT vec_id, label, arg_max(bank_label, (s, -bank_label)) AS best, max(s) AS s FROM p GROUP BY 1, 2) SELECT vec_id, best, round(s, 5) AS similarity, s >= 0.2 AS strict FROM b WHERE best <> label""",
    "c03_gain_rank": _MEANS + f""", n AS (SELECT label, greatest(0, (60 - count(*)) / 60) AS need FROM embeddings GROUP BY 1)
        SELECT vec_id, max(round(greatest(0, {_COS.format('e.embedding::DOUBLE[]', 'm.mean')}) * need, 6)) AS gain FROM embeddings e, m JOIN n ON n.label = m.bank_label GROUP BY 1 ORDER BY gain DESC, vec_id LIMIT 20""",
    "d33_mean_pool": _MEANS + "SELECT bank_label AS label, round(sqrt(list_dot_product(mean, mean)), 6) AS length, round(mean[1] / sqrt(list_dot_product(mean, mean)), 6) AS first FROM m",
    "e11_triage": _MEANS + f""", s AS (SELECT label, round({_COS.format('embedding::DOUBLE[]', 'mean')}, 6) AS s FROM embeddings JOIN m ON label = bank_label), q AS (SELECT label, list(s ORDER BY s)[count(*) // 2 + 1] AS median FROM s GROUP BY 1)
        SELECT label, CASE WHEN s >= median THEN 'keep' WHEN s >= median * 0.6 THEN 'review' ELSE 'drop' END AS tier, count(*) AS n FROM s JOIN q USING (label) GROUP BY 1, 2""",
    "f19_best_match": f"""SELECT vec_id, other_id, s FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, other_id) AS n FROM
        (SELECT a.vec_id, b.vec_id AS other_id, round({_COS.format('a.embedding::DOUBLE[]', 'b.embedding::DOUBLE[]')}, 6) AS s FROM embeddings a JOIN embeddings b ON a.vec_id // 50 = b.vec_id // 50 AND a.vec_id <> b.vec_id)) WHERE n = 1""",
    "c15_phrase_match": f"""WITH b AS (SELECT item_id, {_P.format('text')} AS t FROM benchmark), d AS (SELECT doc_id, ' ' || {_P.format('text')} || ' ' AS t FROM documents)
        SELECT doc_id, item_id FROM d JOIN b ON contains(d.t, ' ' || b.t || ' ') WHERE b.t <> ''""",
}
