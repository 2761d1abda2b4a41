"""Versioned keyed stores: insert-or-enrich, latest wins with older versions, compaction."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.time import micros
from tessera.plans.streams import scratch
from tessera.session import table
from tessera.sources.versioned import VersionedStore

CLIPS = """part long, supp long, order_id long, line long, day long, mode string, status string, uses long, tags array<string>,
    history array<long>, meta map<string, string>"""
CLIP_RULES = {"order_id": "greatest", "line": "greatest", "day": "greatest", "mode": "first", "uses": "sum", "tags": "union", "history": "append", "meta": "merge"}


def a25_clip_store(spark, sf_dir):
    """Segments (part, supplier) registered in three rounds, with a compaction after the second and a rerun of the third: the first
    mode and the last status stay, uses add up, tags unite, history grows, metadata is merged."""
    store = VersionedStore(spark, scratch(spark, "clips"), CLIPS, ["part", "supp"], CLIP_RULES, ["order_id", "line", "day"])
    l = table(spark, sf_dir, "lineitem")
    rows = l.select(
        F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").cast("long").alias("line"), F.unix_date(F.to_date("l_shipdate")).cast("long").alias("day"), F.date_format("l_shipdate", "yyyy").alias("mode"),
        F.col("l_linestatus").alias("status"), F.col("l_quantity").cast("long").alias("uses"), F.array("l_returnflag").alias("tags"), F.array("l_orderkey").alias("history"),
        F.create_map("l_returnflag", F.col("l_linenumber").cast("string")).alias("meta"),
    )
    for i in range(3):
        store.commit(rows.filter(F.col("order_id") % 3 == i), token=f"round-{i}")
        if i == 1:
            store.compact()
    store.commit(rows.filter(F.col("order_id") % 3 == 2), token="round-2")
    meta = F.array_join(F.transform(F.array_sort(F.map_entries("meta")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return store.read().select("part", "supp", "mode", "status", "uses", F.array_join("tags", ",").alias("tags"), F.array_join("history", ",").alias("history"), meta.alias("meta"))


def a26_scene_index(spark, sf_dir):
    """The last event of each user as of the first version and as of the newest, of one store; events of even hours come first."""
    store = VersionedStore(spark, scratch(spark, "scenes"), "user_id long, at long, event_id long, event_type string", ["user_id"], order=["at", "event_id"])
    e = table(spark, sf_dir, "events").withColumn("at", micros(F.col("ts")))
    even = F.floor(F.col("at") / 3_600_000_000) % 2 == 0
    first = store.commit(e.filter(even))
    store.commit(e.filter(~even))
    store.compact()
    then = store.read(first).select("user_id", F.col("event_type").alias("then_type"))
    return store.read().select("user_id", F.col("event_type").alias("now_type"), F.col("event_id").alias("now_id")).join(then, "user_id", "left")


def a11_compacted_matches(spark, sf_dir):
    """Matches (supplier, order, part) upserted in six commits, compacted and vacuumed: the last quantity of each stays, in one version."""
    store = VersionedStore(spark, scratch(spark, "matches"), "supp long, status string, part long, line long, quantity double", ["supp", "status", "part"], order=["line"])
    l = table(spark, sf_dir, "lineitem")
    rows = l.groupBy(F.col("l_suppkey").alias("supp"), F.col("l_linestatus").alias("status"), F.col("l_partkey").alias("part"), F.col("l_linenumber").cast("long").alias("line")).agg(F.max("l_quantity").cast("double").alias("quantity"))
    for i in range(6):
        store.commit(rows.filter(F.pmod(F.col("line"), F.lit(6)) == i))
    store.compact()
    store.vacuum()
    n = len(store.versions())
    return store.read().groupBy("supp", "status").agg(F.count(F.lit(1)).alias("parts"), F.sum("quantity").alias("quantity")).withColumn("versions", F.lit(n).cast("long"))


QUERIES = {k: v for k, v in list(globals().items()) if k[0] == "a" and k[1:3].isdigit()}
ORACLE = {
    "a25_clip_store": """WITH l AS (SELECT *, (l_orderkey % 3, l_orderkey, l_linenumber, l_shipdate) AS o FROM lineitem),
        m AS (SELECT l_partkey, l_suppkey, string_agg(l_returnflag || '=' || v, ',' ORDER BY l_returnflag) AS meta FROM
              (SELECT l_partkey, l_suppkey, l_returnflag, arg_max(l_linenumber, o) AS v FROM l GROUP BY ALL) GROUP BY ALL),
        s AS (SELECT l_partkey, l_suppkey, arg_min(strftime(l_shipdate, '%Y'), o) AS mode, arg_max(l_linestatus, o) AS status, CAST(sum(CAST(floor(l_quantity) AS BIGINT)) AS BIGINT) AS uses,
              string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS tags, string_agg(l_orderkey, ',' ORDER BY o) AS history FROM l GROUP BY ALL)
        SELECT l_partkey AS part, l_suppkey AS supp, mode, status, uses, tags, history, meta FROM s JOIN m USING (l_partkey, l_suppkey)""",
    "a26_scene_index": """WITH e AS (SELECT *, (epoch_us(ts) // 3600000000) % 2 AS odd, (epoch_us(ts), event_id) AS o FROM events)
        SELECT user_id, arg_max(event_type, (odd, o)) AS now_type, arg_max(event_id, (odd, o)) AS now_id, arg_max(event_type, o) FILTER (odd = 0) AS then_type FROM e GROUP BY 1""",
    "a11_compacted_matches": """WITH r AS (SELECT l_suppkey AS supp, l_linestatus AS status, l_partkey AS part, l_linenumber AS line, max(l_quantity)::DOUBLE AS q FROM lineitem GROUP BY ALL),
        k AS (SELECT supp, status, part, arg_max(q, (line % 6, line)) AS q FROM r GROUP BY ALL)
        SELECT supp, status, count(*) AS parts, sum(q) AS quantity, 1::BIGINT AS versions FROM k GROUP BY ALL""",
}
