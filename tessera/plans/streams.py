"""Queries that run as streams over the event table, drained to a table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from tessera.functions.time import micros
from tessera.session import table
from tessera.sources import journal
from tessera.sources.paged import PagedSource
from tessera.streaming import jobs, states


#: Steps that are legal from one type of event to the next.
EDGES = [("signup", "view"), ("view", "click"), ("click", "purchase"), ("click", "view"), ("purchase", "view"), ("error", "view"), ("view", "error"), ("click", "error")]


def scratch(spark, name):
    """A new folder under spark.checkpoint.dir; where that is unset, a local master (tests) uses one of this machine."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root and sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        root = f"file://{tempfile.gettempdir()}/tessera"
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{root.rstrip('/')}/plans/{uuid.uuid4().hex}/{name}"


def _event_stream(spark, sf_dir):
    rows = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.withColumn("time", F.col("ts").cast("timestamp"))


def i01_journal_tail(spark, sf_dir):
    """The events as a journal, tailed from offset 100 as a stream."""
    folder = scratch(spark, "journal")
    e = table(spark, sf_dir, "events")
    journal.append(e.select(F.col("event_id").alias("seq"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("at"), F.col("event_type").alias("stage"), F.lit("step").alias("event"), F.lit("INFO").alias("level"), F.col("props").alias("payload")), folder)
    return jobs.drain(journal.tail(spark, folder, after=100), scratch(spark, "tail")).select("seq", "stage", F.get_json_object("payload", "$.k").cast("long").alias("k"))


def i02_topup(spark, sf_dir):
    """Candidates of each event type taken in four batches by one writer until 100 users are reached; coverage measured at the end."""
    source = scratch(spark, "candidates")
    e = table(spark, sf_dir, "events").select("event_type", "user_id")
    for part in range(4):
        e.filter(F.col("user_id") % 4 == part).write.mode("append").parquet(source)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(source)
    store = jobs.topped_up(stream, scratch(spark, "topup"), ["event_type", "user_id"], "event_type", 100)
    n = F.count(F.lit(1))
    return store.groupBy("event_type").agg(F.least(n, F.lit(100)).alias("n"), (n >= 100).alias("covered"))


def i02_windowed_counts(spark, sf_dir):
    """Daily counts and sums per type from the stream, with a day of lateness; a last event far ahead closes all windows."""
    e = _event_stream(spark, sf_dir).select("event_type", "value", "time")
    end = scratch(spark, "end")
    spark.createDataFrame([("end", 0.0)], "event_type string, value double").select("*", F.expr("timestamp'2100-01-01'").alias("time")).write.parquet(end)
    folder = scratch(spark, "windows")
    run = lambda rows: jobs.drain(jobs.windows(rows, "time", "1 day", "1 day", ["event_type"]), folder)
    out = run(e.union(spark.readStream.schema(e.schema).parquet(end)))
    out = out.filter("event_type <> 'end'")
    return out.select(F.date_format("w_start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def i03_token_bucket(spark, sf_dir):
    """Calls of each user and event type through a bucket of 2 tokens that gains one in 2 days; errors over 30 are refused, three
    in a row hold calls back for ten days."""
    calls = _event_stream(spark, sf_dir).select(
        F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("caller"), "event_id", (micros(F.col("ts")) / 1_000_000).alias("at"), (F.col("value") > 30).alias("refused")
    )
    return jobs.drain(jobs.token_bucket(calls, "caller", 1 / 172_800, 2.0, 3, 864_000.0), scratch(spark, "bucket"))


def i08_once(spark, sf_dir):
    """Users' types once each within 60 days of the stream."""
    rows = _event_stream(spark, sf_dir).withColumn("key", F.concat_ws("/", F.col("user_id").cast("string"), "event_type"))
    return jobs.drain(jobs.once(rows, "key", "time", "60 days").select("key"), scratch(spark, "once"))


def a19_paged_listing(spark, sf_dir):
    """Parts as a provider's paged listing, read back through the paged data source: per license code count and duration."""
    folder = scratch(spark, "pages")
    p = table(spark, sf_dir, "part")
    p.select(F.col("p_partkey").alias("provider_id"), F.col("p_name").alias("title"), F.col("p_type").alias("license"), F.col("p_size").cast("double").alias("duration")).repartition(4, "provider_id").write.json(folder)
    spark.dataSource.register(PagedSource)
    rows = spark.read.format("paged").option("path", folder).load()
    return rows.groupBy("license").agg(F.count(F.lit(1)).alias("n"), F.sum("duration").alias("duration"))


def i04_checked_states(spark, sf_dir):
    """Each user's steps checked as a stream with typed state: accepted and refused ones, and the last state."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", states.STORE)
    try:
        steps = _event_stream(spark, sf_dir).select("user_id", "time", F.col("event_type").alias("event"))
        rows = jobs.drain(states.checked_states(steps, "user_id", EDGES, "0 seconds", idle=10.0**9), scratch(spark, "checked"))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    last = F.max_by("state", "attempts").alias("state")
    return rows.groupBy("user_id").agg(F.count_if(F.col("verdict") == "accepted").alias("accepted"), F.count_if(F.col("verdict") == "refused").alias("refused"), last)


QUERIES = {f.__name__: f for f in (i01_journal_tail, i02_topup, i02_windowed_counts, i03_token_bucket, i08_once, a19_paged_listing, i04_checked_states)}
_LEGAL = ", ".join(f"'{a}>{b}'" for a, b in EDGES)
ORACLE = {
    "i04_checked_states": f"""WITH s AS (SELECT user_id, list(event_type ORDER BY epoch_us(ts), event_type) AS s FROM events GROUP BY 1),
        r AS (SELECT user_id, list_reduce(s[2:], lambda a, x: CASE WHEN list_contains([{_LEGAL}], split_part(a, '|', 1) || '>' || x) THEN x || '|' || (split_part(a, '|', 2)::INT + 1) || '|' || split_part(a, '|', 3) ELSE split_part(a, '|', 1) || '|' || split_part(a, '|', 2) || '|' || (split_part(a, '|', 3)::INT + 1) END, s[1] || '|1|0') AS r FROM s)
        SELECT user_id, split_part(r, '|', 2)::BIGINT AS accepted, split_part(r, '|', 3)::BIGINT AS refused, split_part(r, '|', 1) AS state FROM r""",
    "i01_journal_tail": "SELECT event_id AS seq, event_type AS stage, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id > 100",
    "i02_topup": "SELECT event_type, least(100, count(DISTINCT user_id)) AS n, count(DISTINCT user_id) >= 100 AS covered FROM events GROUP BY 1",
    "i02_windowed_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "i08_once": "SELECT DISTINCT user_id || '/' || event_type AS key FROM events",
    "a19_paged_listing": "SELECT p_type AS license, count(*) AS n, CAST(sum(p_size) AS DOUBLE) AS duration FROM part GROUP BY 1",
}
