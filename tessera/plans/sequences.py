"""Queries on ordered rows: runs, sessions, neighbours, running figures and windows over time."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions.time import micros
from tessera.operators import sequences as S
from tessera.session import table

HOUR = 3_600_000_000


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("at", micros(F.col("ts"))).drop("ts")


def e02_adjacent_repeats(spark, sf_dir):
    """Per user, events of the type of the one before, with the time to the next one less a trim of at most 0.45 s."""
    w = Window.partitionBy("user_id").orderBy("at", "event_id")
    rows = _events(spark, sf_dir).withColumn("same", F.coalesce(F.lag("event_type").over(w) == F.col("event_type"), F.lit(False)))
    length = F.lead("at").over(w) - F.col("at")
    return rows.withColumn("trimmed", length - F.least(F.lit(450_000), length)).filter("same").select("event_id", "trimmed")


def e04_run_starts(spark, sf_dir):
    """First turn of each run of one role in a conversation."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").withColumn("before", F.lag("role").over(w))
    return rows.filter("before IS NULL OR before <> role").select("conv_id", "turn", "role")


def e08_role_runs(spark, sf_dir):
    runs = S.run_ids(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "role")
    return runs.groupBy("conv_id", "run", "role").agg(F.min("turn").alias("first_turn"), F.count(F.lit(1)).alias("turns"), F.sum(F.length("text")).alias("chars"))


def e03_gap_sessions(spark, sf_dir):
    """Sessions of a user's events with gaps of at most 6 hours."""
    rows = S.gap_sessions(_events(spark, sf_dir), ["user_id"], "at", 6 * HOUR)
    return rows.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), (F.max("at") - F.min("at")).alias("length"))


def e10_transitions(spark, sf_dir):
    """Order of each conversation's turns with a fade where the role changes."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", F.when(F.lag("role").over(w) != F.col("role"), "fade").otherwise("cut").alias("transition"))


def e12_uses_before(spark, sf_dir):
    """How often each order's customer and priority were used before, with a penalty that grows to a limit."""
    o = table(spark, sf_dir, "orders")
    rows = S.uses_before(o, ["o_custkey", "o_orderpriority"], ["o_orderdate", "o_orderkey"])
    return rows.select("o_orderkey", F.col("used").cast("long").alias("used"), F.round(F.least(F.lit(1.2), F.col("used") * 0.08), 6).alias("penalty"))


def e13_lead_lengths(spark, sf_dir):
    """Time from each event to the next of its user; the last one ends with the user's largest time plus an hour."""
    w = Window.partitionBy("user_id").orderBy("at", "event_id")
    end = F.max("at").over(Window.partitionBy("user_id")) + HOUR
    return _events(spark, sf_dir).select("event_id", (F.coalesce(F.lead("at").over(w), end) - F.col("at")).alias("length"))


def e14_weighted_bounds(spark, sf_dir):
    """Parts 600 seconds of each conversation by the length of its turns."""
    rows = table(spark, sf_dir, "conversations").withColumn("weight", F.greatest(F.length("text"), F.lit(1)))
    out = S.shares_to_bounds(rows, ["conv_id"], ["turn"], "weight", F.lit(600.0))
    return out.select("conv_id", "turn", F.round("b_start", 6).alias("b_start"), F.round("b_end", 6).alias("b_end"))


def e16_word_timing(spark, sf_dir):
    """Start of each turn's words, each word lasting 0.08 s a character and 0.12 s more, rescaled to 30 s a turn."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.filter(F.split(F.coalesce("text", F.lit("")), "[ \\t\\r\\n]+"), lambda w: w != "")).alias("i", "word"))
    rows = rows.withColumn("ms", F.length("word") * 80 + 120)
    out = S.shares_to_bounds(rows, ["conv_id", "turn"], ["i"], "ms", F.lit(30.0))
    return out.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("words"), F.round(F.max("b_start"), 6).alias("last_start"), F.round(F.max("b_end"), 6).alias("end"))


def e18_hopping(spark, sf_dir):
    """Sub-windows of 3, 5 and 15 units of each part's size range, at most 8."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("long").alias("size"))
    return S.hopping(p, F.lit(0).cast("long"), F.col("size"), [3, 5, 15], 8).select("p_partkey", "h_start", "h_end")


def e19_tumbling(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("long").alias("size"))
    return S.tumbling(p, F.col("size"), 7).select("p_partkey", "number", "w_start", "w_end")


def e20_sample_points(spark, sf_dir):
    """Points at 10, 50 and 90 percent of each order's price, made strictly rising."""
    o = table(spark, sf_dir, "orders")
    point = lambda s: F.floor(F.col("o_totalprice") * s).cast("long")
    a = point(0.1)
    b = F.greatest(point(0.5), a + 1)
    return o.select("o_orderkey", a.alias("p10"), b.alias("p50"), F.greatest(point(0.9), b + 1).alias("p90"))


def e21_recent_repeats(spark, sf_dir):
    """Events whose type occurred among the last three of the user."""
    rows = S.repeats_within(_events(spark, sf_dir), ["user_id"], ["at", "event_id"], "event_type", 3)
    return rows.groupBy("user_id").agg(F.sum(F.col("repeats").cast("long")).alias("repeats"), F.count(F.lit(1)).alias("n"))


def e22_sample_grid(spark, sf_dir):
    """A grid of 10 units over each part's size, with the size's middle and the last unit, once each."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("long").alias("size"))
    grid = F.sequence(F.lit(0).cast("long"), F.col("size"), F.lit(10).cast("long"))
    more = F.array(F.floor(F.col("size") / 2), F.greatest(F.lit(0).cast("long"), F.col("size") - 1))
    return p.select("p_partkey", F.explode(F.array_sort(F.array_union(grid, more))).alias("sample"))


def e23_ema(spark, sf_dir):
    rows = S.ema(_events(spark, sf_dir).withColumn("o", F.struct("at", "event_id")), ["user_id"], "o", "value", 0.3)
    return rows.select("user_id", F.round("ema", 6).alias("ema"))


def e25_neighbour_pairs(spark, sf_dir):
    """Neighbouring role runs of a conversation: role before and after each change and the turn of it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").withColumn("before", F.lag("role").over(w))
    return rows.filter("before <> role").select("conv_id", "turn", "before", F.col("role").alias("after"))


def e01_sampling_grid(spark, sf_dir):
    """Users' active time on a 6-hour grid: events in each cell between the first and last one, zeros included."""
    rows = _events(spark, sf_dir).withColumn("cell", F.floor(F.col("at") / (6 * HOUR)))
    ends = rows.groupBy("user_id").agg(F.min("cell").alias("a"), F.max("cell").alias("b"))
    grid = ends.select("user_id", F.explode(F.sequence("a", "b")).alias("cell"))
    counts = rows.groupBy("user_id", "cell").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, ["user_id", "cell"], "left").select("user_id", "cell", F.coalesce("n", F.lit(0)).alias("n"))


def i04_transitions(spark, sf_dir):
    """Illegal steps of a user's event types, checked against the table of allowed ones."""
    edges = spark.createDataFrame([("signup", "view"), ("view", "click"), ("click", "purchase"), ("click", "view"), ("view", "view"), ("purchase", "view"), ("error", "view"), ("view", "error"), ("click", "error")], "a string, b string")
    w = Window.partitionBy("user_id").orderBy("at", "event_id")
    steps = _events(spark, sf_dir).withColumn("a", F.lag("event_type").over(w)).filter("a IS NOT NULL").withColumnRenamed("event_type", "b")
    return steps.join(F.broadcast(edges), ["a", "b"], "left_anti").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def d40_running_budget(spark, sf_dir):
    """Calls (events) per user and day: those beyond a budget of 2 are blocked."""
    day = F.floor(F.col("at") / (24 * HOUR))
    rows = S.uses_before(_events(spark, sf_dir).withColumn("day", day), ["user_id", "day"], ["at", "event_id"])
    return rows.groupBy("user_id", "day").agg(F.count_if(F.col("used") < 2).alias("allowed"), F.count_if(F.col("used") >= 2).alias("blocked"))


E_ = "WITH e AS (SELECT *, epoch_us(ts) AS tt FROM events)\n"
QUERIES = {
    f.__name__: f
    for f in (
        e01_sampling_grid, e02_adjacent_repeats, e03_gap_sessions, e04_run_starts, e08_role_runs, e10_transitions, e12_uses_before, e13_lead_lengths,
        e14_weighted_bounds, e16_word_timing, e18_hopping, e19_tumbling, e20_sample_points, e21_recent_repeats, e22_sample_grid, e23_ema,
        e25_neighbour_pairs, i04_transitions, d40_running_budget,
    )
}
ORACLE = {
    "e01_sampling_grid": E_ + """, c AS (SELECT user_id, tt // 21600000000 AS cell, count(*) AS n FROM e GROUP BY 1, 2),
        g AS (SELECT user_id, unnest(generate_series(min(cell), max(cell))) AS cell FROM c GROUP BY user_id)
        SELECT g.user_id, g.cell, coalesce(n, 0) AS n FROM g LEFT JOIN c ON g.user_id = c.user_id AND g.cell = c.cell""",
    "e02_adjacent_repeats": E_ + """SELECT event_id, len - least(450000, len) AS trimmed FROM (SELECT event_id, event_type, lag(event_type) OVER w AS b, lead(tt) OVER w - tt AS len FROM e
        WINDOW w AS (PARTITION BY user_id ORDER BY tt, event_id)) WHERE b = event_type""",
    "e03_gap_sessions": E_ + """, f AS (SELECT *, CASE WHEN tt - lag(tt) OVER (PARTITION BY user_id ORDER BY tt) > 21600000000 THEN 1 ELSE 0 END AS fresh FROM e),
        s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY tt RANGE UNBOUNDED PRECEDING) AS session FROM f)
        SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, max(tt) - min(tt) AS length FROM s GROUP BY user_id, session""",
    "e04_run_starts": """SELECT conv_id, turn, role FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) WHERE b IS NULL OR b <> role""",
    "e08_role_runs": """WITH f AS (SELECT *, CASE WHEN lag(role) OVER w IS NOT DISTINCT FROM role AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS c FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
        r AS (SELECT *, sum(c) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS run FROM f)
        SELECT conv_id, CAST(run AS BIGINT) AS run, role, min(turn) AS first_turn, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars FROM r GROUP BY conv_id, run, role""",
    "e10_transitions": """SELECT conv_id, turn, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) <> role THEN 'fade' ELSE 'cut' END AS transition FROM conversations""",
    "e12_uses_before": """SELECT o_orderkey, n AS used, round(least(1.2, n * 0.08), 6) AS penalty FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) - 1 AS n FROM orders)""",
    "e13_lead_lengths": E_ + """SELECT event_id, coalesce(lead(tt) OVER (PARTITION BY user_id ORDER BY tt, event_id), max(tt) OVER (PARTITION BY user_id) + 3600000000) - tt AS length FROM e""",
    "e14_weighted_bounds": """WITH w AS (SELECT conv_id, turn, greatest(length(text), 1) AS weight FROM conversations)
        SELECT conv_id, turn, round(600.0::DOUBLE * (sum(weight) OVER a - weight) / sum(weight) OVER b, 6) AS b_start, round(600.0::DOUBLE * (sum(weight) OVER a) / sum(weight) OVER b, 6) AS b_end FROM w
        WINDOW a AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY conv_id)""",
    "e16_word_timing": """WITH w AS (SELECT conv_id, turn, unnest(list_filter(string_split_regex(text, '[ \\t\\r\\n]+'), lambda x: x <> '')) AS word, generate_subscripts(list_filter(string_split_regex(text, '[ \\t\\r\\n]+'), lambda x: x <> ''), 1) AS i FROM conversations),
        m AS (SELECT *, length(word) * 80 + 120 AS ms FROM w),
        c AS (SELECT *, sum(ms) OVER (PARTITION BY conv_id, turn ORDER BY i ROWS UNBOUNDED PRECEDING) AS run, sum(ms) OVER (PARTITION BY conv_id, turn) AS whole FROM m)
        SELECT conv_id, turn, count(*) AS words, round(max(30.0::DOUBLE * (run - ms) / whole), 6) AS last_start, round(max(30.0::DOUBLE * run / whole), 6) AS "end" FROM c GROUP BY conv_id, turn""",
    "e18_hopping": """WITH p AS (SELECT p_partkey, CAST(p_size AS BIGINT) AS size FROM part),
        h AS (SELECT DISTINCT p_partkey, i * w AS h_start, (i + 1) * w AS h_end FROM p, (VALUES (3), (5), (15)) v(w), LATERAL (SELECT unnest(generate_series(0, size // w - 1)) AS i) s)
        SELECT p_partkey, h_start, h_end FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY h_start, h_end) AS n FROM h) WHERE n <= 8""",
    "e19_tumbling": """WITH p AS (SELECT p_partkey, CAST(p_size AS BIGINT) AS size FROM part WHERE p_size > 0)
        SELECT p_partkey, number, number * 7 AS w_start, least(number * 7 + 7, size) AS w_end FROM p, LATERAL (SELECT unnest(generate_series(0, (size + 6) // 7 - 1)) AS number) s""",
    "e20_sample_points": """WITH a AS (SELECT o_orderkey, CAST(floor(o_totalprice * 0.1::DOUBLE) AS BIGINT) AS p10, CAST(floor(o_totalprice * 0.5::DOUBLE) AS BIGINT) AS m, CAST(floor(o_totalprice * 0.9::DOUBLE) AS BIGINT) AS z FROM orders)
        SELECT o_orderkey, p10, greatest(m, p10 + 1) AS p50, greatest(z, greatest(m, p10 + 1) + 1) AS p90 FROM a""",
    "e21_recent_repeats": E_ + """SELECT user_id, CAST(sum(CASE WHEN list_contains(recent, event_type) THEN 1 ELSE 0 END) AS BIGINT) AS repeats, count(*) AS n FROM
        (SELECT user_id, event_type, list(event_type) OVER (PARTITION BY user_id ORDER BY tt, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS recent FROM e) GROUP BY user_id""",
    "e22_sample_grid": """WITH p AS (SELECT p_partkey, CAST(p_size AS BIGINT) AS size FROM part)
        SELECT p_partkey, unnest(generate_series(0, size, 10)) AS sample FROM p UNION SELECT p_partkey, size // 2 FROM p UNION SELECT p_partkey, greatest(0, size - 1) FROM p""",
    "e23_ema": E_ + """, o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY tt, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM e)
        SELECT user_id, round(sum(value * CASE WHEN i = 1 THEN pow(0.7, n - 1) ELSE 0.3 * pow(0.7, n - i) END), 6) AS ema FROM o GROUP BY user_id""",
    "e25_neighbour_pairs": """SELECT conv_id, turn, b AS before, role AS after FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) WHERE b <> role""",
    "i04_transitions": E_ + """, s AS (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY tt, event_id) AS a, event_type AS b FROM e)
        SELECT a, b, count(*) AS n FROM s WHERE a IS NOT NULL AND (a, b) NOT IN (VALUES ('signup', 'view'), ('view', 'click'), ('click', 'purchase'), ('click', 'view'), ('view', 'view'), ('purchase', 'view'), ('error', 'view'), ('view', 'error'), ('click', 'error')) GROUP BY a, b""",
    "d40_running_budget": E_ + """SELECT user_id, day, count(*) FILTER (n <= 2) AS allowed, count(*) FILTER (n > 2) AS blocked FROM
        (SELECT user_id, tt // 86400000000 AS day, row_number() OVER (PARTITION BY user_id, tt // 86400000000 ORDER BY tt, event_id) AS n FROM e) GROUP BY user_id, day""",
}
