"""Interval, point and as-of queries: events are intervals of their user's time, as long as their value in minutes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.time import micros
from tessera.operators import intervals as I
from tessera.session import table

HOUR = 3_600_000_000
MINUTE = 60_000_000
DAY = 24 * HOUR


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, event_type, start, end in microseconds; events last 10 minutes for each unit of value."""
    e = table(spark, sf_dir, "events")
    start = micros(F.col("ts"))
    return e.select("event_id", "user_id", "event_type", "value", start.alias("start"), (start + F.round(F.col("value") * 10 * MINUTE).cast("long")).alias("end"))


SPANS = """WITH s AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS "start",
    epoch_us(ts) + CAST(round(value * 600000000) AS BIGINT) AS "end" FROM events)
"""


def d03_union_seconds(spark, sf_dir):
    return I.union_length(spans(spark, sf_dir), ["user_id"]).select("user_id", "covered")


def c04_overlap_join(spark, sf_dir):
    s = spans(spark, sf_dir)
    left = s.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("start").alias("l_start"), F.col("end").alias("l_end"))
    right = s.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    out = I.overlap_join(left, right, ["user_id"], 6 * HOUR, min_overlap=MINUTE)
    return out.select("view_id", "click_id", (F.col("hi") - F.col("lo")).alias("shared"))


def c05_best_overlap(spark, sf_dir):
    s = spans(spark, sf_dir)
    left = s.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"), F.col("start").alias("l_start"), F.col("end").alias("l_end"))
    right = s.filter("event_type <> 'purchase'").select("user_id", F.col("event_id").alias("other_id"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    return I.best_overlap(left, right, ["user_id"], 6 * HOUR, "purchase_id", [F.col("other_id")]).select("purchase_id", "other_id", (F.col("hi") - F.col("lo")).alias("shared"))


def c06_dominant(spark, sf_dir):
    """For each purchase the other span that overlaps it longest, on whole minutes; of equal ones the most valued, then the first."""
    s = spans(spark, sf_dir)
    minute = lambda c: F.floor(F.col(c) / MINUTE) * MINUTE
    left = s.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"), minute("start").alias("l_start"), minute("end").alias("l_end"))
    right = s.filter("event_type <> 'purchase'").select("user_id", F.col("event_id").alias("other_id"), F.floor("value").alias("importance"), minute("start").alias("r_start"), minute("end").alias("r_end"))
    out = I.best_overlap(left, right, ["user_id"], 6 * HOUR, "purchase_id", [F.desc("importance"), F.col("r_start"), F.col("other_id")])
    return out.select("purchase_id", "other_id", (F.col("hi") - F.col("lo")).alias("shared"))


def _points(spark, sf_dir, closed):
    s = spans(spark, sf_dir)
    points = s.filter("event_type = 'error'").select("user_id", "event_id", F.col("start").alias("at"))
    right = s.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("start").alias("s_start"), F.col("end").alias("s_end"))
    return I.points_in(points, right, ["user_id"], 6 * HOUR, "event_id", [F.col("s_start"), F.col("view_id")], slack=1000, closed=closed)


def c07_point_lookup(spark, sf_dir):
    """The first view that holds each error, else the last view of the user."""
    s = spans(spark, sf_dir).filter("event_type = 'view'")
    last = s.groupBy("user_id").agg(F.max_by("event_id", F.struct("start", "event_id")).alias("last_view"))
    return _points(spark, sf_dir, False).join(last, "user_id", "left").select("event_id", F.coalesce("view_id", "last_view").alias("view_id"), F.col("view_id").isNotNull().alias("inside"))


def c08_point_inner(spark, sf_dir):
    return _points(spark, sf_dir, False).filter("view_id IS NOT NULL").select("event_id", "view_id")


def c10_closed_lookup(spark, sf_dir):
    return _points(spark, sf_dir, True).select("event_id", "view_id")


def c09_midpoint_lookup(spark, sf_dir):
    """Each signup's middle in a view, or else in a click."""
    s = spans(spark, sf_dir)
    points = s.filter("event_type = 'signup'").select("user_id", "event_id", F.floor((F.col("start") + F.col("end")) / 2).alias("at"))

    def found(kind, name):
        right = s.filter(F.col("event_type") == kind).select("user_id", F.col("event_id").alias(name), F.col("start").alias("s_start"), F.col("end").alias("s_end"))
        return I.points_in(points, right, ["user_id"], 6 * HOUR, "event_id", [F.col("s_start"), F.col(name)]).select("event_id", name)

    return found("view", "v").join(found("click", "c"), "event_id").select("event_id", F.coalesce("v", "c").alias("holder"))


def c11_forward_asof(spark, sf_dir):
    s = spans(spark, sf_dir)
    left = s.filter("event_type = 'signup'").select("user_id", "event_id", F.col("start").alias("at"))
    right = s.filter("event_type = 'purchase'").select("user_id", F.col("start").alias("bought"), "value")
    out = I.as_of(left, right, ["user_id"], "at", "bought", ["value"], forward=True)
    return out.select("event_id", (F.col("matched_bought") - F.col("at")).alias("lag"), "matched_value", (F.col("matched_bought") - F.col("at") > 12 * HOUR).alias("late"))


def c12_backward_asof(spark, sf_dir):
    s = spans(spark, sf_dir)
    left = s.filter("event_type = 'purchase'").select("user_id", "event_id", F.col("start").alias("at"))
    right = s.filter("event_type = 'view'").select("user_id", F.col("start").alias("seen"), "value")
    return I.as_of(left, right, ["user_id"], "at", "seen", ["value"]).select("event_id", (F.col("at") - F.col("matched_seen")).alias("lag"), "matched_value")


def c13_clip_intersection(spark, sf_dir):
    """Views cut to the days that they touch, at most 2 hours of each."""
    s = spans(spark, sf_dir).filter("event_type = 'view'")
    days = s.withColumn("day", F.explode(F.sequence(F.floor(F.col("start") / DAY), F.floor((F.greatest("start", F.col("end") - 1)) / DAY))))
    lo, hi = F.greatest("start", F.col("day") * DAY), F.least("end", (F.col("day") + 1) * DAY)
    return days.select("event_id", "day", F.least(hi - lo, F.lit(2 * HOUR)).alias("kept"))


def c14_text_between(spark, sf_dir):
    """Types of the events within an hour before to 45 minutes after each purchase's start, in order."""
    s = spans(spark, sf_dir)
    left = s.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"), (F.col("start") - HOUR).alias("l_start"), (F.col("start") + 45 * MINUTE).alias("l_end"))
    right = s.select("user_id", "event_id", "event_type", F.col("start").alias("r_start"), (F.col("start") + 1).alias("r_end"))
    near = I.overlap_join(left, right, ["user_id"], 6 * HOUR)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r_start", "event_id", "event_type"))), lambda x: x["event_type"]), " ")
    return near.groupBy("purchase_id").agg(text.alias("types"))


def c22_tolerance_anti(spark, sf_dir):
    s = spans(spark, sf_dir)
    left = s.filter("event_type = 'view'").select("user_id", "event_id", F.col("start").alias("at"))
    right = s.filter("event_type = 'click'").select("user_id", F.col("start").alias("r_at"))
    return I.within_tolerance(left, right, ["user_id"], 2 * HOUR, anti=True).select("event_id")


def c26_nearest(spark, sf_dir):
    """The purchase nearest in time to each error of a user, earlier one on a tie."""
    s = spans(spark, sf_dir)
    left = s.filter("event_type = 'error'").select("user_id", "event_id", F.col("start").alias("at"))
    right = s.filter("event_type = 'purchase'").select("user_id", F.col("start").alias("p_at"))
    back = I.as_of(left, right, ["user_id"], "at", "p_at", []).select("event_id", "user_id", "at", F.col("matched_p_at").alias("b"))
    both = I.as_of(back, right, ["user_id"], "at", "p_at", [], forward=True)
    near = F.when(F.col("matched_p_at").isNull() | (F.col("at") - F.col("b") <= F.col("matched_p_at") - F.col("at")), F.col("b")).otherwise(F.col("matched_p_at"))
    return both.select("event_id", F.abs(near - F.col("at")).alias("distance"))


def e09_merged_spans(spark, sf_dir):
    return I.islands(spans(spark, sf_dir), ["user_id"]).select("user_id", "start", "end")


def e24_failed_ranges(spark, sf_dir):
    """An hour around each error of low value, united per user."""
    s = spans(spark, sf_dir).filter("event_type = 'error' AND value < 20")
    wide = s.select("user_id", (F.col("start") - HOUR).alias("start"), (F.col("start") + HOUR).alias("end"))
    return I.islands(wide, ["user_id"]).select("user_id", "start", "end")


_ISLANDS = """, r AS (SELECT *, max("end") OVER (PARTITION BY user_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
    FROM {src} WHERE "end" > "start"),
  g AS (SELECT *, sum(CASE WHEN reach IS NULL OR "start" > reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS island FROM r),
  i AS (SELECT user_id, island, min("start") AS "start", max("end") AS "end" FROM g GROUP BY user_id, island)
"""
_POINT = """SELECT e.event_id, (SELECT v.event_id FROM s v WHERE v.event_type = 'view' AND v.user_id = e.user_id AND e."start" >= v."start" - 1000
    AND e."start" < v."end" + 1000 + {closed} ORDER BY v."start", v.event_id LIMIT 1) AS view_id FROM s e WHERE e.event_type = 'error'"""

QUERIES = {
    f.__name__: f
    for f in (
        d03_union_seconds, c04_overlap_join, c05_best_overlap, c06_dominant, c07_point_lookup, c08_point_inner, c09_midpoint_lookup, c10_closed_lookup,
        c11_forward_asof, c12_backward_asof, c13_clip_intersection, c14_text_between, c22_tolerance_anti, c26_nearest, e09_merged_spans, e24_failed_ranges,
    )
}
ORACLE = {
    "d03_union_seconds": SPANS + _ISLANDS.format(src="s") + 'SELECT user_id, CAST(sum("end" - "start") AS BIGINT) AS covered FROM i GROUP BY user_id',
    "e09_merged_spans": SPANS + _ISLANDS.format(src="s") + 'SELECT user_id, "start", "end" FROM i',
    "e24_failed_ranges": SPANS + """, w AS (SELECT user_id, "start" - 3600000000 AS "start", "start" + 3600000000 AS "end" FROM s WHERE event_type = 'error' AND value < 20)"""
    + _ISLANDS.format(src="w") + 'SELECT user_id, "start", "end" FROM i',
    "c04_overlap_join": SPANS + """SELECT v.event_id AS view_id, c.event_id AS click_id, least(v."end", c."end") - greatest(v."start", c."start") AS shared
        FROM s v JOIN s c ON v.user_id = c.user_id AND v.event_type = 'view' AND c.event_type = 'click'
        WHERE least(v."end", c."end") - greatest(v."start", c."start") > 60000000""",
    "c05_best_overlap": SPANS + """SELECT purchase_id, other_id, shared FROM (
        SELECT v.event_id AS purchase_id, c.event_id AS other_id, least(v."end", c."end") - greatest(v."start", c."start") AS shared,
               row_number() OVER (PARTITION BY v.event_id ORDER BY least(v."end", c."end") - greatest(v."start", c."start") DESC, c.event_id) AS n
        FROM s v JOIN s c ON v.user_id = c.user_id AND v.event_type = 'purchase' AND c.event_type <> 'purchase'
        WHERE least(v."end", c."end") > greatest(v."start", c."start")) WHERE n = 1""",
    "c06_dominant": SPANS + """, m AS (SELECT s.user_id, s.event_id, s.event_type, floor(e.value) AS importance, "start" // 60000000 * 60000000 AS a, "end" // 60000000 * 60000000 AS b FROM s JOIN events e ON e.event_id = s.event_id)
        SELECT purchase_id, other_id, shared FROM (SELECT v.event_id AS purchase_id, c.event_id AS other_id, least(v.b, c.b) - greatest(v.a, c.a) AS shared,
          row_number() OVER (PARTITION BY v.event_id ORDER BY least(v.b, c.b) - greatest(v.a, c.a) DESC, c.importance DESC, c.a, c.event_id) AS n
        FROM m v JOIN m c ON v.user_id = c.user_id AND v.event_type = 'purchase' AND c.event_type <> 'purchase' WHERE least(v.b, c.b) > greatest(v.a, c.a)) WHERE n = 1""",
    "c07_point_lookup": SPANS + ", p AS (" + _POINT.format(closed=0) + """), l AS (SELECT user_id, arg_max(event_id, ("start", event_id)) AS last_view FROM s WHERE event_type = 'view' GROUP BY user_id)
        SELECT p.event_id, coalesce(p.view_id, l.last_view) AS view_id, p.view_id IS NOT NULL AS inside FROM p JOIN s USING (event_id) LEFT JOIN l USING (user_id)""",
    "c08_point_inner": SPANS + "SELECT * FROM (" + _POINT.format(closed=0) + ") WHERE view_id IS NOT NULL",
    "c10_closed_lookup": SPANS + _POINT.format(closed=1),
    "c09_midpoint_lookup": SPANS + """, p AS (SELECT event_id, user_id, ("start" + "end") // 2 AS at FROM s WHERE event_type = 'signup')
        SELECT event_id, coalesce(
          (SELECT v.event_id FROM s v WHERE v.event_type = 'view' AND v.user_id = p.user_id AND p.at >= v."start" AND p.at < v."end" ORDER BY v."start", v.event_id LIMIT 1),
          (SELECT v.event_id FROM s v WHERE v.event_type = 'click' AND v.user_id = p.user_id AND p.at >= v."start" AND p.at < v."end" ORDER BY v."start", v.event_id LIMIT 1)) AS holder FROM p""",
    "c11_forward_asof": SPANS + """SELECT e.event_id, p."start" - e."start" AS lag, p.value AS matched_value, p."start" - e."start" > 43200000000 AS late
        FROM (SELECT * FROM s WHERE event_type = 'signup') e LEFT JOIN LATERAL
        (SELECT * FROM s p WHERE p.event_type = 'purchase' AND p.user_id = e.user_id AND p."start" >= e."start" ORDER BY p."start", p.value LIMIT 1) p ON true""",
    "c12_backward_asof": SPANS + """SELECT e.event_id, e."start" - p."start" AS lag, p.value AS matched_value
        FROM (SELECT * FROM s WHERE event_type = 'purchase') e LEFT JOIN LATERAL
        (SELECT * FROM s p WHERE p.event_type = 'view' AND p.user_id = e.user_id AND p."start" <= e."start" ORDER BY p."start" DESC, p.value DESC LIMIT 1) p ON true""",
    "c13_clip_intersection": SPANS + """, d AS (SELECT *, unnest(generate_series("start" // 86400000000, greatest("start", "end" - 1) // 86400000000)) AS day FROM s WHERE event_type = 'view')
        SELECT event_id, day, least(least("end", (day + 1) * 86400000000) - greatest("start", day * 86400000000), 7200000000) AS kept FROM d""",
    "c14_text_between": SPANS + """SELECT p.event_id AS purchase_id, string_agg(e.event_type, ' ' ORDER BY e."start", e.event_id) AS types FROM s p JOIN s e ON p.user_id = e.user_id
        AND p.event_type = 'purchase' AND e."start" < p."start" + 2700000000 AND e."start" >= p."start" - 3600000000 GROUP BY p.event_id""",
    "c22_tolerance_anti": SPANS + """SELECT event_id FROM s v WHERE event_type = 'view' AND NOT EXISTS
        (SELECT 1 FROM s c WHERE c.event_type = 'click' AND c.user_id = v.user_id AND abs(c."start" - v."start") < 7200000000)""",
    "c26_nearest": SPANS + """SELECT e.event_id, min(abs(p."start" - e."start")) AS distance FROM s e LEFT JOIN s p ON p.user_id = e.user_id AND p.event_type = 'purchase'
        WHERE e.event_type = 'error' GROUP BY e.event_id""",
}
