"""Edge cases of the relational operators: empty inputs, touching intervals, ties, nulls."""

import random

from pyspark.sql import functions as F

from tessera.functions import jsontext, scoring, text
from tessera.functions import time as T
from tessera.operators import intervals as I
from tessera.operators import keys as K
from tessera.operators import ranking as R
from tessera.operators import sequences as S


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


def test_union_length_merges_touching_and_drops_empty(spark):
    rows = [("a", 0, 5), ("a", 5, 9), ("a", 3, 4), ("a", 20, 20), ("b", 1, 2), ("c", 7, 7)]
    got = I.union_length(spark.createDataFrame(rows, "k string, start long, end long"), ["k"]).collect()
    assert {r.k: r.covered for r in got} == {"a": 9, "b": 1}


def test_overlap_join_equals_all_pairs(spark):
    rnd = random.Random(1)
    make = lambda n: [(i, rnd.randrange(2), s, s + rnd.randrange(60)) for i in range(n) for s in [rnd.randrange(-200, 200)]]
    a, b = make(60), make(60)
    left = spark.createDataFrame(a, "a long, k long, l_start long, l_end long")
    right = spark.createDataFrame(b, "b long, k long, r_start long, r_end long")
    got = sorted((r.a, r.b, r.lo, r.hi) for r in I.overlap_join(left, right, ["k"], 25).collect())
    want = sorted((i, j, max(s, u), min(e, v)) for i, k, s, e in a for j, m, u, v in b if k == m and min(e, v) > max(s, u))
    assert got == want


def test_as_of_takes_equal_times_and_keeps_misses(spark):
    left = spark.createDataFrame([(1, "k", 5), (2, "k", 1), (3, "z", 9)], "id long, k string, at long")
    right = spark.createDataFrame([("k", 5, 50), ("k", 5, 51), ("k", 2, 20), ("k", 8, 80)], "k string, r long, v long")
    back = {r.id: (r.matched_r, r.matched_v) for r in I.as_of(left, right, ["k"], "at", "r", ["v"]).collect()}
    ahead = {r.id: (r.matched_r, r.matched_v) for r in I.as_of(left, right, ["k"], "at", "r", ["v"], forward=True).collect()}
    assert back == {1: (5, 51), 2: (None, None), 3: (None, None)}
    assert ahead == {1: (5, 50), 2: (2, 20), 3: (None, None)}


def test_cascade_skips_rules_that_leave_nothing(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 5)], "k string, v long")
    got = R.cascade(df, ["k"], [F.col("v") > 1, F.col("v") > 9, F.col("v") < 3]).collect()
    assert sorted((r.k, r.v, r.kept_rules) for r in got) == [("a", 2, 2), ("b", 5, 1)]


def test_floor_or_best_and_even_sample(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 9.0), ("b", 2.0), ("b", 3.0)], "k string, v double")
    assert sorted((r.k, r.v) for r in R.floor_or_best(df, ["k"], "v", 5.0, 1, [F.desc("v")]).collect()) == [("a", 9.0), ("b", 3.0)]
    many = spark.range(100).select(F.lit(1).alias("k"), "id")
    assert sorted(r.id for r in R.even_sample(many, ["k"], ["id"], 4).collect()) == [0, 33, 66, 99]
    assert R.even_sample(many.limit(2), ["k"], ["id"], 4).count() == 2


def test_latest_wins_is_idempotent(spark):
    log = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (None, 9, "x")], "k long, version long, v string")
    once = K.latest_wins(log, ["k"], ["version"])
    again = K.latest_wins(log.unionByName(once), ["k"], ["version"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, again.collect())) == [(1, 2, "b"), (2, 1, "c")]


def test_runs_sessions_and_repeats_with_nulls(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(["x", "x", None, None, "y", "x"])], "k long, i long, v string")
    assert [r.run for r in S.run_ids(df, ["k"], ["i"], "v").orderBy("i").collect()] == [1, 1, 2, 2, 3, 4]
    assert [r.repeats for r in S.repeats_within(df, ["k"], ["i"], "v", 3).orderBy("i").collect()] == [False, True, False, False, False, False]
    times = spark.createDataFrame([(1, t) for t in (0, 5, 16, 16, 40)], "k long, t long")
    assert [r.session for r in S.gap_sessions(times, ["k"], "t", 10).orderBy("t").collect()] == [0, 0, 1, 1, 2]


def test_text_functions(spark):
    assert one(spark, text.plain, "  São-Paulo, ÉTÉ! 42 ") == "sao paulo ete 42"
    assert one(spark, text.slug, "Hello, Wörld -- again") == "hello-world-again"
    assert one(spark, text.redact, "http://h/a?api_key=abc&x=1") == "http://h/a?api_key=***&x=1"
    assert one(spark, text.url_title, "https://h.org/a/Blue_Whale-2.jpg?x=1") == "Blue Whale 2"
    assert one(spark, text.license_code, "CC BY-SA 4.0") == "cc-by-sa"
    assert one(spark, lambda x: text.truncate(x, 10), "one two three") == "one two th..."
    assert one(spark, text.sentences, "A b. C d!\nE") == ["A b.", "C d!", "E"]
    assert one(spark, lambda x: text.pack(text.sentences(x), 9), "A b. C d! Eeeeeeeeeeeee. F.") == ["A b. C d!", "Eeeeeeeeeeeee.", "F."]
    assert one(spark, lambda x: text.pack(text.sentences(x), 9), "") == []
    assert one(spark, text.strip_markup, "<p>a<!-- x --><script>1<2</script> &amp; b</p>") == "a & b"
    assert one(spark, lambda x: text.scrub(x, {"bad thing": "it"}), "A BAD thing here") == "A it here"


def test_time_json_and_scores(spark):
    assert one(spark, T.stamp, 3661.5, "double") == "01:01:01,500"
    assert one(spark, T.centi_stamp, 61.256, "double") == "0:01:01.26"
    assert one(spark, T.clock, 125.9, "double") == "2:05"
    assert one(spark, lambda x: jsontext.read_object(x, "a long").a, '```json {"a": 3} ``` done') == 3
    assert one(spark, lambda x: jsontext.object_text(x), "none") is None
    assert one(spark, lambda x: jsontext.redact_keys(x, ["token"]), '{"i":[{"Token": "s"}]}') == '{"i":[{"Token": "***"}]}'
    assert one(spark, lambda x: scoring.batch_count(x, F.lit(10.0), 5), 0.0, "double") == 0
    assert one(spark, lambda x: scoring.batch_count(x, F.lit(10.0), 5), 99.0, "double") == 5
    assert one(spark, scoring.percent, 72.0, "double") == 0.72
