from pyspark.sql import functions as F

from tessera.plans import QUERIES
from tessera.session import table
from tessera.sources import journal
from tessera.streaming import jobs


def test_token_bucket_equals_a_plain_loop(spark, sf_dir):
    got = {r.event_id: r.verdict for r in QUERIES["i03_token_bucket"](spark, sf_dir).collect()}
    state, want = {}, {}
    for r in table(spark, sf_dir, "events").orderBy("ts", "event_id").collect():
        at = (r.ts - __import__("datetime").datetime(1970, 1, 1)).total_seconds()
        tokens, last, refused, shut = state.get((r.user_id, r.event_type), (2.0, at, 0, 0.0))
        tokens = min(2.0, tokens + (at - last) / 172_800)
        want[r.event_id] = "open" if at < shut else "allowed" if tokens >= 1 else "limited"
        if want[r.event_id] == "allowed":
            tokens, refused = tokens - 1, refused + 1 if r.value > 30 else 0
            if refused == 3:
                refused, shut = 0, at + 864_000
        state[r.user_id, r.event_type] = (tokens, at, refused, shut)
    assert got == want


def test_breaker_holds_calls_back(spark, tmp_path):
    rows = [("k", i, float(i), i < 3) for i in range(5)] + [("k", 9, 100.0, False)]
    spark.createDataFrame(rows, "k string, event_id long, at double, refused boolean").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k string, event_id long, at double, refused boolean").parquet(f"{tmp_path}/in")
    got = {r.event_id: r.verdict for r in jobs.drain(jobs.token_bucket(stream, "k", 1.0, 9.0, 3, 60.0), f"{tmp_path}/out").collect()}
    assert got == {0: "allowed", 1: "allowed", 2: "allowed", 3: "open", 4: "open", 9: "allowed"}


def test_journal_skips_broken_lines_and_resumes(spark, tmp_path):
    folder, out = f"file://{tmp_path}/j", f"file://{tmp_path}/o"
    make = lambda a, b: spark.range(a, b).select(F.col("id").alias("seq"), F.lit("t").alias("at"), F.lit("s").alias("stage"), F.lit("e").alias("event"), F.lit("INFO").alias("level"), F.lit("{}").alias("payload"))
    journal.append(make(0, 5), folder)
    (tmp_path / "j" / "broken.json").write_text("{not json\n")
    assert sorted(r.seq for r in journal.read(spark, folder, after=1).collect()) == [2, 3, 4]
    assert jobs.drain(journal.tail(spark, folder), out).count() == 5
    journal.append(make(5, 9), folder)
    assert sorted(r.seq for r in jobs.drain(journal.tail(spark, folder), out).collect()) == list(range(9))
