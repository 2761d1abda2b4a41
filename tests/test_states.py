"""Checked states over batches of a stream."""

import pytest
from pyspark.sql import functions as F

from tessera.streaming import jobs, states

LEGAL = [("queued", "running"), ("running", "done"), ("running", "failed"), ("failed", "running")]


@pytest.fixture
def feed(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", states.STORE)

    def run(rows):
        """Adds a batch of (job, second, event) and returns the rows that this run put out."""
        have = set(map(tuple, spark.read.parquet(f"{tmp_path}/out/rows").collect())) if (tmp_path / "out" / "rows").exists() else set()
        df = spark.createDataFrame(rows, "job long, s long, event string").select("job", F.timestamp_seconds("s").alias("time"), "event")
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("job long, time timestamp, event string").parquet(f"{tmp_path}/in")
        out = jobs.drain(states.checked_states(stream, "job", LEGAL, "0 seconds", "failed", 30, 100), f"{tmp_path}/out")
        new = [r for r in out.withColumn("s", F.unix_timestamp("time")).collect() if tuple(r)[:-1] not in have]
        return sorted(((r.job, r.s, r.event, r.verdict, r.state) for r in new), key=lambda r: (r[0], r[1], str(r[2])))

    yield run
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_illegal_steps_are_refused_across_batches(feed):
    assert feed([(1, 10, "running"), (1, 5, "queued"), (2, 6, "queued")]) == [(1, 5, "queued", "accepted", "queued"), (1, 10, "running", "accepted", "running"), (2, 6, "queued", "accepted", "queued")]
    got = feed([(1, 20, "queued"), (1, 21, "done"), (2, 22, "done"), (2, 23, "running")])
    assert got == [(1, 20, "queued", "refused", "running"), (1, 21, "done", "accepted", "done"), (2, 22, "done", "refused", "queued"), (2, 23, "running", "accepted", "running")]


def test_a_pause_ends_by_its_timer_and_idle_keys_leave(feed):
    feed([(1, 1, "failed"), (2, 1, "running")])
    assert feed([(1, 5, "running"), (2, 6, "done")]) == [(1, 5, "running", "held", "failed"), (2, 6, "done", "accepted", "done")]
    # time goes on by another job's step: the pause of 30 seconds is over
    assert (1, 31, None, "resumed", "failed") in feed([(2, 50, "done")])
    assert feed([(1, 60, "running")])[-1] == (1, 60, "running", "accepted", "running")
    # a hundred seconds later both are gone, and begin anew
    got = feed([(3, 400, "queued")])
    assert [(r[0], r[3]) for r in got] == [(1, "left"), (2, "left"), (3, "accepted")]
    assert feed([(1, 401, "done")]) == [(1, 401, "done", "accepted", "done")]


def test_a_pause_that_is_over_within_a_batch(feed):
    got = feed([(1, 1, "running"), (1, 2, "failed"), (1, 3, "running"), (1, 40, "running")])
    assert [(s, v) for _, s, _, v, _ in got] == [(1, "accepted"), (2, "accepted"), (3, "held"), (32, "resumed"), (40, "accepted")]
