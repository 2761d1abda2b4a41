"""Streams: draining a journal, dropping repeats, windows with a watermark, one writer with a goal, a token bucket per key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def drain(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now, to Parquet, and returns that; started again it goes on from its checkpoint."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{folder}/_state").trigger(availableNow=True).start(f"{folder}/rows")
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def once(stream: DataFrame, key: str, at: str, horizon: str) -> DataFrame:
    """Drops repeats of a key within ``horizon`` of event time; older state is let go."""
    return stream.withWatermark(at, horizon).dropDuplicatesWithinWatermark([key])


def windows(stream: DataFrame, at: str, width: str, late: str, by: list[str]) -> DataFrame:
    """Counts and sums per tumbling window; rows later than ``late`` are left out."""
    rows = stream.withWatermark(at, late).groupBy(F.window(at, width), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("window.start").alias("w_start"), *by, "n", "total")


def topped_up(stream: DataFrame, folder: str, key: list[str], group: str, target: int) -> DataFrame:
    """Runs a stream of candidates through one writer: each batch adds the keys that the store lacks, for groups that have
    fewer than ``target`` rows so far; returns the store. Started again it goes on; a batch that is run twice adds nothing.
    """
    spark, store = stream.sparkSession, f"{folder}/store"
    spark.createDataFrame([], stream.schema).write.mode("append").parquet(store)

    def ingest(batch: DataFrame, _: int) -> None:
        have = spark.read.schema(stream.schema).parquet(store)
        full = have.groupBy(group).count().filter(F.col("count") >= target).select(group)
        new = batch.dropDuplicates(key).join(full, group, "left_anti").join(have.select(*key), key, "left_anti")
        new.select(*stream.columns).write.mode("append").parquet(store)

    query = stream.writeStream.foreachBatch(ingest).option("checkpointLocation", f"{folder}/_state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(store)


#: Groups of keys of a token bucket; a group's keys share one call of Python and one entry of the state store.
SHARES = 4096


def token_bucket(stream: DataFrame, key: str, rate: float, burst: float, most: int = 3, pause: float = 60.0) -> DataFrame:
    """Whether each call (key, event_id, at in seconds, refused by the other side) is let through: allowed, limited or open.

    A token bucket per key, and a breaker: after ``most`` refused calls in a row that were let through, all calls are held
    back for ``pause`` seconds; one that is accepted counts anew. State: tokens, time of the last refill, refusals in a row,
    end of the pause. Calls of one batch are taken in order of time.

    A call of Python for each key costs milliseconds, more than the work on its calls, so keys are dealt to SHARES groups by hash; the state of a
    group holds that of its keys as arrays. A group's calls of a batch are one task's, so keys should be narrow (a user and a type, not a type).
    """

    def step(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {k: s for k, *s in zip(*state.get)} if state.exists else {}
        calls = pd.concat(parts).sort_values(["at", "event_id"])
        keys, verdicts = [None if pd.isna(k) else k for k in calls[key].tolist()], []
        for k, at, no in zip(keys, calls["at"].tolist(), calls["refused"].tolist()):
            if (own := held.get(k)) is None:
                own = held[k] = [burst, at, 0, 0.0]
            tokens, last, refused, shut = own
            tokens = min(burst, tokens + max(0.0, at - last) * rate)
            verdict = "open" if at < shut else "allowed" if tokens >= 1.0 else "limited"
            if verdict == "allowed":
                tokens -= 1.0
                refused = refused + 1 if no else 0
                if refused >= most:
                    refused, shut = 0, at + pause
            own[:] = float(tokens), float(max(last, at)), int(refused), float(shut)
            verdicts.append(verdict)
        state.update(([*held], *([s[i] for s in held.values()] for i in range(4))))
        yield pd.DataFrame({key: keys, "event_id": calls["event_id"].to_numpy(), "verdict": verdicts})

    kind = stream.schema[key].dataType.simpleString()
    share = F.when(F.col(key).isNotNull(), F.pmod(F.xxhash64(key), F.lit(SHARES))).otherwise(-1)  # pandas would make numbers beside a null inexact
    return stream.withColumn("share_", share).groupBy("share_").applyInPandasWithState(
        step, f"{key} {kind}, event_id long, verdict string", f"keys array<{kind}>, tokens array<double>, last array<double>, refused array<int>, shut array<double>", "append", GroupStateTimeout.NoTimeout
    )
