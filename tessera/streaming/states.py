"""Checked states of keys over a stream, with pauses that end and idle keys that leave, by timers of event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Timers and typed states need this store.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "state string, attempts long, refused long, until long, last long"


def millis(at: pd.Timestamp) -> int:
    return at.value // 1_000_000


class Checked(StatefulProcessor):
    """Takes a key's steps in order of time: a legal one becomes its state, others are refused and counted."""

    def __init__(self, key: str, legal: list[tuple[str, str]], pause_on: str | None, pause: int, idle: int):
        self.key, self.legal, self.pause_on, self.pause, self.idle = key, set(legal), pause_on, pause, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("checked", STATE)

    def rows(self, key: tuple, found: list[tuple]) -> pd.DataFrame:
        at, event, verdict, state, attempts = zip(*found)
        stamps = pd.to_datetime(pd.Series(at), unit="ms")
        return pd.DataFrame({self.key: [key[0]] * len(found), "time": stamps, "event": event, "verdict": verdict, "state": state, "attempts": attempts})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state, attempts, refused, until, last = self.held.get() if self.held.exists() else (None, 0, 0, 0, 0)
        out: list[tuple] = []
        steps = pd.concat(rows).sort_values(["time", "event"])
        for at, event in zip(steps["time"].map(millis), steps["event"]):
            if until and at >= until:  # the pause is over before its timer came
                self.handle.deleteTimer(until)
                out.append((until, None, "resumed", state, attempts))
                until = 0
            attempts += 1
            if until:
                verdict = "held"
            elif state is None or (state, event) in self.legal:
                verdict, state = "accepted", event
                if event == self.pause_on:
                    until = at + self.pause
                    self.handle.registerTimer(until)
            else:
                verdict, refused = "refused", refused + 1
            last = max(last, at)
            out.append((at, event, verdict, state, attempts))
        self.handle.registerTimer(last + self.idle)
        self.held.update((state, attempts, refused, until, last))
        yield self.rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if not self.held.exists():
            return
        due = expiredTimerInfo.getExpiryTimeInMs()
        state, attempts, refused, until, last = self.held.get()
        if until and due >= until:
            self.held.update((state, attempts, refused, 0, last))
            yield self.rows(key, [(until, None, "resumed", state, attempts)])
        if due >= last + self.idle:  # not an older timer of a key that has had steps since
            self.held.clear()
            yield self.rows(key, [(due, None, "left", state, attempts)])

    def close(self) -> None:
        pass


def checked_states(stream: DataFrame, key: str, legal: list[tuple[str, str]], late: str, pause_on: str | None = None, pause: float = 60.0, idle: float = 86_400.0) -> DataFrame:
    """(key, time, event, verdict, state, attempts) for every step (key, time, event) of a stream: accepted, refused or held, and rows without an event when
    a pause ends (resumed) and when a key has had no step for ``idle`` seconds and its state is dropped (left).

    ``legal`` lists the steps from one state to the next; the first step of a key is always legal. A step to ``pause_on`` holds back the key's steps for ``pause``
    seconds. Steps of one batch are taken in order of time, one key's of a batch by one task; those later than ``late`` are
    dropped by the watermark. The session's state store must be STORE.
    """
    kind = stream.schema[key].dataType.simpleString()
    steps = stream.select(key, "time", "event").withWatermark("time", late)
    processor = Checked(key, legal, pause_on, int(pause * 1000), int(idle * 1000))
    return steps.groupBy(key).transformWithStateInPandas(processor, f"{key} {kind}, time timestamp, event string, verdict string, state string, attempts long", "Append", "EventTime")
