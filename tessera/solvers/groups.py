"""Steps in order within groups: rows are shuffled by group, sorted, and stream through a Python function a group at a time.

A call of pandas for each group costs milliseconds, more than the work on a small group. Here a task's groups come one after
another in Arrow batches, and the function sees a group's columns as lists; a task holds one batch and one group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def in_groups(rows: DataFrame, group: str, order: list[str | Column], run: Callable[..., Iterable[tuple]], schema: str) -> DataFrame:
    """``run(key, *columns)`` for each ``group``, with lists of its other columns in ``order``; the tuples it gives are the rows of ``schema``."""
    names = [c for c in rows.columns if c != group]
    out = to_arrow_schema(StructType.fromDDL(schema))

    def batch(made: list[tuple]) -> pa.RecordBatch:
        columns = zip(*made) if made else [[]] * len(out)
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, out)], schema=out)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, begun = None, [[] for _ in names], False
        for b in batches:
            keys, *columns = (c.to_pylist() for c in b.columns)
            made: list[tuple] = []
            at = 0
            while at < len(keys):
                if begun and keys[at] != key:
                    made += run(key, *held)
                    held = [[] for _ in names]
                key, begun = keys[at], True
                end = at + 1
                while end < len(keys) and keys[end] == key:
                    end += 1
                for h, c in zip(held, columns):
                    h += c[at:end]
                at = end
            yield batch(made)
        if begun:
            yield batch(list(run(key, *held)))

    return rows.select(group, *names).repartition(group).sortWithinPartitions(group, *order).mapInArrow(step, schema)
