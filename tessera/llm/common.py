"""Helpers shared by the corpus operators: word splitting, durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.arrays import sliced

#: ASCII white space; everything else belongs to words.
SPACE = "[\\x20\\x09-\\x0D]+"
_tables: ContextVar[list[str] | None] = ContextVar("tables", default=None)
#: Rows of an Arrow batch while a working table is written.
BATCH_SIZE, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
SPACES = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """The words of a text as an array; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once a row, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local master (tests) uses a folder of this machine; on a cluster a ValueError is raised.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder and sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        folder = f"file://{tempfile.gettempdir()}/tessera-{sc.applicationId}"
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder.rstrip("/")


@contextmanager
def tracked(tables: list[str]) -> Iterator[None]:
    """Notes in ``tables`` the paths of the working tables that ``cut`` writes meanwhile, for ``release``."""
    before = _tables.set(tables)
    try:
        yield
    finally:
        _tables.reset(before)


@contextmanager
def _batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of ``rows`` rows meanwhile, unless the session sets a size of its own."""
    if BATCH_SIZE in spark.conf.getAll:
        yield
        return
    spark.conf.set(BATCH_SIZE, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(BATCH_SIZE)


def cut(df: DataFrame, name: str, batch: int = BATCH_ROWS) -> DataFrame:
    """Writes the rows as a table in the shared folder and reads them back.

    The result has no lineage, survives lost executors and is computed once. Tables stay until
    their folder is removed or ``release`` deletes them, as the caller's DataFrame reads them lazily. ``batch`` rows
    go to a Python worker at once: few by default, as rows may be whole texts.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tessera/{uuid.uuid4().hex}/{name}"
    with _batches(spark, batch):
        df.write.option("compression", "zstd").parquet(path)
    tables = _tables.get()
    if tables is not None:
        tables.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, tables: list[str], keep: DataFrame | None = None) -> None:
    """Deletes the listed working tables, but for those that ``keep`` reads; other runs' tables are not in the list."""
    needed = keep.inputFiles() if keep is not None else []
    for path in list(tables):
        name = path.split("/tessera/", 1)[1]
        if not any(name in f for f in needed):
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
            tables.remove(path)


#: Bits of a filter for each key and at most: 16 MB. A fuller filter lets more rows pass, never fewer.
FILTER_BITS, MAX_FILTER_BITS = 12, 1 << 27


class KeyFilter:
    """A Bloom filter of a column of hashed longs, sent to all tasks: says which rows a join with them may keep.

    It only saves shuffled rows before that join; its size is bounded whatever the number of keys.
    """

    def __init__(self, keys: DataFrame, column: str):
        n = keys.count()
        size = 1 << max(16, min(MAX_FILTER_BITS, FILTER_BITS * n).bit_length() - 1)
        bit = F.explode(F.array(F.pmod(F.col(column), F.lit(size)), F.pmod(F.shiftright(column, 32), F.lit(size)))).alias("bit")
        longs = keys.select(bit).groupBy(F.shiftright("bit", 6).cast("int").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits"))
        table, found = np.zeros(size >> 6, np.int64), longs.toArrow()  # at most MAX_FILTER_BITS / 64 rows
        table[found["at"].to_numpy()] = found["bits"].to_numpy()
        self._table = keys.sparkSession.sparkContext.broadcast(table.view(np.uint64))

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        """For each key (64 bits, signed or not) whether it may be in the column."""
        table, x = self._table.value, keys.view(np.int64)
        size = len(table) << 6
        out = np.ones(len(x), bool)
        for v in (x % size, (x >> 32) % size):
            out &= (table[v >> 6] >> (v & 63).astype(np.uint64)) & np.uint64(1) > 0
        return out


#: Buckets that are summed as one row.
CHUNK = 4096


def count_rows(counts: np.ndarray) -> list[bytes]:
    """Counts of buckets in rows of CHUNK, for ``summed_counts``."""
    return [counts[a : a + CHUNK].astype(np.int32).tobytes() for a in range(0, len(counts), CHUNK)]


def summed_counts(rows: DataFrame, buckets: int) -> np.ndarray:
    """Sums of the rows (chunk, counts) that tasks made by ``count_rows``: other tasks add them up as they come."""

    def add(batches):
        out: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                more = np.frombuffer(counts, np.int32).astype(np.int64) if len(counts) == 4 * CHUNK else np.frombuffer(counts, np.int64)
                out[chunk] = out.get(chunk, 0) + more
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array([v.tobytes() for v in out.values()], pa.binary())], names=["chunk", "counts"])

    found = rows.repartition("chunk").mapInArrow(add, "chunk int, counts binary").toArrow()
    table = np.zeros((buckets // CHUNK, CHUNK), np.int64)
    for chunk, counts in zip(found["chunk"].to_pylist(), found["counts"].to_pylist()):
        table[chunk] += np.frombuffer(counts, np.int64)
    return table.ravel()


def bucket_counts(docs: DataFrame, hashes, buckets: int) -> np.ndarray:
    """How often each of ``buckets`` hash buckets occurs in all texts; ``hashes`` gives the hashes of a list of texts."""

    def count(batches):
        out = np.zeros(buckets, np.int32)
        for _, texts in sliced(batches):
            out += np.bincount((hashes(texts) % np.uint64(buckets)).astype(np.int64), minlength=buckets).astype(np.int32)
        rows = count_rows(out)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.binary())], names=["chunk", "counts"])

    return summed_counts(docs.select("text").mapInArrow(count, "chunk int, counts binary"), buckets)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
