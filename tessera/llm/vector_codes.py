"""Compression of vectors to codes: product quantisation by Lloyd's rounds over distinct parts.

Vectors of whole numbers are cut into parts. The equal parts of a position are one weighted row, so copies cost nothing
and sums stay exact. A round assigns each distinct part to the nearest entry of its position's codebook and sums
parts by entry in the tasks; only the sums, entries x positions rows, come to the driver, which divides them. In the end codes
and errors of the distinct parts are joined back to the vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut
from tessera.llm.vectors import FLOAT_EXACT, LONG_EXACT, dimension, exact, largest, matrix, whole_vectors

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Parts whose distances to all entries are held at once.
BLOCK = 4096
#: Keys with more rows than this and than a thousandth of all are joined apart from the others: at most 1000 are.
HOT_ROWS = 1000


@dataclass
class Codebooks:
    """entries[part] is a matrix of whole numbers, one row an entry."""

    entries: list[np.ndarray]

    def flat(self) -> list[int]:
        """All components by part, entry and position."""
        return [int(v) for book in self.entries for v in book.ravel()]


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x its nearest row of ``book`` (the lowest of equals) and the squared distance, all exact."""
    code, error = np.zeros(len(x), np.int64), []
    top = max(largest(x), largest(book))
    bound = 4 * x.shape[1] * top * top
    kind = np.float64 if bound < FLOAT_EXACT else np.int64 if bound < LONG_EXACT else object
    b = book.astype(kind)
    square = (b * b).sum(axis=1)
    for at in range(0, len(x), BLOCK):
        a = x[at : at + BLOCK].astype(kind)
        away = square - 2 * (a @ b.T)
        one = np.argmin(away, axis=1) if kind is not object else np.array([min(range(len(b)), key=row.__getitem__) for row in away])
        code[at : at + BLOCK] = one
        error += [int(v) for v in away[np.arange(len(a)), one] + (a * a).sum(axis=1)]
    return code, np.array(error, dtype=np.int64 if bound < LONG_EXACT else object)


SUMS = "part int, entry int, n long, sums array<decimal(38,0)>"
CODES = "part int, v array<long>, n long, code int, error decimal(38,0)"


def lloyd_round(parts: DataFrame, books: Codebooks) -> Codebooks:
    """Assigns the distinct parts (part, v, n) and moves each entry to the floor of its parts' mean; unused ones stay."""
    shared = parts.sparkSession.sparkContext.broadcast(books)
    width = books.entries[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        count = [np.zeros(len(b), object) for b in held.entries]
        total = [np.zeros(b.shape, object) for b in held.entries]
        for batch in batches:
            part, n = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            x = matrix(batch.column(1), width)
            for p in np.unique(part):
                some = part == p
                code, weight = nearest(x[some], held.entries[p])[0], n[some]
                order = np.argsort(code, kind="stable")
                used, first = np.unique(code[order], return_index=True)
                v = exact(x[some][order], largest(x) * int(weight.sum()))
                total[p][used] += np.add.reduceat(v * weight[order, None], first, axis=0).astype(object)
                count[p][used] += np.add.reduceat(weight[order], first).astype(object)
        rows = [(p, e, int(count[p][e]), [Decimal(int(v)) for v in total[p][e]]) for p in range(len(count)) for e in np.flatnonzero(count[p])]
        columns = list(zip(*rows)) or [[], [], [], []]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.decimal128(38, 0)))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["part", "entry", "n", "sums"])

    sums = parts.mapInArrow(run, SUMS).groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)])
    out = [b.copy() for b in books.entries]
    for r in sums.collect():  # a row for each entry of each position at most
        out[r["part"]][r["entry"]] = [int(r[f"s{i}"]) // r["n"] for i in range(width)]
    return Codebooks(out)


def coded(parts: DataFrame, books: Codebooks) -> DataFrame:
    """The distinct parts with code and error."""
    shared = parts.sparkSession.sparkContext.broadcast(books)
    width = books.entries[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, x = batch.column(0).to_numpy(), matrix(batch.column(1), width)
            code, error = np.zeros(len(x), np.int32), np.zeros(len(x), object)
            for p in np.unique(part):
                code[part == p], error[part == p] = nearest(x[part == p], shared.value.entries[p])
            errors = pa.array([Decimal(int(e)) for e in error], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code), errors], names=["part", "v", "n", "code", "error"])

    return parts.mapInArrow(run, CODES)


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """The rows joined with ``table``, one row a key, whose column ``size`` says how many of ``total`` rows have the key.

    Keys with many rows are at most 1000 and sent to all tasks; so the rows of a hot key are not moved. Null keys are equal.
    """
    hot = F.col(size) > max(HOT_ROWS, total // 1000)
    named = table.withColumnsRenamed({k: f"{k}__" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"{k}__")) for k in keys]
    rest = [f"{k}__" for k in keys]
    many = rows.join(F.broadcast(named.filter(hot)), same).drop(*rest, size)
    few = rows.join(F.broadcast(named.filter(hot).select(*rest)), same, "left_anti").join(named.filter(~hot).hint("merge"), same)
    return many.unionByName(few.drop(*rest, size))


def compress(df: DataFrame, column: str = "embedding", order: str = "vec_id", label: str = "label", scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """The rows with a usable vector, with codes (array), error and label_error; and the codebooks.

    A vector is made of whole numbers, floor(scale * c) of its entries c, and cut into ``parts`` equal parts. The codebooks begin as
    the parts of the first ``entries`` rows by ``order`` (nulls last, then by vector; fewer rows: fewer entries). Nearest is by squared distance, the lowest
    index of equals. ``label_error`` is the error summed over the rows of equal labels, nulls being equal.

    Vectors that are null, hold null or numbers that are not finite, or are of another length than most, are dropped;
    repeated rows all stay, each with its codes. An empty table gives an empty one and no codebooks. A length that cannot be cut
    into equal parts raises ValueError. Other columns stay; those of the names above are replaced.
    """
    rows = whole_vectors(df.drop("codes", "error", "label_error"), column, scale, "x__")
    rows = cut(rows.withColumn("row__", F.monotonically_increasing_id()), "vectors")  # written, so the ids stay
    d = dimension(rows, "x__")
    if d % parts:
        raise ValueError(f"vectors of {d} entries cannot be cut into {parts} equal parts")
    width, own = d // parts, [c for c in rows.columns if c not in ("x__", "row__")]
    if not d:
        empty = rows.filter("false").select(*own, F.array().cast("array<int>").alias("codes"), F.lit(0).cast("decimal(38,0)").alias("error"), F.lit(0).cast("decimal(38,0)").alias("label_error"))
        return empty, Codebooks([])
    rows = rows.filter(F.size("x__") == d)
    first = rows.orderBy(F.col(order).asc_nulls_last(), "x__").limit(entries).select("x__").collect()  # the codebooks' size
    start = np.array([r["x__"] for r in first], np.int64)
    books = Codebooks([start[:, p * width : (p + 1) * width] for p in range(parts)])

    cuts = F.posexplode(F.array(*[F.slice("x__", 1 + p * width, width) for p in range(parts)])).alias("part", "v")
    pieces = rows.select("row__", cuts)
    distinct = cut(pieces.groupBy("part", "v").agg(F.count(F.lit(1)).alias("n")), "distinct_parts")
    for _ in range(rounds):
        books = lloyd_round(distinct, books)
    table = cut(coded(distinct, books), "coded_parts")

    total = rows.count()
    found = looked_up(pieces, table, ["part", "v"], "n", parts * total).groupBy("row__")
    found = found.agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "code"))), lambda s: s["code"]).alias("codes"), F.sum("error").cast("decimal(38,0)").alias("error"))
    scored = cut(rows.drop("x__").join(found, "row__").drop("row__"), "scored")
    labels = cut(scored.groupBy(label).agg(F.sum("error").cast("decimal(38,0)").alias("label_error"), F.count(F.lit(1)).alias("n__")), "labels")
    return looked_up(scored, labels, [label], "n__", total).select(*own, "codes", "error", "label_error"), books
