"""Exact k nearest neighbours of many queries: cells around pivots, pruned by the triangle inequality, joined in blocks.

Vectors are scaled to unit length, so that the order by cosine is that by distance. Each shot lies in the cell of its
nearest pivot. A query first meets its own cell, which bounds its k-th distance; after that it goes to a cell only if the
bound reaches it: at distance t from the pivot, shots nearer to the pivot than t - bound or farther than t + bound cannot be among the k. A
cell is dealt out in blocks of about BLOCK shots by QUERIES queries, so that no task holds a whole cell, hot or not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.vector import norm

#: Pivots at most, shots and queries of a block.
PIVOTS, BLOCK, QUERIES = 64, 20_000, 2_000
#: What rounding may add to a distance.
SLACK = 1e-7
FOUND = "query long, id long, distance double, pairs long"


def _matrix(column, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between unit rows."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def _unit(df: DataFrame, id_: str, vector: str) -> DataFrame:
    """(id, v): vectors of length 1; null ones and those of length 0 have no direction and are left out."""
    rows = df.select(F.col(id_).cast("long").alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    rows = rows.withColumn("n", norm(F.col("v"))).filter("id IS NOT NULL AND n > 0")
    return rows.select("id", F.transform("v", lambda x: x / F.col("n")).alias("v"))


def _dealt(rows: DataFrame, counts: dict[int, int], size: int, name: str) -> tuple[DataFrame, DataFrame]:
    """The rows with the number of their block in the cell, and the number of blocks of each cell."""
    spark = rows.sparkSession
    blocks = spark.createDataFrame([(c, -(-n // size)) for c, n in counts.items()], f"cell int, n_{name} int")  # a row for each pivot at most
    return rows.join(F.broadcast(blocks), "cell").withColumn(name, F.pmod(F.xxhash64("id"), F.col(f"n_{name}")).cast("int")).drop(f"n_{name}"), blocks


def _joined(queries: DataFrame, cells: DataFrame, sizes: dict[int, int], width: int, k: int) -> DataFrame:
    """The k nearest shots of each query (cell, id, v, bound, t) in the cell, as FOUND; rows without a query count the pairs computed."""
    asked = {r["cell"]: r["count"] for r in queries.groupBy("cell").count().collect()}
    left, q_blocks = _dealt(queries, asked, QUERIES, "qb")
    right, s_blocks = _dealt(cells, sizes, BLOCK, "sb")
    every = lambda df, other, name: df.join(F.broadcast(other), "cell").withColumn(name, F.explode(F.sequence(F.lit(0), F.col(f"n_{name}") - 1))).drop(f"n_{name}")
    key = ["cell", "qb", "sb"]

    def block(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if a.num_rows and b.num_rows:
            order = np.argsort(b["r"].to_numpy(), kind="stable")
            ids, r, shots = b["id"].to_numpy()[order], b["r"].to_numpy()[order], _matrix(b["v"], width)[order]
            pairs = 0
            for query, bound, t, v in zip(a["id"].to_pylist(), a["bound"].to_pylist(), a["t"].to_pylist(), _matrix(a["v"], width)):
                low, high = np.searchsorted(r, t - bound - SLACK), np.searchsorted(r, t + bound + SLACK, "right")
                pairs += int(high - low)
                d = _gaps(v[None, :], shots[low:high])[0]
                near = np.flatnonzero(d <= bound + SLACK)
                best = near[np.lexsort((ids[low:high][near], d[near]))[:k]]
                out += zip([query] * len(best), ids[low:high][best].tolist(), d[best].tolist(), [0] * len(best))
            out.append((None, None, None, pairs))
        columns = list(zip(*out)) or [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=["query", "id", "distance", "pairs"])

    return every(left, s_blocks, "sb").groupBy(*key).cogroup(every(right, q_blocks, "qb").groupBy(*key)).applyInArrow(block, FOUND)


def knn_join(queries: DataFrame, shots: DataFrame, id_: str, vector: str, k: int, folder: str, pivots: int = PIVOTS) -> tuple[DataFrame, DataFrame]:
    """(query, rank, id, cosine) of the k shots nearest to each query, itself included if it is one of them; equal cosines by id. And (pairs, all_pairs):
    how many cosines were computed, and how many there are.

    ``folder`` takes the working tables. Fewer than k shots give fewer rows; ids must be unique on each side, vectors of one length.
    """
    spark = shots.sparkSession

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    asked, unit = _unit(queries, id_, vector), _unit(shots, id_, vector)
    centres = np.array([r["v"] for r in unit.orderBy(F.xxhash64("id"), "id").limit(pivots).collect()])  # at most PIVOTS rows
    if not len(centres):
        return spark.createDataFrame([], "query long, rank int, id long, cosine double"), spark.createDataFrame([(0, 0)], "pairs long, all_pairs long")
    width = centres.shape[1]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gaps = _gaps(_matrix(b.column(1), width), centres)
            cell = gaps.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(gaps[np.arange(len(cell)), cell])], names=["id", "v", "cell", "r"])

    cells = kept(unit.mapInArrow(placed, "id long, v array<double>, cell int, r double"), "cells")
    stats = {r["cell"]: (r["n"], r["low"], r["high"]) for r in cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("low"), F.max("r").alias("high")).collect()}
    there = np.array(sorted(stats))  # cells with shots
    sizes = {c: n for c, (n, _, _) in stats.items()}
    low, high = (np.array([stats[c][i] for c in there]) for i in (1, 2))

    def routed(own: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                gaps = _gaps(_matrix(b.column(1), width), centres[there])
                bound = np.asarray(b.column(2))[:, None]
                home = gaps.argmin(axis=1)
                reach = (gaps - bound <= high + SLACK) & (gaps + bound >= low - SLACK)
                reach[np.arange(len(home)), home] = own
                if own:
                    reach = np.arange(len(there))[None, :] == home[:, None]
                row, cell = np.nonzero(reach)
                columns = [b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), b.column(2).take(pa.array(row)), pa.array(there[cell].astype(np.int32)), pa.array(gaps[row, cell])]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "v", "bound", "cell", "t"])

        return run

    routes = "id long, v array<double>, bound double, cell int, t double"
    start = asked.withColumn("bound", F.lit(4.0))
    first = kept(_joined(start.mapInArrow(routed(True), routes), cells, sizes, width, k), "first")
    nearest = lambda rows: rows.filter("query IS NOT NULL").groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "id"))), 1, k).alias("near"))
    bounds = nearest(first).select(F.col("query").alias("id"), F.when(F.size("near") == k, F.get("near", F.lit(k - 1))["distance"]).otherwise(4.0).alias("bound"))
    rest = kept(asked.join(bounds, "id").select("id", "v", "bound").mapInArrow(routed(False), routes), "routes")
    second = kept(_joined(rest, cells, sizes, width, k), "second")
    both = first.unionByName(second)
    out = nearest(both).select("query", F.posexplode("near").alias("at", "n"))
    cosine = 1 - F.col("n.distance") * F.col("n.distance") / 2
    out = out.select("query", (F.col("at") + 1).alias("rank"), F.col("n.id").alias("id"), cosine.alias("cosine"))
    every = asked.count() * sum(sizes.values())
    return out, both.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs")).withColumn("all_pairs", F.lit(every).cast("long"))
