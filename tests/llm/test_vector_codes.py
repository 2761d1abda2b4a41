"""Vector codes against a plain Lloyd over all rows, and their defined cases."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, entries, rounds, parts=4, scale=1024):
    good = [(i, [math.floor(scale * c) for c in v], k) for i, v, k in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    w = len(good[0][1]) // parts
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    piece = lambda v, p: v[p * w : (p + 1) * w]
    books = [[piece(v, p) for _, v, _ in good[:entries]] for p in range(parts)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda a, book: min(range(len(book)), key=lambda e: (gap(a, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            held = defaultdict(list)
            for _, v, _ in good:
                held[near(piece(v, p), books[p])].append(piece(v, p))
            books[p] = [[sum(c) // len(held[e]) for c in zip(*held[e])] if e in held else b for e, b in enumerate(books[p])]
    out, by = [], defaultdict(int)
    for i, v, k in good:
        codes = [near(piece(v, p), books[p]) for p in range(parts)]
        error = sum(gap(piece(v, p), books[p][c]) for p, c in enumerate(codes))
        by[k] += error
        out.append((i, tuple(codes), error, k))
    return sorted(((i, c, e, by[k]) for i, c, e, k in out), key=str), books


def rows_of(n, d=8, seed=1, spread=1.0):
    rng = np.random.default_rng(seed)
    return [(int(i), [float(x) for x in np.round(rng.normal(size=d) * spread, 2)], None if i % 5 == 0 else int(i % 3)) for i in range(n)]


def run(spark, rows, entries=6, rounds=3, **kw):
    out, books = vector_codes.compress(spark.createDataFrame(rows, SCHEMA).repartition(4), entries=entries, rounds=rounds, **kw)
    got = sorted(((r.vec_id, tuple(r.codes), int(r.error), int(r.label_error)) for r in out.collect()), key=str)
    return got, [[[int(v) for v in e] for e in b] for b in books.entries]


@pytest.mark.parametrize("spread", [1.0, 1e9, 1e15])  # sums of squares within float64, int64, beyond
def test_equals_plain_lloyd(spark, spread):
    rows = rows_of(60, spread=spread)
    assert run(spark, rows) == brute(rows, 6, 3)


def test_copies_ties_and_repeated_rows(spark):
    rows = rows_of(20)
    rows += [(100 + i, rows[3][1], 7) for i in range(200)] + [rows[4], rows[4]] + [(None, rows[5][1], 1)]
    assert run(spark, rows) == brute(rows, 6, 3)


def test_hot_keys_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "HOT_ROWS", 5)
    rows = rows_of(40)
    rows += [(100 + i, rows[3][1], None) for i in range(30)]
    assert run(spark, rows) == brute(rows, 6, 3)


def test_fewer_rows_than_entries(spark):
    rows = rows_of(5)
    got, books = run(spark, rows, entries=256, rounds=4)
    assert (got, books) == brute(rows, 256, 4) and all(e == 0 for _, _, e, _ in got)


def test_unused_entries_stay(spark):
    rows = [(i, [0.0] * 4, 0) for i in range(3)] + [(9, [1.0] * 4, 0)]
    got, books = run(spark, rows, entries=3)
    assert (got, books) == brute(rows, 3, 3)
    assert books[0] == [[1024], [0], [0]]


def test_unusable_vectors_go(spark):
    rows = rows_of(10)
    bad = [(90, None, 0), (91, [None] * 8, 0), (92, [float("nan")] * 8, 0), (93, [float("-inf")] * 8, 1), (94, [1.0] * 4, 1)]
    assert run(spark, rows + bad)[0] == brute(rows, 6, 3)[0]


def test_empty_table_and_uneven_parts(spark):
    got, books = run(spark, [])
    assert got == [] and books == []
    with pytest.raises(ValueError):
        run(spark, [(1, [1.0, 2.0, 3.0], 0)])


def test_extra_columns_and_clashing_names(spark):
    df = spark.createDataFrame(rows_of(12), SCHEMA).withColumns({c: F.lit("x") for c in ("part", "v", "n", "codes", "row", "error")})
    out, _ = vector_codes.compress(df, entries=4)
    assert len(out.columns) == len(set(out.columns)) and {"part", "v", "n", "row"} <= set(out.columns)
    assert out.count() == 12 and out.first().part == "x"
