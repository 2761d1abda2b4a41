"""Whitening against numpy over the whole fit list, and its defined cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def fit_list(rows, scale=256):
    good = [(i, [math.floor(scale * float(np.float32(c))) for c in v]) for i, v, *_ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    return good, np.array(sorted({tuple(x) for _, x in good}))


def brute(rows, components=4):
    good, x = fit_list(rows)
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:components], axes.T[::-1][:components]
    trace = (centred**2).sum() / n
    out = {}
    for i, v in good:
        v = np.array(v)
        out.setdefault(i, []).append((sum((n * int(a) - int(s)) ** 2 for a, s in zip(v, sums)), (axes @ (v - sums / n)) / np.sqrt(values)))
    return n, out, values / trace


def random_rows(n, d=8, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) @ np.diag(np.linspace(1, 0.1, d)) + 0.3
    return [(i, [float(v) for v in row], i % 3) for i, row in enumerate(x)]


def check(spark, rows):
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    n, want, explained = brute(rows)
    assert len(got) == sum(map(len, want.values()))
    signs = None
    for r in got:
        assert r.n == n and r.identity_error < 1e-8
        assert np.allclose(r.explained, explained, rtol=1e-9)
        found = next(w for w in want[r.vec_id] if w[0] == int(r.deviation))
        if signs is None or not signs.all():
            signs = np.sign(found[1]) * np.sign(r.whitened)
        assert np.allclose(np.array(r.whitened) * signs, found[1], rtol=1e-9, atol=1e-9)


def test_equals_numpy(spark):
    check(spark, random_rows(300))


def test_copies_count_once_and_all_rows_return(spark):
    rows = random_rows(50)
    check(spark, rows + [(100 + i, rows[0][1], 0) for i in range(400)] + [rows[1], rows[1]])


def test_unusable_vectors_go(spark):
    rows = random_rows(40)
    bad = [(90, None, 0), (91, [None] + rows[0][1][1:], 0), (92, [float("nan")] + rows[0][1][1:], 0), (93, [float("inf")] + rows[0][1][1:], 1), (94, [1.0], 1), (95, [], 1)]
    out = whitening.whiten(spark.createDataFrame(rows + bad, SCHEMA))
    assert sorted(r.vec_id for r in out.collect()) == list(range(40))


@pytest.mark.parametrize("rows", [[], [(1, None, 0)], [(1, [0.5, 0.5], 0), (2, [0.5, 0.5], 0)]])
def test_nothing_to_fit(spark, rows):
    out = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r.whitened == [] and r.deviation == 0 and r.n == 1 for r in out)
    assert len(out) == (2 if len(rows) == 2 else 0)


def test_directions_without_variance_are_left_out(spark):
    rows = [(i, [float(i), 2.0 * i, 1.0], 0) for i in range(9)]
    out = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {len(r.whitened) for r in out} == {1} and math.isclose(out[0].explained[0], 1)


def test_large_numbers_stay_exact(spark):
    rows = [(i, [3e11 * i, -1e11 * i * i], 0) for i in range(6)]
    rows = [(i, [float(np.float32(c)) for c in v], k) for i, v, k in rows]
    _, want, _ = brute(rows, 2)
    got = {r.vec_id: int(r.deviation) for r in whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: w[0][0] for i, w in want.items()}


def test_merged_moments_do_not_depend_on_the_parts():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(100, 5)) + 1e6
    whole = whitening.moments(x, [0])
    parts = (0, [0], np.zeros(5), np.zeros((5, 5)))
    for a, b in ((0, 1), (1, 40), (40, 41), (41, 100)):
        parts = whitening.merge(parts, whitening.moments(x[a:b], [0]))
    assert parts[0] == 100 and np.allclose(parts[2], whole[2], rtol=1e-14)
    assert np.allclose(parts[3], whole[3], rtol=1e-9, atol=1e-6)


def test_extra_columns_and_clashing_names(spark):
    df = spark.createDataFrame(random_rows(20), SCHEMA).withColumns({c: F.lit("x") for c in ("n", "whitened", "x", "sums", "explained")})
    out = whitening.whiten(df)
    assert len(out.columns) == len(set(out.columns)) and {"vec_id", "x", "sums", "label"} <= set(out.columns)
    assert out.count() == 20 and out.first().x == "x"


def test_query(spark, sf_dir):
    out = queries.QUERIES["op11_whitening"](spark, sf_dir)
    assert dict(out.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    n, want, explained = brute(rows)
    got = {(r.vec_id, r.component): r for r in out.collect()}
    assert len(got) == 4 * len(want)
    signs = [np.sign(got[i, k].whitened * w[0][1][k - 1]) for k in range(1, 5) for i, w in list(want.items())[:1]]
    for i, w in want.items():
        for k in range(1, 5):
            r = got[i, k]
            assert (r.n, r.deviation) == (n, w[0][0]) and math.isclose(r.explained, explained[k - 1], rel_tol=1e-9)
            assert math.isclose(r.whitened * signs[k - 1], w[0][1][k - 1], rel_tol=1e-9, abs_tol=1e-9)
