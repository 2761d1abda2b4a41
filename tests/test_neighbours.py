"""The exact neighbour join against all cosines in numpy."""

import uuid

import numpy as np
import pytest

from tessera.operators import neighbours as N

SCHEMA = "vec_id long, v array<float>"


def clustered(n, groups=12, d=16, spread=0.05, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, d))
    x = centres[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, d))
    return [(i, [float(c) for c in np.float32(row)]) for i, row in enumerate(x)]


def brute(queries, shots, k):
    ok = [(i, np.array(v)) for i, v in shots if v is not None and np.any(v)]
    out = {}
    for q, v in queries:
        if v is None or not np.any(v):
            continue
        v = np.array(v)
        near = sorted((-round(float(v @ x / np.linalg.norm(v) / np.linalg.norm(x)), 9), i) for i, x in ok)[:k]
        out[q] = [(i, -c) for c, i in near]
    return out


def run(spark, tmp_path, queries, shots, k, **kw):
    a, b = spark.createDataFrame(queries, SCHEMA).repartition(3), spark.createDataFrame(shots, SCHEMA).repartition(4)
    rows, work = N.knn_join(a, b, "vec_id", "v", k, f"file://{tmp_path}/{uuid.uuid4().hex}", **kw)
    out = {}
    for r in sorted(rows.collect()):
        out.setdefault(r.query, []).append((r.id, r.cosine))
        assert len(out[r.query]) == r.rank
    return out, work.first()


def same(got, want):
    assert set(got) == set(want)
    for q in want:
        assert [c for _, c in got[q]] == pytest.approx([c for _, c in want[q]], abs=1e-6)
        mixed = {i for i, _ in got[q]} ^ {i for i, _ in want[q]}
        last = want[q][-1][1]
        assert all(abs(c - last) < 1e-6 for i, c in got[q] + want[q] if i in mixed)  # only ties with the last may differ


@pytest.mark.parametrize("block,queries", [(20_000, 2_000), (30, 7)])
def test_equals_brute_force_and_prunes(spark, tmp_path, monkeypatch, block, queries):
    monkeypatch.setattr(N, "BLOCK", block)
    monkeypatch.setattr(N, "QUERIES", queries)
    rows = clustered(900)
    got, work = run(spark, tmp_path, rows[::9], rows, 5)
    same(got, brute(rows[::9], rows, 5))
    assert work.all_pairs == 100 * 900 and work.pairs < 0.3 * work.all_pairs


def test_vectors_without_structure_are_exact_too(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i, [float(c) for c in rng.normal(size=24)]) for i in range(300)]
    got, work = run(spark, tmp_path, rows[:40], rows, 7, pivots=10)
    same(got, brute([(i, np.float32(v).tolist()) for i, v in rows[:40]], [(i, np.float32(v).tolist()) for i, v in rows], 7))
    assert work.pairs <= work.all_pairs


def test_copies_nulls_zeros_and_few_shots(spark, tmp_path):
    shots = [(i, [1.0, 2.0, 2.0]) for i in range(6)] + [(10, None), (11, [0.0, 0.0, 0.0]), (12, [-1.0, 0.0, 0.0])]
    queries = [(0, [2.0, 4.0, 4.0]), (1, None), (2, [0.0, 0.0, 0.0]), (3, [-3.0, 0.0, 0.1])]
    got, _ = run(spark, tmp_path, queries, shots, 3)
    assert [i for i, _ in got[0]] == [0, 1, 2] and set(got) == {0, 3} and got[3][0][0] == 12
    got, work = run(spark, tmp_path, queries, shots, 50)
    assert len(got[0]) == 7 and work.pairs == 14
    got, work = run(spark, tmp_path, queries, [(1, None)], 3)
    assert got == {} and work.pairs == 0
    assert run(spark, tmp_path, [(1, None)], shots, 3)[0] == {}
