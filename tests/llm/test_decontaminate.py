import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate as D


def semiglobal(p, x):
    """Least edit distance of p to a substring of x."""
    row = [0] * (len(x) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(x, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def least_of_all(t, size, x):
    """Least edit distance of any run of ``size`` characters of t to a substring of x: the whole table for all runs."""
    t, x = D.points(t).astype(np.int64), D.points(x).astype(np.int64)
    runs = np.lib.stride_tricks.sliding_window_view(t, size)
    row, ramp = np.zeros((len(runs), len(x) + 1), np.int64), np.arange(len(x) + 1)
    for i in range(size):
        new = row + 1
        new[:, 1:] = np.minimum(new[:, 1:], row[:, :-1] + (runs[:, i : i + 1] != x))
        row = np.minimum.accumulate(new - ramp, axis=1) + ramp
    return row.min()


def brute(text, items):
    """All passages of all items against the whole text, wherever they begin."""
    x, out = f" {D.normalised(text or '')} ", []
    for item, t in items:
        t = D.normalised(t or "")
        if len(t) < D.SHORT:
            if t and f" {t} " in x:
                out.append(item)
            continue
        size = min(len(t), D.PASSAGE)
        if least_of_all(t, size, x) <= D.edits(size):
            out.append(item)
    return out


def generated():
    rnd = random.Random(11)
    alphabet = "abcdefgh é"
    make = lambda n: "".join(rnd.choice(alphabet) for _ in range(n))
    items = [(i, make(n)) for i, n in enumerate((10, 33, 50, 80, 81, 119, 120, 200, 300, 24, 19))] + [(20, None), (21, ""), (22, "abc"), (23, "Dad fed"), (24, "b"), (25, " ")]
    rows = [(100, None), (101, ""), (102, " "), (None, items[6][1]), (103, "b abcd dad FED"), (104, "xabc"), (105, "abc"), (106, items[10][1])]
    for i in range(70):
        _, t = rnd.choice(items[1:10])
        if rnd.random() < 0.5 and len(t) > 90:  # excerpts that begin anywhere
            a = rnd.randrange(len(t) - 80)
            t = t[a : a + rnd.randrange(70, 100)]
        t = list(t)
        for _ in range(rnd.choice((0, 2, 4, 8, 9, 12))):
            at = rnd.randrange(len(t) + 1)
            t[at : at + rnd.randrange(2)] = [rnd.choice(alphabet)] * rnd.randrange(2)
        rows.append((i, make(rnd.randrange(60)) + "".join(t).upper() + make(rnd.randrange(60))))
    return rows, items


def test_equals_brute_force(frame, spark):
    rows, items = generated()
    got = {r.doc_id: r["items"] for r in D.scan(frame(rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {i: brute(t, items) for i, t in rows}
    assert got == want
    assert sum(map(bool, want.values())) > 20


def test_a_benchmark_beyond_one_block_gives_the_same(frame, spark, monkeypatch):
    rows, items = generated()
    docs = frame(rows + [(None, None)]).withColumn("items", F.lit("old")).withColumn("dk", F.lit(1))
    bench = spark.createDataFrame(items + [(4, items[2][1]), (None, "abc")], "item_id long, text string")
    whole = D.scan(docs, bench)
    monkeypatch.setattr(D, "BLOCK_CHARS", 150)
    joined = D.scan(docs, bench)
    assert joined.columns == whole.columns
    assert sorted(tuple(map(str, r)) for r in joined.collect()) == sorted(tuple(map(str, r)) for r in whole.collect())
    assert D.scan(docs.filter("false"), bench).count() == 0


def test_least_distance():
    rnd = random.Random(2)
    for _ in range(300):
        p = np.array([rnd.randrange(3) for _ in range(rnd.randrange(1, 9))])
        x = np.array([rnd.randrange(3) for _ in range(rnd.randrange(1, 15))])
        assert D.least_distance(p, 0, 1, len(p), x, -len(p), len(x)) == semiglobal(p.tolist(), x.tolist())
        size = rnd.randrange(1, len(p) + 1)
        want = min(semiglobal(p[a : a + size].tolist(), x.tolist()) for a in range(len(p) - size + 1))
        assert D.least_distance(p, 0, len(p) - size + 1, size, x, -len(p), len(x)) == want


def test_real_rows_and_empty(spark, sf_dir, frame):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    items = [(r.item_id, D.normalised(r.text)) for r in bench.collect()]
    for r in D.scan(docs, bench).collect():
        exact = {i for i, t in items if t in D.normalised(r.text)}
        assert exact <= set(r["items"])
    assert D.scan(frame([]), bench).count() == 0
    none = bench.filter("false")
    assert D.scan(docs, none).filter("size(items) > 0").count() == 0
    assert D.clean(docs, none).columns == docs.columns


@pytest.mark.parametrize("text", ["x" * 200_000, "\0" * 100])
def test_odd_texts(frame, spark, text):
    bench = spark.createDataFrame([(1, "y" * 90)], "item_id long, text string")
    assert D.scan(frame([(1, text)]), bench).first()["items"] == []
