import random
import re
import time

import numpy as np
import pytest

from tessera.llm import jaccard_join as J
from tessera.llm.components import components, merged


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return set()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)}


def brute(rows, t_pct, n):
    sets = [(i, shingles(t, n)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, x) in enumerate(sets):
        for j, y in sets[:k]:
            if x and y and 100 * len(x & y) >= t_pct * len(x | y):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s), find(i)) for i, s in sets}


def check(docs, rows, t_pct, n):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.similarity_components(docs, t_pct, n).collect()}
    assert got == brute(rows, t_pct, n)


def generated(seed):
    rnd = random.Random(seed)
    vocab = [f"W{i}" for i in range(400)]
    rows = [(i, rnd.choice(["", " ", "\n", None])) for i in range(5)]
    for size in (1, 2, 3, 4, 8, 12, 20, 21, 35, 60, 150, 400):
        base = [rnd.choice(vocab) for _ in range(size)]
        rows.append((len(rows), " ".join(base)))
        for edits in (0, 0, 1, 1, 1, 2, 3, 4, 6, 8):
            w = list(base)
            for _ in range(edits):
                at = rnd.randrange(len(w)) if w else 0
                kind = rnd.randrange(3)
                if kind == 0 and w:
                    w[at] = rnd.choice(vocab)
                elif kind == 1:
                    w.insert(at, rnd.choice(vocab))
                elif w:
                    del w[at]
            rows.append((len(rows), "  ".join(w).lower() if rnd.random() < 0.3 else " ".join(w)))
    base = [rnd.choice(vocab) for _ in range(120)]  # a group of near copies around one text
    for _ in range(60):
        w = list(base)
        for _ in range(rnd.randrange(9)):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        rows.append((len(rows), " ".join(w)))
    ids = list(range(len(rows)))
    rnd.shuffle(ids)
    return [(i, t) for i, (_, t) in zip(ids, rows)]


@pytest.mark.parametrize("pairs", (J.CROWD_PAIRS, 0))
def test_components_equal_brute_force(frame, monkeypatch, pairs):
    """With 0 pairs all sets that share keys across components meet by their rare tokens."""
    monkeypatch.setattr(J, "CROWD_PAIRS", pairs)
    monkeypatch.setattr(J, "CROWD_OTHERS", min(pairs // 10, 50))
    for seed, t_pct, n in ((1, 90, 3), (2, 80, 5)):
        rows = generated(seed)
        check(frame(rows), rows, t_pct, n)


def boilerplate(n, own, common=100, seed=4):
    """Documents of a common passage and words of their own, as many as ``own`` gives for each."""
    rnd = random.Random(seed)
    head = [f"c{j}" for j in range(common)]
    return [(i, " ".join(head + [f"o{i}x{rnd.randrange(10**6)}" for _ in range(own(i))])) for i in range(n)]


def test_boilerplate_around_the_threshold(frame, monkeypatch):
    """Sets that share most tokens, some just above, some just below the similarity."""
    monkeypatch.setattr(J, "CROWD_PAIRS", 30)
    monkeypatch.setattr(J, "CROWD_OTHERS", 3)
    rows = boilerplate(160, lambda i: i % 16) + [(i + 1000, t) for i, t in boilerplate(60, lambda i: 4 + i % 5, 60, 5)]
    check(frame(rows), rows, 90, 3)


def test_sets_of_thousands(frame):
    """Sets of 5,000 and 50,000 tokens with edits at the bound: the expected links follow from the sizes."""
    rnd = random.Random(6)
    rows, want = [], {}
    for size, at in ((5_000, 0), (50_000, 10)):
        base = [f"t{at}x{j}" for j in range(size + 2)]  # as many 3-word shingles as size
        most = next(k for k in range(size, 0, -1) if 100 * (size - 3 * k) >= 90 * (size + 3 * k))
        for k, own in enumerate((0, most, most + 1)):
            w = list(base)
            for place in rnd.sample(range(2, size - 2, 3), own):  # each changes three shingles, none twice
                w[place] = f"new{at}x{k}x{place}"
            rows.append((at + k, " ".join(w)))
            want[at + k] = (size, at + k if own > most else at)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.similarity_components(frame(rows)).collect()}
    assert got == want


def test_boilerplate_grows_in_proportion(spark):
    """Documents of 100 common and 22 own words: four times the rows take at most five times as long."""

    def seconds(n):
        docs = spark.createDataFrame(boilerplate(n, lambda i: 22), "doc_id long, text string").repartition(8).cache()
        docs.count()
        begin = time.perf_counter()
        assert J.similarity_components(docs).filter("component_id <> doc_id").count() == 0
        return time.perf_counter() - begin

    seconds(1000)
    assert seconds(16_000) <= 5 * seconds(4_000)


def test_real_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check(docs, [(r.doc_id, r.text) for r in docs.collect()], 90, 3)


def test_edges_of_the_input(frame):
    assert J.similarity_components(frame([])).count() == 0
    long = "a b c d e f g " * 20000
    rows = [(3, long), (3, long), (None, long), (5, long + "x"), (6, long + "A b c"), (7, None)]
    got = [(r.doc_id, r.component_id) for r in J.similarity_components(frame(rows)).collect()]
    assert sorted(got, key=str) == sorted([(3, 3), (3, 3), (None, None), (5, 5), (6, 3), (7, 7)], key=str)
    x, y = "p q r s t u v w", "k l m n o a b c d e f g h i j"
    twice = [(3, x), (5, x), (5, y), (9, y), (9, "z")]  # an id that stands for two texts is one node
    assert sorted((r.doc_id, r.component_id) for r in J.similarity_components(frame(twice)).collect()) == [(3, 3), (5, 3), (5, 5), (9, 5), (9, 9)]
    kept = J.keep_first(frame([(1, "a b c d e f g h"), (2, "A b c d e f g h"), (3, ""), (4, None), (None, "a b c d e f g h")]))
    assert sorted(kept.select("doc_id").toPandas().doc_id.fillna(-1)) == [-1, 1, 3, 4]


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000 + i, 1000) for i in range(1, 50)] + [(7, 7), (5, 6)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(50)}}


def test_merged_components_equal_those_of_all_edges(spark):
    rnd = random.Random(9)
    edge = lambda n: [(rnd.randrange(60), rnd.randrange(60)) for _ in range(n)]
    first, more = edge(25), edge(15)
    make = lambda e: spark.createDataFrame(e, "a long, b long")
    got = {r.node: r.component for r in merged(components(make(first)), make(more)).collect()}
    want = {r.node: r.component for r in components(make(first + more)).collect()}
    assert {n: got[n] for n in want} == want and all(got[n] == n for n in got.keys() - want.keys())


def test_members_of_shared_keys_come_from_one_sort(spark):
    """Keys that span Arrow batches: a first row alone in its batch, one that went out before, keys without a whole row."""
    import random

    rng = random.Random(5)
    rows = [(rng.choice((rng.randrange(40), rng.randrange(1000))), n, rng.random() < 0.3) for n in range(600)]
    by = {}
    for k, n, w in rows:
        by.setdefault(k, []).append((n, w))
    want = sorted((k, n, w, min(x for x, y in v if y)) for k, v in by.items() if len(v) > 1 and any(w for _, w in v) for n, w in v)
    keyed = spark.createDataFrame(rows, "key long, node long, whole boolean")
    try:
        for batch in (1, 2, 7, 10_000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
            assert sorted(map(tuple, J.shared_members(keyed).collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_keys_of_sets_are_made_once(frame, monkeypatch):
    import re

    plans, cut = [], J.cut

    def noted(df, name, *more):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df, name, *more)

    monkeypatch.setattr(J, "cut", noted)
    rows = [(i, " ".join(f"w{j + i // 2 * 50}" for j in range(30))) for i in range(8)]
    assert sorted((r.doc_id, r.component_id) for r in J.similarity_components(frame(rows)).collect()) == [(i, i // 2 * 2) for i in range(8)]
    assert sum(len(re.findall(r"MapInArrow[^\n]*near_keys", p)) for p in plans) == 1


def test_texts_are_not_shuffled_for_ids(frame, monkeypatch):
    """Sets of pairs are made where the texts lie, however many ids there are."""
    plans, write = {}, J.cut
    monkeypatch.setattr(J, "cut", lambda df, name, *more: plans.update({name: df._jdf.queryExecution().optimizedPlan().toString()}) or write(df, name, *more))
    words = [f"w{i}" for i in range(60)]
    docs = frame([(1, " ".join(words)), (2, " ".join(words[:-1])), (3, "a b c d e")])
    found = {r.doc_id: r.component_id for r in J.similarity_components(docs).collect()}
    assert found == {1: 1, 2: 1, 3: 3}
    assert "sets" in plans and "Join" not in plans["sets"] and "crowd_texts" not in plans


def test_a_set_has_one_row_for_each_rare_token(frame):
    """The first |x| - t |x| + 1 tokens, whole up to half of what the largest partner may differ in."""
    docs = frame([(1, " ".join(f"w{i}" for i in range(104)))])
    rows = J.rare_keys(docs, np.zeros(J.COUNT_BUCKETS, np.int64), 80, 5).collect()
    assert len(rows) == len({r.key for r in rows}) == 100 - 80 + 1
    assert sum(r.whole for r in rows) == J.most_different(100, 80) // 2 + 1
