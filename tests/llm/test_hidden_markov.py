"""The hidden Markov model against plain recursions over single texts, and base columns against counts in Python."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import hidden_markov as hm
from tessera.llm import queries


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [None]


def kind_of(token, classes):
    h = hm.END if token is None else hm.tokens_of([token.encode()])[0][:1]
    return int(h[0] & np.uint64(classes - 1))


def forward(m, kinds):
    """Scaled weights by token, and the log-likelihood."""
    out, total = [], 0.0
    for i, c in enumerate(kinds):
        w = (m.start if i == 0 else out[-1] @ m.step) * m.emit[c]
        total += math.log(w.sum())
        out.append(w / w.sum())
    return out, total


def baum_welch(m, texts, classes, shares):
    k = len(m.start)
    starts, steps, emits = np.zeros(k), np.zeros((k, k)), np.zeros((classes, k))
    for kinds in texts:
        alphas, _ = forward(m, kinds)
        beta = np.ones(k)
        for i in range(len(kinds) - 1, -1, -1):
            gamma = alphas[i] * beta
            emits[kinds[i]] += gamma / gamma.sum()
            if i:
                xi = alphas[i - 1][:, None] * m.step * (m.emit[kinds[i]] * beta)[None, :]
                steps += xi / xi.sum()
                beta = m.step @ (m.emit[kinds[i]] * beta)
                beta /= beta.sum()
            else:
                starts += gamma / gamma.sum()
    return hm.Hmm.of(starts, steps, emits, shares)


def expected(rows, classes, states, rounds):
    train = Counter(t for _, taught, text in rows if taught for t in tokens(text))
    n, v = sum(train.values()), len(train)
    per, kinds = np.zeros(classes, np.int64), np.zeros(classes, np.int64)
    for t, c in train.items():
        per[kind_of(t, classes)] += c
        kinds[kind_of(t, classes)] += 1
    counts = hm.Counts(per, kinds)
    m = hm.first_model(counts, states)
    for _ in range(rounds):
        m = baum_welch(m, [[kind_of(t, classes) for t in tokens(text)] for _, taught, text in rows if taught], classes, counts.shares())
    out = []
    for i, taught, text in rows:
        ts = tokens(text)
        k = [kind_of(t, classes) for t in ts]
        base = sum(math.log10((train[t] + 1) / (n + v + 1)) for t in ts)
        inside = sum(math.log10((train[t] + 1) / (per[c] + kinds[c] + 1)) for t, c in zip(ts, k))
        out.append((i, not taught, len(ts), sum(t in train for t in ts), n, base, forward(m, k)[1] / math.log(10) + inside))
    return m, out


def same(got, want):
    got = sorted((tuple(r) for r in got), key=str)
    want = sorted(want, key=str)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5]
        assert math.isclose(a[5], b[5], rel_tol=1e-9, abs_tol=1e-9) and math.isclose(a[6], b[6], rel_tol=1e-7)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, train boolean, text string").repartition(3)


COLUMNS = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def corpus(n=60, seed=5):
    rng = np.random.default_rng(seed)
    a, b = [f"a{i}" for i in range(20)], [f"b{i}" for i in range(20)]
    rows = []
    for i in range(n):
        words = [str(w) for w in rng.choice(a if i % 2 else b, int(rng.integers(0, 200)))]
        rows.append((i, i % 7 != 2, " ".join(words)))
    return rows


@pytest.mark.parametrize("rounds,states", [(0, 2), (3, 3), (2, 1)])
def test_equals_plain_recursions(spark, monkeypatch, rounds, states):
    monkeypatch.setattr(hm, "CHUNK_TOKENS", 500)
    rows = corpus() + [(100, True, None), (101, False, ""), (102, True, "A a1 A1 unseen\n\tB"), (103, False, "never met"), (None, True, "b1 b2"), (7, True, "a1"), (7, True, "a1")]
    rows += [(104, True, " ".join(["a1", "b2", "a3"] * 500))]
    got = hm.score(frame(spark, rows), states=states, rounds=rounds, classes=64).select(*COLUMNS).collect()
    same(got, expected(rows, 64, states, rounds)[1])


def test_likelihood_is_the_sum_over_all_paths():
    rng = np.random.default_rng(0)
    emit = rng.random((5, 3))
    m = hm.Hmm(np.array([0.2, 0.5, 0.3]), rng.dirichlet(np.ones(3), 3), emit / emit.sum(axis=0))
    kinds = np.array([0, 3, 2, 4, 1])
    total = 0.0
    for path in itertools.product(range(3), repeat=len(kinds)):
        p = m.start[path[0]]
        for i, (s, c) in enumerate(zip(path, kinds)):
            p *= m.emit[c, s] * (m.step[path[i - 1], s] if i else 1)
        total += p
    assert math.isclose(hm.Pass(m, kinds, np.array([5])).loglik[0], math.log(total), rel_tol=1e-12)


def test_long_texts_do_not_underflow():
    rng = np.random.default_rng(0)
    emit = rng.random((1000, 4)) ** 8 + 1e-12
    m = hm.Hmm(np.ones(4) / 4, rng.dirichlet(np.ones(4) * 0.2, 4), emit / emit.sum(axis=0))
    kinds, sizes = rng.integers(0, 1000, 30_000 + 64 + 1), np.array([30_000, 64, 1])
    got = hm.Pass(m, kinds, sizes).loglik
    at = 0
    for n, x in zip(sizes, got):
        assert math.isclose(x, forward(m, kinds[at : at + n])[1], rel_tol=1e-10)
        at += n


def test_probabilities_of_single_tokens_sum_to_one():
    counts = hm.Counts(np.array([5, 0, 9, 1]), np.array([2, 0, 3, 1]))
    m = hm.first_model(counts, 2)
    assert np.allclose(m.emit.sum(axis=0), 1) and np.allclose(m.step.sum(axis=1), 1)
    # within a class: each known token by its count and one, and one for all unknown ones
    assert np.allclose((counts.tokens + counts.distinct + 1) / (counts.tokens + counts.distinct + 1), 1)


def test_training_helps_on_held_out_texts(spark):
    rows = corpus(200)
    got = {rounds: sum(r.score for r in hm.score(frame(spark, rows), states=2, rounds=rounds).filter("held_out").collect()) for rounds in (0, 6)}
    base = sum(r.base_score for r in hm.score(frame(spark, rows), rounds=0).filter("held_out").collect())
    assert got[6] > got[0] and got[6] > base + 0.1 * abs(base)  # two vocabularies: about 0.3 of 1.6 digits a word


def test_empty_table_and_nothing_to_learn(spark):
    assert hm.score(frame(spark, []).filter("false")).count() == 0
    rows = [(1, False, "a b"), (2, False, None)]
    got = hm.score(frame(spark, rows), classes=64).select(*COLUMNS).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in sorted(got)] == [(3, 0, 0, 0.0), (1, 0, 0, 0.0)]
    assert all(r.score < 0 for r in got)


def test_query(spark, sf_dir):
    got = queries.QUERIES["op12_hidden_markov"](spark, sf_dir)
    assert tuple(got.columns) == COLUMNS
    docs = [(r.doc_id, zlib.crc32(str(r.doc_id).encode()) % 7 != 2, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    same(got.collect(), expected(docs, hm.CLASSES, hm.STATES, hm.ROUNDS)[1])
