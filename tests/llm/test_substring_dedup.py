import hashlib
import random
import re

import pytest

from tessera.llm import substring_dedup as S


def brute(rows, length):
    first = {}
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - length + 1 if i is not None else 0):
            key = tuple(w[k : k + length])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - length + 1 if i is not None else 0):
            if first[tuple(w[k : k + length])] < i:
                gone.update(range(k, k + length))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted([tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()], key=str)


def generated():
    rnd = random.Random(5)
    word = lambda: f"w{rnd.randrange(5000)}"
    text = lambda n: [word() for _ in range(n)]
    shared = [text(n) for n in (49, 50, 51, 70, 120, 300)]
    rows = [(100, None), (101, ""), (102, " \n "), (None, " ".join(shared[4]))]
    for i in range(60):
        w = text(rnd.randrange(5, 90))
        for _ in range(rnd.randrange(3)):
            p = rnd.choice(shared)
            a = rnd.randrange(len(p) // 2)
            w += p[a:] if rnd.random() < 0.3 else p
            w += text(rnd.randrange(20))
        if rnd.random() < 0.2:
            w[rnd.randrange(len(w))] = word()
        rows.append((i, "\n ".join(w)))
    rows += [(200 + i, " ".join(shared[5])) for i in range(6)] + [(200, " ".join(shared[5])), (3, " ".join(shared[3] * 3)), (300, "a b " * 200), (301, "a b " * 100)]
    return rows


@pytest.mark.parametrize("hot", [S.HOT, 1])
def test_equals_brute_force(frame, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT", hot)
    monkeypatch.setattr(S, "SHARD", 20)
    rows = generated()
    assert got(S.digest(frame(rows))) == brute(rows, 50)


def test_real_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert got(S.digest(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()], 50)


def test_automaton_finds_the_least_owner():
    rnd = random.Random(1)
    texts = [[rnd.choice("abc") for _ in range(rnd.randrange(4, 40))] for _ in range(40)]
    a = S.SuffixAutomaton()
    for i, t in enumerate(texts[:30]):
        a.add(t, 100 - i)
    a.close()
    for t in texts:
        want = []
        for k in range(len(t) - 4):
            own = [100 - i for i, r in enumerate(texts[:30]) if any(r[j : j + 5] == t[k : k + 5] for j in range(len(r) - 4))]
            want.append(min(own, default=S.NEVER))
        assert a.owners(t, 5) == want


def test_clean_and_empty(frame):
    assert S.digest(frame([])).count() == 0
    p = " ".join(f"w{i}" for i in range(60))
    rows = S.clean(frame([(1, p), (2, f"x {p} y"), (3, "keep\n as  is"), (4, None)])).collect()
    assert {r.doc_id: r.text for r in rows} == {1: p, 2: "x y", 3: "keep\n as  is", 4: None}
    assert rows[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars"}


def test_very_long_texts(frame):
    """A text of one word a hundred thousand times, and long texts that share a part, against brute force."""
    rnd = random.Random(6)
    part = [f"p{rnd.randrange(10**6)}" for _ in range(20_000)]
    long = [f"q{i}" for i in range(30_000)]
    rows = [(1, "a " * 100_000), (2, "a " * 60_000 + "b"), (3, " ".join(long + part)), (4, " ".join(part[100:] + ["end"])), (5, "x" * 500_000)]
    assert got(S.digest(frame(rows))) == brute(rows, 50)
