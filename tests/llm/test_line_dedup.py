import random
import re

import numpy as np
import pytest

from tessera.llm import line_dedup as L


def words(x):
    return tuple(re.findall(r"[^\x20\x09-\x0D]+", x))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def near(a, b):
    if a == b:
        return True
    n = max(len(a), len(b))
    most = max(1, n // 10)
    return n >= 8 and abs(len(a) - len(b)) <= most and distance(a, b) <= most


def brute(rows):
    lines = sorted({(i, k, words(x)) for i, t in rows if i is not None for k, x in enumerate((t or "").split("\n")) if words(x)}, key=lambda r: r[:2])
    out = []
    for i, t in rows:
        if i is None or t is None:
            out.append((i, t))
            continue
        kept = []
        for k, x in enumerate(t.split("\n")):
            w = words(x)
            gone = w and any((j, m) < (i, k) and near(w, v) for j, m, v in lines)
            if not gone:
                kept.append(x)
        out.append((i, "\n".join(kept)))
    return sorted(out, key=str)


def generated():
    rnd = random.Random(3)
    vocab = "abcdefghijkl"
    base = [[rnd.choice(vocab) for _ in range(n)] for n in (1, 3, 6, 7, 7, 8, 8, 9, 12, 20) for _ in range(2)]
    base.append(list("aaaaaaaa"))
    rows = [(900, None), (901, ""), (902, "\n \n"), (None, " ".join(base[-2]))]
    for i in range(60):
        lines = []
        for _ in range(rnd.randrange(1, 5)):
            w = list(rnd.choice(base))
            for _ in range(rnd.choice((0, 0, 1, 1, 2))):
                at = rnd.randrange(len(w))
                w[at : at + rnd.randrange(2)] = [rnd.choice(vocab + "xyz")] * rnd.randrange(2) or w[at : at + 1]
            lines.append(rnd.choice((" ", "  ")).join(w))
            if rnd.random() < 0.3:
                lines.append("")
        rows.append((i, "\n".join(lines)))
    return rows + [(3, rows[10][1]), (3, rows[10][1])]


def test_equals_brute_force(frame):
    rows = generated()
    got = sorted([(r.doc_id, r.text) for r in L.dedup(frame(rows)).collect()], key=str)
    assert got == brute(rows)


def test_real_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(120)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = L.dedup(spark.createDataFrame(docs.collect(), docs.schema))
    assert sorted([(r.doc_id, r.text) for r in out.collect()], key=str) == brute(rows)
    assert out.columns == docs.columns
    assert out.filter("n_chars <> length(text)").count() == 0


@pytest.mark.parametrize("cells", (64, 1 << 17))
def test_edits_within_a_bound(monkeypatch, cells):
    monkeypatch.setattr(L, "CELLS", cells)
    rnd = random.Random(9)
    runs = [[rnd.randrange(3) for _ in range(rnd.randrange(0, 13))] for _ in range(4000)]
    words = np.array([x for r in runs for x in r], np.uint64)
    ends = np.cumsum([len(r) for r in runs])
    starts = ends - [len(r) for r in runs]
    most = np.array([rnd.randrange(1, 6) for _ in range(2000)])
    got = L.edited_within(words, starts[:2000], ends[:2000], starts[2000:], ends[2000:], most)
    assert got.tolist() == [distance(a, b) <= k for a, b, k in zip(runs[:2000], runs[2000:], most.tolist())]


def test_sketches_differ_by_two_bits_an_edit():
    rnd = random.Random(2)
    for n in (20, 300, 700):
        a = [rnd.randrange(n // 4) for _ in range(n)]
        b = list(a)
        for _ in range(n // 10):
            at = rnd.randrange(len(b))
            b[at : at + rnd.randrange(2)] = [rnd.randrange(n)] * rnd.randrange(2)
        words = np.array(a + b, np.uint64)
        bits, wide = L.parities(words, np.array([0, n]), np.array([n, n + len(b)]))
        edits = distance(a, b)
        assert sum(int(np.bitwise_count(np.uint64(x ^ y))) for x, y in zip(*bits.view(np.uint64))) <= 2 * edits
        if wide[0] is not None and wide[1] is not None:
            x, y = sorted((w.view(np.uint64) for w in wide), key=len)
            while len(y) > len(x):
                y = y[: len(y) // 2] ^ y[len(y) // 2 :]
            assert int(np.bitwise_count(x ^ y).sum()) <= 2 * edits


def test_lines_of_few_words_many_times(frame):
    """Words repeated hundreds of times: lines are near only if the counts are."""
    rows = [(i, " ".join(["the"] * (300 + 9 * i) + ["of"] * (300 - 9 * i))) for i in range(20)] + [(50, " ".join(["the"] * 300 + ["of"] * 301))]
    got = {r.doc_id: r.text for r in L.dedup(frame(rows)).collect()}
    assert sorted(got.items(), key=str) == brute(rows)


def test_empty_and_clashing_columns(frame):
    from pyspark.sql import functions as F

    assert L.dedup(frame([])).count() == 0
    docs = frame([(1, "a b c d e f g h\nx"), (2, "a b c d e f g Z\ny\nx")]).withColumn("line", F.lit(1)).withColumn("ats", F.lit(2)).withColumn("th", F.lit(3))
    got = L.dedup(docs.drop("n_chars"))
    assert {r.doc_id: r.text for r in got.collect()} == {1: "a b c d e f g h\nx", 2: "y"}
    assert got.columns == docs.drop("n_chars").columns


@pytest.mark.parametrize("small,crowd", ((1, 1), (2, 1000), (100, 1000)))
def test_growing_bound_equals_brute_force(frame, monkeypatch, small, crowd):
    monkeypatch.setattr(L, "SMALL", small)
    monkeypatch.setattr(L, "CROWD", crowd)
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(40)]
    base = [[rnd.choice(vocab) for _ in range(n)] for n in (7, 8, 18, 19, 20, 21, 29, 30, 36, 38, 39, 40, 41, 44, 60, 90, 130)]
    base.append(["a"] * 45)
    rows = [(900, None), (901, "")]
    for i in range(110):
        w = list(rnd.choice(base))
        for _ in range(rnd.choice((0, 1, len(w) // 20, len(w) // 20, len(w) // 10, len(w) // 9, len(w) // 7))):
            at = rnd.randrange(len(w))
            w[at : at + rnd.randrange(2)] = [rnd.choice(vocab)] * rnd.randrange(2)
        rows.append((i, " ".join(w)))
    # a copy with edits spread evenly, the worst case for a run of words
    rows += [(200 + n, " ".join(f"u{n}x{j}" for j in range(n))) for n in (20, 29, 40, 60, 100)]
    rows += [(400 + n, " ".join("new" if j % (n // (n // 10 + 1) + 1) == n // (n // 10 + 1) else f"u{n}x{j}" for j in range(n))) for n in (20, 29, 40, 60, 100)]

    def gone(i, w):
        return any(j < i and near(w, v) for j, v in lines)

    lines = [(i, words(t)) for i, t in rows if t]
    want = {i: "" if t and gone(i, words(t)) else t for i, t in rows}
    assert {r.doc_id: r.text for r in L.dedup(frame(rows)).collect()} == want
    assert sum(want[i] == "" for i, t in rows if t and len(words(t)) >= 20) > 30
    assert all(want[400 + n] == "" for n in (20, 29, 40, 60, 100))


def test_longest_is_the_longest_near_line():
    for n in range(7, 500):
        near_to = [m for m in range(n, 2 * n + 9) if m - L.bound(m) <= n]
        assert L.longest(np.array([n]))[0] == max(near_to)


def test_near_lines_share_a_variant(frame):
    """Any lines within the bound have a variant in common, whatever their lengths, edits and words' frequencies."""
    rnd = random.Random(8)
    cores = L.Cores.of(frame([(1, " ".join(f"w{int(rnd.paretovariate(0.5)) % 5000}" for _ in range(5000)))]))
    n_near = 0
    for _ in range(3000):
        n = rnd.choice((7, 8, 9, 18, 19, 20, 27, 29, 30, 38, 39, 40, 45, 49, 54, 59, 64, 90, 130, 300))
        a = [f"w{int(rnd.paretovariate(0.5)) % 5000}" for _ in range(n)]
        b = list(a)
        for _ in range(int(L.bound(L.longest(np.array([n])))[0])):
            at = rnd.randrange(len(b))
            b[at : at + rnd.randrange(2)] = [f"w{rnd.randrange(5000)}"] * rnd.randrange(2)
        if distance(a, b) > L.bound(max(len(a), len(b))) or max(len(a), len(b)) < 8:
            continue
        n_near += 1
        for more in (1, 2):
            x, y = (set(cores.variants(L.words_of([" ".join(w).encode()])[0], np.array([0]), np.array([len(w)]), more)[1].tolist()) for w in (a, b))
            assert len(x & y) >= more
    assert n_near > 500


def test_a_template_line_and_a_very_long_text(frame):
    """Lines of one template with words of their own stay; a text of 200,000 words is handled whole."""
    common = [f"t{j}" for j in range(24)]
    rows = [(i, " ".join(common + [f"own{i}x{j}" for j in range(8)])) for i in range(300)]
    long = "\n".join(" ".join(f"w{i}x{j}" for j in range(20)) for i in range(10_000))
    rows += [(500, long), (501, long + "\n" + " ".join(f"w7x{j}" for j in range(19)) + " changed"), (502, "a " * 50_000)]
    got = {r.doc_id: r.text for r in L.dedup(frame(rows)).collect()}
    assert {i: got[i] for i in range(300)} == dict(rows[:300])
    assert got[500] == long and got[501] == "" and got[502] == "a " * 50_000


@pytest.mark.parametrize("batch", ("3", "1000"))
def test_shared_keys_from_one_sort(spark, batch):
    rnd = random.Random(4)
    rows = [(rnd.randrange(60), rnd.randrange(4)) for _ in range(150)] + [(7, 1)] * 20 + [(100, 5)] * 9 + [(101, x % 7) for x in range(40)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    got = {(r.key, r.line) for r in L.shared_only(spark.createDataFrame(rows, "key long, line long")).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    lines = {}
    for k, v in rows:
        lines.setdefault(k, set()).add(v)
    assert got == {(k, v) for k, v in rows if len(lines[k]) > 1}


def test_members_of_keys_are_not_written_before_their_first_lines(frame):
    """A table of all members of shared keys was written only to be read once."""
    from tessera.llm.common import tracked

    rows = [(i, " ".join(f"w{j}" for j in range(20)) + f" x{i}") for i in range(6)]
    tables = []
    with tracked(tables):
        got = {r.doc_id: r.text for r in L.dedup(frame(rows)).collect()}
    names = [t.rsplit("/", 1)[1] for t in tables]
    assert got[0] == rows[0][1] and not any(got[i] for i in range(1, 6))
    assert "first_lines" in names and "members" not in names
