import re

from tessera.llm import quality_rules as Q


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = {}
    for x in tri:
        count[x] = count.get(x, 0) + 1
    marked = {i + j for i, x in enumerate(tri) if count[x] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(marked)


CASES = [(1, None), (2, ""), (3, " \n\t \n"), (4, "a b c a b c d"), (5, "a a a a a"), (6, "é\U0001f600 #$ x\nx\n\nx\n y"), (7, "a b"), (None, "a b c"), (8, "w " * 3000)]


def test_measures_equal_brute_force(frame, spark, sf_dir):
    for docs in (frame(CASES), spark.read.parquet(f"{sf_dir}/documents.parquet")):
        for r in Q.measures(docs).collect():
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(r.text)


def test_fences_follow_their_group(frame):
    rows = [(i, " ".join(f"word{i}x{j}" for j in range(60)), "en", "a") for i in range(80)]
    rows += [(1000 + i, " ".join(f"#w{i}#{j}#" for j in range(60)), "en", "b") for i in range(80)]
    rows += [(2000, " ".join(f"#w#{j}#" for j in range(60)), "en", "a"), (2001, None, None, None), (2002, "short text", "en", None)]
    got = {r.doc_id: r for r in Q.judge(frame(rows)).collect()}
    assert len(got) == len(rows)
    assert all(got[i].kept for i in range(80)) and all(got[1000 + i].kept for i in range(80))
    assert not got[2000].kept and not got[2000].base_failed
    assert got[2001].base_failed and got[2002].base_failed


def test_empty(frame):
    assert Q.judge(frame([])).count() == 0


def test_fences_equal_plain_quartiles(frame, spark, sf_dir):
    """Fences by sorting each group's values; a sketch is off by 2 % at most."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [r.asDict() for r in Q.measures(docs).collect()]
    values = {}
    for r in rows:
        if r["n_words"]:
            for g in ((r["lang"], r["source"]), None):
                values.setdefault(g, []).append(r["word_chars"] / r["n_words"])
    q = lambda v, p: sorted(v)[max(0, -(-len(v) * p // 100) - 1)]
    for f in Q.fences(Q.sketches(Q.measures(docs))).collect():
        v = values[f.lang, f.source]
        q1, q3 = ((len(v) * q(v, p) + Q.PRIOR_ROWS * q(values[None], p)) / (len(v) + Q.PRIOR_ROWS) for p in (25, 75))
        assert abs(f.mean_word_hi - (q3 + 3 * (q3 - q1))) <= 0.02 * (4 * q3 + 3 * q1)
        assert abs(f.mean_word_lo - (q1 - 3 * (q3 - q1))) <= 0.02 * (4 * q1 + 3 * q3)
        assert f.symbol_share_hi >= Q.MATERIAL["symbol_share"]


def test_equal_hashes_of_different_runs_are_the_only_error(frame):
    """Runs are compared by 64-bit hashes: texts of many different runs have no repeats."""
    rows = [(i, " ".join(f"{i}x{j}" for j in range(5000))) for i in range(4)]
    assert [r.n_repeat_words for r in Q.measures(frame(rows)).collect()] == [0] * 4
