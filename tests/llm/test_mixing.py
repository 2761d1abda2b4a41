import pytest

from tessera.llm import mixing as M


def test_totals_meet_targets_and_caps(frame):
    rows = [(i, " ".join(["w"] * (i % 50)), "en", ["a", "b", "c", None][i % 4]) for i in range(400)] + [(1000, None), (None, "x y"), (None, "x y"), (7, "one two")]
    got = M.mix_totals(frame(rows), block=16).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        by.setdefault(r.source, [r.target, r.source_size, 0])[2] += r.taken
    for target, size, taken in by.values():
        assert target <= 2 * size + 1e-9 and abs(target - taken) < 1
    assert sum(x[0] for x in by.values()) == pytest.approx(1.5 * sum(x[1] for x in by.values()))


def test_reruns_agree_and_prefixes_are_mixed(frame):
    rows = [(i, "w " * 40, "en", "abc"[i % 3]) for i in range(300)]
    a = sorted(M.mix(frame(rows), block=8, share=1.0).collect())
    assert a == sorted(M.mix(frame(rows[::-1]), block=8, share=1.0).collect())
    slots = sorted({(r.slot, r.source) for r in a})
    half = [s for _, s in slots[: len(slots) // 2]]
    whole = [s for _, s in slots]
    for s in "abc":
        assert abs(half.count(s) / len(half) - whole.count(s) / len(whole)) < 0.02


def test_empty(frame):
    assert M.mix_totals(frame([])).count() == 0
    assert M.mix_totals(frame([(1, ""), (2, None)])).filter("taken = 0").count() == 2


def test_extra_columns_and_a_very_long_text(frame):
    """Columns with the names of results do not get in the way; a text of 200,000 words is taken piece by piece."""
    from pyspark.sql import functions as F

    rows = [(1, "w " * 200_000, "en", "a"), (2, "w " * 10, "en", "b"), (3, None, "en", "b")]
    docs = frame(rows).withColumns({n: F.lit("x") for n in ("size", "target", "taken", "sid", "rank", "chunk", "ordinal", "slot", "quota", "start", "source_size")})
    got = {r.doc_id: (r["size"], r.taken) for r in M.mix_totals(docs).collect()}
    assert got == {r.doc_id: (r["size"], r.taken) for r in M.mix_totals(frame(rows)).collect()}
    assert got[1][0] == 200_000 and got[3] == (0, 0) and sum(t for _, t in got.values()) == 300_015


def test_the_driver_plans_few_joins_at_once(frame):
    """The whole schedule was part of the last plan: 28 exchanges over all, and the driver's memory went beyond its budget."""
    rows = [(i, "w " * (i % 9), "en", "abc"[i % 3]) for i in range(60)]
    plan = M.mix_totals(frame(rows), block=8)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 6
