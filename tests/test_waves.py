"""Waves against a plain loop, with reruns and stop rules."""

import random

import pytest

from tessera.operators import waves as W

OFFER, NEED = "entity string, item long, seconds double, tier int, place long", "entity string, required double"


def loop(need, offers, tiers, max_waves, most):
    taken, idle = {}, 0
    for wave in range(max_waves):
        have = {e: 0.0 for e, _ in need}
        for _, (e, s, _, _) in taken.items():
            have[e] = have.get(e, 0.0) + s
        lack = {e: r - have[e] for e, r in need if r - have[e] > 0}
        if not lack:
            return taken, "covered", wave
        best = {}
        for e, i, s, t, p in offers:
            if t == wave % tiers and i not in taken and e in lack:
                best[i] = min(best.get(i, (-lack[e], e, p, s)), (-lack[e], e, p, s))
        per = {}
        for i, (d, e, p, s) in best.items():
            per.setdefault((d, e), []).append((p, i, s))
        wanted = []
        for (d, e), items in sorted(per.items()):
            total = 0.0
            for p, i, s in sorted(items):
                if total < -d:
                    wanted.append((i, e, s))
                total += s
        for i, e, s in wanted[:most]:
            taken[i] = (e, s, wave % tiers, wave)
        idle = 0 if wanted else idle + 1
        if idle >= tiers:
            break
    have = {}
    for e, s, _, _ in taken.values():
        have[e] = have.get(e, 0.0) + s
    done = all(have.get(e, 0.0) >= r for e, r in need)
    return taken, "covered" if done else "exhausted" if idle >= tiers else "limit", wave + 1


def made(seed):
    rnd = random.Random(seed)
    need = [(f"e{k}", float(rnd.randrange(0, 60))) for k in range(6)]
    offers = [(f"e{rnd.randrange(8)}", i, float(rnd.randrange(1, 9)), rnd.randrange(3), rnd.randrange(20)) for i in range(120) for _ in range(rnd.randrange(1, 3))]
    return need, list({(e, i): (e, i, s, t, p) for e, i, s, t, p in offers}.values())


@pytest.mark.parametrize("seed,most,max_waves", [(1, 1000, 8), (2, 7, 5), (3, 3, 40)])
def test_equals_a_plain_loop(spark, tmp_path, seed, most, max_waves):
    need, offers = made(seed)
    offers = [(e, i, float(1 + i % 7), t, p) for e, i, _, t, p in offers]  # an item is as long for everyone
    store = W.store_of(spark, f"file://{tmp_path}/s")
    report = W.fill(store, spark.createDataFrame(need, NEED), spark.createDataFrame(offers, OFFER), 3, min(max_waves, 10), most)
    want, reason, n = loop(need, offers, 3, min(max_waves, 10), most)
    assert {r["item"]: (r.entity, r.seconds, r.tier, r.wave) for r in store.read().collect()} == want
    assert (report.reason, report.waves) == (reason, n)


def test_a_rerun_goes_on_and_then_changes_nothing(spark, tmp_path):
    need, offers = made(4)
    need_df, offer_df = spark.createDataFrame(need, NEED), spark.createDataFrame(offers, OFFER)
    whole, cut = W.store_of(spark, f"file://{tmp_path}/a"), W.store_of(spark, f"file://{tmp_path}/b")
    W.fill(whole, need_df, offer_df, 3, 6)
    W.fill(cut, need_df, offer_df, 3, 2)
    W.fill(cut, need_df, offer_df, 3, 6)
    rows = lambda s: sorted(map(tuple, s.read().collect()))
    assert rows(cut) == rows(whole)
    before = cut.versions()
    W.fill(cut, need_df, offer_df, 3, 6)
    assert cut.versions() == before


def test_nothing_to_do(spark, tmp_path):
    empty = spark.createDataFrame([], OFFER)
    store = W.store_of(spark, f"file://{tmp_path}/a")
    assert W.fill(store, spark.createDataFrame([("a", 0.0)], NEED), empty, 3).reason == "covered"
    assert W.fill(store, spark.createDataFrame([("a", 1.0)], NEED), empty, 2).reason == "exhausted"
