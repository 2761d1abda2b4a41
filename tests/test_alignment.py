"""Violations against rules spelt out in Python for made-up scenes."""

import random

import pytest

from tessera.operators import alignment as A

SEG = "video long, scene long, seg long, t_in double, t_out double, places string, landmarks string, foods string, confirmed boolean"
BRIEF, SPAN, COVER = "scene long, entity string, kind string, strict boolean", "video long, entity string, t_in double, t_out double, strict boolean", "entity string, strict boolean, deficit double"


def brute(segs, briefs, spans, cover, least, promote):
    out = []
    by = {b[0]: b for b in briefs}
    for video, scene, seg, a, b, places, landmarks, foods, confirmed in segs:
        if scene not in by or not by[scene][3] or not by[scene][1]:
            continue
        _, entity, kind, _ = by[scene]
        names = {s[1].strip().lower() for s in spans if s[0] == video and s[4] and min(b, s[3]) - max(a, s[2]) > least}
        if len(names) > 1:
            out.append((scene, seg, "segment_crosses_entity_boundary", "strict", ",".join(sorted(names))))
        where = {"food": [foods], "landmark": [landmarks, places], "building": [landmarks, places], "attraction": [landmarks, places]}.get(kind, [places, landmarks, foods])
        if not any(f" {entity.lower()} " in f" {(w or '').lower()} " for w in where):
            name = "wrong_food_entity" if kind == "food" else "wrong_landmark_entity" if kind in ("landmark", "building", "attraction") else "generic_for_strict_entity" if not any((w or "").strip() for w in (places, landmarks, foods)) else "missing_required_entity"
            out.append((scene, seg, name, "strict", entity))
        if not confirmed:
            out.append((scene, seg, "unconfirmed_entity", "strict" if promote else "warning", entity))
    return sorted(out + [(None, -1, "entity_coverage_gap", "warning", e) for e, strict, d in cover if strict and d > 0], key=str)


@pytest.mark.parametrize("promote,least", [(False, 0.5), (True, 0.0)])
def test_equals_the_rules_in_python(spark, promote, least):
    rnd = random.Random(5)
    names = ["torre", "ribeira", "clerigos tower", "francesinha"]
    text = lambda: rnd.choice([None, "", " ", *names, "old torre wall", "torres"])
    segs = [(s // 3, s, i, 7.0 * i, 7.0 * i + rnd.choice((0.3, 5.0, 25.0)), text(), text(), text(), rnd.choice((True, False, None))) for s in range(40) for i in range(3)]
    briefs = [(s, rnd.choice([*names, "", None]), rnd.choice(["food", "landmark", "building", "place", None]), rnd.random() < 0.8) for s in range(38)]
    spans = [(rnd.randrange(14), rnd.choice(["Torre ", "torre", "Ribeira", "x"]), t, t + rnd.choice((0.2, 4.0, 30.0)), rnd.random() < 0.7) for t in [rnd.random() * 40 for _ in range(60)]]
    cover = [("a", True, 3.0), ("b", True, 0.0), ("c", False, 9.0)]
    frames = [spark.createDataFrame(x, k) for x, k in ((segs, SEG), (briefs, BRIEF), (spans, SPAN), (cover, COVER))]
    got = A.violations(*frames, least=least, promote=promote)
    got = sorted(((r.scene, r.seg, r.violation, r.severity, r.expected) for r in got.collect()), key=str)
    want = brute(segs, briefs, spans, cover, least, promote)
    assert got == want
    assert {v for _, _, v, _, _ in want} == set(A.SEVERITY)


def test_empty_tables(spark):
    frames = [spark.createDataFrame([], k) for k in (SEG, BRIEF, SPAN)]
    assert A.violations(*frames).count() == 0
