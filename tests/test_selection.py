"""Scores and contract rules of single candidates with known answers."""

import pytest

from tessera.operators import selection as S

CAND = "i int, similarity double, quality double, uses double, source_uses long, places string, landmarks string, confirmed boolean, entities array<string>, excluded array<string>"


def test_scores_term_by_term(spark):
    rows = [
        (0, 0.5, 2.0, None, None, None, None, None, None, None), (1, 0.5, 0.0, 2.0, 1, "", "", False, [], []), (2, 0.0, 0.0, 0.0, 0, "Porto", "Torre dos Clérigos, x", True, ["torre"], []),
        (3, 0.0, 0.0, 0.0, 0, "old TORRE", "y", False, ["", "Torre"], None), (4, 0.0, 0.0, 0.0, 0, "Lisbon", "", False, ["torre"], [" lisbon "]), (5, 0.0, 0.0, 0.0, 0, "Lisbon", "", False, [" "], ["", "paris"]),
    ]
    got = {r.i: r.s for r in spark.createDataFrame(rows, CAND).select("i", S.entity_score().alias("s")).collect()}
    assert got == pytest.approx({0: 0.54, 1: 0.5 - 0.3 - 0.1, 2: 0.2 + 0.15, 3: 0.15, 4: -0.1 - 0.3, 5: 0.0})


def test_contract_rules(spark):
    c = spark.createDataFrame([(1, "metadata_fallback", [" Food"], 0.5, "exact"), (2, None, None, None, None), (3, "vision", ["city_landmark"], 0.9, "Regional "), (4, "metadata_fallback", ["x"], 0.1, "no"), (5, "v", ["a"], 0.6, "exact")], "k long, source string, categories array<string>, confidence double, truth string")
    m = spark.createDataFrame([(1, True, ["food"], None, None), (2, True, None, 0.2, True), (3, True, [], 0.9, False), (4, False, ["y"], 0.9, True)], "k long, critical boolean, forbidden array<string>, least double, takes_sights boolean")
    got = {r.k: r.broken for r in S.by_contract(c, m, "k").collect()}
    assert got == {1: ["weak_source", "forbidden_category", "low_confidence"], 2: ["low_confidence", "truth_not_firm"], 3: ["sight_not_taken"], 4: [], 5: []}


def test_briefs(spark):
    from tessera.operators import briefs as B

    rows = [
        (1, 1, "Torre", "landmark", True, "Porto", "x"), (1, 2, None, "food", True, None, "um PRATO de bacalhau"), (1, 3, " ", None, False, "", "a Ponte velha"), (1, 4, None, None, None, "Lisboa", "café e igreja"),
        (1, 5, "Nata", None, None, None, None), (2, 1, None, None, None, None, None), (2, 2, "Pastel", "food", None, None, "pratos"),
    ]
    df = spark.createDataFrame(rows, "v long, n long, entity string, kind string, strict boolean, location string, text string")
    got = {(r.v, r.n): r for r in B.briefs(df, "v", "n").collect()}
    assert got[1, 1].subject == "close-up cinematic shot of Torre in Porto Portugal" and got[1, 1].must_not == ["people"] and got[1, 1].strict and got[1, 1].shot == "close-up"
    assert (got[1, 2].must_have, got[1, 2].must_not, got[1, 2].shot, got[1, 2].location, got[1, 2].strict) == (["food"], ["landmark"], "close-up", "Porto", False)
    assert (got[1, 3].must_have, got[1, 3].shot, got[1, 3].location) == (["landmark"], "wide", "Porto")
    assert got[1, 4].subject == B.GENERAL["street"][0] and got[1, 4].location == "Lisboa"
    assert (got[1, 5].kind, got[1, 5].shot, got[1, 5].mood, got[1, 5].location) == ("other_visual", "medium", "ambiente local", "Lisboa")
    assert got[2, 1].subject == B.GENERAL["street"][0] and got[2, 1].location == "" and got[2, 2].mood == "gastronomia local"
