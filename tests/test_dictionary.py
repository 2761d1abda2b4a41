"""Dictionary matching against a search at every place, and entity mentions."""

import random

import pytest

from tessera.operators import dictionary as D


def brute(docs, terms):
    out = []
    for i, t in docs:
        w = (t or "").split()
        for k, a in terms:
            a = (a or "").split()
            out += [(i, s, len(a), k) for s in range(len(w) - len(a) + 1) if a and w[s : s + len(a)] == a]
    return sorted(out)


def greedy(found):
    out = {}
    for i, s, n, k in sorted(found, key=lambda r: (r[0], r[1], -r[2], r[3])):
        kept = out.setdefault(i, [])
        if not kept or s >= kept[-1][1] + kept[-1][2]:
            kept.append((i, s, n, k))
    return sorted(x for v in out.values() for x in v)


def made(n_docs=60, n_terms=400):
    rnd = random.Random(6)
    vocab = [f"w{i}" for i in range(30)] + ["the", "of"]
    docs = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randrange(0, 60)))) for i in range(n_docs)] + [(900, None), (901, "")]
    terms = [(k, " ".join(rnd.choice(vocab) for _ in range(rnd.randrange(1, 5)))) for k in range(n_terms)]
    return docs, terms + [(5000, None), (5001, ""), (5002, "the the the"), (5003, "the"), (5004, "the")]


@pytest.mark.parametrize("few", (D.FEW, 10))
def test_equals_a_search_at_every_place(spark, few):
    docs, terms = made()
    d, t = spark.createDataFrame(docs, "id long, text string").repartition(3), spark.createDataFrame(terms, "k long, alias string")
    found = D.matches(d, "id", "text", t, "k", "alias", few)
    want = brute(docs, terms)
    assert sorted((r.doc, r.start, r.n, r.term) for r in found.collect()) == want and len(want) > 500
    assert sorted((r.doc, r.start, r.n, r.term) for r in D.longest(found).collect()) == greedy(want)


def test_no_product_of_texts_and_terms(spark):
    docs, terms = made(20, 50)
    d, t = spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(terms, "k long, alias string")
    for few in (D.FEW, 10):
        plan = D.matches(d, "id", "text", t, "k", "alias", few)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_a_hundred_thousand_terms(spark):
    terms = spark.range(100_000).selectExpr("id AS k", "concat('term', id % 5000, ' x', id) AS alias")
    docs = spark.range(200).selectExpr("id", "concat('a term', id * 7 % 5000, ' x', id * 7, ' b term1 x2') AS text")
    found = D.matches(docs, "id", "text", terms, "k", "alias").collect()
    assert sorted((r.doc, r.start, r.n, r.term) for r in found) == [(i, 1, 2, 7 * i) for i in range(200)]


def test_normal_forms_meet(spark):
    docs = spark.createDataFrame([(1, "Ponte  DOM Luís, à noite")], "id long, text string")
    terms = spark.createDataFrame([(1, "ponte dom luis"), (2, "Luís à"), (3, "onte")], "k long, alias string")
    assert sorted((r.start, r.term) for r in D.matches(docs, "id", "text", terms, "k", "alias").collect()) == [(0, 1), (2, 2)]


def test_translation_by_cache_or_parts(spark):
    e = spark.createDataFrame([(1, "torre", "tower", None), (2, "rio", None, "Porto"), (3, None, None, None)], "k long, name string, kind string, place string")
    cache = spark.createDataFrame([("torre", "tower", None, "  old \n stone   tower "), ("torre", "tower", "", "zz"), ("rio", "", "Porto", " ")], "name string, kind string, place string, said string")
    got = {r.k: (r.phrase, r.from_cache) for r in D.translated(e, cache, ["name", "kind", "place"], "said").collect()}
    assert got == {1: ("old stone tower", True), 2: ("rio Porto", False), 3: ("", False)}


def test_runs_of_capitals(spark):
    docs = spark.createDataFrame([(1, "We saw Dom Luis, Porto and the Douro River. It Was"), (2, None), (3, "Only")], "id long, text string")
    got = sorted((r.id, r.start, r.n, r.entity) for r in D.capital_runs(docs, ["id"], "text").collect())
    assert got == [(1, 2, 2, "Dom Luis"), (1, 4, 1, "Porto"), (1, 7, 2, "Douro River"), (1, 9, 2, "It Was")]
