import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import license_scan as L


def brute(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hits = [(i, label) for label, p in L.PHRASES.items() for i in range(len(w)) if w[i : i + len(p)] == p]
    return len(w), len(hits), min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None), sorted({x for _, x in hits})


CASES = [
    (1, None),
    (2, ""),
    (3, "CC-BY cc by; All rights, reserved. all RIGHTS reserved"),
    (4, "x " * 500 + "Licensed under the Apache License, Version 2.0."),
    (5, "Permission is hereby granted, free of charge, to anyone obtaining a copy of this software and associated documentation files é"),
    (6, "cc"),
    (7, "the general public license of GÉNERAL public"),
    (8, "Licensed under CC BY-NC 4.0. " * 50),
    (8, "Licensed under CC BY-NC 4.0. " * 50),
    (None, "all rights reserved"),
]


def test_base_equals_brute_force(frame, spark, sf_dir):
    for docs in (frame(CASES), spark.read.parquet(f"{sf_dir}/documents.parquet")):
        texts = [(r.doc_id, r.text) for r in docs.collect()]
        got = L.scan(docs).collect()
        assert len(got) == len(texts)
        want = dict(texts)
        for r in got:
            n, k, a, b, labels = brute(want[r.doc_id])
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (n, k, a, b, labels)
            assert set(labels) <= set(r.labels) and 0 <= r.score <= 1


def test_templates_are_found_through_small_edits(frame):
    got = {r.doc_id: r for r in L.scan(frame(CASES)).collect()}
    assert "text:apache-2.0" in got[4].labels and got[4].base_labels == []
    assert "text:mit" in got[5].labels and 0.6 <= got[5].score < 1
    assert "text:cc-by-nc" in got[8].labels
    assert got[7].labels == ["gpl"] and got[6].labels == []


def test_empty(frame):
    assert L.scan(frame([])).count() == 0


def test_short_notices_and_whole_texts(frame):
    from pathlib import Path

    folder = Path(L.__file__).parent / "licenses"
    rows = [
        (1, "a b. Released under the MIT License."),
        (2, "SPDX-License-Identifier: GPL-2.0-only"),
        (3, "distributed under the GNU Lesser General Public License"),
        (4, "This is free and unencumbered software released into the public domain."),
        (5, "under the license of the club"),
        (6, (folder / "GPL-2.txt").read_text()[3000:]),
        (7, (folder / "MPL-2.0.txt").read_text()[200:14000]),
    ]
    got = {r.doc_id: {x for x in r.labels if x.startswith("text:")} for r in L.scan(frame(rows)).collect()}
    assert [got[i] for i in (1, 2, 3, 4, 5)] == [{"text:mit"}, {"text:gpl-2.0"}, {"text:lgpl"}, {"text:unlicense"}, set()]
    assert "text:gpl-2.0" in got[6] and "text:mpl-2.0" in got[7]


def common_words(a, b):
    """Longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(new[-1], row[j + 1], row[j] + (x == y)))
        row = new
    return row[-1]


def test_alignment_equals_a_plain_one(spark):
    rnd = random.Random(3)
    rows = [([rnd.choice("abc") for _ in range(rnd.randrange(1, 15))], [rnd.choice("abc") for _ in range(rnd.randrange(1, 10))]) for _ in range(200)]
    docs = spark.createDataFrame([(w, t, -len(t), len(w)) for w, t in rows], "w array<string>, t array<string>, low int, high int")
    got = docs.select("w", "t", L.aligned(F.col("w"), F.col("t"), F.col("low"), F.col("high")).alias("n")).collect()
    assert all(r.n == common_words(r.t, r.w) for r in got)


def test_words_out_of_order_do_not_pass(frame, spark):
    """Hits cover the template, but its parts stand in the wrong order on neighbouring diagonals."""
    text = "one two three four five six seven eight nine ten eleven twelve"
    templates = L.template_table(spark, {"own": [text]})
    w = text.split()
    rows = [(1, text), (2, " ".join(["x"] * 9 + w[4:8] + w[:4] + w[8:])), (3, " ".join(w[:5] + ["z"] + w[5:]))]
    got = {r.doc_id: r for r in L.scan(frame(rows), templates).collect()}
    assert [got[i].labels for i in (1, 2, 3)] == [["own"], [], ["own"]]
    assert got[1].score == 1.0 and got[3].score == 1.0


def test_no_templates_and_templates_too_short(frame, spark):
    none = spark.createDataFrame([], "label string, template string, text string")
    docs = frame(CASES)
    assert L.scan(docs, none).count() == len(CASES)
    with pytest.raises(ValueError, match="fewer than 4 words"):
        L.scan(docs, L.template_table(spark, {"x": ["only three words"]}))


def test_notices_inside_a_longer_license_give_way(frame):
    """The text of one license names others; two licenses one after another both stay."""
    from pathlib import Path

    from tessera.llm import license_scan as L

    whole = lambda n: (Path(L.__file__).parent / "licenses" / f"{n}.txt").read_text("utf-8")
    mit = L.TEMPLATES["text:mit"][0] if "text:mit" in L.TEMPLATES else next(iter(L.NOTICES.values()))[0]
    docs = frame([(1, whole("GPL-3")), (2, whole("GPL-3") + "\n\n" + mit), (3, mit)])
    got = {r.doc_id: [x for x in r.labels if x.startswith("text:")] for r in L.scan(docs).collect()}
    assert got[1] == ["text:gpl-3.0"]
    assert len(got[3]) == 1 and got[2] == sorted(["text:gpl-3.0", *got[3]])


def test_outermost_spans(spark):
    from tessera.llm import license_scan as L

    rows = [(1, "a", 0, 100, 1.0), (1, "b", 5, 20, 0.9), (1, "a", 30, 40, 0.9), (1, "c", 90, 120, 0.9), (1, "d", 0, 100, 0.8), (2, "b", 5, 20, 0.9)]
    got = L.outermost(spark.createDataFrame(rows, "key long, label string, first int, last int, score double")).collect()
    assert sorted((r.key, r.label, r.first) for r in got) == [(1, "a", 0), (1, "c", 90), (1, "d", 0), (2, "b", 5)]
