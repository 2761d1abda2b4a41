"""Made-up values for text functions, decisions, captions, scene bounds and stores."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import evidence as E
from tessera.functions import jsontext, text
from tessera.operators import evidence as O
from tessera.operators import keys as K
from tessera.operators import ranking as R
from tessera.operators import sequences as S
from tessera.operators import vector as V
from tessera.solvers import allocation as A
from tessera.solvers import narration as N
from tessera.sources import files, sinks


def values(spark, column, items, kind="string"):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, x {kind}")
    return [r.y for r in rows.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_plain_decomposes_all_letters(spark):
    given = ["Dvořák Ştefan", "ﬁne Åse Ǆ", "²³ ½ x", "İstanbul", "Straße", None, "", "Ｆｕｌｌ"]
    assert values(spark, text.plain, given) == ["dvorak stefan", "fine ase", "23 x", "istanbul", "stra e", None, "", "full"]
    assert values(spark, text.squeezed, ["Éa-b C"]) == ["eabc"]


def test_redaction_leaves_no_token_readable(spark):
    a, b = "A" * 26, "B" * 30
    given = [
        f"GET https://h.example/{a}/{b}/x?key=S3CRET&z=1",
        "Authorization: Bearer abc123.def456-ghi",
        "shot ad7facb2586f_000 skipped",
        f"no url /{a}",
        f"https://h/{a} https://h/p/{b}",
        "a?token=t1'b",
    ]
    got = values(spark, text.redact, given)
    assert got == ["GET https://h.example/***/***/x?key=***&z=1", "Authorization: Bearer ***", given[2], given[3], "https://h/*** https://h/p/***", "a?token=***'b"]


def test_redacted_keys_keep_the_json_whole(spark):
    raw = json.dumps({"token": 'ab"SECRET', "a": [{"Secret": "x\\", "y": "z"}], "n": 1})
    got = json.loads(values(spark, lambda c: jsontext.redact_keys(c, ["token", "secret"]), [raw])[0])
    assert got == {"token": "***", "a": [{"Secret": "***", "y": "z"}], "n": 1}


def test_url_titles(spark):
    given = ["https://h.org/w/caf%C3%A9-bar_x.jpg", "https://h.org/", "https://h.org/bad%zz-name", "https://h.org/a/Porto.City.png?x=1"]
    assert values(spark, text.url_title, given) == ["café bar x", "h org", "bad zz name", "Porto City"]
    assert values(spark, text.slug_title, ["https://p/video/gothic-aerial_view-12/", None]) == ["gothic aerial view 12", ""]


def test_truncate_cuts_at_punctuation(spark):
    long = "word " * 17 + "end. Then " + "more " * 30
    got = values(spark, lambda c: text.truncate(c, 120), [long, "short  one", "x" * 200])
    assert got == [" ".join(("word " * 17 + "end").split()) + "...", "short one", "x" * 120 + "..."]


def test_spoken_text(spark):
    given = ["```a\nb", "![a photo](u) of snake_case and __bold__", "> said *so*", "a\n\n \n\nb", "# Hi **you** \U0001f600_x_\n\n\n\nsee [the page](http://a/b) and `f(x)`  <i>now</i>", None, "  a  b ", "x ```\ncode\n``` y"]
    assert values(spark, text.spoken, given) == ["", "a photo of snake_case and bold", "said so", "a\n\nb", "Hi you x\n\nsee the page and f(x) now", "", "a b", "x y"]


def test_objects_are_read_from_fences_lists_and_remarks(spark):
    given = ['```json\n{"k": 1}\n```', 'note {"k": 2} done', '[{"k": 3}, {"k": 4}]', "```\n[{\"k\": 5}]\n``` x", '{"k": ', "", None]
    assert [r and r.k for r in values(spark, lambda c: jsontext.read_object(c, "k long"), given)] == [1, 2, 3, 5, None, None, None]


def test_confirmation_states(spark):
    rows = [(0.9, ["a"], False, False), (0.9, [], True, False), (0.8, ["a", "b"], False, False), (0.8, ["a", "a"], False, False), (0.69, ["a", "b"], False, False), (0.1, None, None, True), (None, ["a", "b"], False, False)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, c double, f array<string>, r boolean, x boolean")
    got = [r.s for r in df.select("i", E.confirmation(F.col("c"), F.col("f"), F.col("r"), F.col("x")).alias("s")).orderBy("i").collect()]
    assert got == ["confirmed", "rejected", "corroborated", "rejected", "rejected", "retry", "rejected"]


def test_until_target_equals_a_loop(spark):
    rnd = random.Random(2)
    rows = [(k, i, rnd.random() < 0.4, float(rnd.randrange(1, 9))) for k in range(6) for i in range(rnd.randrange(1, 30))]
    df = spark.createDataFrame(rows, "k long, i long, ok boolean, s double")
    got = {(r.k, r.i, r.batch) for r in O.until_target(df, ["k"], ["i"], F.col("ok"), F.col("s"), 12.0, 3, 4, 5).collect()}
    want = set()
    for k, own in itertools.groupby(rows, lambda r: r[0]):
        own, seconds, shots = list(own), 0.0, 0
        for b in range(5):
            if seconds >= 12.0 and shots >= 3:
                break
            for _, i, ok, s in own[4 * b : 4 * b + 4]:
                want.add((k, i, b))
                seconds, shots = seconds + s * ok, shots + ok
    assert got == want


def test_at_rank_equals_sorting(spark):
    rnd = random.Random(7)
    rows = [(k, rnd.choice((None, 0.0, rnd.gauss(0, 50), float(rnd.randrange(5))))) for k in "abc" for _ in range(500)] + [("d", 3.0)] * 9 + [("e", None), ("f", float("nan"))]
    rows += [("h", rnd.paretovariate(0.2) * 10.0 ** rnd.randrange(-200, 100)) for _ in range(6000)] + [("i", 1.0)] * 3000 + [("i", 1e300)] + [("j", float(i)) for i in range(20_000)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    for q in (1, 50, 95, 100):
        got = {r.k: r.v for r in R.at_rank(df, ["k"], "v", lambda n: F.ceil(n * q / 100)).collect()}  # noqa: B023
        for k in "abcdhij":
            v = sorted(x for g, x in rows if g == k and x is not None)
            assert got[k] == v[max(1, -(-len(v) * q // 100)) - 1]
        assert set(got) == set("abcdhij")


def test_before_in_order_equals_lag(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice(("a", "b", None)), i * rnd.choice((1, 7)), i) for i in range(1, 400)]
    rows = list({(k, o): (k, o, v) for k, o, v in rows}.values())
    got = {(r.k, r.o): r.b for r in S.before_in_order(spark.createDataFrame(rows, "k string, o long, v long"), ["k"], "o", "v", "b", 16).collect()}
    for k in ("a", "b", None):
        own = sorted((o, v) for g, o, v in rows if g == k)
        for (o, _), before in zip(own, [None] + [v for _, v in own]):
            assert got[k, o] == before


@pytest.mark.parametrize("most", (2, 6, 12))
def test_near_hashes_equal_all_pairs(spark, most):
    rnd = random.Random(most)
    base = [rnd.getrandbits(64) for _ in range(12)]
    hashes = []
    for i in range(120):
        h = rnd.choice(base)
        for bit in rnd.sample(range(64), rnd.randrange(0, most + 3)):
            h ^= 1 << bit
        hashes.append(h - (1 << 64) if h >> 63 else h)
    got = {(r.i, r.other_id, r.distance) for r in K.near_hashes(spark.createDataFrame(list(enumerate(hashes)), "i long, h long"), "i", "h", most).collect()}
    d = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    assert got == {(i, j, d(a, b)) for i, a in enumerate(hashes) for j, b in enumerate(hashes) if i < j and d(a, b) <= most} and got


def test_enrich_fills_and_keeps(spark):
    now = spark.createDataFrame([(1, "a", None, "old"), (2, "", "x", "old")], "k int, first string, fill string, new string")
    more = spark.createDataFrame([(1, "b", "y", "new"), (3, "c", "z", "n")], "k int, first string, fill string, new string")
    got = {r.k: tuple(r)[1:] for r in K.enrich(now, more, ["k"], ["first"]).collect()}
    assert got == {1: ("a", "y", "new"), 2: (None, "x", "old"), 3: ("c", "z", "n")}


@pytest.mark.parametrize("rows", (10_000, 3))
def test_best_of_bank_in_one_block_and_in_many(spark, monkeypatch, rows):
    monkeypatch.setattr(V, "BANK_ROWS", rows)
    vectors = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(9)] + [(99, [0.0, 0.0])], "id long, embedding array<double>")
    bank = spark.createDataFrame([(b, [float(b % 4), 1.0]) for b in range(8)], "bank_label long, mean array<double>")
    got = {r.id: r.best for r in V.best_of_bank(vectors, bank, "id", F.col("s")).collect()}
    assert {i: got[i] for i in range(9)} == {i: i % 3 for i in range(9)}


def test_rematch_reasons(spark):
    now = [("a", 1, 5.0, True), ("a", 2, 5.0, False), ("b", 3, 5.0, True), ("c", 4, 1.0, True), ("d", 5, 9.0, False), ("e", 6, 5.0, True)]
    pool = [("a", 10, 6.0, False), ("b", 11, 9.0, True), ("d", 12, 8.0, False), ("e", 13, 5.0, False), ("e", 6, 5.0, False)]
    make = lambda r: spark.createDataFrame(r, "scene string, shot long, score double, bad boolean")
    got = {(r.scene, r.shot): r.state for r in O.rematch(make(now), make(pool), "scene", F.col("bad"), ~F.col("bad"), "score").collect()}
    assert got == {("a", 10): "replaced", ("a", 2): "replaced", ("b", 3): "breaks the brief", ("c", 4): "no alternative", ("d", 5): "worse", ("e", 13): "replaced"}


def test_caption_rows_keep_their_limits():
    rnd = random.Random(1)
    for _ in range(60):
        at, words = 0.0, []
        for _ in range(rnd.randrange(1, 60)):
            d = rnd.choice((0.01, 0.2, 0.4, 1.5))
            words.append(("x" * rnd.choice((1, 3, 8, 50)), at, at + d))
            at += d + rnd.choice((0, 0, 0.6))
        rows = N.caption_rows(words)
        assert all(round(e - s, 3) >= 0.5 and t.count("\n") < 2 for s, e, t in rows)
        assert all(a[1] <= b[0] + 1e-9 or a[0] > b[0] for a, b in zip(rows, rows[1:]))
    assert N.caption_rows([("a", 0.0, 0.04)]) == []
    assert N.caption_rows([("hi", 0.0, 0.3), ("there", 0.3, 0.9)]) == [(0.0, 1.0, "hi there")]
    # the first cue is shown for a second, so both meet in the middle
    got = N.caption_rows([("a" * 42, 0.0, 0.2), ("b" * 42, 0.2, 0.5), ("c", 0.6, 1.9)])
    assert got == [(0.0, 0.8, "a" * 42 + "\n" + "b" * 42), (0.8, 1.9, "c")]
    # every word stands in one cue, in order, and lines keep their width
    words = [("x" * n, float(i), i + 0.9) for i, n in enumerate((3, 30, 9, 9, 41, 60, 1, 1))]
    lines = [x for _, _, t in N.caption_rows(words, most=100.0) for x in t.split("\n")]
    assert " ".join(lines).split() == [w for w, _, _ in words] and all(len(x) <= 42 or " " not in x for x in lines)


def test_scene_bounds():
    assert N.by_silences(2, [(4.0, 5.0), (9.8, 9.9)], 10.0) == [(0.0, 4.0), (5.0, 9.8)]
    assert N.by_silences(3, [(1.0, 1.5)], 10.0) is None
    assert N.by_silences(2, [(2.0, 2.5), (3.0, 3.5), (8.0, 8.5)], 10.0) == [(0.0, 3.0), (3.5, 10.0)]
    words = [(w, float(i), i + 0.9) for i, w in enumerate("the red house and then a blue garden wall".split())]
    got = N.by_terms([["house"], ["garden"], []], words, 9.0)
    assert got == [(2.0, 2.9, 0.85, "house"), (5.0, 7.9, 0.85, "a"), (7.9, 9.0, 0.2, "")]  # a word that a term holds counts too


def test_most_scenes_are_met_in_order():
    """Rising places against a search through all choices."""
    rnd = random.Random(3)
    for _ in range(200):
        words = [rnd.choice("abcd") for _ in range(rnd.randrange(0, 7))]
        terms = [[rnd.choice("abcde")] if rnd.random() < 0.8 else [] for _ in range(rnd.randrange(1, 5))]
        got = N.first_hits(terms, words)
        choices = [[None, *[i for i, w in enumerate(words) if w in own]] for own in terms]
        rising = [c for c in itertools.product(*choices) if [x for x in c if x is not None] == sorted({x for x in c if x is not None})]
        most = max(sum(x is not None for x in c) for c in rising)
        assert tuple(got) in rising and sum(x is not None for x in got) == most
    # the term of the first scene comes again later; the others are met only if it takes the early one
    assert N.first_hits([["x"], ["y"], ["z"]], ["x", "y", "z", "x"]) == [0, 1, 2]


def test_sessions_close_by_pause_length_and_entity(spark):
    rows = [("v", 0, 0.0, 5.0, None, False), ("v", 1, 5.5, 8.0, "Ribeira", True), ("v", 2, 8.0, 12.0, "Torre", True), ("v", 3, 12.0, 20.0, None, False), ("v", 4, 20.0, 27.0, "x", False)]
    got = N.sessions(spark.createDataFrame(rows, "v string, n long, start double, end double, entity string, strict boolean"), "v").orderBy("scene").collect()
    assert [(r.start, r.end, r.sentences, r.entity, r.beat) for r in got] == [(0.0, 5.0, 1, "", "hook"), (5.5, 8.0, 1, "Ribeira", "detail"), (8.0, 20.0, 2, "Torre", "detail"), (20.0, 27.0, 1, "x", "payoff")]


def test_timeline_states(spark):
    rows = [
        ("v", 1, 1, 1, "s", 0.9, True, True), ("v", 1, 2, 2, "s", 1.0, True, False), ("v", 2, 3, 1, "s", 0.9, True, True), ("v", 2, 4, 3, "t", 0.85, True, True),
        ("v", 3, 5, 4, "t", 0.9, True, False), ("v", 4, 6, 5, "x", 0.5, False, True), ("v", 5, 7, 6, "t", 0.5, True, True),
    ]
    got = {r.slot: (r.shot, r.state) for r in A.plan_timeline(spark.createDataFrame(rows, "v string, slot long, shot long, media long, signature string, score double, allowed boolean, fits boolean"), "v").collect()}
    assert got == {1: (1, "planned"), 2: (4, "planned"), 3: (5, "off contract"), 4: (None, "empty"), 5: (7, "repeated")}


def test_caption_files_keep_their_order(spark, tmp_path):
    rows = [(v, i, float(i), i + 0.5, f"l{i}") for v in (1, 2) for i in range(12)]
    random.Random(3).shuffle(rows)
    cues = spark.createDataFrame(rows, "v long, cue long, start double, end double, line string").repartition(5)
    for kind in ("srt", "vtt"):
        sinks.write_captions(cues, f"{tmp_path}/{kind}", "v", kind)
        for v in (1, 2):
            (file,) = (tmp_path / kind / f"v={v}").glob("*.txt")
            blocks = file.read_text().removeprefix("WEBVTT\n\n").rstrip("\n").split("\n\n")
            assert [b.rsplit("\n", 1)[1] for b in blocks] == [f"l{i}" for i in range(12)]
    assert (tmp_path / "srt" / "v=1").glob("*.txt").__next__().read_text().startswith("1\n00:00:00,000 --> 00:00:00,500\nl0\n\n2\n")


def test_library_walks_subfolders(spark, tmp_path):
    rows = [("a/x.MP4", b"12"), ("a/x.meta.json", b'{"title": "T"}'), ("b/c/y.png", b"1"), ("z.exe", b"1"), ("b/w.mp3", b"123"), ("b/empty.mp3", b""), ("b/w.meta.json", b"broken")]
    files.write_files(spark.createDataFrame(rows, "name string, content binary"), f"file://{tmp_path}/l").count()
    got = {(r["name"], r.kind, r.bytes, r.title) for r in files.library(spark, f"{tmp_path}/l", "title string").collect()}
    assert got == {("x.MP4", "video", 2, "T"), ("y.png", "image", 1, None), ("w.mp3", "audio", 3, None)}


def test_balanced_objects(spark):
    """Braces inside strings, two objects, objects that are not closed, quotes in remarks; against a plain scanner."""
    given = [
        'He said "go: {"a": "}{", "b": {"c": 1}} and {"d": "x\\\\"} end', None, "", "no braces", "} { } {", '{"open": {"x": 1}', '{"a": "\\"}"} tail }', "{}{}", '{"é": "\U0001f600}"}x', '"{" {"k": 2}', "{'a': '}'}",
    ]

    def plain(t):
        t = t or ""
        t = t[t.find("{") : t.rfind("}") + 1] if "{" in t and "}" in t[t.find("{") :] else ""
        out, depth, text, escape, start = [], 0, False, False, 0
        for i, c in enumerate(t):
            if text:
                text, escape = (c != '"' or escape), c == "\\" and not escape
            elif c == '"' and depth:
                text = True
            elif c == "{":
                start, depth = (i if not depth else start), depth + 1
            elif c == "}" and depth:
                depth -= 1
                out += [t[start : i + 1]] if not depth else []
        return out

    rnd = random.Random(7)
    given += ["".join(rnd.choice('{}"\\ax') for _ in range(rnd.randrange(0, 25))) for _ in range(300)]
    assert values(spark, jsontext.objects, given) == [plain(t) for t in given]
    assert values(spark, jsontext.first_valid, ['x {bad} {"a": 1} {"b": 2}', "{bad}", None]) == ['{"a": 1}', None, None]


def test_split_within_keeps_the_text(spark):
    rnd = random.Random(2)
    given = [None, "", "short", "x" * 95, "One. Two! Three, four; five six\n\nNew paragraph here. " * 5]
    given += ["".join(rnd.choice(["word", "Long-word-without-end", ". ", ", ", "\n\n", " ", "é", "? "]) for _ in range(rnd.randrange(1, 60))) for _ in range(80)]
    for most in (10, 40):
        got = values(spark, lambda c: text.split_within(c, most), given)
        assert ["".join(p) for p in got] == [t or "" for t in given]
        assert all(0 < len(x) <= most for p in got for x in p)
    assert values(spark, lambda c: text.split_within(c, 30), ["First one. Second one here. A third, with a clause that is long."]) == [["First one. Second one here. ", "A third, ", "with a clause that is long."]]


def test_capital_phrases(spark):
    got = values(spark, lambda c: text.capital_phrases(c, ["of", "do", "de"]), ["the Palace of Porto and Vila Nova de Gaia, Porto again: Palace of Porto", "none here", None])
    assert got == [["Palace of Porto", "Vila Nova de Gaia", "Porto"], [], None]
