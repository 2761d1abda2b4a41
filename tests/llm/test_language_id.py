import zlib

import numpy as np

from tessera.llm import language_id as L
from tessera.llm import queries


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = queries.op7_language_id(spark, sf_dir).collect()
    assert len(got) == len(truth)
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) >= 0.9
    assert all(0 <= r.score <= 1 for r in got)


def test_predictions_use_the_text_alone(frame, spark, sf_dir):
    model = L.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    text = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("lang = 'de'").first().text
    rows = [(1, text, "en", "a"), (None, text, None, None), (3, None), (4, ""), (5, "123 !?"), (6, "é"), (7, text * 50)]
    got = {r.doc_id: r for r in L.predict(frame(rows), model).collect()}
    assert (got[1].lang_pred, got[1].score) == (got[None].lang_pred, got[None].score)
    assert got[1].lang_pred == got[7].lang_pred == "de"
    for i in (3, 4, 5):
        assert (got[i].lang_pred, got[i].score, got[i].accepted) == ("und", 0.0, False)
    assert got[6].lang_pred in model.languages


def test_subwords_do_not_depend_on_the_batch():
    texts = [b"ab cd", "été Haus".encode(), b"", b"x", b"the end"]
    ids, begins = L.subwords(texts)
    for i, t in enumerate(texts):
        assert sorted(ids[begins[i] : begins[i + 1]]) == sorted(L.subwords([t])[0])


def test_empty_and_unlabelled(frame):
    none = frame([(1, "some words", None)])
    assert L.fit(none) is None
    assert L.predict(none, None).first().lang_pred == "und"
    assert L.predict(frame([]), None).count() == 0


def plain_bag(text):
    """Subwords by loops over the runs of letters; hashes as the module defines them."""
    out = {}
    data = bytes(b if L.LETTER[b] else L.EDGE for b in (" " + text.lower() + " ").encode())
    for n in L.NGRAMS:
        for i in range(len(data) - n + 1):
            g = data[i : i + n]
            if L.EDGE in g[1:-1] or (n == 2 and L.EDGE in g) or (g[0] == L.EDGE and g[-1] == L.EDGE):
                continue
            h = n
            for b in g:
                h = (h * 257 + b) % (1 << 64)
            k = int(L.mix(np.array([h], np.uint64))[0] % np.uint64(L.BUCKETS))
            out[k] = out.get(k, 0) + 1
    return out


def plain_score(model, text):
    """(language, score) by loops."""
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    found = plain_bag(text)
    z = model.bias + sum(n * model.weights[k].astype(float) for k, n in found.items()) / sum(found.values())
    p = np.exp(z / model.temperature - max(z / model.temperature))
    p /= p.sum()
    return model.languages[int(p.argmax())], p.max()


def test_predictions_equal_plain_sums(frame, spark, sf_dir):
    """Score and language by loops over each text's subwords, for every document of the table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = L.fit(docs)
    for r in L.predict(docs, model).collect():
        lang, score = plain_score(model, r.text)
        assert lang == r.lang_pred and abs(score - r.score) < 1e-6
        if lang == "und":
            continue
        assert r.accepted == (r.score >= model.threshold)


def test_gradients_equal_differences():
    rng = np.random.default_rng(1)
    emb, out, bias = rng.normal(size=(5, 4)), rng.normal(size=(4, 3)), rng.normal(size=3)
    share, y = np.array([0.1, 0.2, 0.3, 0.3, 0.1]), 1

    def loss(emb, bias):
        z = share @ emb @ out + bias
        return np.log(np.exp(z).sum()) - z[y]

    _, to_mean, to_out = L.gradients(emb, share, out, bias, y)
    for i in range(5):
        for d in range(4):
            step = np.zeros((5, 4))
            step[i, d] = 1e-6
            assert abs((loss(emb + step, bias) - loss(emb - step, bias)) / 2e-6 - share[i] * to_mean[d]) < 1e-6
    for k in range(3):
        step = np.eye(3)[k] * 1e-6
        assert abs((loss(emb, bias + step) - loss(emb, bias - step)) / 2e-6 - to_out[k]) < 1e-6


def test_rare_languages_are_learnt(frame):
    """A language of 40 rows among 4,000 of others, some with a null id or label."""
    rows = [(i, f"the house and the garden of the king {i}", "en") for i in range(4000)]
    rows += [(None, f"xhaq qoph zyx waqf qwerq {i} xhaq", "xx") for i in range(40)] + [(9000 + i, "the", None) for i in range(5)]
    model = L.fit(frame(rows), rows=400, least=50)
    assert model.languages == ["en", "xx"]
    got = {r.doc_id: r.lang_pred for r in L.predict(frame([(1, "xhaq waqf zyx"), (2, "the king of the garden")]), model).collect()}
    assert got == {1: "xx", 2: "en"}
