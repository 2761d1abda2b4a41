"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its subwords (letter n-grams with word edges, hashed to a
fixed number of buckets). Embeddings and softmax are trained together by stochastic gradient descent
in numpy on a bounded sample of labelled rows. A temperature fitted on a part of the sample kept aside
calibrates the probabilities; the rejection threshold is a low quantile of the calibrated scores there.

Prediction needs only the product of the two matrices, one small row per bucket, so
whole texts are scored with array operations.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.arrays import lists, mix, sliced

UNKNOWN = "und"
BUCKETS = 1 << 15
DIM = 16
NGRAMS = (2, 3, 4)
#: Labelled rows used: about so many, shared evenly by the languages, LEAST_ROWS each at least where there are as many. They
#: are chosen by a hash of id and text, and reach the driver as bags of subwords, BUCKETS numbers each at most. One of
#: ASIDE only calibrates.
SAMPLE_ROWS, LEAST_ROWS = 6000, 100
ASIDE = 5
#: Texts of the part kept aside that calibration would reject.
REJECT_SHARE = 0.002

EDGE = 32


@dataclass
class Model:
    """weights: buckets x languages, the product of embeddings and softmax; threshold: least score accepted."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0
    accuracy_aside: float = field(default=0.0)


def _letters() -> np.ndarray:
    out = np.zeros(256, bool)
    out[65:91] = out[97:123] = True
    out[128:] = True
    return out


LETTER = _letters()


def subwords(texts: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each subword of the texts, and where each text's subwords begin (with the end).

    Texts are lower-cased. Bytes other than letters become word edges; an n-gram may begin or
    end with an edge but holds none inside.
    """
    low = [t.decode("utf-8", "replace").lower().encode() for t in texts]
    buf = np.frombuffer(b" " + b"  ".join(low) + b" ", np.uint8)
    begins = np.concatenate(([0], np.cumsum(np.fromiter((len(t) + 2 for t in low), np.int64, len(low)))))
    inside = LETTER[buf]
    x = np.where(inside, buf, np.uint8(EDGE)).astype(np.uint64)
    found, places = [], []
    for n in NGRAMS:
        m = len(x) - n + 1
        if m <= 0:
            continue
        h = np.full(m, np.uint64(n), np.uint64)
        for j in range(n):
            h = h * np.uint64(257) + x[j : j + m]
        good = np.ones(m, bool)
        for j in range(1, n - 1):
            good &= inside[j : j + m]
        good &= (inside[:m] & inside[n - 1 :]) if n == 2 else (inside[:m] | inside[n - 1 :])
        at = np.flatnonzero(good)
        found.append((mix(h[at]) % np.uint64(buckets)).astype(np.int32))
        places.append(at)
    if not found:
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    at = np.concatenate(places)
    order = np.argsort(np.searchsorted(begins, at, "right"), kind="stable")
    at, found = at[order], np.concatenate(found)[order]
    of = np.searchsorted(begins, at, "right") - 1
    return found, np.searchsorted(of, np.arange(len(texts) + 1))


def _means(rows: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Mean of the rows of each text; zeros for a text without rows."""
    total = np.concatenate((np.zeros((1, rows.shape[1])), np.cumsum(rows, axis=0, dtype=np.float64)))
    n = np.maximum(np.diff(begins), 1)[:, None]
    return (total[begins[1:]] - total[begins[:-1]]) / n


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


Bag = tuple[np.ndarray, np.ndarray]


def bag(text: bytes) -> Bag:
    """The distinct subwords of a text and their counts."""
    ids, counts = np.unique(subwords([text])[0], return_counts=True)
    return ids.astype(np.int32), counts.astype(np.int32)


def train(bags: list[Bag], labels: list[str], epochs: int = 5, rate: float = 0.5, seed: int = 7) -> Model:
    """Trains on bounded labelled bags; every ASIDE-th row only calibrates. Needs one bag at least."""
    languages = sorted(set(labels))
    y = np.array([languages.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (BUCKETS, DIM))
    out, bias = rng.normal(0, 0.1, (DIM, len(languages))), np.zeros(len(languages))
    bags = [(ids, (counts / max(1, counts.sum())).astype(np.float32)) for ids, counts in bags]
    aside = np.arange(len(bags)) % ASIDE == ASIDE - 1
    rows = np.flatnonzero(~aside)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(rows):
            ids, share = bags[i]
            if not len(ids):
                continue
            mean, to_mean, to_out = gradients(emb[ids], share, out, bias, y[i])
            out -= step * np.outer(mean, to_out)
            bias -= 0.1 * step * to_out
            emb[ids] -= step * 50 * np.outer(share, to_mean)
    model = Model(languages, (emb @ out).astype(np.float32), bias)
    return calibrate(model, [bags[i] for i in np.flatnonzero(aside)], y[aside])


def gradients(emb: np.ndarray, share: np.ndarray, out: np.ndarray, bias: np.ndarray, y: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A text's mean embedding, and the gradients of its log loss by that mean and by the logits."""
    mean = share @ emb
    p = mean @ out + bias
    p = np.exp(p - p.max())
    p /= p.sum()
    p[y] -= 1
    return mean, out @ p, p


def _logits(model: Model, texts: list[bytes]) -> np.ndarray:
    ids, begins = subwords(texts)
    return _means(model.weights[ids], begins) + model.bias


def calibrate(model: Model, bags: list[Bag], y: np.ndarray) -> Model:
    """Temperature of least log loss, and the threshold that rejects REJECT_SHARE of these bags (of shares)."""
    if not bags:
        return model
    z = np.stack([share @ model.weights[ids] + model.bias for ids, share in bags])
    grid = np.geomspace(0.05, 5, 60)
    loss = [-np.log(np.maximum(_softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    p = _softmax(z / model.temperature)
    model.accuracy_aside = float((p.argmax(1) == y).mean())
    model.threshold = float(min(np.quantile(p.max(axis=1), REJECT_SHARE), 0.5))
    return model


BAGS = "lang string, h long, ids array<int>, counts array<int>"


def fit(docs: DataFrame, usable: Column | None = None, rows: int = SAMPLE_ROWS, least: int = LEAST_ROWS) -> Model | None:
    """Fits on about ``rows`` labelled texts, those of each language chosen by hash; None if there is none.

    ``usable`` limits the rows that may be learnt from. Null and empty texts and null labels teach nothing.
    """
    labelled = docs.filter("lang IS NOT NULL AND length(text) > 0")
    if usable is not None:
        labelled = labelled.filter(usable)
    counts = labelled.groupBy("lang").count().collect()  # a row for each language
    if not counts:
        return None
    want = max(least, rows // len(counts))
    share = F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], min(1.0, want / r["count"]))])
    h = F.xxhash64("doc_id", "text", F.lit(11))
    some = labelled.filter(F.pmod(h, F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000).select("lang", h.alias("h"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in sliced(batches):
            bags = [bag(t) for t in texts]
            sizes = [len(ids) for ids, _ in bags]
            columns = [lists(np.concatenate([b[k] for b in bags]), sizes, pa.int32()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], names=["lang", "h", "ids", "counts"])

    taken = sorted(((r["h"], r["lang"], np.array(r["ids"], np.int32), np.array(r["counts"], np.int32)) for r in some.mapInArrow(run, BAGS).toLocalIterator()), key=lambda r: r[:2])
    return train([(ids, n) for _, _, ids, n in taken], [lang for _, lang, _, _ in taken])


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """Adds lang_pred, score (calibrated probability) and accepted to all rows; only the text is read.

    Null texts and texts without a letter are UNKNOWN with score 0, as is every text without a model.
    Columns of these names are replaced.
    """
    docs = docs.drop("lang_pred", "score", "accepted")
    schema = T.StructType([*docs.schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: buckets x languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part, texts in sliced(batches):
            names, scores, good = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
            lettered = [i for i, t in enumerate(texts) if t and has_letter(t)]
            if m is not None and lettered:
                p = _softmax(_logits(m, [texts[i] for i in lettered]) / m.temperature)
                for k, i in enumerate(lettered):
                    names[i], scores[i] = m.languages[int(p[k].argmax())], min(1.0, float(p[k].max()))
                    good[i] = scores[i] >= m.threshold
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(scores), pa.array(good)], names=schema.names)

    return docs.mapInArrow(run, schema)


def has_letter(text: bytes) -> bool:
    """Whether some character is a letter by Unicode; most texts have one in ASCII near the start."""
    data = np.frombuffer(text, np.uint8)
    if (LETTER[data] & (data < 128)).any():
        return True
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))
