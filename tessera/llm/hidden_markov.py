"""Language-model scores by a hidden Markov model over the words of whole texts.

A text is its words (A-Z lower-cased) and one end. A latent state emits the class of each token, one of a fixed
number of classes by hash (tied emissions); the class emits the token itself by its count in the corpus, plus one. So the states'
parameters have a fixed size and go to all tasks, while the counts of words grow with the corpus and stay in tables.

Texts are encoded once, in chunks that each have a dictionary of their words. Dictionaries meet in a shuffle by word, which counts
each word over the corpus, and their rows come back with the counts to their chunk: a word has a row for each chunk
that holds it, not one for each time it stands there, and no dictionary goes through the driver.

Baum-Welch: each round, tasks sum expected counts of starts, transitions and emissions over their training texts; the sums are
added across partitions and make the next parameters. The recursions run over segments of a text at once: from every state a
segment has a scaled transfer matrix, the matrices are multiplied in order, and so a text of any length is scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.arrays import mix, sliced, words_of
from tessera.llm.common import cut

STATES, ROUNDS = 4, 3
#: Classes of tokens, a power of 2.
CLASSES = 1 << 16
#: Tokens of a chunk, or one longer text.
CHUNK_TOKENS = 1 << 22
#: Tokens of a segment, and steps between two scalings.
SEGMENT, SCALED = 64, 8
#: Tokens' worth of the classes' shares in the corpus that each state's emissions are drawn towards.
PRIOR = 50.0
#: Weight of a class's own state, and of staying in a state, at the start.
OWN, STAY = 0.85, 0.98
END = mix(np.array([0x656E64], np.uint64))
#: Classes that are summed as one row.
PART = 4096

ENCODED = "chunk long, ids array<long>, train array<boolean>, sizes array<int>, tokens binary, classes binary, words array<long>, counts array<long>"


def tokens_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of the texts, each text's end included, and the number of tokens of each."""
    hashes, begins, _, _ = words_of(texts, lower=True)
    return np.insert(hashes, begins[1:], END), np.diff(begins) + 1


def encoded(docs: DataFrame, classes: int) -> DataFrame:
    """Chunks of documents (doc_id, train, text) in rows of a slice each; a chunk's last row has its words and how often they stand in training texts."""

    def pack(chunk: int, held: list) -> pa.RecordBatch:
        words, place = np.unique(np.concatenate([h for _, _, _, h in held]), return_inverse=True)
        taught = np.concatenate([np.repeat(train, sizes) for _, train, sizes, _ in held])
        counts = np.bincount(place[taught], minlength=len(words))
        place, at, tokens, kinds = place.astype(np.uint32), 0, [], []
        for *_, h in held:
            own = place[at : at + len(h)]
            at += len(h)
            tokens.append(own.tobytes())
            kinds.append((words[own] & np.uint64(classes - 1)).astype(np.uint32).tobytes())
        last = [None] * (len(held) - 1)
        longs, flags, ints = pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32())
        columns = [pa.array([chunk] * len(held)), pa.array([x[0] for x in held], longs), pa.array([x[1].tolist() for x in held], flags), pa.array([x[2].tolist() for x in held], ints)]
        columns += [pa.array(tokens, pa.binary()), pa.array(kinds, pa.binary()), pa.array([*last, words.view(np.int64)], longs), pa.array([*last, counts], longs)]
        return pa.RecordBatch.from_arrays(columns, names=["chunk", "ids", "train", "sizes", "tokens", "classes", "words", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, n = TaskContext.get().partitionId() << 32, [], 0
        for part, texts in sliced(batches):
            hashes, sizes = tokens_of(texts)
            held.append((part.column(0).to_pylist(), part.column(1).to_numpy(zero_copy_only=False).astype(bool), sizes, hashes))
            n += len(hashes)
            if n >= CHUNK_TOKENS:
                yield pack(chunk, held)
                chunk, held, n = chunk + 1, [], 0
        if held:
            yield pack(chunk, held)

    return docs.select("doc_id", "train", "text").mapInArrow(run, ENCODED)


def tallied(chunks: DataFrame, classes: int) -> DataFrame:
    """(chunk, at, class, c, first): each chunk's words by place with their count in all training texts; ``first`` is true once a word."""
    each = F.posexplode(F.arrays_zip("words", "counts")).alias("at", "w")
    rows = chunks.filter("words IS NOT NULL").select("chunk", each).select("chunk", "at", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    by = Window.partitionBy("word")
    kind = F.col("word").bitwiseAND(classes - 1).cast("int").alias("class")
    return rows.select("chunk", "at", kind, F.sum("n").over(by).alias("c"), (F.min("chunk").over(by) == F.col("chunk")).alias("first"))


@dataclass
class Counts:
    """Training tokens and distinct ones, by class."""

    tokens: np.ndarray
    distinct: np.ndarray

    @property
    def n(self) -> int:
        return int(self.tokens.sum())

    @property
    def v(self) -> int:
        return int(self.distinct.sum())

    def shares(self) -> np.ndarray:
        """Each class's share of all tokens, one more counted for each distinct one and one for unknown ones of the class."""
        out = self.tokens + self.distinct + 1.0
        return out / out.sum()


def class_counts(tally: DataFrame, classes: int) -> Counts:
    known = F.sum(F.when(F.col("c") > 0, 1).otherwise(0))
    found = tally.filter("first").groupBy("class").agg(F.sum("c").alias("n"), known.alias("v")).toArrow()  # a row for each class at most
    out = Counts(np.zeros(classes, np.int64), np.zeros(classes, np.int64))
    at = found["class"].to_numpy()
    out.tokens[at], out.distinct[at] = found["n"].to_numpy(), found["v"].to_numpy()
    return out


@dataclass
class Hmm:
    """start[i], step[i, j], and emit[class, i]: probabilities."""

    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray

    @staticmethod
    def of(starts: np.ndarray, steps: np.ndarray, emits: np.ndarray, shares: np.ndarray) -> Hmm:
        """From (expected) counts; one more is counted for each start and step."""
        a, b = starts + 1, steps + 1
        emit = (emits + PRIOR * shares[:, None]) / (emits.sum(axis=0) + PRIOR)
        return Hmm(a / a.sum(), b / b.sum(axis=1, keepdims=True), np.ascontiguousarray(emit))


def first_model(counts: Counts, states: int) -> Hmm:
    """States that differ: each class leans to one of them by hash, and states last."""
    own = (mix(np.arange(len(counts.tokens), dtype=np.uint64) + np.uint64(17)) % np.uint64(states)).astype(np.int64)
    lean = np.full((len(own), states), (1 - OWN) / max(1, states - 1)) if states > 1 else np.ones((len(own), 1))
    if states > 1:
        lean[np.arange(len(own)), own] = OWN
    model = Hmm.of(np.ones(states), np.ones((states, states)), counts.tokens[:, None] * lean, counts.shares())
    model.step = np.full((states, states), (1 - STAY) / max(1, states - 1)) if states > 1 else np.ones((1, 1))
    if states > 1:
        np.fill_diagonal(model.step, STAY)
    return model


class Pass:
    """The recursions over some texts: classes of their tokens end to end, and the number of tokens of each text."""

    def __init__(self, hmm: Hmm, kinds: np.ndarray, sizes: np.ndarray):
        self.hmm, self.kinds = hmm, kinds
        parts = -(-sizes // SEGMENT)
        self.offset = np.cumsum(parts) - parts
        self.parts = parts
        doc = np.repeat(np.arange(len(sizes)), parts)
        nth = np.arange(len(doc)) - self.offset[doc]
        begins = np.cumsum(sizes) - sizes
        length = np.minimum(SEGMENT, sizes[doc] - nth * SEGMENT)
        self.order = np.argsort(-length, kind="stable")  # longest first: those that a step reaches are a prefix
        self.start, self.first = (begins[doc] + nth * SEGMENT)[self.order], (nth == 0)[self.order]
        length = length[self.order]
        self.active = [int(np.searchsorted(-length, -t, "left")) for t in range(int(length[0]) if len(length) else 0)]
        self.matrices, self.logs = self._transfer()
        self.loglik, self.before = self._forward()

    def _emitted(self, t: int) -> np.ndarray:
        return self.hmm.emit[self.kinds[self.start[: self.active[t]] + t]]

    def _transfer(self) -> tuple[np.ndarray, np.ndarray]:
        """For each segment the scaled matrix that takes the state before it to that at its end, and the log of the scale."""
        k, step = len(self.hmm.start), self.hmm.step
        logs = np.zeros(len(self.order))
        p = np.where(self.first[:, None, None], self.hmm.start[None, None, :], step[None]) if len(self.order) else np.zeros((0, k, k))
        for t, a in enumerate(self.active):
            if t:
                p[:a] = (p[:a].reshape(-1, k) @ step).reshape(a, k, k)
            p[:a] *= self._emitted(t)[:, None, :]
            if t % SCALED == SCALED - 1 or t == len(self.active) - 1:
                scale = p[:a].sum(axis=(1, 2))
                p[:a] /= scale[:, None, None]
                logs[:a] += np.log(scale)
        matrices, out = np.empty_like(p), np.empty_like(logs)
        matrices[self.order], out[self.order] = p, logs
        return matrices, out

    def _rounds(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(texts, their segments) by place of the segment."""
        most = np.argsort(-self.parts, kind="stable")
        falling = -self.parts[most]
        for j in range(int(self.parts.max()) if len(self.parts) else 0):
            texts = most[: int(np.searchsorted(falling, -j, "left"))]
            yield texts, self.offset[texts] + j

    def _forward(self) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihood of each text, and the states' weights before each segment."""
        k = len(self.hmm.start)
        at, logs = np.full((len(self.parts), k), 1 / k), np.zeros(len(self.parts))
        before = np.empty((len(self.order), k))
        for texts, segments in self._rounds():
            before[segments] = at[texts]
            new = np.matmul(at[texts][:, None, :], self.matrices[segments])[:, 0]
            scale = new.sum(axis=1)
            at[texts] = new / scale[:, None]
            logs[texts] += np.log(scale) + self.logs[segments]
        return logs, before

    def _after(self) -> np.ndarray:
        """The weights of what follows each segment, by the state at its end."""
        out = np.ones((len(self.order), len(self.hmm.start)))
        for texts, segments in reversed(list(self._rounds())):
            later = segments[segments > self.offset[texts]]
            new = np.matmul(self.matrices[later], out[later][:, :, None])[:, :, 0]
            out[later - 1] = new / new.sum(axis=1, keepdims=True)
        return out

    def expected(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected starts, steps, and the states' weights for each token."""
        k, step = len(self.hmm.start), self.hmm.step
        before, beta = self.before[self.order], self._after()[self.order]
        alphas, emitted, at = [], [], before
        for t, a in enumerate(self.active):
            e = self._emitted(t)
            at = at[:a] @ step
            if not t:
                at[self.first] = self.hmm.start
            at *= e
            at /= at.sum(axis=1, keepdims=True)
            alphas.append(at)
            emitted.append(e)
        starts, steps, weights = np.zeros(k), np.zeros((k, k)), np.empty((len(self.kinds), k))
        for t in range(len(self.active) - 1, -1, -1):
            a = self.active[t]
            gamma = alphas[t] * beta[:a]
            gamma /= gamma.sum(axis=1, keepdims=True)
            weights[self.start[:a] + t] = gamma
            ahead = emitted[t] * beta[:a]
            past = ahead @ step.T
            prev = alphas[t - 1][:a] if t else before
            part = prev / (prev * past).sum(axis=1, keepdims=True)
            if not t:
                part[self.first] = 0
                starts = gamma[self.first].sum(axis=0)
            steps += part.T @ ahead
            beta[:a] = past / past.sum(axis=1, keepdims=True)
        return starts, steps * step, weights


SUMS = "part int, sums binary"


def baum_welch(chunks: DataFrame, model: Hmm, counts: Counts) -> Hmm:
    """One round over the training texts of the chunks."""
    shared = chunks.sparkSession.sparkContext.broadcast(model)  # fixed size: classes x states
    classes, states = model.emit.shape
    size = min(PART, classes)

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emits, starts, steps = np.zeros((classes, states)), np.zeros(states), np.zeros((states, states))
        for batch in batches:
            for train, sizes, kinds in zip(*batch.columns):
                train, sizes = np.array(train.as_py(), bool), np.array(sizes.as_py(), np.int64)
                kinds = np.frombuffer(kinds.as_py(), np.uint32)[np.repeat(train, sizes)]
                a, b, weights = Pass(shared.value, kinds, sizes[train]).expected()
                starts, steps = starts + a, steps + b
                for k in range(states):
                    emits[:, k] += np.bincount(kinds, weights[:, k], classes)
        rows = [np.concatenate((starts, steps.ravel())).tobytes(), *(emits[at : at + size].tobytes() for at in range(0, classes, size))]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(rows) - 1), pa.int32()), pa.array(rows, pa.binary())], names=["part", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out[part] = out.get(part, 0) + np.frombuffer(sums)
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array([v.tobytes() for v in out.values()], pa.binary())], names=["part", "sums"])

    found = chunks.select("train", "sizes", "classes").mapInArrow(expect, SUMS).repartition("part").mapInArrow(add, SUMS).toArrow()
    emits, heads = np.zeros((classes // size, size * states)), np.zeros(states + states * states)
    for part, sums in zip(found["part"].to_pylist(), found["sums"].to_pylist()):
        if part < 0:
            heads += np.frombuffer(sums)
        else:
            emits[part] += np.frombuffer(sums)
    return Hmm.of(heads[:states], heads[states:].reshape(states, states), emits.reshape(classes, states), counts.shares())


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def scored(chunks: DataFrame, tally: DataFrame, model: Hmm, counts: Counts) -> DataFrame:
    """A row for each document of the chunks."""
    shared = chunks.sparkSession.sparkContext.broadcast((model, counts))
    names = [c.split()[0] for c in SCORES.split(", ")]

    def run(rows: pa.Table, words: pa.Table) -> pa.Table:
        hmm, total = shared.value
        at, kind = words["at"].to_numpy(), np.empty(words.num_rows, np.int64)
        c = np.empty(words.num_rows, np.int64)
        kind[at], c[at] = words["class"].to_numpy(), words["c"].to_numpy()
        plain = np.log10(c + 1.0)
        inside = plain - np.log10(total.tokens[kind] + total.distinct[kind] + 1.0)
        out: list[list] = [[] for _ in names]
        for row in range(rows.num_rows):
            sizes = np.array(rows["sizes"][row].as_py(), np.int64)
            tokens = np.frombuffer(rows["tokens"][row].as_py(), np.uint32)
            begins = np.cumsum(sizes) - sizes
            total_of = lambda x: np.add.reduceat(x[tokens], begins)  # noqa: B023, E731
            base = total_of(plain) - sizes * np.log10(total.n + total.v + 1.0)
            score = Pass(hmm, kind[tokens], sizes).loglik / np.log(10) + total_of(inside)
            columns = (rows["ids"][row].as_py(), [not t for t in rows["train"][row].as_py()], sizes.tolist(), total_of((c > 0).astype(np.int64)).tolist(), base.tolist(), score.tolist())
            for have, new in zip(out, columns):
                have += new
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.table([pa.array(x, k) for x, k in zip(out, kinds)], names=names)

    left = chunks.select("chunk", "ids", "train", "sizes", "tokens").groupBy("chunk")
    return left.cogroup(tally.select("chunk", "at", "class", "c").groupBy("chunk")).applyInArrow(run, SCORES)


def score(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS, classes: int = CLASSES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs (doc_id, train, text).

    Texts where ``train`` is true (or null) teach, all are scored; ``held_out`` is its opposite. ``base_score`` is the log10 probability by counts plus one of
    single tokens, ``score`` that of the model. Null texts are empty: one token, the end. Very long texts are scored whole, repeated rows each
    teach and return, null ids stay. Without training texts all tokens are unknown alike. Other columns do not return.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("train", F.lit(True)).alias("train"), "text")
    chunks = cut(encoded(rows, classes), "chunks")
    tally = cut(tallied(chunks, classes), "word_counts")
    counts = class_counts(tally, classes)
    model = first_model(counts, states)
    for _ in range(rounds):
        model = baum_welch(chunks, model, counts)
    return scored(chunks, tally, model, counts).withColumn("train_tokens", F.lit(counts.n).cast("long"))
