"""Removal of long passages that an earlier document holds, by suffix automata of reference shards.

A window is ``length`` consecutive words. Which windows can be shared at all is found by anchors: the
least hash among the word k-grams of a window, equal for equal windows. Only passages around anchors
that stand in two documents become references. Equal passages are one reference, with the least
doc_id that holds it. References are dealt to shards by anchor, each shard's generalised suffix
automaton is built over words, with the least doc_id below each state, and passages are streamed
through it for their matching statistics, cut at the window's length: the state reached gives the
earliest document that holds the window ending there. A document drops the spans whose windows start
in an earlier one.

Broadcasting every automaton to all documents would cost shards x documents. Equal windows have
equal anchors, so a passage only has to be streamed through the automaton of its anchor's shard, and
automaton and passages are brought together by a shuffle of distinct passages. Shards hold a bounded number
of passages; an anchor with more of them (a phrase in ever new surroundings) is dealt by whole windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.arrays import grams, lists, mix, sliced, window_min, words_of
from tessera.llm.common import cut

LENGTH = 50
GRAM = 12
#: Passages of a shard, on average, and the number beyond which an anchor's passages are dealt by window.
SHARD = 250
HOT = 2000
NEVER = (1 << 63) - 1


class SuffixAutomaton:
    """Generalised suffix automaton over sequences of words; ``least`` is the least owner of each state's strings."""

    def __init__(self) -> None:
        self.next, self.link, self.len, self.least = [{}], [-1], [0], [NEVER]

    def _state(self, length: int, owner: int, edges: dict, link: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.len.append(length)
        self.least.append(owner)
        return len(self.len) - 1

    def _split(self, p: int, word, q: int) -> int:
        """A copy of q for the strings that end at p's length and one more."""
        copy = self._state(self.len[p] + 1, NEVER, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def add(self, words: list, owner: int) -> None:
        last = 0
        for word in words:
            p, q = last, self.next[last].get(word)
            if q is not None:
                last = q if self.len[q] == self.len[p] + 1 else self._split(p, word, q)
                self.least[last] = min(self.least[last], owner)
                continue
            last = self._state(self.len[p] + 1, owner, {}, 0)
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = last
                p = self.link[p]
            if p >= 0:
                q = self.next[p][word]
                self.link[last] = q if self.len[q] == self.len[p] + 1 else self._split(p, word, q)

    def close(self) -> None:
        """Hands the least owner down the suffix links, longest strings first."""
        for v in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            u = self.link[v]
            if self.least[v] < self.least[u]:
                self.least[u] = self.least[v]

    def owners(self, words: list, length: int) -> list[int]:
        """For each window of ``length`` words the least owner that has it, NEVER if none has."""
        out, v, n = [], 0, 0
        for i, word in enumerate(words):
            while v and word not in self.next[v]:
                v = self.link[v]
                n = self.len[v]
            if word in self.next[v]:
                v, n = self.next[v][word], n + 1
            if n > length:
                n = length
            while n <= self.len[self.link[v]] and v:
                v = self.link[v]
            if i >= length - 1:
                out.append(self.least[v] if n == length else NEVER)
        return out


def _minima(hashes: np.ndarray, length: int, k: int) -> np.ndarray:
    return window_min(grams(hashes, k), length - k + 1)


SUMMARY = "doc_id long, th long, n_words long, sha256 string, anchors array<long>"


def summaries(docs: DataFrame, length: int, k: int) -> DataFrame:
    """Per document: words, digest of the words joined by spaces, distinct anchors of its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in sliced(batches):
            hashes, begins, _, _ = words_of(texts)
            anchors = []
            for i in range(len(texts)):
                w = hashes[begins[i] : begins[i + 1]]
                anchors.append(np.unique(_minima(w, length, k)) if len(w) >= length else w[:0])
            digests = [hashlib.sha256(b" ".join(t.split())).hexdigest() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(np.diff(begins)), pa.array(digests), lists(np.concatenate(anchors).view(np.int64), [len(a) for a in anchors])],
                names=["doc_id", "th", "n_words", "sha256", "anchors"],
            )

    return docs.select("doc_id", "th", "text").mapInArrow(run, SUMMARY)


PASSAGES = "doc_id long, th long, start long, anchor long, content long, passage string"


def passages(candidates: DataFrame, length: int, k: int) -> DataFrame:
    """The runs of windows with one shared anchor, as rows with the words they cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in sliced(batches):
            hashes, begins, _, _ = words_of(texts)
            rows: list = []
            for i, (text, shared) in enumerate(zip(texts, part.column(3))):
                w = hashes[begins[i] : begins[i + 1]]
                if len(w) < length:
                    continue
                least = _minima(w, length, k)
                starts = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
                ends = np.concatenate((starts[1:], [len(least)]))
                good = np.isin(least[starts], np.array(shared.values, np.int64).view(np.uint64))
                if not good.any():
                    continue
                words, doc, th = text.split(), part.column(0)[i].as_py(), part.column(1)[i].as_py()
                for s, e in zip(starts[good].tolist(), ends[good].tolist()):
                    content = int(grams(mix(w[s : e + length - 1]), e + length - 1 - s).view(np.int64)[0])
                    rows.append((doc, th, s, int(least[s].astype(np.int64)), content, b" ".join(words[s : e + length - 1]).decode()))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, t) for v, t in zip(zip(*rows), [pa.int64()] * 5 + [pa.string()])], names=["doc_id", "th", "start", "anchor", "content", "passage"]
                )

    return candidates.select("doc_id", "th", "text", "anchors").mapInArrow(run, PASSAGES)


def matched(references: DataFrame, length: int) -> DataFrame:
    """(anchor, content, owners): for each window of a passage the least document that holds it."""
    n = references.count()
    shards = max(1, -(-n // SHARD))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        automaton = SuffixAutomaton()
        split = [p.split(" ") for p in pdf["passage"]]
        for words, owner in zip(split, pdf["owner"].tolist()):
            automaton.add(words, owner)
        automaton.close()
        return pd.DataFrame({"anchor": pdf["anchor"], "content": pdf["content"], "owners": [automaton.owners(w, length) for w in split]})

    shard = F.pmod(F.xxhash64("anchor"), F.lit(shards))
    return references.groupBy(shard.alias("shard")).applyInPandas(run, "anchor long, content long, owners array<long>")


def _owners(found: DataFrame, length: int) -> DataFrame:
    """Owners of the windows of all distinct passages, hot anchors by window."""
    text = F.first("passage").alias("passage")
    references = cut(found.groupBy("anchor", "content").agg(F.min("doc_id").alias("owner"), text), "references")
    hot = cut(references.groupBy("anchor").count().filter(F.col("count") > HOT).select("anchor"), "hot_anchors")
    if hot.isEmpty():
        return cut(matched(references, length), "owners")
    plain = matched(references.join(hot, "anchor", "left_anti"), length)
    word = F.split("passage", " ")
    at = F.sequence(F.lit(0), F.size(word) - length)
    windows = references.join(hot, "anchor").select("anchor", "content", "owner", word.alias("w"), F.explode(at).alias("at"))
    windows = windows.select("anchor", "content", "owner", "at", F.array_join(F.slice("w", F.col("at") + 1, length), " ").alias("passage"))
    windows = cut(windows.withColumn("wa", F.xxhash64("passage")).withColumn("wc", F.xxhash64("passage", F.lit(1))), "hot_windows")
    single = windows.groupBy("wa", "wc").agg(F.min("owner").alias("owner"), text)
    single = cut(matched(cut(single.select(F.col("wa").alias("anchor"), F.col("wc").alias("content"), "owner", "passage"), "windows"), length), "window_owners")
    single = single.select(F.col("anchor").alias("wa"), F.col("content").alias("wc"), F.get("owners", F.lit(0)).alias("o"))
    back = windows.select("anchor", "content", "at", "wa", "wc").join(single, ["wa", "wc"]).groupBy("anchor", "content")
    hot_owners = back.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "o"))), lambda s: s["o"]).alias("owners"))
    return cut(plain.unionByName(hot_owners), "owners")


def repeats(docs: DataFrame, length: int = LENGTH, k: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(summary, changed): a row per document with doc_id, th (hash of the text), n_words, sha256; and the
    documents that lose words, with doc_id, th, n_words, n_removed and the kept words as ``text``.

    Null texts have no words. A document with a null doc_id is neither earlier nor later than
    others. Rows of equal doc_id are equally early. Texts under ``length`` words lose nothing.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), "text")
    summary = cut(summaries(rows, length, k), "summaries")
    known = summary.filter("doc_id IS NOT NULL").select("doc_id", "th", F.explode("anchors").alias("anchor"))
    shared = known.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("anchor")
    holding = known.join(cut(shared, "anchors"), "anchor").groupBy("doc_id", "th").agg(F.collect_set("anchor").alias("anchors"))
    candidates = cut(rows.join(cut(holding, "holding"), ["doc_id", "th"]), "candidates")
    found = cut(passages(candidates, length, k), "passages")
    owners = _owners(found, length)

    placed = found.select("doc_id", "th", "start", "anchor", "content").join(owners, ["anchor", "content"])
    late = F.filter(F.transform("owners", lambda o, i: F.when(o < F.col("doc_id"), F.col("start") + i)), lambda x: x.isNotNull())
    gone = placed.select("doc_id", "th", late.alias("late")).filter(F.size("late") > 0).groupBy("doc_id", "th")
    gone = cut(gone.agg(F.flatten(F.collect_list("late")).alias("late")), "late_windows")
    return summary.drop("anchors"), cut(removed(candidates.join(gone, ["doc_id", "th"]), length), "changed")


CHANGED = "doc_id long, th long, n_words long, n_removed long, text string"


def removed(rows: DataFrame, length: int) -> DataFrame:
    """Drops the words of the windows that start at ``late``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in sliced(batches):
            total, gone, kept = [], [], []
            for text, late in zip(texts, part.column(3)):
                words = text.split()
                cover = np.zeros(len(words) + 1, np.int64)
                starts = np.unique(np.array(late.values, np.int64))
                np.add.at(cover, starts, 1)
                np.add.at(cover, starts + length, -1)
                drop = np.cumsum(cover)[:-1] > 0
                total.append(len(words))
                gone.append(int(drop.sum()))
                kept.append(b" ".join(w for w, d in zip(words, drop.tolist()) if not d).decode())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
                names=["doc_id", "th", "n_words", "n_removed", "text"],
            )

    return rows.select("doc_id", "th", "text", "late").mapInArrow(run, CHANGED)


def clean(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents with the repeated passages removed; a text that loses words has the rest joined by spaces."""
    _, changed = repeats(docs, length)
    new = changed.select(F.col("doc_id").alias("new__id"), F.col("th").alias("new__th"), F.col("text").alias("new__text")).dropDuplicates(["new__id", "new__th"])
    rows = docs.withColumn("own__th", F.xxhash64("text"))
    rows = rows.join(new, (F.col("doc_id") == F.col("new__id")) & (F.col("own__th") == F.col("new__th")), "left")
    return rows.select(*[F.coalesce("new__text", "text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    summary, changed = repeats(docs, length)
    same = summary.join(changed.select("doc_id", "th").distinct(), ["doc_id", "th"], "left_anti")
    same = same.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha256").alias("kept_sha256"))
    return same.unionByName(changed.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")))
