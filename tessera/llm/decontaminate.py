"""Benchmark decontamination by the q-gram lemma on diagonal bands.

A text holds a passage of m characters with at most e edits only if they share m - q + 1 - q * e q-grams on diagonals (place
in the text less place in the item) that differ by e at most. The q-grams of whole items are indexed; hits are counted in
windows of 2 * PASSAGE places of the item that overlap by half, and in diagonal bands of twice the width which overlap by
half, so every passage lies whole in one of them. Regions that reach the bound are kept, and a banded alignment of
all passages of the window at once verifies them.

Items of up to PASSAGE characters are one passage, those of fewer than SHORT are looked for exactly, as whole words.

The benchmark is a stated query set. Up to BLOCK_CHARS characters it is sent to all tasks and documents are scanned in
place, without a shuffle. A larger one is joined with the documents by q-grams: hits are counted by Spark, so nothing grows
with the benchmark in a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.arrays import mix, sliced
from tessera.llm.common import KeyFilter, cut

Q = 8
#: Characters of a passage, and of an item below which it is looked for exactly.
PASSAGE, SHORT = 80, 20
#: Edits for a hundred characters of a passage.
PERCENT = 10
#: Benchmark characters sent to the tasks at most.
BLOCK_CHARS = 1_000_000
TABLE_BITS = 20


def normalised(text: str) -> str:
    return " ".join(text.replace("\0", " ").lower().split())


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def document_points(text: bytes) -> np.ndarray:
    """The text's code points, normalised, between spaces."""
    return points(f" {normalised(text.decode('utf-8', 'replace'))} ")


def item_points(text: str) -> np.ndarray:
    """The item's code points, normalised; a short item between spaces, so that it is found as whole words."""
    t = normalised(text)
    return points(f" {t} " if 0 < len(t) < SHORT else t)


def edits(n: int) -> int:
    """Edits within which a passage of n characters (or a padded short item) is found."""
    return max(0, min(n * PERCENT // 100, (n - Q - 3) // Q)) if n >= SHORT + 2 else 0


def gram_hashes(x: np.ndarray, q: int = Q) -> np.ndarray:
    h = np.full(max(0, len(x) - q + 1), q, np.uint64)
    for j in range(q):
        h = h * np.uint64(0x9E3779B97F4A7C15) + x[j : j + len(h)]
    return mix(h)


def least_distance(item: np.ndarray, start: int, passages: int, size: int, x: np.ndarray, first: int, last: int) -> int:
    """Least edit distance of any passage item[s : s + size], s from ``start`` on, to a substring of x.

    By alignment on the diagonals first to last (place in x less place in the item), all passages at once.
    """
    width = last - first + 1
    far = size + 1
    ramp = np.arange(width)
    # column k of row i of passage s stands at place s + first + k + i of x, counted in characters consumed
    ends = start + np.arange(passages)[:, None] + first + ramp
    row = np.where((ends >= 0) & (ends <= len(x)), 0, far)
    begin, total = start + first, passages + size + width
    padded = np.full(total, -1, np.int64)
    lo, hi = max(0, begin), min(len(x), begin + total)
    if hi > lo:
        padded[lo - begin : hi - begin] = x[lo:hi]
    beside = np.lib.stride_tricks.sliding_window_view(padded, width)
    wall = np.full((passages, 1), far)
    for i in range(size):
        same = row + (beside[i : i + passages] != item[start + i : start + i + passages, None])
        down = np.concatenate((row[:, 1:], wall), axis=1) + 1  # a character of the passage without one of x
        ends = ends + 1
        new = np.where((ends >= 0) & (ends <= len(x)), np.minimum(same, down), far)
        row = np.minimum.accumulate(new - ramp, axis=1) + ramp  # characters of x without one of the passage
    return int(row.min())


def holds(item: np.ndarray, window: int, first: int, last: int, x: np.ndarray) -> bool:
    """Whether a passage of the item's window stands in x with few edits, on a diagonal of the band or within the budget of it."""
    size = min(len(item), PASSAGE)
    e = edits(size)
    start = window * PASSAGE
    return least_distance(item, start, min(PASSAGE, len(item) - size + 1 - start), size, x, first - e, last + e) <= e


def windows_of(place: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The (index, window) of the windows in which a q-gram at ``place`` of an item counts: two, but where none begins."""
    size = np.minimum(length, PASSAGE)
    out = []
    for back in (0, 1):
        w = place // PASSAGE - back
        some = np.flatnonzero((w >= 0) & (w * PASSAGE <= length - size))
        out.append((some, w[some]))
    return np.concatenate([i for i, _ in out]), np.concatenate([w for _, w in out])


class Index:
    """The q-grams of the items of a benchmark."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, self.text, self.tiny = [], [], {}
        for i, text in items:
            x = item_points(text)
            if len(x) >= Q:
                self.ids.append(i)
                self.text.append(x)
            elif len(x):
                self.tiny.setdefault(len(x), {}).setdefault(int(gram_hashes(x, len(x))[0]), set()).add(i)
        none = [np.zeros(0, np.int64)]
        length = np.array([len(x) for x in self.text], np.int64)
        grams = np.concatenate([gram_hashes(x) for x in self.text] or none).astype(np.uint64)
        order = np.argsort(grams, kind="stable")
        self.grams = grams[order]
        self.owner = np.repeat(np.arange(len(length)), length - Q + 1)[order]
        self.place = np.concatenate([np.arange(n - Q + 1) for n in length] or none)[order]
        self.length, self.longest = length, int(length.max(initial=0))
        size = np.minimum(length, PASSAGE)
        self.edits = np.array([edits(int(n)) for n in size], np.int64)
        self.bound = size - Q + 1 - Q * self.edits
        self.first_window = np.concatenate(([0], np.cumsum(length // PASSAGE + 1)))
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[(self.grams & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)] = True

    def hits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in x, entry of the index) of all equal q-grams."""
        h = gram_hashes(x)
        at = np.flatnonzero(self.table[(h & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)])
        low, high = (np.searchsorted(self.grams, h[at], side) for side in ("left", "right"))
        n = high - low
        each = np.repeat(np.arange(len(at)), n)
        return at[each], low[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)

    def regions(self, x: np.ndarray, begins: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, item, window, first diagonal, last diagonal) of the regions that reach the bound.

        x holds texts that begin at ``begins``, parted by zeros; diagonals count from the text's begin.
        """
        at, entry = self.hits(x) if len(self.grams) and len(x) >= Q else (np.zeros(0, np.int64),) * 2
        if not len(at):
            return []
        text = np.searchsorted(begins, at, "right") - 1
        item, place = self.owner[entry], self.place[entry]
        width = self.edits[item] + 1
        band = (at - place + self.longest) // width  # never negative
        i, window = windows_of(place, self.length[item])
        spread = 2 * PASSAGE
        slots = np.int64(len(x) + self.longest + 2)
        base = ((self.first_window[item[i]] + window) * slots + band[i] + 1) * len(begins) + text[i]
        # a q-gram of the item counts once for each region, however often the text repeats it nearby
        key = np.concatenate([(base - back * len(begins)) * spread + place[i] - window * PASSAGE for back in (0, 1)])
        slot = ((key // spread) * 2654435761) & ((1 << TABLE_BITS) - 1)
        dense = np.bincount(slot, minlength=1 << TABLE_BITS)[slot] >= np.tile(self.bound[item[i]], 2)
        keys, counts = np.unique(np.unique(key[dense]) // spread, return_counts=True)
        keys, text = np.divmod(keys, len(begins))
        window, band = np.divmod(keys, slots)
        item = np.searchsorted(self.first_window, window, "right") - 1
        good = np.flatnonzero(counts >= self.bound[item])
        first = (band - 1) * (self.edits[item] + 1) - self.longest - begins[text]
        last = first + 2 * self.edits[item] + 1
        return [tuple(map(int, r)) for r in zip(text[good], item[good], (window - self.first_window[item])[good], first[good], last[good])]

    def found(self, texts: list[np.ndarray]) -> list[set]:
        """For each text (as ``document_points``) the ids of the items it holds."""
        gap = np.zeros(1, np.uint32)
        x = np.concatenate([v for t in texts for v in (t, gap)])
        begins = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])[:-1]))
        out: list[set] = [set() for _ in texts]
        for text, item, window, first, last in self.regions(x, begins):
            if self.ids[item] not in out[text] and holds(self.text[item], window, first, last, texts[text]):
                out[text].add(self.ids[item])
        for n, ids in self.tiny.items():
            h = gram_hashes(x, n)
            for at in np.flatnonzero(np.isin(h, np.fromiter(ids, np.uint64, len(ids)))).tolist():
                out[int(np.searchsorted(begins, at, "right")) - 1] |= ids[int(h[at])]
        return out


NONE = "cast(array() as array<bigint>)"


def scan(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Adds ``items``: the sorted distinct item_ids of which a passage stands in the text.

    Case and white space do not matter. Null and empty texts hold none; null items and those without words are in none; an
    empty benchmark finds none. Repeated rows are judged alike; other columns pass through, an older ``items`` is replaced.
    """
    docs = docs.drop("items")
    known = benchmark.filter("text IS NOT NULL AND item_id IS NOT NULL").select(F.col("item_id").cast("long"), "text")
    size = known.agg(F.sum(F.length("text") + 2)).first()[0] or 0
    if size > BLOCK_CHARS:
        return scan_joined(docs, known)
    index = docs.sparkSession.sparkContext.broadcast(Index([tuple(r) for r in known.collect()]))  # within BLOCK_CHARS
    schema = docs.select("*", F.expr(NONE).alias("items")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in sliced(batches):
            found = index.value.found([document_points(t) for t in texts])
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([sorted(s) for s in found], pa.list_(pa.int64()))], names=schema.names)

    return docs.mapInArrow(run, schema)


ITEM_GRAMS = "gram long, ik long, place int, length int, edits int"
TEXT_GRAMS = "gram long, dk long, at int"


def _item_grams(items: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in sliced(batches):
            for key, t in zip(part.column(0), texts):
                x = item_points(t.decode())
                if not len(x):
                    continue
                g = gram_hashes(x, min(Q, len(x)))
                n, e = len(g), edits(min(len(x), PASSAGE))
                column = lambda v: pa.array(np.full(n, v, np.int32))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g.view(np.int64)), pa.array(np.full(n, key.as_py(), np.int64)), pa.array(np.arange(n, dtype=np.int32)), column(len(x)), column(e)],
                    names=["gram", "ik", "place", "length", "edits"],
                )

    return items.select("ik", "text").mapInArrow(run, ITEM_GRAMS)


def _text_grams(texts: DataFrame, wanted: KeyFilter, sizes: list[int]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in sliced(batches):
            for key, t in zip(part.column(0), found):
                x = document_points(t)
                for q in sizes:
                    g = gram_hashes(x, q)
                    at = np.flatnonzero(wanted.may_hold(g))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(g[at].view(np.int64)), pa.array(np.full(len(at), key.as_py(), np.int64)), pa.array(at.astype(np.int32))], names=["gram", "dk", "at"]
                    )

    return texts.select("dk", "text").mapInArrow(run, TEXT_GRAMS)


def scan_joined(docs: DataFrame, known: DataFrame) -> DataFrame:
    """``scan`` for a benchmark of any size, by a shuffled join of q-grams; equal texts are looked at once."""
    items = cut(known.select("item_id", "text", F.xxhash64("item_id", "text").alias("ik")), "items")
    grams = cut(_item_grams(items), "item_grams")
    sizes = [r[0] for r in grams.select(F.least(F.lit(Q), "length")).distinct().collect()]  # at most Q
    texts = docs.filter("text IS NOT NULL").select(F.xxhash64("text").alias("dk"), "text").dropDuplicates(["dk"])
    wanted = KeyFilter(grams.select("gram").distinct(), "gram")
    hits = _text_grams(texts, wanted, sizes).join(grams, "gram")

    # windows and bands as in Index.regions
    size = F.least("length", F.lit(PASSAGE))
    width = F.col("edits") + 1
    band = F.floor((F.col("at") - F.col("place")) / width)
    window = F.floor(F.col("place") / PASSAGE)
    spread = hits.select("dk", "ik", "place", "length", "edits", F.explode(F.array(band, band - 1)).alias("band"), F.explode(F.array(window, window - 1)).alias("window"))
    spread = spread.filter((F.col("window") >= 0) & (F.col("window") * PASSAGE <= F.col("length") - size))
    bound = F.greatest(F.lit(1), size - Q + 1 - Q * F.col("edits"))
    regions = spread.groupBy("dk", "ik", "window", "band", "length", "edits").agg(F.count_distinct("place").alias("n")).filter(F.col("n") >= bound)
    regions = cut(regions.select("dk", "ik", F.struct("window", (F.col("band") * width).cast("long").alias("first"), (F.col("band") * width + 2 * F.col("edits") + 1).cast("long").alias("last")).alias("region")), "regions")
    pairs = regions.groupBy("dk", "ik").agg(F.collect_set("region").alias("regions"))
    pairs = pairs.join(texts, "dk").join(items.select("ik", "item_id", F.col("text").alias("item")), "ik").select("dk", "item_id", "regions", "item", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in sliced(batches):
            good = []
            for t, item, places in zip(found, part.column(3), part.column(2)):
                item, x = item_points(item.as_py()), document_points(t)
                good.append(any(len(item) < Q or holds(item, r["window"], r["first"], r["last"], x) for r in places.as_py()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["dk", "item_id"]).filter(pa.array(good, pa.bool_()))

    held = cut(pairs.mapInArrow(run, "dk long, item_id long"), "held")
    held = held.groupBy("dk").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    out = docs.withColumn("dk__", F.xxhash64("text")).join(held.withColumnRenamed("dk", "dk__"), "dk__", "left")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.coalesce("items", F.expr(NONE)).alias("items"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no passage of the benchmark, unchanged."""
    return scan(docs.withColumnRenamed("items", "items_old__"), benchmark).filter(F.size("items") == 0).drop("items").withColumnRenamed("items_old__", "items")
