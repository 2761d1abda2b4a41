"""Near-duplicate line removal by a join on deletion variants.

Lines are compared as word sequences. Two lines, the longer of n words, MIN_WORDS or more, are near if at most
``bound(n)`` word edits (insert, delete or replace) turn one into the other: a tenth of n, at least one; shorter lines
are near only if equal.

All variants of a line with up to e words deleted are too many to write (6,018 for 33 words and 3 edits), so a covering
part of them is: a variant keeps two words, one of the line's core, its 2 e + 1 rarest words in order of their frequency in
the corpus, and the next one that is not FREQUENT, and deletes the others. Near lines lack e of each other's words at most, so
e + 1 words of both cores are common, and an edit changes the next such word of one of these at most: one variant is the same.
A core that reaches frequent words has 3 e + 1; these go with the very next word, which the same edit may change too.
The hashed variants are sorted by key, keys of a single line go, and pairs of lines that share a key are verified by edit distance,
after a bound by parity sketches of the words, the first, second ... occurrence of a word in a line counting as different ones.

A line meets the first line of each key before any other. Lines that are near to none of those meet all earlier ones of the
key, each pair in the first key that both have; or, in keys of more than CROWD lines, those with which they share a second
variant, from a core that is larger by a word. So lines of one large template with words of their own do not meet.

A line goes if an earlier line of the corpus is near, whether or not that one stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.llm.arrays import Ranges, mix, sliced, words_of
from tessera.llm.common import KeyFilter, bucket_counts, count_rows, cut, summed_counts

MIN_WORDS = 8
#: Edits for a hundred words of the longer line.
PERCENT = 10
#: Lines of a key beyond which they meet by their rare words.
CROWD = 5_000
#: Lines of a key up to which a pair may meet in each key that both lines have.
SMALL = 100
#: Buckets of words whose occurrences are counted.
COUNT_BUCKETS = 1 << 20
#: Words of the corpus among which a frequent word stands more than once.
FREQUENT = 2000
#: Places of the table of lines that a task has just seen.
SEEN = 1 << 16
#: Bits of the parity sketch of a line's words, lines whose sketches are made at once, and words from which a line also has a
#: wide sketch, of a bit or more for each word.
SKETCH_BITS, SKETCH_LINES, WIDE_WORDS = 128, 4096, 256
_AGAIN = np.uint64(0x9E3779B97F4A7C15)
#: Numbers that the edit distances of a block of pairs hold at once.
CELLS = 1 << 17


def bound(n):
    """Edits at which two lines are near, the longer of n words (a number or an array)."""
    return np.maximum(1, n * PERCENT // 100)


def longest(n: np.ndarray) -> np.ndarray:
    """Words of the longest line that n words may be near to."""
    out = n + np.maximum(1, n * PERCENT // (100 - PERCENT))
    while True:
        over = out - bound(out) > n
        if not over.any():
            return out
        out = out - over


class _Lines:
    """The lines with words of some texts: hashes of their words, where they begin and end."""

    def __init__(self, texts: list[bytes]):
        self.split = [t.split(b"\n") for t in texts]
        hashes, begins, _, _ = words_of([x for lines in self.split for x in lines])
        first = np.concatenate(([0], np.cumsum([len(x) for x in self.split]))).astype(np.int64)
        some = np.flatnonzero(begins[1:] > begins[:-1])
        self.text = np.searchsorted(first, some, "right") - 1
        self.at = some - first[self.text]
        self.words, self.start, self.end = Ranges(hashes), begins[some], begins[some + 1]
        self.hash = self.words.of(self.start, self.end)

    def long(self) -> np.ndarray:
        """Distinct lines that may be near to another."""
        _, one = np.unique(self.hash, return_index=True)
        return one[self.end[one] - self.start[one] >= MIN_WORDS - 1]


class _Seen:
    """Drops lines that the task has met shortly before: a saving only."""

    def __init__(self):
        self.table = np.zeros(SEEN, np.uint64)

    def fresh(self, hashes: np.ndarray) -> np.ndarray:
        slot = (hashes >> np.uint64(40)).astype(np.int64) % SEEN
        out = self.table[slot] != hashes
        self.table[slot] = hashes
        return out


def occurrences(words: np.ndarray, each: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, element): a hash for each word of the lines and the number of its occurrence there."""
    order = np.argsort((each.astype(np.uint64) << np.uint64(46)) | (words >> np.uint64(18)))
    w, line = words[order], each[order]
    alike = (w[1:] >> np.uint64(18) == w[:-1] >> np.uint64(18)) & (w[1:] != w[:-1]) & (line[1:] == line[:-1])
    if alike.any():  # the sort took two words for one
        order = np.lexsort((words, each))
        w, line = words[order], each[order]
    at = np.arange(len(w))
    fresh = np.concatenate(([True], (w[1:] != w[:-1]) | (line[1:] != line[:-1])))[: len(w)]
    nth = at - np.maximum.accumulate(np.where(fresh, at, 0))
    return line, mix(w + nth.astype(np.uint64) * _AGAIN)


def _packed(odd: np.ndarray) -> np.ndarray:
    return np.packbits(odd.astype(np.uint8), axis=-1).view(np.int64)


def parities(words: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list]:
    """Two longs a line, and more for long lines (else None): bits that say how many words, with the number of their occurrence, fall on
    each, modulo 2. An edit changes two bits at most."""
    out, wide = [np.zeros((0, 2), np.int64)], []
    for a in range(0, len(start), SKETCH_LINES):
        s, n = start[a : a + SKETCH_LINES], (end - start)[a : a + SKETCH_LINES]
        begin = np.cumsum(n) - n
        each = np.repeat(np.arange(len(s)), n)
        place = np.arange(len(each)) - begin[each] + s[each]
        line, element = occurrences(words[place], each)
        bit = (element % np.uint64(SKETCH_BITS)).astype(np.int64)
        out.append(_packed((np.bincount(line * SKETCH_BITS + bit, minlength=len(s) * SKETCH_BITS) & 1).reshape(-1, SKETCH_BITS)))
        own = [None] * len(s)
        for i in np.flatnonzero(n >= WIDE_WORDS):
            bits = 1 << int(n[i] - 1).bit_length()
            own[i] = _packed(np.bincount((element[begin[i] : begin[i] + n[i]] % np.uint64(bits)).astype(np.int64), minlength=bits) & 1)
        wide += own
    return np.concatenate(out), wide


LINES = "doc_id long, th long, at int, line long, n int, b1 long, b2 long, wide array<long>, chunk int, counts binary"


def line_table(docs: DataFrame) -> DataFrame:
    """A row per line with words: document, place, hash, number of words and their sketches; and rows of (chunk, counts): how often words stand in the texts, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(COUNT_BUCKETS, np.int32)
        names = [c.split()[0] for c in LINES.split(", ")]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.binary())
        for part, texts in sliced(batches):
            x = _Lines(texts)
            seen += np.bincount((x.words.items % np.uint64(COUNT_BUCKETS)).astype(np.int64), minlength=COUNT_BUCKETS).astype(np.int32)
            rows = pa.array(x.text)
            bits, wide = parities(x.words.items, x.start, x.end)
            columns = [part.column(0).take(rows), part.column(1).take(rows), pa.array(x.at.astype(np.int32)), pa.array(x.hash.view(np.int64))]
            columns += [pa.array((x.end - x.start).astype(np.int32)), pa.array(bits[:, 0]), pa.array(bits[:, 1]), pa.array(wide, kinds[7])]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(rows), kinds[8]), pa.nulls(len(rows), kinds[9])], names=names)
        counts = count_rows(seen)
        yield pa.RecordBatch.from_arrays([*[pa.nulls(len(counts), k) for k in kinds[:8]], pa.array(range(len(counts)), kinds[8]), pa.array(counts, kinds[9])], names=names)

    return docs.select("doc_id", "th", "text").mapInArrow(run, LINES)


class Cores:
    """The rarest words of lines, by the counts of their hash buckets over the corpus, which are sent to all tasks."""

    @staticmethod
    def of(docs: DataFrame) -> Cores:
        return Cores(docs.sparkSession, bucket_counts(docs, lambda texts: words_of(texts)[0], COUNT_BUCKETS))

    def __init__(self, spark: SparkSession, counts: np.ndarray):
        # frequency in steps of a quarter of a power of 2, and whether it is high: a byte for each bucket
        steps = np.minimum(127, 4 * np.log2(1.0 + counts)).astype(np.uint8) | (counts * FREQUENT > counts.sum()).astype(np.uint8) << 7
        self.steps = spark.sparkContext.broadcast(steps)

    def variants(self, words: np.ndarray, start: np.ndarray, end: np.ndarray, more: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """(line, key): the hashed variants of each line with 2 * bound + ``more`` words of core, rarest first."""
        n = end - start
        begin = np.cumsum(n) - n
        each = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(each)) - begin[each] + start[each]
        h = words[place]
        step = self.steps.value[(h % np.uint64(COUNT_BUCKETS)).astype(np.int64)]
        common = step > 127
        # the next word, for one that is not frequent the next such word; 0 at the line's end
        last = begin + n
        pad = np.append(h, np.uint64(0))
        at = np.arange(len(h))
        rare = np.append(np.where(common, len(h), at), len(h))
        rare = np.minimum.accumulate(rare[::-1])[::-1][1:]
        follow = np.where(common, at + 1, rare)
        after = np.where(follow < last[each], pad[np.minimum(follow, len(h))], np.uint64(0))
        # in order of frequency, then of the word's hash
        rank = (step.astype(np.uint64) << np.uint64(56)) | (mix(h) >> np.uint64(8))
        if len(n) < 1 << 18:  # one sort by line and rank; words of a line that then rank alike count as one
            order = np.argsort((each.astype(np.uint64) << np.uint64(46)) | (rank >> np.uint64(18)))
            rank = rank >> np.uint64(18)
        else:
            order = np.lexsort((rank, each))
        rank, common = rank[order], common[order]
        fresh = np.concatenate(([True], (rank[1:] != rank[:-1]) | (each[1:] != each[:-1])))[: len(rank)]  # lines keep their places
        nth = np.cumsum(fresh)
        nth -= nth[begin[each]] if len(nth) else 0
        most = bound(longest(n))[each]
        core = nth < 2 * most + more
        short = np.zeros(len(n), bool)
        short[each[core & common]] = True
        wanted = core | (short[each] & (nth < 3 * most + more))
        return each[wanted], mix(h[order][wanted] * np.uint64(31) + mix(after[order][wanted]))

    def distinct(self, words: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``variants`` without most of the repeats that words which a line has twice make."""
        of, key = self.variants(words, start, end)
        order = np.argsort(key)
        of, key = of[order], key[order]
        fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (of[1:] != of[:-1])))[: len(key)]
        return of[fresh], key[fresh]


KEYS = "key long, line long"


def variant_table(docs: DataFrame, cores: Cores) -> DataFrame:
    """(key, line) of the variants of all long lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for _, texts in sliced(batches):
            x = _Lines(texts)
            one = x.long()
            one = one[seen.fresh(x.hash[one])]
            of, key = cores.distinct(x.words.items, x.start[one], x.end[one])
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(x.hash[one][of].view(np.int64))], names=["key", "line"])

    return docs.select("text").mapInArrow(run, KEYS)


def shared_only(keyed: DataFrame) -> DataFrame:
    """The rows (key, line) of the keys that two lines or more have, from one sort by key; a key of any size streams through.

    A row may come twice where a key fills more than a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, met = np.zeros((2, 0), np.int64), False  # the last key's first row, and whether another line has it
        for batch in batches:
            k, v = (np.concatenate((h, c.to_numpy())) for h, c in zip(held, batch.columns))
            if not len(k):
                continue
            begin = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
            mixed = np.minimum.reduceat(v, begin) != np.maximum.reduceat(v, begin)
            again = met and k[0] == held[0, 0]
            mixed[0] |= again
            some = np.repeat(mixed, np.diff(np.append(begin, len(k))))
            some[0] &= not again  # it went out with the batch before
            held, met = np.array([[k[-1]], [v[begin[-1]]]]), bool(mixed[-1])
            x, y = k[some], v[some]
            order = np.lexsort((y, x))
            x, y = x[order], y[order]
            fresh = np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])))[: len(x)]
            yield pa.RecordBatch.from_arrays([pa.array(x[fresh]), pa.array(y[fresh])], names=["key", "line"])

    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(run, KEYS)


def pair_table(texts: DataFrame, cores: Cores, crowded: KeyFilter) -> DataFrame:
    """(key, line) of the pairs of variants that both may be ``crowded``, or the first and the core's last, for lines (line, words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in sliced(batches):
            hashes, begins, _, _ = words_of(found)
            line, token = cores.variants(hashes, begins[:-1], begins[1:], 2)
            # of the variants that near lines share, at most the last of a core is not crowded, or they met by it
            busy = crowded.may_hold(token)
            last = np.searchsorted(line, line, "right") - 1
            first = np.flatnonzero(busy)
            n = last[first] - first
            a = np.repeat(first, n)
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
            some = busy[b] | (b == last[b])
            a, b = a[some], b[some]
            key = mix(token[a] * np.uint64(31) + token[b])
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), part.column(0).take(pa.array(line[a]))], names=["key", "line"])

    return texts.select("line", F.col("words").alias("text")).mapInArrow(run, KEYS)


TEXTS = "line long, words string"


def line_texts(docs: DataFrame, lines: DataFrame, name: str) -> DataFrame:
    """(line, words) of the lines (line, doc_id of its first place): documents that hold none are passed over."""
    wanted = KeyFilter(lines, "line")
    owners = KeyFilter(lines.select("doc_id").distinct(), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        some = (b.filter(pa.array(owners.may_hold(np.asarray(b.column(0)).astype(np.int64)))) for b in batches)
        for _, texts in sliced(b for b in some if b.num_rows):
            x = _Lines(texts)
            one = x.long()
            one = one[wanted.may_hold(x.hash[one])]
            one = one[seen.fresh(x.hash[one])]
            words = [b" ".join(x.split[i][k].split()).decode() for i, k in zip(x.text[one].tolist(), x.at[one].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(x.hash[one].view(np.int64)), pa.array(words, pa.string())], names=["line", "words"])

    found = docs.select("doc_id", "text").mapInArrow(run, TEXTS)
    return cut(found.join(lines.select("line").hint("merge"), "line", "left_semi").dropDuplicates(["line"]), name)


def edited_within(words: np.ndarray, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray, most: np.ndarray) -> np.ndarray:
    """For each pair of runs of ``words``, from a to a_end and from b to b_end, whether ``most`` edits or fewer turn one into the other."""
    out, n, m = np.zeros(len(a), bool), a_end - a, b_end - b
    order = np.flatnonzero(np.abs(n - m) <= most)
    order = order[np.lexsort((n[order], most[order]))]
    at = 0
    while at < len(order):
        width = 2 * int(most[order[min(len(order), at + 4096) - 1]]) + 1
        block = order[at : at + max(1, min(4096, CELLS // width))]
        out[block] = _banded(words, a[block], n[block], b[block], m[block], most[block])
        at += len(block)
    return out


def _banded(words: np.ndarray, a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray, most: np.ndarray) -> np.ndarray:
    """``edited_within`` of pairs at once: a row of all tables at a time, as far as ``most`` from the diagonal; pairs beyond it leave."""
    reach, end = int(most.max()), len(words)
    off = np.arange(-reach, reach + 1, dtype=np.int32)
    far = np.int32(1 << 24)
    words = np.concatenate((words, words[:1]))
    row = np.where(off >= 0, off, far)[None, :] + np.zeros((len(a), 1), np.int32)
    out, live = np.zeros(len(a), bool), np.arange(len(a))
    for i in range(int(n.max()) + 1):
        if i:
            at = i + off[None, :]
            inside = (at >= 1) & (at <= m[:, None])
            other = words[np.where(inside, b[:, None] + at - 1, end)]
            new = np.where(inside, row + (other != words[a + i - 1][:, None]), far)
            new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + 1)
            new = np.where(at == 0, np.int32(i), np.where((at < 0) | (at > m[:, None]), far, new))
            row = np.minimum.accumulate(new - off, axis=1) + off
        done = n == i
        if done.any():
            ended = np.flatnonzero(done)
            out[live[ended]] = row[ended, m[ended] - n[ended] + reach] <= most[ended]
        if done.any() or i % 8 == 7:
            stay = ~done & (row.min(axis=1) <= most)
            live, row, a, n, b, m, most = live[stay], row[stay], a[stay], n[stay], b[stay], m[stay], most[stay]
            if not len(live):
                break
    return out


@F.arrow_udf(T.BooleanType())
def _near(x: pa.Array, y: pa.Array) -> pa.Array:
    texts = [v.encode() for v in (*x.to_pylist(), *y.to_pylist())]
    words, begins, _, _ = words_of(texts)
    k = len(x)
    n = np.diff(begins)
    longer = np.maximum(n[:k], n[k:])
    most = bound(longer)
    return pa.array(edited_within(words, begins[:k], begins[1 : k + 1], begins[k : 2 * k], begins[k + 1 :], most) & (longer >= MIN_WORDS))


def _differ(a: str, b: str) -> Column:
    """Bits in which two wide sketches differ, the wider one folded to the size of the other; 0 where one is missing."""
    xor = lambda x, y: x.bitwiseXOR(y)

    def fold(x: str, y: str) -> Column:
        half = (F.size(x) / 2).cast("int")
        return F.when(F.size(x) > F.size(y), F.zip_with(F.slice(x, 1, half), F.slice(x, half + 1, half), xor)).otherwise(F.col(x))

    counts = F.zip_with(fold(a, b), fold(b, a), lambda x, y: F.bit_count(xor(x, y)))
    return F.when(F.col(a).isNull() | F.col(b).isNull(), F.lit(0)).otherwise(F.aggregate(counts, F.lit(0), lambda t, x: t + x))


#: What a member row knows of its line: place of its first occurrence, words, sketches.
OWN = ("d", "a", "n", "b1", "b2", "wide")
#: Rows of keys that go to a Python worker at once.
KEY_ROWS = 1 << 16


def near_lines(docs: DataFrame, firsts: DataFrame, cores: Cores) -> DataFrame:
    """(line): the lines to which a line is near whose first place is earlier. ``firsts`` has line and OWN.

    Tables that grow with the input are joined by sorting, whatever their size, so none passes through the driver.
    """
    lines = firsts.select("line", *OWN)
    members = shared_only(variant_table(docs, cores)).join(lines.hint("merge"), "line")

    most = F.expr(f"2 * greatest(1, greatest(n, n2) * {PERCENT} div 100) - abs(n - n2)")
    differ = F.bit_count(F.col("b1").bitwiseXOR(F.col("b12"))) + F.bit_count(F.col("b2").bitwiseXOR(F.col("b22")))
    fits = F.expr("d2 < d OR (d2 = d AND a2 < a)") & (differ <= most) & (_differ("wide", "wide2") <= most)
    mates = lambda m, *more: m.select("key", *more, F.col("line").alias("other"), *[F.col(c).alias(f"{c}2") for c in OWN])

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """The lines of pairs (line, other) that are near."""
        pairs = cut(pairs.select("line", "other").distinct(), f"{name}_pairs")
        ends = pairs.select("line").union(pairs.select("other")).distinct()
        ends = cut(ends.join(firsts.select("line", F.col("d").alias("doc_id")).hint("merge"), "line"), f"{name}_ends")
        words = line_texts(docs, ends, f"{name}_words")
        both = pairs.join(words, "line").join(words.select(F.col("line").alias("other"), F.col("words").alias("words2")), "other")
        return cut(both.filter(_near("words", "words2")).select("line").distinct(), name)

    # the first line of each key; keys of two lines are done with it
    by = Window.partitionBy("key").orderBy("d", "a")
    first = F.first(F.struct("line", *OWN)).over(by.rowsBetween(Window.unboundedPreceding, 0))
    met = members.select("key", "line", *OWN, first.alias("m"), F.count(F.lit(1)).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("size"))
    met = met.select("key", "size", "line", *OWN, F.col("m.line").alias("other"), *[F.col(f"m.{c}").alias(f"{c}2") for c in OWN])
    met = met.withColumn("other", F.when(fits, F.col("other"))).filter("size > 2 OR other IS NOT NULL").select("key", "size", "line", *OWN, "other")
    met = cut(met, "first_lines", KEY_ROWS)
    easy = verified(met.filter("other IS NOT NULL"), "near_first")

    # all earlier lines of a key for the others
    rest = met.filter("size > 2").drop("other")
    asking = cut(rest.join(easy.hint("merge"), "line", "left_anti"), "asking")
    few = F.col("size") <= SMALL
    pairs = asking.filter(few).join(mates(rest.filter(few)), "key").filter(fits).select("line", "other")
    # a pair meets in the first of the larger keys that both have
    large = ~few & (F.col("size") <= CROWD)
    held = rest.filter(large).groupBy("line").agg(*[F.first(c).alias(c) for c in OWN], F.array_sort(F.collect_set("key")).alias("keys"))
    held = held.select("line", *OWN, F.posexplode("keys").alias("at", "key"), "keys")
    held = cut(held.select("line", *OWN, "key", F.slice("keys", F.lit(1), F.col("at")).alias("before")), "held")
    some = held.join(asking.filter(large).select("line").distinct().hint("merge"), "line", "left_semi")
    once = some.join(mates(held, F.col("before").alias("before2")), "key").filter(fits & ~F.arrays_overlap("before", "before2"))
    some = verified(pairs.union(once.select("line", "other")), "near_any")
    left = asking.filter(F.col("size") > CROWD)
    crowd = cut(left.select("key").distinct(), "crowded")
    if crowd.isEmpty():
        return easy.union(some)
    busy = cut(rest.join(crowd, "key", "left_semi").select("line").distinct().join(firsts.select("line", F.col("d").alias("doc_id")), "line"), "busy_lines")
    words = line_texts(docs, busy, "busy_words")
    rare = cut(shared_only(pair_table(words, cores, KeyFilter(crowd, "key"))).join(lines.hint("merge"), "line"), "rare_members", KEY_ROWS)
    asking = left.select("line").distinct().join(some, "line", "left_anti")
    asked = rare.join(asking, "line", "left_semi")
    lowest = rare.groupBy("key").agg(F.min(F.struct("d", "a", "line", *OWN[2:])).alias("m"))
    rarely = verified(asked.join(mates(lowest.select("key", "m.*")), "key").filter(fits), "near_rare_first")
    last = verified(asked.join(rarely, "line", "left_anti").join(mates(rare), "key").filter(fits), "near_rare")
    return easy.union(some).union(rarely).union(last)


def late_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, th, ats): the places of the lines that an earlier line of the corpus equals or is near to."""
    docs = docs.filter("doc_id IS NOT NULL")
    table = cut(line_table(docs), "lines")
    counts = summed_counts(table.filter("chunk IS NOT NULL").select("chunk", "counts"), COUNT_BUCKETS)
    lines = table.filter("chunk IS NULL").drop("chunk", "counts")
    firsts = lines.groupBy("line").agg(F.min(F.struct("doc_id", "at")).alias("p"), F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in OWN[2:]])
    firsts = firsts.select("line", F.col("p.doc_id").alias("d"), F.col("p.at").alias("a"), *OWN[2:], "copies")
    firsts = cut(firsts, "distinct_lines")
    near = cut(near_lines(docs, firsts.drop("copies"), Cores(docs.sparkSession, counts)).distinct().withColumn("near", F.lit(True)), "near")
    gone = firsts.join(near.hint("merge"), "line", "left").filter("copies > 1 OR near")
    # the first place of a line goes too if it is near to an earlier one
    gone = gone.select("line", "d", "a", F.coalesce("near", F.lit(False)).alias("near"))
    late = lines.join(gone.hint("merge"), "line").filter("near OR d < doc_id OR (d = doc_id AND a < at)")
    return cut(late.groupBy("doc_id", "th").agg(F.collect_set("at").alias("ats")), "late_lines")


def dedup(docs: DataFrame) -> DataFrame:
    """The documents without lines that repeat an earlier one (by doc_id, then place) exactly or nearly.

    Columns and rows stay; n_chars, where present, follows the new text. Lines without words stay. A
    text all of whose lines go becomes empty. Null texts stay null; documents with a null doc_id neither
    lose lines nor count as earlier. Rows of equal doc_id and text lose the same lines.
    """
    rows = docs.withColumn("th__", F.xxhash64("text")).withColumn("key__", F.col("doc_id").cast("long"))
    late = late_lines(rows.select(F.col("key__").alias("doc_id"), F.col("th__").alias("th"), "text"))
    # documents that keep all lines are not shuffled
    hit = KeyFilter(late.select("doc_id").distinct(), "doc_id")

    @F.pandas_udf("boolean")
    def some(ids: pd.Series) -> pd.Series:
        return pd.Series(hit.may_hold(ids.fillna(0).to_numpy(np.int64)))

    rows = rows.withColumn("some__", some("key__"))
    late = late.select(F.col("doc_id").alias("id__"), F.col("th").alias("h__"), F.col("ats").alias("ats__"))
    joined = rows.filter("some__").join(late, (F.col("key__") == F.col("id__")) & (F.col("th__") == F.col("h__")), "left")
    left = F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains("ats__", i))
    text = F.when(F.col("ats__").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    out = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("ats__").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    own = [F.col(f"`{c}`") for c in docs.columns]
    return out.select(*own).unionByName(rows.filter("NOT some__").select(*own))
