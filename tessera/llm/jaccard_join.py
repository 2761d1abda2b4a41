"""Exact Jaccard join of word n-gram sets by partition of the token universe.

Two sets x and y with Jaccard similarity of t or more differ in at most
H = (1 - t) / (1 + t) * (|x| + |y|) tokens. Sets are put in bands by size; each band hashes the universe into
segments and gives each segment 1 or 2 units, H and a slack in all. A segment of 1 unit is indexed by the
subset of the set that falls in it; one of 2 units also by all subsets with one token deleted, where two
sets meet only if the key is the whole subset of one. By the pigeonhole, similar sets share keys: units
of segments without one add up to H at most. So a set can do without keys of empty segments as long as they
are fewer than the slack, and a small set of a band needs only the first segments, as many as its own H asks for. The split into segments of 1 and 2 units is chosen per band by cost: keys
written, and pairs of sets expected to share a key by chance.

Equal sets form one class before anything else. Sets that share a key are not paired with each other: each is
paired with the key's first set, verified exactly, and components are formed. What is left are keys
whose sets lie in several components; there sets of different components are compared. A bound on the
difference from 512-bit parity sketches, which never rejects a similar pair, comes before each exact check.

Sets that are alike in part but not similar (pages of one template) crowd the keys of the common part. A key
that would compare more than CROWD_PAIRS pairs, and more than CROWD_OTHERS sets with all others, is given up for keys by rare tokens: with the tokens of a set in order of
their frequency among such sets, similar sets share a token among the first |x| - t * |x| + 1 of each, at places
that add up to H at most, as no token before it is common. So one of the places is H / 2 at most: for that set the token is
whole, and a key needs one such set. The common part comes last in the order, so sets with enough tokens of their own do not
meet. Places are not part of the keys: all that are left to a partner would take four times the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.arrays import grams, lists, mix, sliced, words_of
from tessera.llm.common import KeyFilter, bucket_counts, cut
from tessera.llm.components import components, merged

#: Bits of distinction that a token is taken to give, in the cost model.
TOKEN_BITS = 10.0
#: Pairs of a key, and sets outside its largest component, beyond which its sets meet by their rare tokens.
CROWD_PAIRS, CROWD_OTHERS = 2500, 50
#: Buckets of tokens whose occurrences are counted.
COUNT_BUCKETS = 1 << 16
#: Size of the parity sketch in longs; larger sets also have a wide one of a bit or more for each token.
SKETCH_LONGS = 8
#: Rows of texts and of keys that go to a Python worker at once.
KEY_ROWS = 1 << 13
#: Copies whose ids are sent to all tasks; beyond that they are left out by a shuffled join.
MAX_BROADCAST_ROWS = 1_000_000

SKETCH = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("th", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("bits", T.ArrayType(T.LongType())), T.StructField("wide", T.ArrayType(T.LongType()))])


def shingle_sets(texts: list[bytes], n: int = 3) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its word n-grams, A-Z lower-cased.

    A text of fewer words has one, its whole sequence; one without words has none.
    """
    hashes, begins, _, _ = words_of(texts, lower=True)
    for i in range(len(texts)):
        w = hashes[begins[i] : begins[i + 1]]
        if len(w) >= n:
            yield np.unique(grams(w, n))
        elif len(w):
            yield mix(grams(w, len(w)) + np.uint64(len(w)))
        else:
            yield w


def bands(t: float) -> list[int]:
    """Lower ends of the size bands; a set similar to one of a band lies in that band or beside it.

    A band spans the ratio of similar sizes, or a power of it up to 1.6: fewer sets then have keys in two bands.
    """
    ratio = (1 / t) ** max(1, int(math.log(1.6) / math.log(1 / t)))
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, math.floor(out[-1] * ratio) + 1))
    return out


def most_different(size: int, t_pct: int) -> int:
    """Tokens in which a set may differ from a similar one of its size or more."""
    t = t_pct / 100
    return math.floor((1 - t) / (1 + t) * (size + size / t) + 1e-9)


@lru_cache(None)
def allocation(low: int, high: int, t_pct: int, n_docs: int) -> tuple[int, int, int]:
    """(slack, segments of 1 unit, segments of 2 units) for pairs whose smaller set has low to high - 1 tokens.

    The slack exceeds the number of empty segments that a set has by chance.
    """
    differ = most_different(high - 1, t_pct)
    best = None
    for two in range(0, differ // 2 + 2):
        slack = 2
        while True:
            one = max(0, differ + slack - 2 * two)
            per = low / (one + two)
            empty = one * math.exp(-per)
            enough = 2 + math.ceil(empty + 4 * math.sqrt(empty) - 0.1)
            if slack >= enough or slack > 2 * differ + 2:
                break
            slack += 1
        chance = lambda tokens: n_docs * 2.0 ** (-TOKEN_BITS * max(0.0, tokens))
        cost = one * (1 + chance(per)) + two * (1 + per + chance(per - 1))
        if best is None or cost < best[0]:
            best = (cost, slack, one, two)
    return best[1], best[2], best[3]


def band_keys(tokens: np.ndarray, band: int, low: int, high: int, t_pct: int, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys of one set in one band: of whole subsets, and of subsets with one token deleted."""
    slack, one, two = allocation(low, high, t_pct, n_docs)
    m = one + two
    seg = ((tokens >> np.uint64(33)) % np.uint64(m)).astype(np.int64)
    order = np.argsort(seg, kind="stable")
    part = mix(tokens[order] ^ np.uint64(0x5851F42D4C957F2D))
    total = np.zeros(len(part) + 1, np.uint64)
    np.cumsum(part, out=total[1:])
    ends = np.cumsum(np.bincount(seg, minlength=m))
    starts = np.concatenate(([0], ends[:-1]))
    salt = mix(np.arange(m, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(band + 1))
    sums = total[ends] - total[starts] + salt
    need = most_different(min(len(tokens), high - 1), t_pct) + slack
    first = min(need, one) + min(two, max(0, -(-(need - one) // 2)))  # segments that add up to the units needed
    empty = (ends == starts) & (np.arange(m) < one)
    wanted = np.arange(m) < first
    whole = sums[wanted] if (empty & wanted).sum() >= slack else sums[wanted & ~empty]
    near = np.zeros(0, np.uint64)
    if first > one:
        a, b = int(starts[one]), int(ends[first - 1])
        near = np.unique(mix(sums[seg[order][a:b]] - part[a:b]))
    return np.unique(mix(whole)), near


def parity(tokens: np.ndarray, longs: int) -> np.ndarray:
    """Bits that say how many tokens fall on each, modulo 2; halves of a sketch XOR to the sketch of half the size."""
    flips = np.bincount((tokens % np.uint64(64 * longs)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(flips.astype(np.uint8)).view(np.int64)


def sketches(docs: DataFrame, n: int = 3) -> DataFrame:
    """One row per document: size, two hashes of the set, its parity sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in sliced(batches):
            sizes, h1, h2, bits, wide = [], [], [], [], []
            for s in shingle_sets(texts, n):
                sizes.append(len(s))
                h1.append(mix(np.array([mix(s).sum(dtype=np.uint64) + np.uint64(len(s))]))[0])
                h2.append(mix(s ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64))
                bits.append(parity(s, SKETCH_LONGS))
                longs = 1 << max(0, len(s) - 1).bit_length() - 6 if len(s) > 64 * SKETCH_LONGS else 0
                wide.append(parity(s, longs) if longs else bits[-1][:0])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    part.column(1),
                    pa.array(sizes, pa.int64()),
                    pa.array(np.array(h1, np.uint64).view(np.int64)),
                    pa.array(np.array(h2, np.uint64).view(np.int64)),
                    lists(np.concatenate(bits), [SKETCH_LONGS] * len(bits)),
                    lists(np.concatenate(wide), [len(x) for x in wide]),
                ],
                names=SKETCH.names,
            )

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), "text").mapInArrow(run, SKETCH)


KEYS = "node long, keys array<long>, near_keys array<long>"


def set_keys(docs: DataFrame, n_docs: int, t_pct: int, n: int) -> DataFrame:
    """The keys of each document's set."""
    ends = bands(t_pct / 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in sliced(batches):
            keys, near_keys = [], []
            for s in shingle_sets(texts, n):
                own = [(s[:0], s[:0])]
                if len(s):
                    b = int(np.searchsorted(ends, len(s), "right")) - 1
                    below = [b - 1] if b and t_pct * len(s) <= 100 * (ends[b] - 1) else []
                    own = [band_keys(s, k, ends[k], ends[k + 1], t_pct, n_docs) for k in (b, *below)]
                keys.append(np.concatenate([k for k, _ in own]))
                near_keys.append(np.concatenate([k for _, k in own]))
            columns = [lists(np.concatenate(k).view(np.int64), [len(x) for x in k]) for k in (keys, near_keys)]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["node", "keys", "near_keys"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, KEYS)


SETS = "node long, tokens array<long>"


def token_sets(docs: DataFrame, n: int = 3) -> DataFrame:
    """(node, tokens) of the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in sliced(batches):
            found = list(shingle_sets(texts, n))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), lists(np.concatenate(found).view(np.int64), [len(s) for s in found])], names=["node", "tokens"]
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SETS)


RARE = "node long, key long, whole boolean"


def rare_keys(docs: DataFrame, counts: np.ndarray, t_pct: int, n: int) -> DataFrame:
    """(node, key, whole): each set's rarest tokens, whole those at places up to H / 2 for the largest partner.

    A pair meets by a token that is whole for one of them, so a set needs one row a token.
    """
    sent = docs.sparkSession.sparkContext.broadcast(counts)  # COUNT_BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = sent.value
        for part, texts in sliced(batches):
            keys, whole = [], []
            for s in shingle_sets(texts, n):
                size = len(s)
                first = size - -(-t_pct * size // 100) + 1 if size else 0
                order = np.lexsort((s, frequent[(s % np.uint64(COUNT_BUCKETS)).astype(np.int64)]))[:first]
                keys.append(mix(s[order]))
                whole.append(np.arange(len(order)) <= most_different(size, t_pct) // 2)
            sizes = np.array([len(k) for k in keys], np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes))),
                    pa.array(np.concatenate(keys).view(np.int64)),
                    pa.array(np.concatenate(whole)),
                ],
                names=["node", "key", "whole"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, RARE)


def near(t_pct: int) -> Column:
    """Whether the sizes and parity sketches of l and r leave the similarity possible: sketches differ in no more
    bits than the sets differ in tokens. Wide sketches are compared where both sets have one."""
    differ = F.lit(0)
    for i in range(SKETCH_LONGS):
        differ = differ + F.bit_count(F.get("l_bits", F.lit(i)).bitwiseXOR(F.get("r_bits", F.lit(i))))
    low, high = F.least("l_n_shingles", "r_n_shingles"), F.greatest("l_n_shingles", "r_n_shingles")
    most = (100 - t_pct) * (low + high)
    xor = lambda x, y: x.bitwiseXOR(y)

    def fold(a: str, b: str) -> Column:
        """a folded to the size of b: sizes are powers of 2, similar sets differ by one at most."""
        half = (F.size(a) / 2).cast("int")
        return F.when(F.size(a) > F.size(b), F.zip_with(F.slice(a, 1, half), F.slice(a, half + 1, half), xor)).otherwise(F.col(a))

    counts = F.zip_with(fold("l_wide", "r_wide"), fold("r_wide", "l_wide"), lambda x, y: F.bit_count(xor(x, y)))
    wide = F.when((F.size("l_wide") == 0) | (F.size("r_wide") == 0), F.lit(0)).otherwise(F.aggregate(counts, F.lit(0), lambda a, x: a + x))
    return (100 * low >= t_pct * high) & ((100 + t_pct) * differ <= most) & ((100 + t_pct) * wide <= most)


def possible(pairs: DataFrame, bits: DataFrame, t_pct: int) -> DataFrame:
    """The pairs (a, b) that ``near`` does not rule out."""
    side = lambda p, key: bits.select(F.col("node").alias(key), *[F.col(c).alias(f"{p}_{c}") for c in ("n_shingles", "bits", "wide")])
    return pairs.join(side("l", "a"), "a").join(side("r", "b"), "b").filter(near(t_pct)).select("a", "b")


def holding(docs: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """(doc_id, text) of the documents with these ids, and maybe of some others: a join would shuffle all texts where the ids are many."""
    wanted = KeyFilter(ids, column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(wanted.may_hold(ids)))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, text string")


def verified(pairs: DataFrame, docs: DataFrame, t_pct: int, n: int) -> DataFrame:
    """The pairs (a, b) that reach the similarity, by exact intersection of the sets of the documents concerned."""
    wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    sets = cut(token_sets(holding(docs, wanted, "doc_id"), n), "sets")  # of other documents too, which no pair has
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("ta")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("tokens").alias("tb")), "b"
    )
    inner = F.size(F.array_intersect("ta", "tb"))
    return both.withColumn("i", inner).filter(100 * F.col("i") >= t_pct * (F.size("ta") + F.size("tb") - F.col("i"))).select("a", "b").distinct()


MEMBERS = "key long, node long, whole boolean, first long"


def shared_members(keyed: DataFrame) -> DataFrame:
    """MEMBERS of the keys that two sets or more have, one of them whole, from one sort of (key, node, whole); first is the least such node.

    A key's first row says all that its others need, so a key of any size streams through.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, gone = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)], False  # the last key's first row, and whether it went out
        for batch in batches:
            key, node, whole = (np.concatenate((h, np.asarray(c).astype(h.dtype))) for h, c in zip(held, batch.columns))
            if not len(key):
                continue
            begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            size = np.diff(np.append(begin, len(key)))
            several = size > 1
            some = np.repeat(several & whole[begin], size)
            first = np.repeat(node[begin], size)
            some[0] &= not gone
            held, gone = [x[begin[-1:]] for x in (key, node, whole)], bool(several[-1])
            yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (key, node, whole, first)], names=[c.split()[0] for c in MEMBERS.split(", ")])

    return keyed.select("key", "node", "whole").repartition("key").sortWithinPartitions("key", F.desc("whole"), "node").mapInArrow(run, MEMBERS)


def members_of_shared(keyed: DataFrame, name: str) -> DataFrame:
    """``shared_members`` as a table. The keys take more room than the texts, so they are made and shuffled once."""
    return cut(shared_members(keyed), f"{name}_members", KEY_ROWS)


def placed_in(members: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The members with their components, and of the keys that span several: the largest component and the pairs to compare."""
    placed = members.join(found, "node", "left").select("key", "node", "whole", F.coalesce("component", "node").alias("component"))
    sizes = placed.groupBy("key", "component").count().groupBy("key")
    sizes = sizes.agg(F.max(F.struct("count", "component")).alias("main"), F.count(F.lit(1)).alias("parts"), F.sum("count").alias("n"))
    others = F.col("n") - F.col("main.count")
    return placed, cut(sizes.filter("parts > 1").select("key", F.col("main.component").alias("main"), others.alias("others"), (others * F.col("n")).alias("pairs")), "mixed_keys")


def across(placed: DataFrame, mixed: DataFrame, bits: DataFrame, t_pct: int, name: str) -> DataFrame:
    """The pairs (a, b) of different components that share a key and that ``near`` does not rule out."""
    open_ = cut(placed.join(mixed.select("key", "main"), "key").join(bits, "node"), name)
    side = lambda p: open_.select("key", "main", *[F.col(c).alias(f"{p}_{c}") for c in ("node", "whole", "component", "n_shingles", "bits", "wide")])
    left, right = side("l").filter("l_component <> main").drop("main"), side("r")
    other = (F.col("l_component") != F.col("r_component")) & ((F.col("r_component") == F.col("main")) | (F.col("l_node") < F.col("r_node")))
    other = other & (F.col("l_whole") | F.col("r_whole"))
    rest = left.join(right, "key").filter(other & near(t_pct))
    return rest.select(F.least("l_node", "r_node").alias("a"), F.greatest("l_node", "r_node").alias("b")).distinct()


def similarity_components(docs: DataFrame, t_pct: int = 90, n: int = 3) -> DataFrame:
    """doc_id, n_shingles and component_id for every document.

    Documents link when 100 * intersection >= t_pct * union of their n-gram sets; component_id is the smallest
    doc_id reachable. Pairs are not returned: copies of one text alone would have quadratically many. Null and empty texts
    link with nothing. Rows of equal doc_id are one node; a null doc_id has a null component. Very long texts are sets
    of their full size.
    """
    sk = cut(sketches(docs, n), "sketches")
    some = sk.filter("doc_id IS NOT NULL AND n_shingles > 0")
    classes = cut(some.groupBy("h1", "h2").agg(F.min("doc_id").alias("node")), "classes")
    # copies of a smaller doc_id leave; their ids are few or else joined by a shuffle
    copies = cut(some.join(classes, ["h1", "h2"]).filter("doc_id <> node").select("doc_id", "th").distinct(), "copies")
    few = copies.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS
    copies = F.broadcast(copies) if few else copies
    reps = some.join(copies, ["doc_id", "th"], "left_anti").withColumnRenamed("doc_id", "node")
    left = docs.filter("doc_id IS NOT NULL").select("doc_id", "text", F.xxhash64("text").alias("th")).join(copies, ["doc_id", "th"], "left_anti")
    own = set_keys(left, max(1, docs.count()), t_pct, n)
    pair = lambda key, whole: F.struct(key.alias("key"), F.lit(whole).alias("whole"))
    every = F.concat(F.transform("keys", lambda k: pair(k, True)), F.transform("near_keys", lambda k: pair(k, False)))
    members = members_of_shared(own.select("node", F.inline(every)), "segments")

    bits = cut(reps.select("node", "n_shingles", "bits", "wide").join(members.select("node").distinct(), "node"), "bits")
    stars = members.filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    stars = cut(possible(stars, bits, t_pct), "stars")
    links = cut(verified(stars, docs, t_pct, n), "links")
    found = components(links)

    # keys whose sets lie in several components
    placed, mixed = placed_in(members, found)
    placed = cut(placed.join(mixed.select("key", ((F.col("pairs") > CROWD_PAIRS) & (F.col("others") > CROWD_OTHERS)).alias("crowded")), "key"), "placed")
    rest = across(placed.filter("NOT crowded").drop("crowded"), mixed, bits, t_pct, "open")

    crowd = cut(placed.filter("crowded").select("node").distinct(), "crowd")
    if not crowd.isEmpty():
        texts = holding(left, crowd, "node")  # sets beyond the crowd only meet others once more
        members = members_of_shared(rare_keys(texts, bucket_counts(texts, lambda t: np.concatenate(list(shingle_sets(t, n))), COUNT_BUCKETS), t_pct, n), "rare")
        place = lambda name: found.select(F.col("node").alias(name), F.col("component").alias(f"{name}_component"))
        more = members.filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
        more = more.join(place("a"), "a", "left").join(place("b"), "b", "left").filter("coalesce(a_component, a) <> coalesce(b_component, b)")
        more = cut(possible(more.select("a", "b"), bits, t_pct), "rare_stars")
        found = merged(found, cut(verified(more, docs, t_pct, n), "rare_links"))
        stars = stars.union(more)
        placed, mixed = placed_in(members, found)
        rest = rest.union(across(placed, mixed, bits, t_pct, "rare_open")).distinct()

    rest = cut(rest.join(stars, ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        found = merged(found, cut(verified(rest, docs, t_pct, n), "more_links"))

    named = cut(classes.join(found, "node", "left").select("h1", "h2", F.coalesce("component", "node").alias("component_id")), "named")
    out = sk.select("doc_id", "n_shingles", "h1", "h2").join(named, ["h1", "h2"], "left")
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    return out.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_first(docs: DataFrame, t_pct: int = 80, n: int = 5) -> DataFrame:
    """Keeps one document of each component, that with the smallest doc_id.

    Documents that link with nothing stay, as do rows with a null doc_id. Of repeated rows all stay.
    """
    found = similarity_components(docs, t_pct, n).filter("component_id < doc_id").select(F.col("doc_id").alias("gone__id")).distinct()
    found = cut(found, "gone")
    return docs.join(found, F.col("doc_id") == F.col("gone__id"), "left_anti")
