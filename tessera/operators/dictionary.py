"""Dictionary matching on whole words: texts against very many terms, without a product of the two.

Terms and texts are compared run by run: for each number of words that terms have, the runs of so many words of a text. Words are hashed, and
the hash of any run follows from sums over the words before it, so tasks look a text's runs up in a filter of the terms' hashes without writing any.
Only runs that pass are written; they meet the terms in an equi-join on their words, which leaves nothing to chance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import plain
from tessera.solvers.groups import in_groups

#: Bits of the filter for each term and at most: 16 MB. A fuller filter lets more runs pass, never fewer.
FILTER_BITS, MAX_FILTER_BITS = 16, 1 << 27
#: Terms that are sent to all tasks.
FEW = 200_000
#: Words that a task looks up at once.
STEP = 1 << 20
#: An odd factor and its inverse modulo 2^64.
ODD = 0x9E3779B97F4A7C15
INVERSE = pow(ODD, -1, 1 << 64)


def _split(text: Column) -> Column:
    return F.filter(F.split(plain(text), " "), lambda w: w != "")


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _runs(words: np.ndarray, lengths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(n, hashes) of the runs of n words at each place where n words are left; ``words`` are hashes."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * _powers(ODD, len(words))[:-1], dtype=np.uint64)])
    back = _powers(INVERSE, len(words))
    for n in lengths:
        if n <= len(words):
            h = (sums[n:] - sums[:-n]) * back[: len(words) - n + 1]
            h ^= h >> np.uint64(32)
            yield n, h * np.uint64(ODD)


def _hashes(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All hashes of a column of arrays, and where each row's begin and end."""
    at = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]].view(np.uint64), at - at[0]


def _filter(terms: DataFrame, n_terms: int) -> np.ndarray:
    """Bits of the hashes of all terms (h: the hashes of their words), as 64-bit words; at most MAX_FILTER_BITS."""
    size = 1 << max(16, min(MAX_FILTER_BITS, FILTER_BITS * n_terms).bit_length() - 1)

    def bits(batches):
        for b in batches:
            words, at = _hashes(b.column(0))
            whole = [next(h for _, h in _runs(words[i:j], [j - i])) for i, j in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([pa.array((np.concatenate([np.zeros(0, np.uint64), *whole]) >> np.uint64(1)).view(np.int64) % size)], names=["bit"])

    longs = terms.select("h").mapInArrow(bits, "bit long").groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits"))
    table, found = np.zeros(size >> 6, np.int64), longs.toArrow()  # at most MAX_FILTER_BITS / 64 rows
    table[found["at"].to_numpy()] = found["bits"].to_numpy()
    return table.view(np.uint64)


def matches(docs: DataFrame, id_: str, text: str, terms: DataFrame, term_id: str, alias: str, few: int = FEW) -> DataFrame:
    """(doc, start, n, term) for every place where the n words of a term stand in a text, both in normal form; words count from 0.

    Ids of texts must be unique. Null texts and terms without a word match nothing; terms of equal words all match.
    """
    spark = docs.sparkSession
    t = terms.select(F.col(term_id).alias("term"), _split(F.col(alias)).alias("words")).filter("term IS NOT NULL AND size(words) > 0").distinct().persist()  # read three times
    hashed = F.transform("words", lambda w: F.xxhash64(w)).alias("h")
    sizes = {r["n"]: r["count"] for r in t.groupBy(F.size("words").alias("n")).count().collect()}  # a row for each number of words
    total, lengths = sum(sizes.values()), sorted(sizes)
    table = spark.sparkContext.broadcast(_filter(t.select(hashed), total))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = table.value
        size = np.int64(len(bits) << 6)
        for b in batches:
            words, at = _hashes(b.column(2))
            first = 0
            while first < b.num_rows:  # texts of about STEP words at once
                last = max(first + 1, int(np.searchsorted(at, at[first] + STEP, "right")) - 1)
                own, edges = words[at[first] : at[last]], at[first : last + 1] - at[first]
                row = np.repeat(np.arange(last - first), np.diff(edges))
                rows, starts, ns = [], [], []
                for n, h in _runs(own, lengths):
                    x = (h >> np.uint64(1)).view(np.int64) % size
                    hit = np.flatnonzero((bits[x >> 6] >> (x & 63).astype(np.uint64)) & np.uint64(1))
                    hit = hit[hit + n <= edges[row[hit] + 1]]  # a run ends within its text
                    rows.append(row[hit])
                    starts.append(hit - edges[row[hit]])
                    ns.append(np.full(len(hit), n))
                if rows and sum(map(len, rows)):
                    each = np.concatenate(rows)
                    order = np.argsort(each, kind="stable")
                    counts = np.bincount(each, minlength=last - first)
                    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                    start, n = (pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(v)[order].astype(np.int32))) for v in (starts, ns))
                    some = pa.array(counts > 0)
                    part = b.slice(first, last - first)
                    columns = [part.column(0), part.column(1), start, n]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc", "words", "start", "n"]).filter(some)
                first = last

    d = docs.select(F.col(id_).alias("doc"), _split(F.col(text)).alias("words")).select("doc", "words", hashed)
    kind = d.schema["doc"].dataType.simpleString()
    held = d.mapInArrow(look, f"doc {kind}, words array<string>, start array<int>, n array<int>")
    run = F.array_join(F.slice("words", F.col("r.start") + 1, F.col("r.n")), " ")
    runs = held.select("doc", "words", F.explode(F.arrays_zip("start", "n")).alias("r")).select("doc", "r.start", "r.n", run.alias("run"))
    known = t.select("term", F.array_join("words", " ").alias("run"))
    return runs.join(F.broadcast(known) if total <= few else known, "run").select("doc", "start", "n", "term")


def marked(found: DataFrame) -> DataFrame:
    """The matches with ``taken``: whether a reader takes them from left to right, the longest at the first place, then on after its end."""

    def take(key, starts, ns, terms):
        until = 0
        for start, n, term in zip(starts, ns, terms):
            yield key, start, n, term, start >= until
            until = start + n if start >= until else until

    kind = found.schema["doc"].dataType.simpleString()
    rows = found.select("doc", "start", "n", F.col("term").cast("long"))
    return in_groups(rows, "doc", ["start", F.desc("n"), "term"], take, f"doc {kind}, start int, n int, term bigint, taken boolean")


def longest(found: DataFrame) -> DataFrame:
    """Of the matches of a text those that a reader takes."""
    return marked(found).filter("taken").drop("taken")


def translated(entities: DataFrame, cache: DataFrame, parts: list[str], phrase: str, most: int = 120) -> DataFrame:
    """Adds ``phrase`` and ``from_cache``: the cached phrase of the same ``parts`` (nulls as empty), spaces squeezed and cut to ``most`` characters, or else the
    parts joined by a space. A cache row without words is no phrase; of rows with equal parts the first by phrase counts."""
    clean = F.substring(F.trim(F.regexp_replace(F.col(phrase), "\\s+", " ")), 1, most)
    keys = [F.coalesce(F.col(p), F.lit("")).alias(f"{p}__") for p in parts]
    known = cache.select(*keys, clean.alias("cached__")).filter("cached__ <> ''").groupBy(*[f"{p}__" for p in parts]).agg(F.min("cached__").alias("cached__"))
    rows = entities.select("*", *keys).join(known, [f"{p}__" for p in parts], "left")
    fallback = F.trim(F.array_join(F.filter(F.array(*[F.col(f"{p}__") for p in parts]), lambda x: x != ""), " "))
    return rows.select(*entities.columns, F.coalesce("cached__", fallback).alias("phrase"), F.col("cached__").isNotNull().alias("from_cache"))


def capital_runs(docs: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, start, n, entity): runs of words that begin with a capital and go on in small letters, from the second word of a text on.

    Marks of punctuation at a word's end close its run and are left out.
    """
    words = F.transform(F.filter(F.split(F.col(text), "\\s+"), lambda w: w != ""), lambda w, i: F.struct(i.alias("at"), F.regexp_replace(w, "[.,;:!?]+$", "").alias("w"), w.rlike("[.,;:!?]$").alias("last")))
    kept = F.filter(words, lambda x: (x["at"] > 0) & x["w"].rlike("^\\p{Lu}\\p{Ll}"))
    each = docs.select(*key, F.inline(kept))
    by = Window.partitionBy(*key).orderBy("at")
    fresh = F.coalesce((F.lag("at").over(by) < F.col("at") - 1) | F.lag("last").over(by), F.lit(True))
    runs = each.withColumn("fresh", fresh).withColumn("run", F.sum(F.col("fresh").cast("int")).over(by))
    out = runs.groupBy(*key, "run").agg(F.min("at").alias("start"), F.count(F.lit(1)).cast("int").alias("n"), F.array_sort(F.collect_list(F.struct("at", "w"))).alias("ws"))
    return out.select(*key, "start", "n", F.array_join(F.transform("ws", lambda x: x["w"]), " ").alias("entity"))
