"""Quality rules with thresholds that adapt to language and source.

Each measure's distribution per (lang, source) is kept as a quantile sketch: counts of
logarithmic buckets, which merge by addition, so partial sketches combine before any shuffle and the
result does not depend on the order of merging. A group's quartiles are drawn towards those of all rows, the more the fewer
rows it has, and fences beyond them replace fixed cutoffs: the mean word length has a lower and an upper one. Shares of
symbols, repeated lines and repeated words are 0 in most texts, so their quartiles alone would reject every text
that has any: their fence is at least MATERIAL, and higher in groups where larger shares are usual. Documents join their
group's fences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import SPACES, cut, let, words

#: Relative width of a sketch bucket: a quantile is off by 2 % at most.
GAMMA = 1.04
#: Rows of all rows' quartiles that are mixed into a group's.
PRIOR_ROWS = 50
#: Distance of the fences from the quartiles, in quartile ranges.
REACH = 3.0
#: Shares up to which a text is not rejected, whatever its group: fixed, as most groups' quartiles are 0.
MATERIAL = {"symbol_share": 0.06, "dup_line_share": 0.4, "repeat_share": 0.3}
#: Measures that also have a lower fence.
TWO_SIDED = ("mean_word",)
MAX_BROADCAST_ROWS = 100_000
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def n_repeat_words(w: Column) -> Column:
    """Words within a run of three words that stands twice or more in the text.

    Runs are compared by 64-bit hashes. Only texts with a repeated run sort them.
    """

    def runs(x):
        return F.transform(F.sequence(F.lit(0), F.size(x) - 3), lambda i: F.xxhash64(F.get(x, i), F.get(x, i + 1), F.get(x, i + 2)))

    def covered(h):
        pairs = F.array_sort(F.transform(h, lambda v, i: F.struct(v.alias("h"), i.alias("i"))))
        same = lambda p, k, d: F.coalesce(F.get(p, k + d)["h"] == F.get(p, k)["h"], F.lit(False))
        twice = let(pairs, lambda p: F.filter(p, lambda _, k: same(p, k, -1) | same(p, k, 1)))
        places = F.array_sort(F.transform(twice, lambda s: s["i"]))
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
        step = lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"))
        return F.aggregate(places, start, step)["n"]

    some = let(w, lambda x: let(runs(x), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0)))
    return F.when(F.size(w) >= 4, some).otherwise(0)


def measures(docs: DataFrame) -> DataFrame:
    """Adds MEASURES, replacing columns of these names; a null text counts as empty."""
    docs = docs.drop(*MEASURES)
    text = F.coalesce(F.col("text"), F.lit(""))
    without = lambda t, chars: F.length(F.translate(t, chars, ""))
    rows = docs.withColumn("words__", words(text)).withColumn(
        "lines__", F.filter(F.split(text, "\n"), lambda x: without(x, SPACES) > 0)
    )
    return rows.select(
        *docs.columns,
        F.size("words__").cast("long").alias("n_words"),
        without(text, SPACES).cast("long").alias("word_chars"),
        (F.length(text) - without(text, "#*$%&|<>")).cast("long").alias("n_symbols"),
        F.size("lines__").cast("long").alias("n_lines"),
        (F.size("lines__") - F.size(F.array_distinct("lines__"))).cast("long").alias("n_dup_lines"),
        n_repeat_words(F.col("words__")).cast("long").alias("n_repeat_words"),
    )


def _shares() -> dict[str, Column]:
    over = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "symbol_share": over("n_symbols", "word_chars"),
        "mean_word": over("word_chars", "n_words"),
        "dup_line_share": over("n_dup_lines", "n_lines"),
        "repeat_share": over("n_repeat_words", "n_words"),
    }


def sketches(measured: DataFrame) -> DataFrame:
    """Mergeable sketches as rows (lang, source, measure, bucket, n); bucket null holds zeros."""
    shares = F.array(*[F.struct(F.lit(k).alias("measure"), v.alias("x")) for k, v in _shares().items()])
    rows = measured.filter("n_words > 0").select("lang", "source", F.inline(shares))
    bucket = F.when(F.col("x") > 0, F.ceil(F.log(F.col("x")) / F.log(F.lit(GAMMA))).cast("int"))
    return rows.groupBy("lang", "source", "measure", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def quartiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Per group and measure: rows, first and third quartile of the merged sketch."""
    merged = sketch.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by, "measure")
    run = group.orderBy(F.col("bucket").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    value = F.when(F.col("bucket").isNull(), 0.0).otherwise(2 * F.pow(F.lit(GAMMA), F.col("bucket")) / (1 + GAMMA))
    at = merged.withColumn("upto", F.sum("n").over(run)).withColumn("all", F.sum("n").over(group)).withColumn("value", value)
    quartile = lambda q: F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("value")))
    return at.groupBy(*by, "measure").agg(F.max("all").alias("n"), quartile(0.25).alias("q1"), quartile(0.75).alias("q3"))


def fences(sketch: DataFrame) -> DataFrame:
    """Per (lang, source): the lower and upper fence of each measure."""
    every = quartiles(sketch, []).select("measure", F.col("q1").alias("all1"), F.col("q3").alias("all3"))  # a row for each measure
    own = quartiles(sketch, ["lang", "source"]).join(F.broadcast(every), "measure")
    drawn = lambda q, a: (F.col("n") * F.col(q) + PRIOR_ROWS * F.col(a)) / (F.col("n") + PRIOR_ROWS)
    own = own.select("lang", "source", "measure", drawn("q1", "all1").alias("q1"), drawn("q3", "all3").alias("q3"))
    width = REACH * (F.col("q3") - F.col("q1"))
    out = []
    for m in _shares():
        hi = F.greatest(F.col("q3") + width, F.lit(MATERIAL.get(m, 0.0)))
        out.append(F.max(F.when(F.col("measure") == m, hi)).alias(f"{m}_hi"))
        if m in TWO_SIDED:
            out.append(F.max(F.when(F.col("measure") == m, F.col("q1") - width)).alias(f"{m}_lo"))
    return own.groupBy("lang", "source").agg(*out)


def judge(docs: DataFrame, min_words: int = 50, max_repeat_pct: int = 50) -> DataFrame:
    """Adds the measures, ``base_failed`` and ``kept``.

    base_failed: under ``min_words`` words, or over ``max_repeat_pct`` percent repeated words. Others are
    kept if each measure is within its group's fences. Null texts have no words and fail. Null lang
    or source form groups of their own. An empty table gives an empty result. The text leaves, other columns stay;
    those with the names of results are replaced.
    """
    docs = docs.drop("base_failed", "kept")
    carried = [F.col(f"`{c}`") for c in docs.columns if c not in ("text", *MEASURES)]
    measured = cut(measures(docs).select(*carried, *MEASURES), "measures")
    sketch = cut(sketches(measured), "sketches")
    own = fences(sketch)
    own = cut(own.select(*[F.col(c).alias(f"fence__{c}") for c in own.columns]), "fences")
    small = own.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS
    rows = measured.join(
        F.broadcast(own) if small else own,
        F.col("lang").eqNullSafe(F.col("fence__lang")) & F.col("source").eqNullSafe(F.col("fence__source")),
        "left",
    )
    fence = lambda name: F.col(f"fence__{name}")
    within = F.lit(True)
    for m, share in _shares().items():
        within = within & (share <= fence(f"{m}_hi"))
        if m in TWO_SIDED:
            within = within & (share >= fence(f"{m}_lo"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & F.coalesce(within, F.lit(True))).drop(*own.columns)
