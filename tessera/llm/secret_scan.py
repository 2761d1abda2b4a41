"""Secret scan: base patterns, and random strings found by two character Markov models.

The models count character pairs, one in random strings, one in ordinary identifiers. Both are
trained from labelled samples (string, label); a token's score is the mean over its pairs of the
log-likelihood ratio, so long tokens do not pass by their length. Everything runs as DataFrame expressions; the only
thing that reaches the driver is the model, 67 x 67 numbers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import let, words

ASSIGN = "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
#: Tokens that the Markov models judge.
TOKEN = "[A-Za-z0-9+/_=-]{20,}"
#: Words of the corpus that train the ordinary class, as they are and joined to identifiers.
WORD = "^[A-Za-z0-9+/_=-]{2,40}$"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
KINDS = ["assign", "access", "hex", "random"]
#: Bounds of the labelled sample: documents that give ordinary identifiers, and random strings made.
SAMPLE_DOCUMENTS = 2000
SAMPLE_RANDOM = 4000
#: Natural log of the odds for each pair of characters that a token must reach.
THRESHOLD = 0.5
#: Matches whose places are summed up at once.
CHUNK = 64
NONE = "cast(array() as array<struct<start:int,rank:int,end:int,value:string>>)"


def _located(text: Column, pattern: str, keep, kind: int) -> Column:
    """Array of (start, rank, end, value) of the matches, in code points; empty without a match.

    The text between matches comes from split, so starts follow by adding lengths: first over chunks of
    CHUNK matches, then within each, as appending to one array for all of them would copy it for every match.
    """

    def of(t: Column) -> Column:
        pairs = F.arrays_zip(F.split(t, pattern, -1).alias("gap"), F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("hit"))
        return let(F.filter(pairs, lambda p: p["hit"].isNotNull()), placed)

    def placed(pairs: Column) -> Column:
        chunk = lambda c: F.slice(pairs, c * CHUNK + 1, F.lit(CHUNK))
        numbers = F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / CHUNK).cast("int"))
        size = lambda c: F.aggregate(chunk(c), F.lit(0), lambda n, x: n + F.length(x["gap"]) + F.length(x["hit"]))
        before = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
        add = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        begins = F.aggregate(F.transform(numbers, size), before, add)["out"]
        return F.flatten(F.transform(begins, lambda at, c: within(chunk(c), at)))

    def within(some: Column, begin: Column) -> Column:
        start = F.struct(begin.alias("at"), F.expr(NONE).alias("out"))

        def step(acc, x):
            first = acc["at"] + F.length(x["gap"])
            end = first + F.length(x["hit"])
            item = F.struct(first.alias("start"), F.lit(kind).alias("rank"), end.alias("end"), x["hit"].alias("value"))
            return F.struct(end.alias("at"), F.when(keep(x["hit"]), F.concat(acc["out"], F.array(item))).otherwise(acc["out"]).alias("out"))

        return F.aggregate(some, start, step)["out"]

    return F.when(text.rlike(pattern), of(text)).otherwise(F.expr(NONE))


def labelled_sample(docs: DataFrame, documents: int = SAMPLE_DOCUMENTS, random: int = SAMPLE_RANDOM) -> DataFrame:
    """The default training rows (token, random, weight).

    Ordinary: words of the token alphabet from about ``documents`` documents chosen by hash, as they are and in the shapes of
    identifiers: paths, slugs, constants, snake and camel case. As only pairs of characters count, a shape is its words in
    its case and the joints of neighbouring words, each distinct one once with a weight. UUIDs, numbers and dates are made by rule; tokens that a base
    pattern matches are left out. Random: encodings of digests of whole numbers (hexadecimal in upper case, base64, letters and digits of
    base64, base32-like).
    """
    spark = docs.sparkSession
    step = max(1, docs.count() // documents)
    some = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0)
    own = some.select(F.filter(words(F.col("text")), lambda w: w.rlike(WORD)).alias("w"))
    row = lambda token, times=1: F.struct(token.alias("token"), (F.col("n") * times).alias("weight"))
    said = own.select(F.explode("w").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    cases = F.array(row(F.col("t")), row(F.lower("t"), 3), row(F.upper("t")), row(F.initcap("t")))
    # the last character of a word and the first of the next
    ends = F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1), lambda a, b: F.concat(F.right(a, F.lit(1)), F.left(b, F.lit(1))))
    joints = own.filter(F.size("w") > 1).select(F.explode(ends).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    a, b = F.left("t", F.lit(1)), F.right("t", F.lit(1))
    glued = [F.concat(F.lower(a), F.lit(x), F.lower(b)) for x in "/-_"] + [F.concat(F.upper(a), F.lit("_"), F.upper(b)), F.concat(F.lower(a), F.upper(b)), F.concat(a, F.lit("/"), b)]
    glued += [F.concat(F.lit("/"), b), F.concat(a, F.lit("-"))]
    plain = said.select(F.inline(cases)).unionByName(joints.select(F.inline(F.array(*[row(t) for t in glued]))))
    digest = F.sha2(F.col("id").cast("string"), 256)
    part = lambda a, n: F.substring(digest, a, n)
    rules = spark.range(random).select(
        F.explode(
            F.array(
                F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)),
                F.concat(F.conv(part(1, 12), 16, 10), F.conv(part(13, 12), 16, 10)),
                F.translate(F.date_format(F.timestamp_seconds(F.conv(part(1, 7), 16, 10).cast("long") * 8), "yyyy-MM-dd_HH-mm-ss"), ":", "-"),
                F.concat(F.lit("-"), F.pmod(F.xxhash64("id"), F.lit(3000)).cast("string")),
            )
        ).alias("token")
    )
    digest = F.sha2(F.concat(F.lit("random"), F.col("id").cast("string")), 256)
    base64 = F.base64(F.unhex(digest))
    letters = F.regexp_replace(base64, "[^A-Za-z0-9]", "")
    random_rows = spark.range(random).select(
        F.explode(
            F.array(
                F.upper(F.substring(digest, 1, 40)),
                F.translate(base64, "=", ""),
                F.translate(base64, "+/=", "-_"),
                F.substring(letters, 1, 36),
                F.substring(letters, 1, 24),
                F.substring(F.upper(letters), 1, 32),
            )
        ).alias("token")
    )
    once = lambda df: df.withColumn("weight", F.lit(1).cast("long"))
    ordinary = plain.unionByName(once(rules)).filter(~F.col("token").rlike(f"{ACCESS}|{HEX}"))
    return ordinary.withColumn("random", F.lit(False)).unionByName(once(random_rows).withColumn("random", F.lit(True)))


def train(sample: DataFrame, smoothing: float = 0.5) -> list[float]:
    """The log-likelihood ratio of each pair of characters, as a flat list by code of first and second.

    ``sample`` has token, random and maybe weight, how often the row counts. Code 0 stands for characters outside the alphabet. An empty
    sample gives zeros.
    """
    n = len(ALPHABET) + 1
    weight = F.col("weight") if "weight" in sample.columns else F.lit(1)
    rows = sample.groupBy("random", "token").agg(F.sum(weight).alias("w")).filter(F.length("token") > 1)
    pair = F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.substring(F.col("token"), i, F.lit(2)))
    pairs = rows.select("random", "w", F.explode(pair).alias("pair")).groupBy("random", "pair").agg(F.sum("w").alias("w"))
    code = {c: i + 1 for i, c in enumerate(ALPHABET)}
    inside = F.col("pair").rlike("^[A-Za-z0-9+/_=-]{2}$")
    known = F.when(inside, F.col("pair")).otherwise(F.regexp_replace("pair", "[^A-Za-z0-9+/_=-]", "\u0000"))
    counts: dict = {True: [0] * (n * n), False: [0] * (n * n)}
    for label, two, count in pairs.groupBy("random", known.alias("pair")).agg(F.sum("w")).collect():  # at most 2 * 67 * 67 rows
        counts[label][code.get(two[0], 0) * n + code.get(two[1], 0)] += count
    out = [0.0] * (n * n)
    for a in range(n):
        total = {k: sum(v[a * n : a * n + n]) + smoothing * n for k, v in counts.items()}
        for b in range(n):
            p, q = ((counts[k][a * n + b] + smoothing) / total[k] for k in (True, False))
            out[a * n + b] = round(math.log(p / q), 6)
    return out


def score(token: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio of a token's pairs of characters, random against ordinary; 0 without a pair."""
    n = len(ALPHABET) + 1
    table = F.array(*[F.lit(x) for x in model])
    codes = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))

    def of(c: Column) -> Column:
        count = F.greatest(F.size(c) - 1, F.lit(0))
        pairs = F.zip_with(F.slice(c, 1, count), F.slice(c, 2, count), lambda a, b: a * n + b)
        return F.aggregate(pairs, F.lit(0.0), lambda acc, pair: acc + F.get(table, pair)) / F.greatest(count, F.lit(1))

    return let(codes, of)


def scan(docs: DataFrame, sample: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Adds ``found``: array of (start, rank, end, value) by start and kind; rank indexes KINDS.

    Base kinds (assign, access, hex) are exact patterns. A token of 20 or more characters that
    overlaps none of them is added as ``random`` if its score reaches ``threshold``. Null and empty
    texts have no spans; other columns pass through; repeated rows are judged alike.
    """
    model = train(sample if sample is not None else labelled_sample(docs))
    text = F.coalesce(F.col("text"), F.lit(""))
    value = lambda hit: F.length(F.regexp_extract(hit, ASSIGN, 2)) >= 6
    base = F.concat(
        _located(text, ASSIGN, value, 0), _located(text, ACCESS, lambda h: F.lit(True), 1), _located(text, HEX, lambda h: F.lit(True), 2)
    )
    own = _located(text, TOKEN, lambda h: F.lit(True), 3)
    both = docs.withColumn("base__spans", base).withColumn("own__spans", own)
    clear = lambda t: ~F.exists("base__spans", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))
    own = F.filter("own__spans", lambda t: clear(t) & (score(t["value"], model) >= threshold))
    return both.withColumn("found", F.array_sort(F.concat("base__spans", own))).drop("base__spans", "own__spans")


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kind = F.array(*[F.lit(k) for k in KINDS])
    item = lambda s: F.concat_ws(":", F.get(kind, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, item), ",")


def digest(docs: DataFrame) -> DataFrame:
    """Per document: counts by base kind, the digest of the base spans, and all spans."""
    found = scan(docs.select("doc_id", "text"))
    count = lambda k: F.size(F.filter("found", lambda s: s["rank"] == k)).cast("long")
    base = F.filter("found", lambda s: s["rank"] < 3)
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
    )
