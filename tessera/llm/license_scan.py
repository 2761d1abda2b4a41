"""License scan by diagonal voting.

All rolling word k-gram hashes of the corpus join the hashed k-grams of the license templates. A hit
votes for the diagonal (place in the document less place in the template) it lies on; votes are
summed before the shuffle. Neighbouring diagonals merge into one span. A span whose hits cover enough of the template is
verified by a banded alignment of the document's words with the template's on those diagonals: its score is the share of the
template's words that stand there in order.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, let

#: Separators of words: ASCII other than 0-9 and a-z.
BREAK = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
K = 4
#: Diagonals at most so far apart merge.
GAP = 3
#: Share of a template's words that a span must hold.
COVER = 0.6
MAX_TEMPLATE_WORDS = 100_000
RESULTS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

#: Phrases of the base labels.
PHRASES = {"cc-by": ["cc", "by"], "gpl": ["general", "public", "license"], "reserved": ["all", "rights", "reserved"]}

#: License notices and opening passages. The first ones of cc-by-nc and gpl-3.0 are short forms in common use.
TEMPLATES = {
    "text:apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    ],
    "text:bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "text:cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "text:cc-by-nc": ["Licensed under CC BY-NC 4.0"],
    "text:cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "text:gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    ],
    "text:mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ],
    "text:mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
}

#: Short notices. Those of four words are found only word for word.
NOTICES = {
    "text:agpl-3.0": [
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "GNU Affero General Public License",
        "Identifier: AGPL-3.0",
    ],
    "text:apache-2.0": ["Apache License, Version 2.0", "Identifier: Apache-2.0"],
    "text:bsd": ["under the BSD License", "Identifier: BSD-3-Clause", "Identifier: BSD-2-Clause"],
    "text:cc0": ["CC0 1.0 Universal", "Identifier: CC0-1.0"],
    "text:epl-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
        "Eclipse Public License 2.0",
        "Identifier: EPL-2.0",
    ],
    "text:gpl-2.0": ["Identifier: GPL-2.0"],
    "text:gpl-3.0": ["Identifier: GPL-3.0"],
    "text:isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies",
        "under the ISC License",
        "SPDX-License-Identifier: ISC",
    ],
    "text:lgpl": ["GNU Lesser General Public License", "Identifier: LGPL-2.1", "Identifier: LGPL-3.0"],
    "text:mit": [
        "under the MIT License",
        "SPDX-License-Identifier: MIT",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    ],
    "text:mpl-2.0": ["Identifier: MPL-2.0"],
    "text:unlicense": [
        "This is free and unencumbered software released into the public domain",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a "
        "compiled binary, for any purpose, commercial or non-commercial, and by any means",
        "SPDX-License-Identifier: Unlicense",
    ],
}
#: Whole texts in the folder ``licenses``.
WHOLE = {
    "text:apache-2.0": ["Apache-2.0"],
    "text:bsd": ["BSD"],
    "text:cc0": ["CC0-1.0"],
    "text:gpl-2.0": ["GPL-2"],
    "text:gpl-3.0": ["GPL-3"],
    "text:lgpl": ["LGPL-2.1", "LGPL-3"],
    "text:mpl-2.0": ["MPL-2.0"],
}
for _label, _texts in NOTICES.items():
    TEMPLATES.setdefault(_label, []).extend(_texts)
for _label, _names in WHOLE.items():
    for _name in _names:
        # marks part words, so apostrophes may go
        _text = (Path(__file__).parent / "licenses" / f"{_name}.txt").read_text("utf-8").replace("'", " ")
        TEMPLATES.setdefault(_label, []).append(_text)


def license_words(text: Column) -> Column:
    """Words after lower-casing A-Z; a null text has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BREAK), "")


def _grams(w: Column, k: int) -> Column:
    """Array of (place, hash, word): the k-gram that starts at each place, with its first word."""
    gram = lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)])
    all_ = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.struct(i.alias("at"), gram(i).alias("hash"), F.get(w, i).alias("word")))
    return F.when(F.size(w) >= k, all_)


def template_table(spark: SparkSession, templates: dict[str, list[str]] | None = None) -> DataFrame:
    rows = [(label, f"{label}/{i}", text) for label, texts in (templates or TEMPLATES).items() for i, text in enumerate(texts)]
    fields = lambda r: F.struct(*[F.lit(v).alias(n) for v, n in zip(r, ("label", "template", "text"))])
    return spark.range(1).select(F.inline(F.array(*[fields(r) for r in rows])))


def _template_words(t: DataFrame, k: int) -> int:
    """Words of all templates; raises ValueError for templates under k words, which no k-gram can find."""
    short = F.when(F.size("tw") < k, F.col("template"))
    n, lost, some = t.agg(F.sum(F.size("tw")), F.count(short), F.min(short)).first()
    if lost:
        raise ValueError(f"{lost} templates have fewer than {k} words, {some} among them")
    return n or 0


def aligned(w: Column, tw: Column, low: Column, high: Column) -> Column:
    """The longest run of template words ``tw`` that stand in order in ``w``, on diagonals low to high.

    Dynamic programming over the template's words: an entry for each diagonal, kept or advanced by a match, by skipping a
    word of the template (from the next diagonal) or of the document (from the one before).
    """
    band = F.sequence(F.lit(0), (high - low).cast("int"))

    def step(best: Column, p: Column) -> Column:
        same = lambda j: F.coalesce((F.get(w, p["at"] + low.cast("int") + j) == p["word"]).cast("int"), F.lit(0))
        entry = F.transform(band, lambda j: F.greatest(F.get(best, j) + same(j), F.coalesce(F.get(best, j + 1), F.lit(0))))
        return let(entry, lambda e: F.transform(band, lambda j: F.array_max(F.slice(e, 1, j + 1))))

    places = F.transform(tw, lambda x, i: F.struct(i.alias("at"), x.alias("word")))
    return F.array_max(F.aggregate(places, F.transform(band, lambda _: F.lit(0)), step))


def votes(docs: DataFrame, templates: DataFrame, k: int = K) -> DataFrame:
    """Per document key, template and diagonal: hits, places covered. ``docs`` has key and words ``w``."""
    t = templates.select("label", "template", license_words(F.col("text")).alias("tw"))
    places = t.select("label", "template", F.size("tw").alias("t_words"), F.inline(_grams(F.col("tw"), k))).select(
        "label", "template", "t_words", F.col("at").alias("t_at"), F.col("hash").alias("t_hash"), F.col("word").alias("t_word")
    )
    if _template_words(t, k) <= MAX_TEMPLATE_WORDS:
        places = F.broadcast(places)
    grams = docs.select("key", F.inline(_grams(F.col("w"), k)))
    hits = grams.join(places, (F.col("hash") == F.col("t_hash")) & (F.col("word") == F.col("t_word")))
    return hits.groupBy("key", "label", "template", "t_words", (F.col("at") - F.col("t_at")).alias("diagonal")).agg(
        F.count(F.lit(1)).alias("votes"),
        F.min("at").alias("first"),
        (F.max("at") + k - 1).alias("last"),
        F.collect_set("t_at").alias("t_places"),
    )


def spans(voted: DataFrame, k: int = K, gap: int = GAP, cover: float = COVER) -> DataFrame:
    """Spans of merged diagonals whose hits cover enough of the template: key, label, template, first, last, low, high (diagonals)."""
    line = Window.partitionBy("key", "template").orderBy("diagonal")
    fresh = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(line) > gap, F.lit(True)).cast("int")
    groups = voted.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    held = F.array_distinct(F.flatten(F.transform(F.flatten(F.collect_list("t_places")), lambda p: F.sequence(p, p + k - 1))))
    merged = groups.groupBy("key", "label", "template", "t_words", "run").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.min("diagonal").alias("low"), F.max("diagonal").alias("high"), F.size(held).alias("held")
    )
    return merged.filter(F.col("held") >= cover * F.col("t_words")).drop("held", "run", "t_words")


def verified(found: DataFrame, docs: DataFrame, templates: DataFrame, cover: float = COVER) -> DataFrame:
    """The spans of ``spans`` that the alignment confirms: key, label, first, last, score. ``docs`` has key and words ``w``."""
    t = templates.select("template", license_words(F.col("text")).alias("tw"))
    both = docs.join(found, "key").join(t, "template")
    share = aligned(F.col("w"), F.col("tw"), F.col("low"), F.col("high")) / F.size("tw")
    return both.select("key", "label", "first", "last", share.alias("score")).filter(F.col("score") >= cover).distinct()


def outermost(found: DataFrame) -> DataFrame:
    """The spans without those that lie in a longer one of another label: a license's text names others, and holds their notices."""
    span = F.struct("label", "first", "last", "score")
    within = lambda s, o: (o["first"] <= s["first"]) & (o["last"] >= s["last"]) & (o["last"] - o["first"] > s["last"] - s["first"]) & (o["label"] != s["label"])
    all_ = found.groupBy("key").agg(F.collect_list(span).alias("all__"))  # a text has few verified spans
    kept = F.filter("all__", lambda s: ~F.exists("all__", lambda o: within(s, o)))
    return all_.select("key", F.inline(kept))


def scan(docs: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """Adds n_words, n_base, first_word, last_word, base_labels, labels (arrays, sorted) and score.

    Phrases of PHRASES give base labels wherever their words stand one after the other; verified spans
    add labels of templates, unless they lie in a longer one of another label. Null and empty texts have no words, no labels and score 0. Documents
    are told apart by a hash of id and text, so repeated rows get the same labels. The text leaves, other
    columns stay; those with the names of results are replaced. Without templates there are base labels only; a
    template of fewer than K words raises ValueError.
    """
    spark = docs.sparkSession
    docs = docs.drop(*RESULTS)
    carried = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    key = F.xxhash64("doc_id", "text")
    templates = templates if templates is not None else template_table(spark)
    grams = docs.select(key.alias("key"), license_words(F.col("text")).alias("w")).filter(F.size("w") >= K)
    found = cut(spans(votes(grams, templates)), "spans")
    found = outermost(verified(found, grams, templates))
    # repeated rows vote together: places and shares are sets, so they do not change
    found = found.groupBy("key").agg(F.collect_set("label").alias("own__"), F.max("score").alias("own_score__"))
    found = cut(found.withColumnRenamed("key", "key__"), "verified")

    def places(phrase: list[str]) -> Column:
        hit = lambda i: _all([F.get("words__", i + j) == p for j, p in enumerate(phrase)])
        some = F.filter(F.sequence(F.lit(0), F.size("words__") - len(phrase)), hit)
        there = (F.size("words__") >= len(phrase)) & F.array_contains("words__", phrase[-1])
        return F.when(there, some).otherwise(F.expr("cast(array() as array<int>)"))

    rows = docs.select(*carried, key.alias("key__"), license_words(F.col("text")).alias("words__"))
    names = [f"places__{i}" for i in range(len(PHRASES))]
    rows = rows.withColumns({n: places(p) for n, p in zip(names, PHRASES.values())})
    base = rows.drop("words__", *names).columns
    rows = rows.select(
        *[F.col(f"`{c}`") for c in base],
        F.size("words__").cast("long").alias("n_words"),
        F.concat(*names).alias("places__"),
        F.array_compact(F.array(*[F.when(F.size(n) > 0, F.lit(label)) for n, label in zip(names, PHRASES)])).alias("base_labels"),
    )
    none = F.expr("cast(array() as array<string>)")
    return rows.join(found, "key__", "left").select(
        *carried,
        "n_words",
        F.size("places__").cast("long").alias("n_base"),
        F.array_min("places__").cast("long").alias("first_word"),
        F.array_max("places__").cast("long").alias("last_word"),
        F.array_sort("base_labels").alias("base_labels"),
        F.array_sort(F.array_union("base_labels", F.coalesce("own__", none))).alias("labels"),
        F.when(F.size("places__") > 0, 1.0).otherwise(F.coalesce("own_score__", F.lit(0.0))).alias("score"),
    )


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
