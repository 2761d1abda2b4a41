"""Corpus pipeline: from raw documents to a mix of sources.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and is written as a table
that the next one reads. A stage begins by deleting the working tables of those before it over the same folder,
but for what ``docs`` still reads; tables of other folders' runs and of other queries are left alone. So runs over one
folder follow each other in a process.
"""

from __future__ import annotations

import functools
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, jaccard_join, language_id, line_dedup, mixing
from tessera.llm.common import SPACES, cut, read, release, tracked


_tables: dict[str, list[str]] = defaultdict(list)


def _stage(stage):
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, _tables[sf_dir], docs)
        with tracked(_tables[sf_dir]):
            return stage(spark, docs, sf_dir)

    return run_stage


@_stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is not told with enough certainty (no letters, or a low score).

    Without a labelled row there is no model to reject by; then only documents without letters go.
    """
    model = language_id.fit(docs)
    if model is None:
        return docs.filter(F.col("text").rlike("\\p{L}"))
    return language_id.predict(docs, model).filter("accepted").select(*docs.columns)


@_stage
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that repeat an earlier one, exactly or with up to a tenth of its words edited, and documents left without words."""
    kept = line_dedup.dedup(docs)
    return kept.filter(F.length(F.translate("text", SPACES, "")) > 0)


@_stage
def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of near-duplicates (five-word shingles, 0.8)."""
    return jaccard_join.keep_first(docs, 80, 5)


@_stage
def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document, by the target weights of the sources."""
    return mixing.mix_totals(docs)


STAGES = [
    ("language", identify_language),
    ("lines", drop_repeated_lines),
    ("near_duplicates", keep_one_of_each_group),
    ("benchmark", drop_benchmark_leaks),
    ("mix", mix_sources),
]

#: Stages learn a model and compare lines by edits, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; only the table of the last one stays."""
    docs, stages = read(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        result = stage(spark, docs, sf_dir)
        with tracked(stages):
            docs = cut(result, f"stage_{name}")
        release(spark, stages, docs)
    release(spark, _tables[sf_dir], docs)
    return docs
