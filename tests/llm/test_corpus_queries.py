"""The registered corpus queries: SQL where there is some, schemas, whole tables, the pipeline by stages."""

import pytest

import corpus_pipeline
from compare import connect, rows_of, rows_of_sql
from tessera.llm import queries
from tessera.llm.common import cut


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, sf_dir, name):
    names, got = rows_of(queries.QUERIES[name](spark, sf_dir))
    want_names, want = rows_of_sql(connect(sf_dir), queries.ORACLE[name])
    assert names == want_names
    assert got == want


@pytest.mark.parametrize("name", sorted({n for n in queries.QUERIES if n not in ("op1_warc", "op11_whitening", "op13_vector_codes")}))
def test_a_row_for_every_document(spark, sf_dir, name):
    ids = sorted(r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    assert sorted(r.doc_id for r in queries.QUERIES[name](spark, sf_dir).collect()) == ids


def test_pipeline_stages_follow_one_another(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, {r.doc_id for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_duplicates", "benchmark", "mix"]
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
        after = {r.doc_id for r in docs.collect()}
        assert after and after <= before
        if name != "mix":
            assert docs.columns == columns
        before = after
    bench = {" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    kept = spark.read.parquet(f"{sf_dir}/documents.parquet").filter(f"doc_id IN ({','.join(map(str, before))})").collect()
    assert not any(b in " ".join(r.text.lower().split()) and len(r.text.split("\n")) == 1 for r in kept for b in bench)


def test_pipeline_takes_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("false")
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
        assert docs.count() == 0


def test_extra_columns_with_clashing_names(frame):
    """Operators carry extra columns, and replace those that have the names of their results."""
    from pyspark.sql import functions as F

    from tessera.llm import decontaminate, jaccard_join, language_id, license_scan, line_dedup, quality_rules, secret_scan, substring_dedup

    names = ["n_words", "key", "w", "w_", "l_", "labels", "score", "kept", "items", "found", "gone_", "ats", "th", "line", "n_rows", "lang_", "places", "own", "text_", "node", "component_id", "lang_pred", "size", "hash", "anchors"]
    docs = frame([(1, "a b c d e f g h"), (2, None), (2, None), (None, "")]).withColumns({n: F.lit(1) for n in names})
    bench = docs.sparkSession.createDataFrame([(1, "z" * 90)], "item_id long, text string")
    for out in (
        secret_scan.scan(docs), quality_rules.judge(docs), license_scan.scan(docs), language_id.predict(docs, None), decontaminate.scan(docs, bench),
        decontaminate.clean(docs, bench), line_dedup.dedup(docs), substring_dedup.clean(docs), jaccard_join.keep_first(docs),
    ):
        assert out.count() == 4
        assert len(out.columns) == len(set(out.columns)) and {"doc_id", "node", "size"} <= set(out.columns)
