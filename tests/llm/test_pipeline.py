"""The pipeline's result against plain versions of its stages, one after another, on a small table."""

import duckdb

import corpus_pipeline
import test_decontaminate
import test_jaccard_join
import test_line_dedup
from compare import plain
from tessera.llm import language_id, queries
from test_language_id import plain_score


def test_pipeline_equals_its_stages_by_brute_force(spark, sf_dir, tmp_path):
    every = spark.read.parquet(f"{sf_dir}/documents.parquet")
    leaks = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").limit(6).collect()]
    rows = [tuple(r) for r in every.orderBy("doc_id").limit(36).collect() if len(r.text or "") < 6000]
    columns = every.columns
    place = {c: i for i, c in enumerate(columns)}
    first = next(r for r in rows if len(r[place["text"]]) > 400)

    def like(doc_id, text):
        r = list(first)
        r[place["doc_id"]], r[place["text"]], r[place["n_chars"]] = doc_id, text, len(text or "")
        return tuple(r)

    near = first[place["text"]].replace("\n", " ").split()
    rows += [like(9001, " ".join([*near[:-1], "changed"])), like(9002, "one more text, " + leaks[0][3:99] + " and so on"), like(9003, None), like(9004, "12 34"), like(9005, first[place["text"]])]
    docs = spark.createDataFrame(rows, every.schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bench = [(i, t) for i, t in enumerate(leaks)]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    model = language_id.fit(docs)
    kept = [r for r in rows if plain_score(model, r[place["text"]])[1] >= model.threshold and plain_score(model, r[place["text"]])[0] != "und"]
    texts = {i: t for i, t in test_line_dedup.brute([(r[place["doc_id"]], r[place["text"]]) for r in kept])}
    texts = {i: t for i, t in texts.items() if t and t.strip(" \t\n\x0b\x0c\r")}
    found = test_jaccard_join.brute(sorted(texts.items()), 80, 5)
    texts = {i: t for i, t in texts.items() if found[i][1] == i}
    texts = {i: t for i, t in texts.items() if not test_decontaminate.brute(t, bench)}
    assert 9002 not in texts and 9003 not in texts and 9004 not in texts and 9005 not in texts and len(texts) > 10

    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(r[place["doc_id"]], texts[r[place["doc_id"]]], r[place["source"]]) for r in kept if r[place["doc_id"]] in texts])
    want = sorted(tuple(map(plain, r)) for r in con.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({queries.ORACLE['op5_mixing']})").fetchall())
    got = sorted(tuple(map(plain, r)) for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "size", "source_size", "target", "taken").collect())
    assert got == want


def test_tables_of_a_run_go_and_others_stay(spark, sf_dir, frame):
    """A run deletes its own working tables; a result of another query is still there afterwards."""
    from tessera.llm import quality_rules

    other = quality_rules.judge(frame([(i, f"a few words of text {i}") for i in range(20)]))
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0 and other.count() == 20 and spark.conf.get(size) == before
    assert corpus_pipeline._tables[sf_dir] == []
