"""Cases of the third round's findings that failed before."""

from pyspark.sql import functions as F

from tessera import plans


def test_scan_index_rounds_in_single_precision_as_its_sql(spark, tmp_path):
    from compare import connect, rows_of, rows_of_sql

    # as a float, 0.105 times 100 is 10.5; as a double, 10.4999997
    spark.createDataFrame([(1, [0.105, -0.105, 0.2], 0), (2, [0.105, 0.3], 1)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = rows_of(plans.QUERIES["a14_scan_index"](spark, str(tmp_path)))
    assert got == rows_of_sql(connect(str(tmp_path)), plans.ORACLE["a14_scan_index"])
    assert len(got[1]) == 2


def test_only_runs_that_may_be_terms_are_written(spark):
    from tessera.operators import dictionary as D

    docs = spark.range(300).selectExpr("id", "concat_ws(' ', transform(sequence(1, 400), i -> concat('w', (i * 7 + id) % 900)), 'w1 x7') AS text")
    terms = spark.range(5000).selectExpr("id AS k", "concat('w', id % 900, ' x', id) AS alias")
    found = D.matches(docs, "id", "text", terms, "k", "alias", few=10)  # shuffled, as a large dictionary is
    assert found.count() == 0
    terms = terms.unionByName(spark.createDataFrame([(9000, "w1 x7")], "k long, alias string"))
    before = _written(spark)
    assert D.matches(docs, "id", "text", terms, "k", "alias", few=10).count() == 300
    assert _written(spark) - before < 10_000  # the texts have 120,000 words


def _written(spark):
    """Shuffle records written by this session so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    gateway = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_many_pages_make_few_partitions_with_the_same_rows(spark, tmp_path):
    import json

    from tessera.sources import providers as P

    for provider, pages in (("a", 700), ("b", 300)):
        (tmp_path / provider).mkdir()
        for n in range(pages):
            (tmp_path / provider / f"page-{n:06d}.json").write_text(json.dumps({"id": n, "title": "t", "license": "by", "duration": 1.0, "files": [{"height": 360, "url": "u"}]}))
    P.register(spark)
    rows = spark.read.format("providers").option("path", f"file://{tmp_path}").load()
    assert rows.rdd.getNumPartitions() <= P.RUNS
    assert sorted((r.provider, r.page, r.provider_id) for r in rows.collect()) == [(p, n, n) for p, k in (("a", 700), ("b", 300)) for n in range(k)]
    stream = P.StreamReader({"path": f"file://{tmp_path}"})
    parts = stream.partitions({"a": 99}, {"a": 699, "b": 299})
    assert len(parts) <= P.RUNS and sum(len(list(stream.read(p))) for p in parts) == 900


def test_groups_stream_through_few_calls_in_order(spark):
    """Groups that span Arrow batches stay whole; no call is made for each group by pandas."""
    from tessera.plans import QUERIES
    from tessera.solvers.groups import in_groups

    rows = spark.range(9000).selectExpr("CASE WHEN id % 10 = 0 THEN NULL WHEN id < 6000 THEN 7 ELSE id % 500 END AS g", "id * 7919 % 9000 AS i")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = in_groups(rows, "g", ["i"], lambda key, i: [(key, len(i), i == sorted(i))], "g long, n long, sorted boolean").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {r.g: r.n for r in rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert {r.g: r.n for r in got} == want and len(got) == len(want) and all(r.sorted for r in got)
    for name in ("e03_scenes", "e05_scene_chunks", "e06_cues", "e07_two_line_cues", "c16_sentence_alignment", "c17_scene_bounds", "k01_allocation", "k02_slots", "k03_timeline"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "InPandas" not in plan and "MapInArrow" in plan


def test_files_are_written_by_many_tasks_and_captions_without_a_writer_each(spark, tmp_path):
    from tessera.sources import files, sinks

    # one partition of many small files: its time is in their number
    rows = spark.range(400).coalesce(1).selectExpr("concat(id, '.txt') AS name", "cast('x' AS binary) AS content")
    assert files.write_files(rows, f"file://{tmp_path}/f").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    names = ["a/b=c:%41", "é x", None, "plain"]
    cues = spark.createDataFrame([(v, i, float(i), i + 0.5, f"l{i}") for v in names for i in (1, 0)], "v string, cue long, start double, end double, line string")
    for _ in range(2):  # the second run takes the place of the first
        sinks.write_captions(cues, f"{tmp_path}/c", "v")
    back = {r.v: r.value for r in spark.read.text(f"{tmp_path}/c", wholetext=True).collect()}
    text = "1\n00:00:00,000 --> 00:00:00,500\nl0\n\n2\n00:00:01,000 --> 00:00:01,500\nl1\n"
    assert back == dict.fromkeys(names, text)


def test_the_inbox_has_folders_enough_to_be_listed_by_tasks(spark):
    import os
    from urllib.parse import urlparse

    from tessera.plans import stores

    folder = urlparse(stores._inbox(spark, "/root/testdata/sf0.1")).path
    assert len(os.listdir(folder)) > 32


def test_token_bucket_keeps_states_of_a_group_apart_over_batches(spark, tmp_path):
    from tessera.streaming import jobs

    schema = "k long, event_id long, at double, refused boolean"
    out, plain = f"file://{tmp_path}/out", []
    for batch in range(2):
        rows = [(k, batch * 20_000 + i * 10_000 + n, batch * 100.0 + i, False) for n, k in enumerate([*range(2**60, 2**60 + 9000), None]) for i in range(2)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        plain += [(k, e, "allowed" if e % 20_000 < 10_000 and not batch else "limited") for k, e, _, _ in rows]
        got = jobs.drain(jobs.token_bucket(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "k", 0.0, 1.0), out).collect()
    assert sorted((r.event_id, r.k, r.verdict) for r in got) == sorted((e, k, v) for k, e, v in plain)
    # a call of Python and a state for each group of keys, not for each key
    (query,) = [f for f in (tmp_path / "out" / "_state" / "state" / "0").iterdir() if f.name == "0"]
    assert jobs.SHARES < 9000 and query.exists()
    held = spark.read.format("statestore").load(f"{tmp_path}/out/_state")
    assert held.count() <= jobs.SHARES + 1


def test_lines_are_dealt_by_how_many_parts_they_are_read_in(spark, tmp_path):
    from tessera.operators import ranking as R

    spark.range(0, 600, numPartitions=6).selectExpr("id AS l_orderkey", "id AS l_partkey", "id AS l_suppkey", "1 AS l_linenumber", "cast(id % 50 AS double) AS l_quantity").write.parquet(f"{tmp_path}/lineitem.parquet")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        parts = spark.read.parquet(f"{tmp_path}/lineitem.parquet").rdd.getNumPartitions()
        out = plans.QUERIES["b17_floor_or_best"](spark, str(tmp_path))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert parts >= 6 and plan.count("Exchange") == 1 and out.rdd.getNumPartitions() == 4 * parts
        assert R.dealt(spark.range(3).filter("id < 0"), ["id"]).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
