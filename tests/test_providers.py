"""The provider source: pushed filters, options by provider, broken items, a stream that resumes."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.sources.providers import BatchReader, Listings, StreamReader, register
from tessera.streaming import jobs


def put(folder, provider, page, items):
    (folder / provider).mkdir(parents=True, exist_ok=True)
    (folder / provider / f"page-{page:04d}.json").write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in items))


def item(i, license="cc0", duration=10.0, heights=(360, 720, 2160), **more):
    return {"id": i, "title": f"t{i}", "license": license, "duration": duration, "files": [{"height": h, "url": f"u{i}/{h}"} for h in heights], **more}


@pytest.fixture
def folder(tmp_path):
    put(tmp_path, "a", 0, [item(1), item(2, license=None), "not json", item(3, heights=()), {"id": "x"}, item(4, duration=None)])
    put(tmp_path, "a", 1, [item(5, license="by"), item(1)])
    put(tmp_path, "b", 0, [item(1, heights=(1080,)), item(6, heights=(2160,))])
    (tmp_path / "b" / "notes.txt").write_text("no page")
    return tmp_path


def pushed(spark, folder, *filters, **options):
    register(spark)
    rows = spark.read.format("providers").option("path", folder).options(**options).load()
    for f in filters:
        rows = rows.filter(f)
    return rows


def ids(df):
    return sorted((r.provider, r.page, r.provider_id, r.height) for r in df.collect())


def test_reads_all_pages_and_skips_what_is_broken(spark, folder):
    got = ids(pushed(spark, f"file://{folder}"))
    assert got == [("a", 0, 1, 2160), ("a", 0, 4, 2160), ("a", 1, 1, 2160), ("a", 1, 5, 2160), ("b", 0, 1, 1080), ("b", 0, 6, 2160)]


def test_options_by_provider(spark, folder):
    got = ids(pushed(spark, f"file://{folder}", providers="b,a,none", max_height="1080", **{"a.pages": "1", "b.max_height": "0"}))
    assert got == [("a", 0, 1, 720), ("a", 0, 4, 720), ("b", 0, 1, 1080), ("b", 0, 6, 2160)]
    rows = pushed(spark, f"file://{folder}", providers="b,a")
    assert {(r.provider, r.listing) for r in rows.collect()} == {("b", 0), ("a", 1)}


def test_pushed_filters_leave_out_pages_and_rows(spark, folder):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringContains

    reader = BatchReader({"path": f"file://{folder}"})
    left = list(reader.pushFilters([EqualTo(("provider",), "a"), GreaterThan(("page",), 0), StringContains(("title",), "t"), In(("license",), ("by",)), EqualTo(("duration",), None)]))
    assert [type(f) for f in left] == [StringContains, EqualTo]
    pages = reader.partitions()
    assert [(p.provider, p.number) for p in pages] == [("a", 1)]
    assert [r[4] for r in reader.read(pages[0])] == [5]


def test_plan_shows_the_pushed_filters(spark, folder):
    rows = pushed(spark, f"file://{folder}", F.col("provider") == "a", F.col("duration") >= 5.0, F.col("title").contains("5"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "provider" in plan.split("PushedFilters")[1].split("]")[0] if "PushedFilters" in plan else "Filter" in plan
    condition = plan.split("Filter")[1].split("\n")[0] if "Filter" in plan else ""
    assert "Contains" in condition and "duration" not in condition.replace("isnotnull(duration", "")
    assert ids(rows) == [("a", 1, 5, 2160)]


def test_filters_do_not_change_results(spark, folder):
    filters = [F.col("license") != "by", F.col("duration") < 11.0, F.col("height") > 720, F.col("provider").isin("a", "b")]
    every = spark.createDataFrame(pushed(spark, f"file://{folder}").collect(), pushed(spark, f"file://{folder}").schema)
    for f in filters:
        every = every.filter(f)
    assert ids(pushed(spark, f"file://{folder}", *filters)) == ids(every)


def test_a_stream_resumes_after_the_last_page(spark, folder, tmp_path_factory):
    register(spark)
    out = str(tmp_path_factory.mktemp("swept"))
    run = lambda: jobs.drain(spark.readStream.format("providers").option("path", f"file://{folder}").load(), out)
    assert run().count() == 6
    assert run().count() == 6
    put(folder, "a", 2, [item(7)])
    put(folder, "c", 0, [item(8), item(9)])
    assert ids(run())[-3:] == [("b", 0, 6, 2160), ("c", 0, 8, 2160), ("c", 0, 9, 2160)] and run().count() == 9


def test_offsets(folder):
    reader = StreamReader({"path": f"file://{folder}"})
    assert reader.initialOffset() == {} and reader.latestOffset() == {"a": 1, "b": 0}
    assert [(p.provider, p.number) for p in reader.partitions({"a": 0}, {"a": 1, "b": 0})] == [("a", 1), ("b", 0)]
    assert Listings({"path": f"file://{folder}/nowhere"}).pages() == []
