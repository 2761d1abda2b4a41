"""The versioned store against a plain fold of rows."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tessera.sources.versioned import Conflict, VersionedStore

SCHEMA = "k long, name string, note string, n long, tags array<string>, log array<string>, meta map<string,string>, at long"
RULES = {"name": "first", "n": "sum", "tags": "union", "log": "append", "meta": "merge", "at": "greatest"}


@pytest.fixture
def store(spark, tmp_path):
    return VersionedStore(spark, f"file://{tmp_path}/store", SCHEMA, ["k"], RULES, ["at"])


def rows_of(df):
    return {r.k: r.asDict() for r in df.collect()}


def fold(rounds):
    out = {}
    for rows in rounds:
        for r in sorted(rows, key=lambda r: r[7]):
            k, name, note, n, tags, log, meta, at = r
            o = out.setdefault(k, {"k": k, "name": None, "note": None, "n": None, "tags": [], "log": [], "meta": {}, "at": None})
            o["name"] = o["name"] or name or None
            o["note"] = note or o["note"]
            o["n"] = o["n"] if n is None else (o["n"] or 0) + n
            o["tags"] = sorted(set(o["tags"]) | set(tags or []))
            o["log"] = o["log"] + (log or [])
            o["meta"] = {**o["meta"], **(meta or {})}
            o["at"] = at if o["at"] is None else max(o["at"], at)
    return out


ROUNDS = [
    [(1, "a", None, 1, ["x"], ["r1"], {"p": "1", "q": "1"}, 1), (2, "", "n2", None, None, None, None, 1), (1, "b", "n1", 2, ["w"], ["r1b"], {"q": "2"}, 2)],
    [(2, "late", "", 5, ["y", "x"], ["r2"], {"p": "3"}, 3), (3, None, None, 7, [], ["r2"], {}, 3)],
    [(1, "c", "n1c", None, ["x", "v"], ["r3"], {"p": "9"}, 4), (3, "c3", None, 1, None, None, None, 5)],
]


@pytest.mark.parametrize("compact_after", [(), (0,), (0, 1, 2)])
def test_equals_a_plain_fold(spark, store, compact_after):
    for i, rows in enumerate(ROUNDS):
        store.commit(spark.createDataFrame(rows, SCHEMA).repartition(2))
        if i in compact_after:
            store.compact()
    assert rows_of(store.read()) == fold(ROUNDS)


def test_older_versions_stay_readable_until_vacuum(spark, store):
    versions = [store.commit(spark.createDataFrame(rows, SCHEMA)) for rows in ROUNDS]
    last = store.compact()
    for i, v in enumerate(versions):
        assert rows_of(store.read(v)) == fold(ROUNDS[: i + 1])
    reader = store.read(versions[1])
    assert reader.count() == 3
    gone = store.vacuum()
    assert store.versions() == [last] and sum(g.startswith("delta-") for g in gone) == 3
    assert rows_of(store.read()) == fold(ROUNDS)
    with pytest.raises(ValueError):
        store.read(versions[0])


def test_a_rerun_with_its_token_changes_nothing(spark, store):
    df = spark.createDataFrame(ROUNDS[0], SCHEMA)
    first = store.commit(df, token="job-1")
    assert store.commit(df, token="job-1") == first
    store.compact()
    assert store.commit(df, token="job-1") == store.manifest()["version"]
    assert rows_of(store.read()) == fold(ROUNDS[:1])
    assert store.compact() == store.manifest()["version"]  # nothing to fold


def test_a_commit_that_failed_midway_is_not_seen(spark, store, tmp_path):
    store.commit(spark.createDataFrame(ROUNDS[0], SCHEMA))
    spark.createDataFrame(ROUNDS[1], SCHEMA).withColumn("seq__", F.lit(2).cast("long")).write.parquet(f"{store.folder}/delta-stray")
    os.makedirs(tmp_path / "store/aside", exist_ok=True)
    (tmp_path / "store/aside/half").write_text('{"version": 2')
    assert rows_of(store.read()) == fold(ROUNDS[:1])
    assert {"delta-stray", "aside"} <= set(store.vacuum())
    assert rows_of(store.read()) == fold(ROUNDS[:1])


def test_two_writers_of_one_version(spark, store, monkeypatch):
    store.commit(spark.createDataFrame(ROUNDS[0], SCHEMA))
    old = store.manifest()
    store.commit(spark.createDataFrame(ROUNDS[1], SCHEMA))
    monkeypatch.setattr(store, "manifest", lambda version=None: json.loads(json.dumps(old)))
    with pytest.raises(Conflict):
        store.commit(spark.createDataFrame(ROUNDS[2], SCHEMA))
    monkeypatch.undo()
    assert rows_of(store.read()) == fold(ROUNDS[:2])


def test_empty_store_missing_columns_and_null_keys(spark, store):
    assert store.read().count() == 0 and store.read().columns == ["k", "name", "note", "n", "tags", "log", "meta", "at"]
    assert store.compact() == 0
    store.commit(spark.createDataFrame([(1, "a")], "k int, name string"))
    assert rows_of(store.read())[1]["name"] == "a" and rows_of(store.read())[1]["n"] is None
    with pytest.raises(Exception, match="null in its key"):
        store.commit(spark.createDataFrame([(None, "a")], "k long, name string"))
    assert store.versions() == [1]
    with pytest.raises(ValueError):
        VersionedStore(spark, "file:///tmp/none", SCHEMA, ["k"], {"nope": "last"})


def test_untouched_rows_of_the_base_are_not_folded(spark, store):
    """Keys without a delta pass through an anti join; they are not grouped again."""
    store.commit(spark.range(1000).selectExpr("id AS k", "'a' AS name"))
    store.compact()
    store.commit(spark.createDataFrame([(5, "", "later")], "k long, name string, note string"))
    plan = store.read()._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "LeftSemi" in plan
    got = rows_of(store.read())
    assert len(got) == 1000 and got[5]["name"] == "a" and got[5]["note"] == "later"


def test_rows_of_a_key_are_collected_once(spark, store):
    """Columns that need the rows themselves share one list, whatever their number; one row alone and several give what a plain fold does."""
    one = [(1, "", "x", 1, ["b", "a", "b"], ["l"], {"k": "v"}, 3), (2, None, None, None, None, None, None, None)]
    several = [(3, "", "n", 1, None, ["y", "z"], {"k": "2"}, 2), (3, "b", "", 2, ["t"], None, None, 3), (3, "a", "m", None, ["s"], ["x"], {"k": "1", "j": "0"}, 1)]
    store.commit(spark.createDataFrame(one + several, SCHEMA))
    assert store.read()._jdf.queryExecution().optimizedPlan().toString().count("collect_list(") == 1
    got = rows_of(store.read())
    assert got[1] == {"k": 1, "name": None, "note": "x", "n": 1, "tags": ["a", "b"], "log": ["l"], "meta": {"k": "v"}, "at": 3}
    assert got[2] == {"k": 2, "name": None, "note": None, "n": None, "tags": [], "log": [], "meta": {}, "at": None}
    assert got[3] == {"k": 3, "name": "a", "note": "n", "n": 3, "tags": ["s", "t"], "log": ["x", "y", "z"], "meta": {"k": "2", "j": "0"}, "at": 3}
