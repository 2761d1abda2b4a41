import base64
import hashlib
import os
import shutil

import pytest
from pyspark.sql import functions as F

from tessera.llm import warc as W

SCHEMA = "page_id long, url string, html string, payload_bytes string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)


def brute(rows):
    data = [(i, (h or "").encode()) for i, _, h in rows]
    top = {}
    for i, d in data:
        if i is not None:
            top[d] = max(top.get(d, i), i)
    out = []
    for i, d in data:
        again = d in top and (i is None or i < top[d])
        digest = base64.b32encode(hashlib.sha1(d).digest()).decode()
        out.append((i, len(d), digest, "revisit" if again else "response", top[d] if again else None))
    return sorted(out, key=str)


CASES = [(3, "http://a/", "<p>é</p>"), (1, "http://b/", "<p>é</p>"), (2, None, None), (9, "u v\n", ""), (5, "x", "z" * 300_000), (5, "x", "z" * 300_000), (None, "n", "<p>é</p>"), (7, "y", "only\r\n\r\nonce")]


def digest(df):
    return sorted([tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()], key=str)


def test_round_trip_equals_brute_force(spark):
    assert digest(W.round_trip(pages(spark, CASES))) == brute(CASES)


def test_files_do_not_depend_on_partitions_and_roll_by_size(spark, tmp_path, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/pages.parquet")
    made = []
    for k, df in enumerate((docs.repartition(7), docs.coalesce(1))):
        folder = f"file://{tmp_path}/{k}"
        manifest = W.write_warc(df, folder, roll=20_000, shard_bytes=100_000)
        assert manifest.count() > 3
        files = sorted(f for f in os.listdir(tmp_path / str(k)) if f.endswith(".gz"))
        assert not (tmp_path / str(k) / "_temporary").exists()
        assert sorted(r.file for r in W.read_manifest(spark, folder).collect()) == files
        made.append([(f, (tmp_path / str(k) / f).read_bytes()) for f in files])
        back = W.read_warc(spark, folder, manifest)
        assert {(r.page_id, bytes(r.payload).decode()) for r in back.filter("record_type = 'response'").collect()} <= {(r.page_id, r.html) for r in docs.collect()}
        ids = [r.page_id for f in files for r in W.read_warc(spark, f"{folder}/{f}", manifest.filter(F.col("file") == f)).collect()]
        assert ids == sorted(ids) and len(ids) == docs.count()
    assert made[0] == made[1]


def test_a_changed_file_is_noticed(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    manifest = W.write_warc(pages(spark, CASES), folder)
    name = manifest.first().file
    (tmp_path / "w" / name).write_bytes(b"x")
    with pytest.raises(ValueError, match="missing, changed"):
        W.read_warc(spark, folder, manifest).collect()


def test_the_manifest_marks_a_whole_archive(spark, tmp_path):
    """Without it nothing is read; an unfinished write is written again, a whole archive is not."""
    folder = f"file://{tmp_path}/w"
    W.write_warc(pages(spark, CASES), folder)
    whole = digest(W.read_warc(spark, folder))
    assert whole == brute(CASES)
    with pytest.raises(ValueError, match="already"):
        W.write_warc(pages(spark, CASES), folder)
    shutil.rmtree(tmp_path / "w" / W.MANIFEST_NAME)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        W.read_warc(spark, folder)
    (tmp_path / "w" / "_temporary").mkdir()
    (tmp_path / "w" / "_temporary" / "stray").write_bytes(b"x")
    W.write_warc(pages(spark, CASES), folder)
    assert digest(W.read_warc(spark, folder)) == whole
    assert not (tmp_path / "w" / "_temporary").exists()


def test_empty(spark):
    assert W.round_trip(pages(spark, []).select("page_id", "url", "html")).count() == 0


def test_what_an_unfinished_write_left_goes(spark, tmp_path):
    """A smaller archive after an unfinished larger one is read; a manifest that was not finished is no mark."""
    folder = f"file://{tmp_path}/w"
    many = [(i, f"http://h/{i}", f"page {i} " * 50) for i in range(60)]
    assert W.write_warc(pages(spark, many), folder, roll=400, shard_bytes=2000).count() > 5
    shutil.rmtree(tmp_path / "w" / W.MANIFEST_NAME)
    half = tmp_path / "w" / "_temporary" / W.MANIFEST_NAME
    half.mkdir(parents=True)
    (half / "part-00000.json").write_text('{"file": "x')
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        W.read_warc(spark, folder)
    W.write_warc(pages(spark, many[:5]), folder, roll=400, shard_bytes=2000)
    assert digest(W.read_warc(spark, folder)) == brute(many[:5])
    assert sorted(f for f in os.listdir(tmp_path / "w") if f.endswith(".gz")) == sorted(r.file for r in W.read_manifest(spark, folder).collect())
