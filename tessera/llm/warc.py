"""Deterministic sharded WARC writer and its reader.

Records are sorted by (id, digest) and dealt to shards by ranges whose bounds come from a hashed
sample, so the same rows give the same files however they are partitioned. A shard's task rolls to a
new file once the compressed size is reached. Headers and digests are made anew from the payloads.
Files are written under temporary names in the shared folder; each task reports what it finished, the
reports become the manifest, and only files in the manifest are renamed. A task that is run twice
leaves a temporary file that no manifest names; these are removed once all is renamed. Last the manifest is written into the
folder: an archive is whole once it is there.

Payloads cross the network once: which record of equal payloads stays a response is decided on
(id, digest) rows, which travel beside the payloads in the same shuffle.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import cut, shared_folder

#: A new file starts once the compressed size reaches this; the last record may go beyond it.
ROLL_BYTES = 32 << 20
#: Uncompressed bytes of payload for each shard.
SHARD_BYTES = 64 << 20
#: Rows of the sample that sets the bounds, at most twice as many.
SAMPLE = 20_000
#: Compressed bytes that the reader hands to the decompressor at once.
READ_BYTES = 16 << 10
MANIFEST_NAME = "_manifest"
DATE = "2020-01-01T00:00:00Z"
LEVEL = 6

MANIFEST = T.StructType().add("shard", "integer").add("file", "string").add("temporary", "string").add("records", "long").add("bytes", "long").add("sha1", "string")
RECORD = (
    T.StructType().add("page_id", "long").add("uri", "string").add("record_type", "string").add("refers_to", "long")
    .add("payload_digest", "string").add("payload_bytes", "long").add("payload", "binary").add("file", "string")
)


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column; 40 bits at a time, as 160 needs no padding."""
    hexed = F.sha1(data)
    part = lambda i: F.lpad(F.conv(F.substring(hexed, 10 * i + 1, 10), 16, 32), 8, "0")
    return F.translate(F.concat(*[part(i) for i in range(4)]), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def decide(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Revisits as rows (page_id, digest, refers_to): of equal payloads the largest page_id stays a response.

    Works on ids and digests. The join with the payloads that repeat may be split by AQE, so a payload
    that a third of all pages share does not meet in one task.
    """
    ids = cut(pages.filter(F.col("payload_bytes") >= min_bytes).select("page_id", "digest"), "digests")
    keep = ids.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
    keep = cut(keep.filter("n > 1 AND refers_to IS NOT NULL").drop("n"), "kept_payloads")
    return ids.join(keep, "digest").filter("page_id IS NULL OR page_id < refers_to").select("page_id", "digest", "refers_to").distinct()


def _bounds(pages: DataFrame, shards: int, n: int) -> list[tuple[int, str]]:
    """Keys that part the rows into shards of about equal bytes, from a sample chosen by hash of the row."""
    if shards < 2:
        return []
    step = max(1, n // SAMPLE)
    some = pages.filter(F.pmod(F.xxhash64("page_id", "digest"), F.lit(step)) == 0)
    rows = some.select(F.coalesce("page_id", F.lit(-(2**63))).alias("id"), "digest", "payload_bytes").collect()
    rows = sorted((r[0], r[1], r[2] + 500) for r in rows)
    total, run, out = sum(r[2] for r in rows), 0, []
    for key, digest, size in rows:
        if len(out) < shards - 1 and run >= total * (len(out) + 1) / shards:
            out.append((key, digest))
        run += size
    return out


def _with_payload(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.select("page_id", F.col("url"), payload.alias("payload")).select(
        "*", base32_sha1(F.col("payload")).alias("digest"), F.length("payload").cast("long").alias("payload_bytes")
    )


def record_bytes(page_id, url, digest: str, size: int, payload: bytes | None, refers_to, date: str = DATE) -> bytes:
    """One WARC/1.1 record; a revisit (payload None) holds the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    name = lambda i: uuid.UUID(bytes=hashlib.md5(f"{i}:{digest}".encode()).digest()).urn
    uri = "".join(c if c.isprintable() and not c.isspace() else "" for c in url or "") or "urn:unknown"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if payload is not None else 'revisit'}",
        f"WARC-Record-ID: <{name(page_id)}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"X-Page-Id: {'' if page_id is None else page_id}",
    ]
    if payload is None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <{name(refers_to)}>",
            f"X-Refers-To-Page-Id: {refers_to}",
        ]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    """A gzip member without time or name, so equal data give equal bytes."""
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class _Roller:
    """Writes members to temporary files and starts a new one once the size is reached."""

    def __init__(self, folder: str, roll: int):
        from pyarrow import fs

        self.store, self.root = fs.FileSystem.from_uri(folder)
        self.roll, self.shard, self.part, self.out, self.done = roll, None, 0, None, []

    def add(self, shard: int, member: bytes) -> None:
        if shard != self.shard:
            self.close()
            self.shard, self.part = shard, 0
        if self.out is None:
            self.file = f"part-{shard:06d}-{self.part:05d}.warc.gz"
            self.temporary = f"_temporary/{self.file}.{uuid.uuid4().hex}"
            self.store.create_dir(f"{self.root}/_temporary", recursive=True)
            self.out, self.size, self.records, self.sha1 = self.store.open_output_stream(f"{self.root}/{self.temporary}"), 0, 0, hashlib.sha1()
        self.out.write(member)
        self.sha1.update(member)
        self.size, self.records = self.size + len(member), self.records + 1
        if self.size >= self.roll:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.shard, self.file, self.temporary, self.records, self.size, self.sha1.hexdigest()))
            self.out, self.part = None, self.part + 1


def write_warc(pages: DataFrame, folder: str, min_bytes: int = 0, roll: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES, date: str = DATE) -> DataFrame:
    """Writes pages (page_id, url, html) as WARC files under ``folder`` and returns the manifest.

    ``folder`` is a URI that pyarrow's file systems open (file, hdfs, s3, gs) and all executors share. A null
    html is an empty payload, a null url urn:unknown. Null ids come first; rows that repeat the
    largest page_id of a payload are all responses; a payload under ``min_bytes`` is never a revisit.
    An empty table gives an empty manifest. A folder that holds an archive raises ValueError; one that an unfinished
    write has left is written again, and what is left of that write goes. Rows that repeat id and payload keep the order of
    their URLs. A very long html is one record of its size, in one task's memory.
    """
    spark = pages.sparkSession
    path = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    store = path(MANIFEST_NAME).getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(path(MANIFEST_NAME)):
        raise ValueError(f"{folder} holds an archive already")
    rows = _with_payload(pages)
    n, size = rows.agg(F.count(F.lit(1)), F.sum("payload_bytes")).first()
    shards = max(1, -(-((size or 0) + 500 * n) // shard_bytes))
    bounds = _bounds(rows, shards, n)
    shards = len(bounds) + 1

    first = np.array([i for i, _ in bounds], np.int64)

    @F.pandas_udf("int")
    def shard_of(ids: pd.Series, digests: pd.Series) -> pd.Series:
        low, high = (np.searchsorted(first, ids.to_numpy(np.int64), side) for side in ("left", "right"))
        for i in np.flatnonzero(low < high):  # an id that is also a bound's: the digest decides
            low[i] = bisect.bisect_right(bounds, (ids.iat[i], digests.iat[i]), low[i], high[i])
        return pd.Series(low.astype(np.int32))

    fields = ["page_id", "url", "payload", "digest", "payload_bytes"]
    both = (
        decide(rows, min_bytes)
        .select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "digest", F.lit(-1).cast("long").alias("payload_bytes"), "refers_to")
        .unionByName(rows.select(*fields, F.lit(None).cast("long").alias("refers_to")))
        .withColumn("id_", F.coalesce("page_id", F.lit(-(2**63))))
    )
    both = both.withColumn("shard", shard_of("id_", "digest") if bounds else F.lit(0)).repartitionById(shards, F.col("shard"))
    both = both.sortWithinPartitions("shard", "id_", "digest", "payload_bytes", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolled = _Roller(folder, roll)
        revisit = (None, None, None)
        for b in batches:
            cols = [b.column(b.schema.get_field_index(c)) for c in (*fields, "refers_to", "shard")]
            for i in range(b.num_rows):
                page_id, url, payload, digest, length, refers_to, shard = (c[i].as_py() for c in cols)
                if length < 0:  # a decision comes just before the rows it is for
                    revisit = (page_id, digest, refers_to)
                    continue
                again = revisit[:2] == (page_id, digest)
                rolled.add(shard, _gzip(record_bytes(page_id, url, digest, length, None if again else payload, revisit[2], date)))
        rolled.close()
        rows = list(zip(*rolled.done)) or [[] for _ in MANIFEST]
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, t) for v, t in zip(rows, (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()))], names=MANIFEST.names
        )

    manifest = cut(both.mapInArrow(run, MANIFEST), "manifest")

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for b in batches:
            for file, temporary in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                if store.get_file_info(f"{root}/{temporary}").type != fs.FileType.NotFound:
                    if store.get_file_info(f"{root}/{file}").type != fs.FileType.NotFound:  # of a write that was not finished
                        store.delete_file(f"{root}/{file}")
                    store.move(f"{root}/{temporary}", f"{root}/{file}")
            yield b

    committed = cut(manifest.mapInArrow(commit, MANIFEST), "committed")
    # files that an unfinished write left under other names, before the mark that the archive is whole
    there = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz")
    if store.exists(path("")):
        strays = there.load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file")).join(committed.select("file"), "file", "left_anti")
        for r in strays.toLocalIterator():
            store.delete(path(r["file"]), False)
    # the manifest is written aside and gets its name by one rename, so a folder of that name is a whole manifest
    aside = f"_temporary/{MANIFEST_NAME}"
    store.delete(path(aside), True)
    committed.write.json(f"{folder}/{aside}")
    if not store.rename(path(aside), path(MANIFEST_NAME)):
        raise OSError(f"the manifest of {folder} cannot be put")
    store.delete(path("_temporary"), True)
    return committed


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest of an archive; raises an error where there is none, as the archive is not whole then."""
    return spark.read.schema(MANIFEST).json(f"{folder}/{MANIFEST_NAME}")


def parse_warc(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """(headers, block) of each record of a file of gzip members; raises ValueError on a broken record."""
    view, at = memoryview(data), 0
    while at < len(data):
        z, parts = zlib.decompressobj(31), []
        while not z.eof and at < len(data):
            chunk = view[at : at + READ_BYTES]
            parts.append(z.decompress(chunk))
            at += len(chunk) - len(z.unused_data)
        if not z.eof:
            raise ValueError("the file ends within a record")
        record = b"".join(parts)
        head, _, rest = record.partition(b"\r\n\r\n")
        lines = head.decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        block = rest[: int(fields["Content-Length"])]
        if len(block) != int(fields["Content-Length"]) or rest[len(block) :] != b"\r\n\r\n":
            raise ValueError("the block's length differs from its header")
        yield fields, block


def read_warc(spark: SparkSession, folder: str, manifest: DataFrame | None = None, payloads: bool = True) -> DataFrame:
    """The records of the committed files as rows of RECORD; digests are checked against the content.

    The manifest is that of the folder unless one is given. A file that is missing, unlisted or has other bytes raises an error before anything is read. A
    revisit has no payload; its length is that of its HTTP header.
    """
    manifest = manifest if manifest is not None else read_manifest(spark, folder)
    if manifest.isEmpty():
        return spark.createDataFrame([], RECORD)
    # a file is one row of at most the rolled size, so whole files fit in a task
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    files = files.select("content", F.element_at(F.split("path", "/"), -1).alias("file"))
    there = files.select("file", F.sha1("content").alias("found"))
    bad = manifest.select("file", "sha1").join(there, "file", "full_outer").filter("sha1 IS NULL OR found IS NULL OR sha1 <> found")
    wrong = [r.file for r in bad.select("file").limit(3).collect()]
    if wrong:
        raise ValueError(f"missing, changed or unlisted: {wrong}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("uri", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("file", pa.string())])
        for b in batches:
            for content, file in zip(b.column(0), b.column(1)):
                rows, held = [], 0
                for fields, block in parse_warc(content.as_py()):
                    http, _, body = block.partition(b"\r\n\r\n")
                    kind = fields["WARC-Type"]
                    if base64.b32encode(hashlib.sha1(block).digest()).decode() != fields["WARC-Block-Digest"][5:]:
                        raise ValueError(f"block digest differs in {file}")
                    digest, size = fields["WARC-Payload-Digest"][5:], int(http.rpartition(b"Content-Length: ")[2])
                    if kind == "response" and (size != len(body) or base64.b32encode(hashlib.sha1(body).digest()).decode() != digest):
                        raise ValueError(f"payload differs from its header in {file}")
                    number = lambda k: int(fields[k]) if fields.get(k) else None
                    rows.append((number("X-Page-Id"), fields["WARC-Target-URI"], kind, number("X-Refers-To-Page-Id"), digest, size, body if payloads and kind == "response" else None, file.as_py()))
                    held += len(body)
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), schema)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), schema)], schema=schema)

    return files.select("content", "file").mapInArrow(run, RECORD)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes the pages and reads the archives back: one row per record."""
    spark = pages.sparkSession
    folder = folder or f"{shared_folder(spark)}/tessera/{uuid.uuid4().hex}/warc"
    manifest = write_warc(pages, folder)
    return read_warc(spark, folder, manifest, payloads=False)
