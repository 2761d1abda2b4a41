"""Folders of files: writing named files from rows, walking a folder with its sidecars."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions of each kind of media.
KINDS = {"video": ["mp4", "mov", "mkv", "webm"], "image": ["jpg", "jpeg", "png", "webp"], "audio": ["mp3", "wav"]}
SIDECAR, EXTENSION = ".meta.json", re.compile(r"\.[A-Za-z0-9]+\Z")
#: Tasks a core that write, list or read files.
SHARES = 4
#: Levels of folders below the first whose folders are dealt to tasks one by one.
LEVELS = 2
#: Names in a batch of a listing, bytes of sidecars in a batch.
BATCH, HELD = 10_000, 1 << 24


def media_kind(name: Column) -> Column:
    """Kind by extension, case ignored; null for others."""
    extension = F.lower(F.regexp_extract(name, "\\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(*[F.when(extension.isin(*e), F.lit(k)) for k, e in KINDS.items()])


def _shares(spark: SparkSession) -> int:
    return SHARES * spark.sparkContext.defaultParallelism


def _hidden(name: str) -> bool:
    """Names that Spark's readers pass over."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """Writes rows (name, content as binary) as files under ``folder``, a URI that all executors share; returns name and bytes.

    A file gets its name once it is whole, so a task that is lost and run again leaves the same files. Files are dealt to SHARES tasks a core,
    as many small ones, whose time is in their number, may come from few partitions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        there = {root}
        for b in batches:
            sizes = []
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                target = f"{root}/{name}"
                if (above := target.rsplit("/", 1)[0]) not in there:
                    store.create_dir(above, recursive=True)
                    there.add(above)
                with store.open_output_stream(f"{target}.part") as out:
                    out.write(content)
                store.move(f"{target}.part", target)
                sizes.append(len(content))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64())], names=["name", "bytes"])

    return rows.select("name", "content").repartition(_shares(rows.sparkSession), "name").mapInArrow(run, "name string, bytes long")


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """The files of a folder and those below it, but for sidecars and empty files: path, name, bytes and ``beside``, the path of the sidecar in the same
    folder that has the file's name but for the extension, or null.

    Tasks list the folders, so the driver holds no names, whatever their number: folders of the first LEVELS levels are dealt to tasks one by one, deeper ones
    are walked by the task of the folder above. A task holds the names of one folder at a time. Names that Spark's readers pass over are passed over.
    """

    def walk(deep: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, _ = fs.FileSystem.from_uri(folder)
            for b in batches:
                found = b.column(1).is_valid()
                yield pa.RecordBatch.from_arrays(b.filter(found).columns, names=names)
                below = b.filter(pc.invert(found)).column(0).to_pylist()
                while below:
                    there = [i for i in store.get_file_info(fs.FileSelector(below.pop())) if not _hidden(i.base_name)]
                    beside = {i.path.removesuffix(SIDECAR): i.path for i in there if i.size and i.base_name.endswith(SIDECAR)}
                    out = [(i.path, i.size, beside.get(EXTENSION.sub("", i.path))) for i in there if i.size and not i.base_name.endswith(SIDECAR)]
                    folders = [i.path for i in there if i.type == fs.FileType.Directory]
                    if deep:
                        below += folders
                    else:
                        out += [(p, None, None) for p in folders]
                    for start in range(0, len(out), BATCH):
                        path, size, side = zip(*out[start : start + BATCH])
                        yield pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(size, pa.int64()), pa.array(side, pa.string())], names=names)

        return run

    names = ["path", "bytes", "beside"]
    _, root = fs.FileSystem.from_uri(folder)
    rows = spark.range(1).select(F.lit(root).alias("path"), F.lit(None).cast("long").alias("bytes"), F.lit(None).cast("string").alias("beside"))
    for level in range(LEVELS + 1):
        rows = rows.repartition(_shares(spark), "path").mapInArrow(walk(level == LEVELS), "path string, bytes long, beside string")
    return rows.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "bytes", "beside")


def media(spark: SparkSession, folder: str) -> DataFrame:
    """The listed files of known kind: path, name, kind, bytes and beside."""
    return listing(spark, folder).select("path", "name", media_kind(F.col("name")).alias("kind"), "bytes", "beside").filter("kind IS NOT NULL")


def library(spark: SparkSession, folder: str, sidecar: str) -> DataFrame:
    """The media files of a folder and those below it: name, kind, bytes and the fields of the sidecars beside them (``sidecar`` is their
    schema). Files of unknown kind and empty ones are left out; a file without a sidecar or with a broken one has nulls. Sidecars are read by tasks,
    HELD bytes of them at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for b in batches:
            texts, held, start = [], 0, 0
            for n, path in enumerate(b.column("beside").to_pylist(), 1):
                if path is None:
                    texts.append(None)
                else:
                    with store.open_input_file(path) as f:
                        texts.append(f.read())
                    held += len(texts[-1])
                if held > HELD or n == b.num_rows:
                    columns = [b.column(c).slice(start, n - start) for c in ("name", "kind", "bytes")]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.binary())], names=["name", "kind", "bytes", "text"])
                    texts, held, start = [], 0, n

    rows = media(spark, folder).repartition(_shares(spark), "path").mapInArrow(run, "name string, kind string, bytes long, text binary")
    return rows.select("name", "kind", "bytes", F.from_json(F.col("text").cast("string"), sidecar).alias("meta")).select("name", "kind", "bytes", "meta.*")
