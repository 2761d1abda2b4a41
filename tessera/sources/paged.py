"""A data source for paged listings kept as JSON files: one partition per page, read by the executors."""

from __future__ import annotations

import json

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Page(InputPartition):
    def __init__(self, path: str):
        self.path = path


class PagedReader(DataSourceReader):
    def __init__(self, schema, options):
        self.folder, self.limit = options["path"], int(options.get("pages", 0))

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.folder)

    def partitions(self):
        from pyarrow import fs

        store, root = self._store()
        files = sorted(f.path for f in store.get_file_info(fs.FileSelector(root)) if f.path.endswith(".json"))
        return [Page(f) for f in (files[: self.limit] if self.limit else files)]

    def read(self, partition):
        store, _ = self._store()
        with store.open_input_stream(partition.path) as f:
            for line in f.read().decode("utf-8").splitlines():
                row = json.loads(line)
                yield row.get("provider_id"), row.get("title"), row.get("license"), row.get("duration")


class PagedSource(DataSource):
    """``spark.read.format("paged").option("path", uri).load()``; option ``pages`` limits the pages read."""

    @classmethod
    def name(cls):
        return "paged"

    def schema(self):
        return "provider_id long, title string, license string, duration double"

    def reader(self, schema):
        return PagedReader(schema, self.options)
