"""Listings of several providers, kept page by page as JSON lines, as one data source for batch and stream.

A folder holds a folder for each provider with files ``page-<number>.json``; a line is an item with id, title, license, duration and
its files by height. There is a partition for each provider and page, or, of more than SINGLE pages, for a run of them. Filters on the provider and the page leave out partitions
before anything is opened; those on license, duration and height are applied while pages are read; others stay with Spark.

As a stream, the offset is the number of the last page read of each provider, so a run that resumes from its checkpoint opens new pages only.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "provider string, listing int, page int, place int, provider_id long, title string, license string, duration double, height int, url string"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
#: Columns whose filters the source applies, and how.
PUSHED = ("provider", "page", "license", "duration", "height")
TESTS = {
    EqualTo: lambda x, v: x is not None and x == v,
    In: lambda x, v: x is not None and x in v,
    GreaterThan: lambda x, v: x is not None and x > v,
    GreaterThanOrEqual: lambda x, v: x is not None and x >= v,
    LessThan: lambda x, v: x is not None and x < v,
    LessThanOrEqual: lambda x, v: x is not None and x <= v,
}


@dataclass
class Page(InputPartition):
    provider: str
    listing: int
    number: int
    path: str
    max_height: int


@dataclass
class Run(InputPartition):
    pages: list[Page]


#: Pages up to which each is a partition of its own, and partitions beyond.
SINGLE, RUNS = 64, 256


def parts(pages: list[Page]) -> list[InputPartition]:
    """Partitions of pages: one for each, or RUNS at most, so that tasks and what they shuffle do not grow as the square of the pages."""
    if len(pages) <= SINGLE:
        return pages
    n = min(RUNS, len(pages) // 8)
    return [Run(pages[len(pages) * i // n : len(pages) * (i + 1) // n]) for i in range(n)]


class Listings:
    """The pages there are, by the options: ``path``; ``providers`` in order of precedence (default: all folders by name); ``pages`` and
    ``max_height`` (default: no limit), which ``<provider>.pages`` and ``<provider>.max_height`` override."""

    def __init__(self, options):
        self.options, self.path = options, options["path"]

    def store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path)

    def of(self, provider: str, option: str) -> int:
        return int(self.options.get(f"{provider}.{option}", self.options.get(option, 0)))

    def pages(self) -> list[Page]:
        from pyarrow import fs

        store, root = self.store()
        found: dict[str, list[tuple[int, str]]] = {}
        for f in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            *_, provider, name = f.path.split("/")
            number = name.removeprefix("page-").removesuffix(".json")
            if f.is_file and name == f"page-{number}.json" and number.isdigit():
                found.setdefault(provider, []).append((int(number), f.path))
        chosen = self.options.get("providers")
        order = [p.strip() for p in chosen.split(",")] if chosen else sorted(found)
        out = []
        for listing, provider in enumerate(order):
            most = self.of(provider, "pages")
            pages = sorted(found.get(provider, []))
            out += [Page(provider, listing, n, path, self.of(provider, "max_height")) for n, path in (pages[:most] if most else pages)]
        return out

    def rows(self, part: InputPartition, tests: list[tuple[str, type, object]] = ()) -> Iterator[tuple]:
        """Items of a partition's pages."""
        store, _ = self.store()
        for page in part.pages if isinstance(part, Run) else [part]:
            yield from self.items(store, page, tests)

    def items(self, store, page: Page, tests: list[tuple[str, type, object]] = ()) -> Iterator[tuple]:
        """Items of a page; lines that are not valid, items without an id or a license, and those without a file that is low enough are left out."""
        with store.open_input_stream(page.path) as f:
            lines = f.read().decode("utf-8", "replace").splitlines()
        for place, line in enumerate(lines):
            try:
                item = json.loads(line)
                files = [(int(x["height"]), str(x["url"])) for x in item.get("files", []) if not page.max_height or int(x["height"]) <= page.max_height]
                row = (page.provider, page.listing, page.number, place, int(item["id"]), item.get("title"), item.get("license"), float(item["duration"]) if item.get("duration") is not None else None, *max(files))
            except (ValueError, KeyError, TypeError, AttributeError):
                continue
            if row[6] and all(TESTS[kind](row[COLUMNS.index(c)], v) for c, kind, v in tests):
                yield row


class BatchReader(DataSourceReader):
    def __init__(self, options):
        self.listings, self.tests = Listings(options), []

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            if type(f) in TESTS and len(f.attribute) == 1 and f.attribute[0] in PUSHED and f.value is not None:
                self.tests.append((f.attribute[0], type(f), f.value))
            else:
                yield f

    def partitions(self):
        about = {"provider": lambda p: p.provider, "page": lambda p: p.number}
        return parts([p for p in self.listings.pages() if all(TESTS[kind](about[c](p), v) for c, kind, v in self.tests if c in about)])

    def read(self, partition):
        return self.listings.rows(partition, self.tests) if partition else iter(())


class StreamReader(DataSourceStreamReader):
    def __init__(self, options):
        self.listings = Listings(options)

    def initialOffset(self):  # noqa: N802
        return {}

    def latestOffset(self):  # noqa: N802
        out: dict[str, int] = {}
        for p in self.listings.pages():
            out[p.provider] = max(out.get(p.provider, -1), p.number)
        return out

    def partitions(self, start, end):
        return parts([p for p in self.listings.pages() if start.get(p.provider, -1) < p.number <= end.get(p.provider, -1)])

    def read(self, partition):
        return self.listings.rows(partition)

    def commit(self, end):
        pass


class ProviderSource(DataSource):
    """``spark.read.format("providers").option("path", uri)``, or ``spark.readStream``; the options are those of Listings."""

    @classmethod
    def name(cls):
        return "providers"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return BatchReader(self.options)

    def streamReader(self, schema):  # noqa: N802
        return StreamReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the source known to the session, and lets Spark push filters to Python sources, which it asks for."""
    spark.dataSource.register(ProviderSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
