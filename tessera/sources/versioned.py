"""A keyed store on plain files: a base snapshot, deltas beside it, and a manifest for each version.

A commit writes its rows as a delta folder of its own and then puts one small manifest file, which lists the base and the deltas of the
new version, under its number; a manifest appears whole or not at all and never replaces another. Readers take the
newest manifest (or a chosen one) and read just the folders it lists, so they see whole versions while writers go on. Compaction
folds the deltas into a new base and swaps it in by a manifest as well; ``vacuum`` removes what no kept version lists.

Rows of one key are folded in the order of their commits by a rule for each column (RULES). Only keys that deltas hold are
folded when reading; the other rows of the base are passed through without a shuffle of their own where the deltas are small.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEQ, ROWS = "seq__", "rows__"
#: Fields of a collected row: its place in the order, and its columns under a prefix, as a column may have any name.
AT, OF = "at", "of_"


class Conflict(RuntimeError):
    """Another writer has put this version first; commit again."""


def _filled(c: Column) -> Column:
    """Null and empty text count as missing."""
    return F.when(c.cast("string") != "", F.lit(True))


def _in_order(rows: Column, c: str, value=lambda x: x) -> Column:
    """The column's values in ``rows`` that are not null, each as ``value`` makes it, as an array by ``at``."""
    some = F.filter(rows, lambda r: r[OF + c].isNotNull())
    return F.transform(F.array_sort(F.transform(some, lambda r: F.struct(r[AT].alias("at"), value(r[OF + c]).alias("v")))), lambda r: r["v"])


def _at_end(rows: Column, c: str, end: Callable[[Column], Column]) -> Column:
    """The first or last filled value by ``at``; the place in ``rows`` decides between equal ones."""
    some = F.filter(rows, lambda r: _filled(r[OF + c]).isNotNull())
    return F.get(some, end(F.transform(some, lambda r, i: F.struct(r[AT].alias("at"), i.alias("i"))))["i"])[OF + c]


def _newer_wins(rows: Column, c: str, kind: T.MapType) -> Column:
    """Entries of all maps; of equal keys that of the last map."""
    maps = F.transform(_in_order(rows, c, F.map_entries), F.map_from_entries)  # maps themselves have no order
    older = lambda acc, m: F.map_filter(acc, lambda k, _: ~F.array_contains(F.map_keys(m), k))
    return F.aggregate(maps, F.create_map().cast(kind), lambda acc, m: F.map_concat(older(acc, m), m))


#: How a column of equal keys is folded by an aggregate; each rule gets the column's name and its type.
SUMMED: dict[str, Callable[[str, T.DataType], Column]] = {
    "least": lambda c, _: F.min(c),
    "greatest": lambda c, _: F.max(c),
    "sum": lambda c, kind: F.sum(c).cast(kind),
    "every": lambda c, _: F.min(c),
}

#: The same for the rules of one end, where no other column needs the key's rows: a key of any number of rows keeps one value each.
ENDS: dict[str, Callable[[str, Column], Column]] = {
    "first": lambda c, at: F.min_by(c, F.when(_filled(F.col(c)), at)),
    "last": lambda c, at: F.max_by(c, F.when(_filled(F.col(c)), at)),
}

#: How a column is folded that needs the key's rows, which are collected once for all such columns.
LISTED: dict[str, Callable[[Column, str, T.DataType], Column]] = {
    "first": lambda rows, c, _: _at_end(rows, c, F.array_min),
    "last": lambda rows, c, _: _at_end(rows, c, F.array_max),
    "union": lambda rows, c, _: F.array_sort(F.array_distinct(F.flatten(F.filter(F.transform(rows, lambda r: r[OF + c]), lambda v: v.isNotNull())))),
    "append": lambda rows, c, _: F.flatten(_in_order(rows, c)),
    "merge": _newer_wins,
}

#: The same for the only row of a key.
ALONE: dict[str, Callable[[Column, T.DataType], Column]] = {
    "first": lambda v, _: F.when(_filled(v), v),
    "last": lambda v, _: F.when(_filled(v), v),
    "union": lambda v, kind: F.array_sort(F.array_distinct(F.coalesce(v, F.array().cast(kind)))),
    "append": lambda v, kind: F.coalesce(v, F.array().cast(kind)),
    "merge": lambda v, kind: F.coalesce(v, F.create_map().cast(kind)),
}
RULES = {*SUMMED, *LISTED}


class VersionedStore:
    """``rules`` gives the rule of each column outside ``key`` (default: last); ``order`` orders the rows that one commit holds of a key.

    Rows with a null in the key are refused: they would have no identity.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: list[str], rules: dict[str, str] | None = None, order: list[str] | None = None):
        self.spark, self.folder, self.key, self.order = spark, folder.rstrip("/"), key, order or []
        self.schema = T.StructType.fromDDL(schema)
        self.rules = {f.name: (rules or {}).get(f.name, "last") for f in self.schema if f.name not in key}
        unknown = set(self.rules.values()) - RULES | set(rules or {}) - set(self.schema.names) | set(key) - set(self.schema.names)
        if unknown:
            raise ValueError(f"no such rule or column: {sorted(unknown)}")
        self._stored = T.StructType([*self.schema, T.StructField(SEQ, T.LongType())])

    # manifests

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Numbers of the versions there are, oldest first."""
        fs, at = self._fs(), self._path("versions")
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, of the newest one by default; before the first commit that of version 0."""
        have = self.versions()
        if version is None:
            version = have[-1] if have else 0
        if version == 0:
            return {"version": 0, "base": None, "deltas": [], "tokens": [], "seq": 0}
        if version not in have:
            raise ValueError(f"version {version} is not there; there are {have}")
        return json.loads("\n".join(r["value"] for r in self.spark.read.text(self._path(self._name(version)).toString(), wholetext=True).collect()))

    @staticmethod
    def _name(version: int) -> str:
        return f"versions/v{version:012d}.json"

    def _put(self, manifest: dict) -> int:
        """Puts a manifest under its number: written aside, then renamed, which fails where the number is taken."""
        jvm, fs = self.spark._jvm, self._fs()
        aside, final = self._path(f"aside/{uuid.uuid4().hex}"), self._path(self._name(manifest["version"]))
        fs.mkdirs(final.getParent())
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(fs.makeQualified(aside), fs.makeQualified(final), none)
        except Exception as failed:
            if fs.exists(final):
                raise Conflict(f"version {manifest['version']} of {self.folder} is there already") from failed
            raise
        return manifest["version"]

    # rows

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self._stored)
        return self.spark.read.schema(self._stored).parquet(*[f"{self.folder}/{f}" for f in folders])

    def _folded(self, rows: DataFrame) -> DataFrame:
        at = F.struct(F.col(SEQ), *[F.col(c) for c in self.order])
        listed = {c: rule for c, rule in self.rules.items() if rule in LISTED}
        folds = [SUMMED[rule](c, self.schema[c].dataType).alias(c) for c, rule in self.rules.items() if rule in SUMMED]
        if set(listed.values()) <= set(ENDS):
            folds += [ENDS[rule](c, at).alias(c) for c, rule in listed.items()]
            listed = {}
        if listed:
            folds.append(F.collect_list(F.struct(at.alias(AT), *[F.col(c).alias(OF + c) for c in listed])).alias(ROWS))
        out, found = rows.groupBy(*self.key).agg(*folds, F.max(SEQ).alias(SEQ)), F.col(ROWS)
        for c, rule in listed.items():
            kind = self.schema[c].dataType
            out = out.withColumn(c, F.when(F.size(found) == 1, ALONE[rule](found[0][OF + c], kind)).otherwise(LISTED[rule](found, c, kind)))
        return out.select(*self._stored.names)

    def _state(self, manifest: dict) -> DataFrame:
        base = self._rows([manifest["base"]] if manifest["base"] else [])
        if not manifest["deltas"]:
            return base
        deltas = self._rows(manifest["deltas"])
        if not manifest["base"]:
            return self._folded(deltas)
        touched = deltas.select(*self.key).distinct()
        return base.join(touched, self.key, "left_anti").unionByName(self._folded(base.join(touched, self.key, "left_semi").unionByName(deltas)))

    def read(self, version: int | None = None) -> DataFrame:
        """One row for each key, as of a version; the newest by default."""
        return self._state(self.manifest(version)).select(*self.schema.names)

    def commit(self, changes: DataFrame, token: str | None = None) -> int:
        """Adds rows; columns that ``changes`` lacks are null. Returns the version.

        A ``token`` that the store has seen changes nothing: a job that is run again commits once.
        """
        now = self.manifest()
        if token is not None and token in now["tokens"]:
            return now["version"]
        seq, folder = now["seq"] + 1, f"delta-{uuid.uuid4().hex}"
        columns = [(F.col(f.name) if f.name in changes.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema]
        some = F.lit(True)
        for k in self.key:
            some = some & F.col(k).isNotNull()
        rows = changes.select(*columns, F.lit(seq).cast("long").alias(SEQ))
        rows = rows.withColumn(self.key[0], F.when(some, F.col(self.key[0])).otherwise(F.raise_error(F.lit("a row has a null in its key")).cast(self.schema[self.key[0]].dataType)))
        rows.write.parquet(f"{self.folder}/{folder}")
        tokens = now["tokens"] + ([token] if token is not None else [])
        return self._put({"version": now["version"] + 1, "base": now["base"], "deltas": [*now["deltas"], folder], "tokens": tokens, "seq": seq})

    def compact(self) -> int:
        """Folds all deltas into a new base, sorted by key within files; returns the version. Without deltas nothing happens."""
        now = self.manifest()
        if not now["deltas"]:
            return now["version"]
        folder = f"base-{uuid.uuid4().hex}"
        self._state(now).sortWithinPartitions(*self.key).write.parquet(f"{self.folder}/{folder}")
        return self._put({**now, "version": now["version"] + 1, "base": folder, "deltas": []})

    def vacuum(self, keep: int = 1) -> list[str]:
        """Deletes manifests but for the last ``keep``, and folders that these do not list; returns what went.

        Readers of older versions and commits under way must have ended, as their folders may go.
        """
        fs, have = self._fs(), self.versions()
        kept = have[-keep:] if keep > 0 else have
        listed = {"versions"} | {f for v in kept for m in [self.manifest(v)] for f in (m["base"], *m["deltas"])}
        gone = [self._name(v) for v in have if v not in kept]
        gone += sorted(n for n in (s.getPath().getName() for s in fs.listStatus(self._path(""))) if n not in listed)
        for name in gone:
            fs.delete(self._path(name), True)
        return gone
