"""Named queries over the standard tables, each with its SQL equivalent.

Every module here fills two dictionaries, ``QUERIES`` (name to ``(spark, sf_dir) -> DataFrame``)
and ``ORACLE`` (name to SQL); this package merges them.
"""

from __future__ import annotations

import importlib
import pkgutil


def _collect() -> tuple[dict, dict]:
    queries: dict = {}
    oracle: dict = {}
    for info in sorted(pkgutil.iter_modules(__path__), key=lambda m: m.name):
        module = importlib.import_module(f"{__name__}.{info.name}")
        clash = set(queries) & set(module.QUERIES)
        if clash:
            raise ValueError(f"query names registered twice: {sorted(clash)}")
        queries.update(module.QUERIES)
        oracle.update(module.ORACLE)
    return queries, oracle


QUERIES, ORACLE = _collect()
