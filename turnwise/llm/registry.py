"""Registered queries of the subpackage: key -> (builder over a folder of tables, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

MODULES = ("secret_scan", "bpe_codec", "language_id", "simhash", "sharding", "quality", "exact_dedup", "mixing",
           "license_scan", "fingerprints", "vector_codes",
           "prefix_trie", "ppm")

_QUERIES: dict[str, QueryFn] = {}
_SQL: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        _QUERIES[key] = fn
        if sql is not None:
            _SQL[key] = sql
        return fn
    return deco


def _load() -> None:
    for m in MODULES:
        import_module(f"{__package__}.{m}")


def queries() -> dict[str, QueryFn]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
