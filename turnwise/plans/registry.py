"""Query registry: key -> (Spark builder over a testdata folder, DuckDB oracle SQL or None).

Each registered query reads whole driver tables through the fixture views; the oracle text
is plain SQL over the same views (prefixed with their CTEs by ``fixtures.with_views``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.fixtures import with_views

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_SQL: dict[str, str | None] = {}


def register(key: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if key in _QUERIES:
            raise ValueError(f"duplicate query key {key}")
        _QUERIES[key] = fn
        _SQL[key] = sql
        return fn
    return deco


def _load_all() -> None:
    from . import queries_core  # noqa: F401
    from . import queries_state  # noqa: F401
    from . import queries_entities  # noqa: F401
    from . import queries_text  # noqa: F401
    from . import queries_predict  # noqa: F401
    from . import queries_index  # noqa: F401
    from . import queries_sessions  # noqa: F401


def queries() -> dict[str, QueryFn]:
    _load_all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return {k: with_views(v) for k, v in _SQL.items() if v is not None}
