"""Registry of the engine's queries: name, callable and the equivalent DuckDB SQL."""

from __future__ import annotations

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Registers a callable (spark, sf_dir) -> DataFrame under name."""

    def keep(f):
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return keep


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
