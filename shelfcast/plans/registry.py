"""Registry of named queries.

Each query is `fn(spark, sf_dir) -> DataFrame`; the optional oracle is a
DuckDB SQL string over the same tables (views named like the parquet files).
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def load_all() -> None:
    # Importing the catalog modules fills the registry.
    from shelfcast.plans import catalog  # noqa: F401
