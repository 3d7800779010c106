"""Query registry: key -> (Spark callable, optional SQL check)."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from .oracle import Check

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, Check] = {}

DOMAINS = (
    "technical", "ingestion", "scalars", "joins", "orderflow", "levels", "patterns", "anomaly", "regime", "options", "flow",
    "text", "macro", "fundamentals", "assembly", "gates", "risk", "outcomes", "ledger", "performance", "ml", "drift", "streams",
)


def register(key: str, fn: Query, sql: Check | None = None) -> None:
    if key in _QUERIES:
        raise ValueError(f"duplicate query key {key}")
    _QUERIES[key] = fn
    if sql is not None:
        _ORACLES[key] = sql


def check(key: str) -> Check:
    """The SQL check of a key that is registered already."""
    return _ORACLES[key]


def wrap(decorator: Callable[[Query], Query], *keys: str) -> None:
    for key in keys:
        _QUERIES[key] = decorator(_QUERIES[key])


def query(key: str, sql: Check | None = None) -> Callable[[Query], Query]:
    def wrap(fn: Query) -> Query:
        register(key, fn, sql)
        return fn

    return wrap


def load() -> None:
    for name in DOMAINS:
        import_module(f"{__package__}.{name}")


def queries() -> dict[str, Query]:
    load()
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    load()
    return {k: c.render() for k, c in _ORACLES.items()}
