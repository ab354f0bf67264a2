"""Registry: query name -> callable, and name -> oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    """Decorator that enters a (spark, folder) -> DataFrame function under ``name``."""

    def put(f):
        assert name not in _QUERIES, name
        _QUERIES[name] = f
        if oracle:
            _ORACLES[name] = oracle
        return f

    return put


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _ORACLES


def _load() -> None:
    from dialoom.plans import acts, candidates, context, lookups, manifests, metrics, retrieval, samples, stages, states, streams, texts  # noqa: F401
