"""Queries of the training-data operators: name -> callable, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, fn: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    _QUERIES[name] = fn
    if sql is not None:
        _ORACLES[name] = sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from convlens.llm import queries as _  # noqa: F401  (registers opN_)

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from convlens.llm import queries as _  # noqa: F401

    return dict(_ORACLES)
