"""Named queries with the SQL that states their result."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
_MODULES = tuple(f"scriptloom.plans.{m}" for m in ("statistics", "quality", "relational", "texts", "grading", "comparing", "corpus_tools", "scripts", "statements"))


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a function of (spark, sf_dir); ``oracle`` is DuckDB SQL with the same columns and rows."""

    def add(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} exists")
        _QUERIES[name] = f
        if oracle:
            _ORACLES[name] = oracle
        return f

    return add


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(m)


def all_queries() -> dict[str, Query]:
    _load()
    return _QUERIES


def all_oracles() -> dict[str, str]:
    _load()
    return _ORACLES
