"""The registered queries: each operator over the test tables, with the same question in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query; without SQL only its rows are checked."""

    def add(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


def load() -> None:
    """Imports every module that registers queries."""
    from basketflow.catalog import (  # noqa: F401
        cleaning, evaluating, measuring, modelling, objectives, ranking, retrieving, sequencing, serving, storing,
    )
