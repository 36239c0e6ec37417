"""Queries over the driver's tables, each with SQL of the same result where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparrowmill.queries import corpus, params, scoring, streams

_REGISTRIES = [scoring, corpus, params, streams]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for r in _REGISTRIES for n, (f, _) in r.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {n: sql for r in _REGISTRIES for n, (_, sql) in r.QUERIES.items() if sql}
