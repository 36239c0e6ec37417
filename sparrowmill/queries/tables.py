"""The driver's tables, and the query registry of a module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def registry() -> tuple[dict, Callable]:
    """A dict and a decorator that puts (function, SQL) into it under the function's name."""
    found: dict = {}

    def put(sql: str | None = None) -> Callable:
        def take(fn: Callable) -> Callable:
            found[fn.__name__] = (fn, sql)
            return fn

        return take

    return found, put


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of sums does not show."""
    return df.withColumns({n: F.round(F.col(n), places) for n in names})


def long(c: Column) -> Column:
    return c.cast("long")
