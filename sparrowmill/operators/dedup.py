"""Corpus hygiene: unions, keep-first dedup, rows not seen yet, counts by file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowmill.functions.text import trim_u


def keep_first(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of rows with the same trimmed key, the first in ``order``; null keys are one key.

    Rows are grouped by the key's SHA-256, each task's first one before they are shuffled, so however often
    a text is repeated, a task sends it once.
    """
    first = F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_first")
    return df.groupBy(F.sha2(trim_u(F.col(key)), 256).alias("_key")).agg(first).select("_first.*")


def not_seen(new: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` whose trimmed key isn't in ``stored``; null is a key.

    Keys are compared by their SHA-256, so no text is shuffled as a key.
    """
    digest = lambda df: F.unhex(F.sha2(F.coalesce(F.concat(F.lit("="), trim_u(df[key].cast("string"))), F.lit("")), 256))
    seen = stored.select(digest(stored).alias("_seen")).distinct()
    return new.withColumn("_digest", digest(new)).join(seen, F.col("_digest") == F.col("_seen"), "left_anti").drop("_digest")


def file_counts(df: DataFrame, key: str, file: str = "file") -> DataFrame:
    """(file, raw, unique, duplicates) of each file, and of all with file null; a row counts as unique
    in the whole once for its trimmed key, in its file once as well."""
    sets = df.withColumn("_key", F.coalesce(trim_u(F.col(key)), F.lit(""))).groupBy(F.col(file).alias("file"), "_key").agg(F.count(F.lit(1)).alias("n"))
    per = sets.groupBy("file").agg(F.sum("n").alias("raw"), F.count(F.lit(1)).alias("unique"))
    whole = sets.groupBy("_key").agg(F.sum("n").alias("n")).agg(F.lit(None).cast("string").alias("file"), F.coalesce(F.sum("n"), F.lit(0)).alias("raw"), F.count(F.lit(1)).alias("unique"))
    return per.unionByName(whole).withColumn("duplicates", F.col("raw") - F.col("unique"))


def existing_counts(df: DataFrame, *labels: str) -> DataFrame:
    """(label, n): rows by the first of the label columns that is not null, __unknown__ without any."""
    return df.groupBy(F.coalesce(*[F.col(c) for c in labels], F.lit("__unknown__")).alias("label")).agg(F.count(F.lit(1)).alias("n"))
