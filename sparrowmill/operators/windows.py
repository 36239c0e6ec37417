"""Ordered choices within groups: first rows, seeded samples, batches, shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparrowmill.sources.shared import stored


def _numbered(df: DataFrame, group: list[str], order: list) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def in_ranges(df: DataFrame, group: list[str], order: list) -> DataFrame:
    """``df``, stored in ranges of group and order of about equal size, with the number of its range as _range.

    Ranges follow one another in that order, so what a group needs to know of its rows before is a row
    for each range it touches. Columns are stored as given; select what is needed first.
    """
    return stored(df.repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id()), "ranges")


def _in_range_of(group: list[str]) -> list[Column]:
    """Joins a row (_in, _g0, _g1 ...) of range summaries to the rows of that range and group."""
    return [F.col("_range") == F.col("_in")] + [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)]


def numbered(df: DataFrame, group: list[str], order: list, name: str, key: list[str] | None = None) -> DataFrame:
    """``df`` with the place (long, from 1) of each row in its group, for groups of any size.

    Places are counted within ranges, after the sizes of the ranges before. With a ``key`` that names each
    row, only key, group and order columns (given by name) go through the ranges, and places are joined
    back; without one all columns of ``df`` do.
    """
    names = df.columns
    rows = df if key is None else df.select(*dict.fromkeys([*key, *group, *order]))
    parts = in_ranges(rows, group, order)
    before = Window.partitionBy(*[f"_g{i}" for i in range(len(group))]).orderBy("_in").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_range").alias("_in")).agg(F.count(F.lit(1)).alias("_n"))
    sums = sums.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = parts.withColumn("_n", F.row_number().over(Window.partitionBy(*group, "_range").orderBy(*order)))
    out = inside.join(sums, _in_range_of(group)).withColumn(name, (F.col("_n") + F.col("_base")).cast("long"))
    if key is None:
        return out.select(*names, name)
    out = out.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], name)
    return df.join(out, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)]).select(*names, name)


def carried(df: DataFrame, group: list[str], order: list, value: str, name: str) -> DataFrame:
    """``df`` with the last value that is not null, of the row or one before it in its group, for groups of
    any size: the last one of each range is carried over the ranges, then each range is filled."""
    parts = in_ranges(df, group, order)
    place = F.struct(*order)
    ends = parts.where(F.col(value).isNotNull()).groupBy(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_range").alias("_from")).agg(F.max_by(value, place).alias("_last"))
    # A range takes over from the last range before it that has a value of its group.
    touched = parts.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_range").alias("_in")).distinct()
    ends = ends.withColumnsRenamed({f"_g{i}": f"_e{i}" for i in range(len(group))})
    both = touched.join(ends, [F.col("_in") == F.col("_from"), *[F.col(f"_g{i}").eqNullSafe(F.col(f"_e{i}")) for i in range(len(group))]], "left")
    before = Window.partitionBy(*[f"_g{i}" for i in range(len(group))]).orderBy("_in").rowsBetween(Window.unboundedPreceding, -1)
    above = both.select(*[f"_g{i}" for i in range(len(group))], "_in", F.last("_last", True).over(before).alias("_above"))
    down = Window.partitionBy(*group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = parts.withColumn("_own", F.last(value, True).over(down)).join(above, _in_range_of(group))
    return filled.select(*df.columns, F.coalesce("_own", "_above").alias(name))


def first_rows(df: DataFrame, group: list[str], order: list, most: int) -> DataFrame:
    """The first ``most`` rows of each group; groups without a key (null or empty) are left out."""
    for g in group:
        df = df.where(F.col(g).isNotNull() & (F.col(g).cast("string") != ""))
    return _numbered(df, group, order).where(F.col("_n") <= most).drop("_n")


def joined_names(df: DataFrame, group: list[str], order: str, name: Column, most: int, separator: str = "、") -> DataFrame:
    """(*group, names, members): the first ``most`` names of each group in order, as one text."""
    for g in group:
        df = df.where(F.col(g).isNotNull() & (F.col(g).cast("string") != ""))
    ranked = df.select(*group, F.col(order).alias("_o"), name.alias("_name"))
    ranked = ranked.withColumns({"_n": F.row_number().over(Window.partitionBy(*group).orderBy("_o")), "members": F.count(F.lit(1)).over(Window.partitionBy(*group))})
    few = ranked.where(F.col("_n") <= most).groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("_n", "_name"))).alias("_l"), F.first("members").alias("members"))
    return few.select(*group, F.array_join(F.transform("_l", lambda x: x["_name"]), separator).alias("names"), "members")


def group_size_between(df: DataFrame, group: list[str], least: int = 1, most: int | None = None) -> DataFrame:
    """Rows of groups whose size lies within the limits."""
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") >= least)
    if most is not None:
        sizes = sizes.where(F.col("_size") <= most)
    return df.join(sizes.drop("_size"), group, "left_semi")


def seeded_order(seed: int, *keys: str) -> list[Column]:
    """An order that looks random and is the same on every run."""
    return [F.xxhash64(F.lit(seed), *keys), *[F.col(k) for k in keys]]


def seeded_sample(df: DataFrame, group: list[str], keys: list[str], cap: int, seed: int = 42) -> DataFrame:
    """At most ``cap`` rows of each group, chosen by hash of seed and keys."""
    return _numbered(df, group, seeded_order(seed, *keys)).where(F.col("_n") <= cap).drop("_n")


def preview(df: DataFrame, most: int = 5, at_random: int = 0, keys: list[str] | None = None, seed: int = 42) -> DataFrame:
    """A few rows to look at: the first that come, or ``at_random`` ones in the seeded order of ``keys``."""
    if at_random:
        return df.orderBy(*seeded_order(seed, *(keys or df.columns))).limit(at_random)
    return df.limit(most)


def shuffled(df: DataFrame, keys: list[str], seed: int = 42) -> DataFrame:
    """All rows in seeded order."""
    return df.orderBy(*seeded_order(seed, *keys))


def batches(quotas: DataFrame, size: int, need: str = "need") -> DataFrame:
    """A row for each batch of a quota: batch (from 0) and batch_size, the last one smaller."""
    count = F.ceil(F.col(need) / size).cast("int")
    out = quotas.where(F.col(need) > 0).withColumn("batch", F.explode(F.sequence(F.lit(0), count - 1)))
    return out.withColumn("batch_size", F.least(F.lit(size), F.col(need) - F.col("batch") * size).cast("int"))


def exact_quota(df: DataFrame, group: list[str], order: list, target: str, key: list[str] | None = None) -> DataFrame:
    """The first rows of each group up to the number in its ``target`` column; ``key`` as in ``numbered``."""
    return numbered(df, group, order, "_place", key).where(F.col("_place") <= F.col(target)).drop("_place")
