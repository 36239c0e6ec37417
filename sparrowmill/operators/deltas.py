"""Differences between parameter tables and their statistics.

A parameter table is long: (tensor, row, col, pos, value). All statistics are aggregates over it,
and what compares two or more tables joins them on (tensor, pos), so nothing grows with the number
of tensors and no vector is ever in one place. Values are doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrowmill.functions.tensors import layer_key

KEY = ["tensor", "pos"]


def param_delta(base: DataFrame, target: DataFrame, keep: Column | None = None) -> DataFrame:
    """(tensor, pos, value) = target - base over all elements of both; what one side lacks counts as 0.

    ``keep`` is a predicate on tensor. It is asked for tensors that both sides have; others pass.
    """
    both = base.select(*KEY, F.col("value").alias("b")).join(target.select(*KEY, F.col("value").alias("t")), KEY, "full_outer")
    if keep is not None:
        names = lambda df, c: df.select("tensor").distinct().withColumn(c, F.lit(True))
        shared = names(base, "in_base").join(names(target, "in_target"), "tensor").select("tensor")
        both = both.join(shared.where(~keep), "tensor", "left_anti")
    return both.select(*KEY, (F.coalesce("t", F.lit(0.0)) - F.coalesce("b", F.lit(0.0))).alias("value"))


def param_delta_strict(base: DataFrame, target: DataFrame) -> DataFrame:
    """(tensor, pos, value) over the elements of base; an error at the first one that target lacks."""
    both = base.select(*KEY, F.col("value").alias("b")).join(target.select(*KEY, F.col("value").alias("t")), KEY, "left")
    missing = F.raise_error(F.concat(F.lit("target lacks "), F.col("tensor"))).cast("double")
    return both.select(*KEY, (F.when(F.col("t").isNull(), missing).otherwise(F.col("t")) - F.col("b")).alias("value"))


def align(a: DataFrame, b: DataFrame) -> DataFrame:
    """(tensor, pos, x, y) of two deltas; an error if one has an element that the other lacks."""
    both = a.select(*KEY, F.col("value").alias("x")).join(b.select(*KEY, F.col("value").alias("y")), KEY, "full_outer")
    alone = F.col("x").isNull() | F.col("y").isNull()
    fail = F.raise_error(F.concat(F.lit("one side lacks "), F.col("tensor"))).cast("double")
    return both.select(*KEY, F.when(alone, fail).otherwise(F.col("x")).alias("x"), F.when(alone, fail).otherwise(F.col("y")).alias("y"))


def _share(condition: Column) -> Column:
    return F.coalesce(F.try_divide(F.count_if(condition), F.count(F.lit(1))), F.lit(0.0))


def delta_size(delta: DataFrame) -> DataFrame:
    """One row: tensors, elements."""
    per = delta.groupBy("tensor").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("tensors"), F.coalesce(F.sum("n"), F.lit(0)).alias("elements"))


def delta_distance(delta: DataFrame) -> DataFrame:
    """One row: l1, l2, rms, elements, and increased, decreased, unchanged in percent (0 of nothing)."""
    v, squares, n = F.col("value"), F.coalesce(F.sum(F.col("value") * F.col("value")), F.lit(0.0)), F.count(F.lit(1))
    return delta.agg(
        F.coalesce(F.sum(F.abs(v)), F.lit(0.0)).alias("l1"), F.sqrt(squares).alias("l2"), F.coalesce(F.sqrt(F.try_divide(squares, n)), F.lit(0.0)).alias("rms"), n.alias("elements"),
        (100 * _share(v > 0)).alias("increased"), (100 * _share(v < 0)).alias("decreased"), (100 * _share(v == 0)).alias("unchanged"),
    )


def layer_distance(delta: DataFrame) -> DataFrame:
    """(layer, l2, rms, elements), in text order of layer."""
    named = delta.withColumn("layer", layer_key(F.col("tensor")))
    squares, n = F.sum(F.col("value") * F.col("value")), F.count(F.lit(1))
    return named.groupBy("layer").agg(F.sqrt(squares).alias("l2"), F.sqrt(squares / n).alias("rms"), n.alias("elements")).orderBy("layer")


def tensor_stats(delta: DataFrame, top: int | None = None) -> DataFrame:
    """(tensor, abs_mean, std, direction, elements); the ``top`` tensors by abs_mean, ties by name.

    std is the sample deviation, null for one element; direction is + where the mean is above 0.
    """
    out = delta.groupBy("tensor").agg(F.avg(F.abs("value")).alias("abs_mean"), F.stddev_samp("value").alias("std"), F.when(F.avg("value") > 0, "+").otherwise("-").alias("direction"), F.count(F.lit(1)).alias("elements"))
    return out if top is None else out.orderBy(F.desc("abs_mean"), "tensor").limit(top)


def delta_summary(delta: DataFrame) -> DataFrame:
    """One row: mean, std, and the shares positive, negative, zero."""
    v = F.col("value")
    return delta.agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), _share(v > 0).alias("positive"), _share(v < 0).alias("negative"), _share(v == 0).alias("zero"))


def cosine(dot: Column, xx: Column, yy: Column) -> Column:
    """Cosine within [-1, 1]; 0 if a vector is 0."""
    norms = F.sqrt(xx) * F.sqrt(yy)
    return F.when(norms > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(dot, norms)))).otherwise(0.0)


def cosine_similarity(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: cosine of two deltas."""
    sums = [F.coalesce(F.sum(F.col(p) * F.col(q)), F.lit(0.0)) for p, q in ("xy", "xx", "yy")]
    return align(a, b).agg(cosine(*sums).alias("cosine"))


def sign_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: of elements that are not 0 on either side, the shares agreement, same_pos, same_neg
    and opposite (1 and zeros if there are none); of all, a_only and b_only."""
    x, y = F.col("x"), F.col("y")
    both, n = F.count_if((x != 0) & (y != 0)), F.count(F.lit(1))
    of = lambda c, k, empty: F.coalesce(F.try_divide(F.count_if(c), k), F.lit(empty))
    return align(a, b).agg(
        of(((x > 0) & (y > 0)) | ((x < 0) & (y < 0)), both, 1.0).alias("agreement"), of((x > 0) & (y > 0), both, 0.0).alias("same_pos"), of((x < 0) & (y < 0), both, 0.0).alias("same_neg"),
        of(((x > 0) & (y < 0)) | ((x < 0) & (y > 0)), both, 0.0).alias("opposite"), of((x != 0) & (y == 0), n, 0.0).alias("a_only"), of((x == 0) & (y != 0), n, 0.0).alias("b_only"),
    )


def pair_cosines(deltas: DataFrame, least: float = 0.3) -> DataFrame:
    """(a, b, cosine, class) of all tasks a < b in ``deltas`` (task, tensor, pos, value).

    The elements of one (tensor, pos) are gathered as one row, at most one for each task, and give
    the products of all pairs at once; each task's norm is taken once. compatible is asked before
    conflicting (below 0); else neutral. Classes go by the cosine as it is, not rounded.
    """
    element = deltas.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("task", "value"))).alias("e"))
    products = element.select(F.explode(F.flatten(F.transform("e", lambda x: F.transform(F.filter("e", lambda y: y["task"] > x["task"]), lambda y: F.struct(x["task"].alias("a"), y["task"].alias("b"), (x["value"] * y["value"]).alias("p"))))))).select("col.*")
    dots = products.groupBy("a", "b").agg(F.sum("p").alias("dot"))
    norms = deltas.groupBy("task").agg(F.sum(F.col("value") * F.col("value")).alias("n"))
    out = dots.join(norms.toDF("a", "na"), "a").join(norms.toDF("b", "nb"), "b").select("a", "b", cosine(F.col("dot"), F.col("na"), F.col("nb")).alias("cosine"))
    return out.withColumn("class", F.when(F.col("cosine") >= least, "compatible").when(F.col("cosine") < 0, "conflicting").otherwise("neutral"))


def compat_matrix(deltas: DataFrame, tasks: list) -> DataFrame:
    """(task, one column for each of ``tasks``): cosines rounded to 4 places, 1 on the diagonal."""
    pairs = pair_cosines(deltas).select("a", "b", F.round("cosine", 4).alias("c"))
    own = deltas.select(F.col("task").alias("a"), F.col("task").alias("b"), F.lit(1.0).alias("c")).distinct()
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "c")).unionByName(own).groupBy(F.col("a").alias("task")).pivot("b", tasks).agg(F.first("c"))
