"""Scores of predictions against references: one row score each, and their aggregates.

A metric is known by name. Row metrics are Columns, so a run over many metrics and groups is one plan;
what a metric gives besides its score (its parts) is averaged as well. List metrics score all rows of a
group at once: either from sums of row statistics, which Spark adds up in any order, or from a function
on whole lists, whose group then is one task. Python row metrics run in a query of their own if one
that fails is not to stop the others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrowmill.functions.text import characters, reference_text, trim_u
from sparrowmill.operators import json_scores, ngrams

#: (prediction, reference) -> Column of double, or of a struct with a field of the metric's name and its parts.
RowScore = Callable[[Column, Column], Column]


@dataclass(frozen=True)
class Metric:
    """A metric by one of its forms: ``score`` for rows; ``sums`` of rows with ``of_sums``, the score of
    their sums; or ``whole``, a pandas function on the lists of a group."""

    score: RowScore | None = None
    parts: tuple[str, ...] = ()
    sums: Callable[[Column, Column], dict[str, Column]] | None = None
    of_sums: Callable[[dict[str, Column]], Column] | None = None
    whole: Callable[[pd.Series, pd.Series], float] | None = None


METRICS: dict[str, Metric] = {}


def register_metric(name: str, parts: Iterable[str] = ()) -> Callable[[RowScore], RowScore]:
    """Registers a row score; the function takes and gives Columns."""

    def put(fn: RowScore) -> RowScore:
        METRICS[name] = Metric(fn, tuple(parts))
        return fn

    return put


def register_python_metric(name: str, score: Callable[[pd.Series, pd.Series], pd.Series]) -> None:
    """Registers a row score that works on pandas series."""
    METRICS[name] = Metric(F.pandas_udf(score, "double"))


def register_list_metric(name: str, sums: Callable[[Column, Column], dict[str, Column]], of_sums: Callable[[dict[str, Column]], Column]) -> None:
    """Registers a metric of whole lists given by sums of row statistics: corpus ratios, micro averages,
    correlations. Lists of any size are summed by all tasks."""
    METRICS[name] = Metric(sums=sums, of_sums=of_sums)


def register_pandas_list_metric(name: str, whole: Callable[[pd.Series, pd.Series], float]) -> None:
    """Registers any function of the whole lists. Each group, and the list of all rows, meets in one task's
    memory; what can be put in sums belongs in ``register_list_metric``."""
    METRICS[name] = Metric(whole=whole)


@register_metric("exact_match")
def exact_match(prediction: Column, reference: Column) -> Column:
    return (trim_u(prediction) == trim_u(reference_text(reference))).cast("double")


@register_metric("contains")
def contains(prediction: Column, reference: Column) -> Column:
    """1 where the reference lies in the prediction; an empty one always does."""
    return F.contains(trim_u(prediction), trim_u(reference_text(reference))).cast("double")


@register_metric("json_accuracy")
def json_accuracy(prediction: Column, reference: Column) -> Column:
    return json_scores.compared(prediction, reference)["accuracy"]


@register_metric("json_exact_match")
def json_exact_match(prediction: Column, reference: Column) -> Column:
    return json_scores.compared(prediction, reference)["exact"]


@register_metric("char_f1")
def char_f1(prediction: Column, reference: Column) -> Column:
    """F1 of the sets of characters; two empty texts score 1, one empty text 0."""
    p, r = characters(trim_u(prediction)), characters(trim_u(reference_text(reference)))
    both = F.size(F.array_intersect(p, r))
    return F.when((F.size(p) == 0) & (F.size(r) == 0), 1.0).when(both == 0, 0.0).otherwise(2 * both / (F.size(p) + F.size(r)))


@register_metric("bleu", ["bleu1", "bleu2", "bleu3", "bleu4"])
def bleu(prediction: Column, reference: Column) -> Column:
    return ngrams.char_bleu_scores(trim_u(prediction), trim_u(reference_text(reference)))


def choose_metrics(names: Iterable[str]) -> tuple[list[str], list[str]]:
    """The known and the unknown of the names; an error if none is known."""
    names = list(dict.fromkeys(names))
    known = [n for n in names if n in METRICS]
    if not known:
        raise ValueError(f"no known metric among {names}; there are {sorted(METRICS)}")
    return known, [n for n in names if n not in METRICS]


def pair(predictions: DataFrame, samples: DataFrame, key: str = "sample_id") -> DataFrame:
    """Predictions with their samples."""
    return predictions.join(samples, key)


def _stat(metric: str, name: str) -> str:
    return f"_{metric}_{name}"


def score_rows(rows: DataFrame, metrics: Iterable[str], prediction: str = "prediction", reference: str = "reference") -> DataFrame:
    """``rows`` with a column for each row metric and its parts, and for each list metric the columns
    (named _metric_statistic) that its sums are made of; rows with an error get nulls."""
    ok = F.col("error").isNull() if "error" in rows.columns else F.lit(True)
    p, r = F.when(ok, F.col(prediction)), F.when(ok, F.col(reference))
    cells: dict[str, Column] = {}
    for m in metrics:
        entry = METRICS[m]
        if entry.score is not None:
            value = entry.score(p, r)
            cells |= {n: F.when(ok, value[n]) for n in (m, *entry.parts)} if entry.parts else {m: F.when(ok, value)}
        elif entry.sums is not None:
            cells |= {_stat(m, n): F.when(ok, c) for n, c in entry.sums(p, r).items()}
        else:
            cells |= {_stat(m, "p"): F.coalesce(p, F.lit("")), _stat(m, "r"): reference_text(r)}
    return rows.withColumns(cells)


def _means(metrics: Iterable[str], correct: bool = False, empty: float | None = None) -> list[Column]:
    """An aggregate for each metric that needs no list in one task."""
    cells = []
    for m in metrics:
        entry = METRICS[m]
        if entry.score is not None:
            mean = lambda n: F.avg(n) if empty is None else F.coalesce(F.avg(n), F.lit(empty))
            cells.append(mean(m).alias(m))
            if correct:
                cells.append(F.coalesce(F.floor(F.sum(m)), F.lit(0)).cast("long").alias(f"{m}_correct"))
            cells += [mean(n).alias(n) for n in entry.parts]
        elif entry.of_sums is not None:
            names = list(entry.sums(F.lit(""), F.lit("")))
            cells.append(entry.of_sums({n: F.sum(_stat(m, n)) for n in names}).cast("double").alias(m))
    return cells


def _whole(scored: DataFrame, metrics: Iterable[str], group: str | None) -> DataFrame | None:
    """(group_value, whole, *metrics) of metrics on whole lists; None without any."""
    names = [m for m in metrics if METRICS[m].whole is not None]
    if not names:
        return None
    cells = [F.pandas_udf(METRICS[m].whole, "double")(F.col(_stat(m, "p")), F.col(_stat(m, "r"))).alias(m) for m in names]
    every = scored.groupBy(F.lit(1).alias("one")).agg(*cells).select(F.lit(None).cast("string").alias("group_value"), F.lit(1).alias("whole"), *names)
    if group is None:
        return every
    parts = scored.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("group_value")).agg(*cells)
    return every.unionByName(parts.select("group_value", F.lit(0).alias("whole"), *names))


def _valid(scored: DataFrame) -> DataFrame:
    return scored.where(F.col("error").isNull()) if "error" in scored.columns else scored


def summarise(scored: DataFrame, metrics: Iterable[str]) -> DataFrame:
    """One row: total, valid, errors, all_failed; for each row metric its mean over valid rows (0 without
    any), the number of points as m_correct and the means of its parts; each list metric's score."""
    metrics = list(metrics)
    failed = F.count_if(F.col("error").isNotNull()) if "error" in scored.columns else F.lit(0).cast("long")
    total = F.count(F.lit(1))
    out = scored.agg(total.alias("total"), (total - failed).alias("valid"), failed.alias("errors"), ((total == failed) & (total > 0)).alias("all_failed"), *_means(metrics, correct=True, empty=0.0))
    lists = _whole(_valid(scored), metrics, None)
    if lists is None:
        return out
    both = out.unionByName(lists.drop("group_value", "whole"), allowMissingColumns=True)  # a row each, with nulls for the other's columns
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def group_text(rows: DataFrame, group: str) -> Column:
    """The text of a grouping field: a column, or a field of the map ``meta`` that nobody declared."""
    if group in rows.columns or "meta" not in rows.columns:
        return F.col(group).cast("string")
    value = F.try_element_at("meta", F.lit(group))
    text = F.try_variant_get(value, "$", "string")
    return F.when(F.schema_of_variant(value) == "BOOLEAN", F.initcap(text)).when(F.schema_of_variant(value).rlike("^(OBJECT|ARRAY)"), F.to_json(value)).otherwise(text)


def by_group(scored: DataFrame, metrics: Iterable[str], group: str) -> DataFrame:
    """(group_value, whole, n, scores): the row of all valid rows has whole 1 and group_value null, other
    rows a value of ``group`` as text; rows without a value count in the whole only. One pass for both,
    and one more for each kind of metric on whole lists."""
    metrics = list(metrics)
    named = _valid(scored).withColumn("group_value", group_text(scored, group))
    sets = named.groupingSets([[], [F.col("group_value")]], F.col("group_value"))
    out = sets.agg(F.grouping("group_value").cast("int").alias("whole"), F.count(F.lit(1)).alias("n"), *_means(metrics))
    out = out.where((F.col("whole") == 1) | F.col("group_value").isNotNull())
    lists = _whole(named, metrics, "group_value")
    if lists is None:
        return out
    lists = lists.withColumnsRenamed({"group_value": "_of", "whole": "_all"})
    return out.join(lists, F.col("group_value").eqNullSafe(F.col("_of")) & (F.col("whole") == F.col("_all")), "left").drop("_of", "_all")


def isolated(rows: DataFrame, metrics: Iterable[str], prediction: str = "prediction", reference: str = "reference") -> DataFrame:
    """(metric, score, failure): each metric in its own query, so that one that fails leaves the others."""
    spark, found = rows.sparkSession, []
    for m in metrics:
        try:
            value = summarise(score_rows(rows, [m], prediction, reference), [m]).first()[m]
            found.append((m, value, None))
        except Exception as e:  # noqa: BLE001  a metric may fail in any way
            found.append((m, None, f"{type(e).__name__}: {e}"[:500]))
    return spark.createDataFrame(found, "metric string, score double, failure string")


def char_bleu(rows: DataFrame, key: str, prediction: str = "prediction", reference: str = "reference", most: int = 4) -> DataFrame:
    """(key, bleu1 .. bleu4, bleu) of each row: clipped precision of character n-grams, their
    geometric mean (each at least 1e-10) times the brevity penalty.

    A text shorter than n counts as one n-gram. Rows are scored where they are.
    """
    score = ngrams.char_bleu_scores(trim_u(F.col(prediction)), trim_u(reference_text(F.col(reference))), most)
    return rows.select(key, score.alias("s")).select(key, "s.*")
