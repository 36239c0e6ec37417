"""The three whole jobs: score answers, fill quotas, compare models."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowmill.functions.text import render_prompt, value_text
from sparrowmill.operators import deltas, json_scores, quota, scores


def rebatched(parts: Iterator[pd.DataFrame], size: int | None) -> Iterator[pd.DataFrame]:
    """The rows of ``parts`` in frames of ``size`` rows, the last one smaller; as they come without a size."""
    if size is None:
        yield from parts
        return
    waiting: list[pd.DataFrame] = []
    held = 0
    for part in parts:
        waiting.append(part)
        held += len(part)
        if held >= size:
            rows = pd.concat(waiting, ignore_index=True)
            full = held - held % size
            yield from (rows.iloc[i : i + size] for i in range(0, full, size))
            waiting, held = [rows.iloc[full:]], held - full
    if held:
        yield pd.concat(waiting, ignore_index=True)


def responses(prompts: list[str], respond: Callable[[list[str]], list[str]], narrow: bool) -> tuple[list, list]:
    """What a function gives for prompts, and errors. A batch that fails has the error on all its rows, or,
    if it is to be narrowed down, is halved until the rows that fail by themselves are found."""
    out, errors, waiting = [None] * len(prompts), [None] * len(prompts), [(0, len(prompts))]
    while waiting:
        first, end = waiting.pop()
        try:
            found = list(respond(prompts[first:end]))
            if len(found) != end - first:
                raise ValueError(f"{len(found)} answers to {end - first} prompts")
            out[first:end] = found
        except Exception as e:  # noqa: BLE001  a user's function may fail in any way
            if narrow and end - first > 1:
                middle = (first + end) // 2
                waiting += [(first, middle), (middle, end)]
            else:
                errors[first:end] = [f"{type(e).__name__}: {e}"] * (end - first)
    return out, errors


def answer(samples: DataFrame, respond: Callable[[list[str]], list[str]], template: str = "default", key: str = "sample_id", batch_size: int | None = None, narrow: bool = False) -> DataFrame:
    """(key, prediction, error): a batched user function over rendered prompts; where it fails, all
    rows of its batch get the error and the others go on.

    ``batch_size`` rows of a partition go to the function at a time, however Spark hands them over; by
    default what it hands over is a batch. ``narrow`` calls a failed batch again in halves.
    """
    kind = samples.schema[key].dataType.simpleString()
    prompts = samples.select(key, render_prompt(F.coalesce("instruction", F.lit("")), F.coalesce("input", F.lit("")), template).alias("prompt"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in rebatched(parts, batch_size):
            out, errors = responses(part["prompt"].tolist(), respond, narrow)
            yield pd.DataFrame({key: part[key].array, "prediction": pd.Series(out, dtype=object), "error": pd.Series(errors, dtype=object)})

    return prompts.mapInPandas(run, f"{key} {kind}, prediction string, error string")


class Evaluation(NamedTuple):
    """Row scores, the summary, scores by group, accuracy by JSON field, and names that are no metrics."""

    rows: DataFrame
    summary: DataFrame
    groups: DataFrame | None
    fields: DataFrame | None
    unknown: list[str]


def evaluate(samples: DataFrame, predictions: DataFrame, metrics: Iterable[str], group: str | None = None, key: str = "sample_id") -> Evaluation:
    """Scores of predictions (key, prediction, error) against samples (key, output, ...) by named metrics.

    References that are no text (structs, arrays, maps, variants, numbers) are put as Python prints them,
    containers as JSON; a null one is the empty text. ``group`` is a column of the samples, or a field of
    their map ``meta``. Field accuracy comes with json_accuracy. Unknown names are given back; it is an
    error if all are.
    """
    known, unknown = scores.choose_metrics(metrics)
    reference = F.coalesce(value_text(samples, "output"), F.lit(""))
    paired = scores.pair(predictions, samples.withColumn("reference", reference), key)
    rows = scores.score_rows(paired, known)
    valid = paired.where(F.col("error").isNull()) if "error" in paired.columns else paired
    fields = json_scores.field_accuracy(json_scores.json_field_scores(valid, key)) if "json_accuracy" in known else None
    return Evaluation(rows, scores.summarise(rows, known), scores.by_group(rows, known, group) if group else None, fields, unknown)


def plan_requests(quotas: DataFrame, existing: DataFrame, dimension: DataFrame, seeds: DataFrame, template: str, batch_size: int = 5) -> DataFrame:
    """The requests that fill what is missing."""
    return quota.requests(quota.unfinished(quota.remaining(quotas, existing)), dimension, seeds, template, batch_size)


def compare_models(base: DataFrame, targets: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(task, distance statistics) of each target against the base, and the cosines of all pairs."""
    each = {t: deltas.param_delta(base, df).withColumn("task", F.lit(t)) for t, df in targets.items()}
    distances, all_ = None, None
    for t, d in each.items():
        one = deltas.delta_distance(d).withColumn("task", F.lit(t))
        distances, all_ = (one, d) if distances is None else (distances.unionByName(one), all_.unionByName(d))
    return distances, deltas.pair_cosines(all_)
