"""Streams of responses and samples; progress is the checkpoint's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparrowmill.functions.text import trim_u
from sparrowmill.operators.quota import SAMPLE, samples_and_rejects, with_samples
from sparrowmill.sources.shared import stored


def response_stream(spark: SparkSession, path: str) -> DataFrame:
    """(label, content) of files that appear below ``path``; the label is the name before a dash or dot."""
    raw = spark.readStream.format("text").option("wholetext", True).load(path)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return raw.select(F.regexp_extract(name, r"^([^-.]+)", 1).alias("label"), F.col("value").alias("content"))


def ingest(responses: DataFrame, out: str, checkpoint: str, schema: str = SAMPLE, once: bool = True) -> StreamingQuery:
    """Appends parsed samples as JSON lines below ``out``, rejects below ``out``-rejects, exactly once
    for a batch: a batch that is run again overwrites its own folder."""

    def store(batch: DataFrame, number: int) -> None:
        samples, rejects = samples_and_rejects(stored(with_samples(batch, schema), "responses"), schema)  # parsed once
        samples.write.mode("overwrite").json(f"{out}/batch={number}")
        rejects.write.mode("overwrite").json(f"{out}-rejects/batch={number}")

    writer = responses.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def for_each_batch(stream: DataFrame, call: Callable[[DataFrame], None], checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Calls a function with each micro-batch, on an interval or once for all that is there."""
    writer = stream.writeStream.foreachBatch(lambda batch, _: call(batch)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def label_counts(stream: DataFrame, label: str = "label") -> DataFrame:
    """Running (label, n); for update or complete mode."""
    return stream.groupBy(F.coalesce(F.col(label), F.lit("__unknown__")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def first_seen_within(stream: DataFrame, key: str, event_time: str, delay: str = "1 hour") -> DataFrame:
    """The first row of each trimmed key, repeats being at most ``delay`` of event time apart; the state holds
    the keys of that span. Streams without an event time: ``stateful.first_seen``."""
    return stream.withColumn("_key", trim_u(F.col(key))).withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["_key"]).drop("_key")
