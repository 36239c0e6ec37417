"""Streams over the driver's tables: all that is there, in several micro-batches, then the result as a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowmill.functions.text import trim_u
from sparrowmill.queries.tables import registry, table
from sparrowmill.sources.shared import shared_folder
from sparrowmill.streaming import ingest, stateful

QUERIES, query = registry()
#: Files that a table is written to before it is streamed, and files of a micro-batch, at least.
FILES, FILES_AT_ONCE = 6, 2


def files_at_once(spark: SparkSession) -> int:
    """Files of a micro-batch: one for each core, so that all take part in each."""
    return max(FILES_AT_ONCE, spark.sparkContext.defaultParallelism)


def streamed(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a stream of the files it was written to."""
    path, files = shared_folder(df.sparkSession, name), files_at_once(df.sparkSession)
    df.repartition(FILES // FILES_AT_ONCE * files).write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


def run_out(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """What a stream has put out when all its input is used: all rows, or in complete mode the last state."""
    spark, out = stream.sparkSession, shared_folder(stream.sparkSession, name)

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/last" if mode == "complete" else f"{out}/batch={number}")

    writer = stream.writeStream.foreachBatch(store).outputMode(mode).option("checkpointLocation", f"{out}-checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/last" if mode == "complete" else out).select(*stream.columns)


@query("SELECT coalesce(lang, '__unknown__') AS label, count(*) AS n FROM documents GROUP BY 1")
def stream_label_counts(spark: SparkSession, sf: str) -> DataFrame:
    stream = streamed(table(spark, sf, "documents").select("doc_id", "lang"), "stream-labels")
    return run_out(ingest.label_counts(stream, "lang"), "stream-counts", "complete")


def in_slices(df: DataFrame, order: str, name: str) -> DataFrame:
    """``df`` as a stream of slices that follow one another in a number column; each micro-batch is one slice."""
    spark, path, files = df.sparkSession, shared_folder(df.sparkSession, name), files_at_once(df.sparkSession)
    low, high = df.agg(F.min(order), F.max(order)).first()
    slices = FILES // FILES_AT_ONCE
    at = F.floor((F.col(order) - F.lit(low)) * slices / F.lit((high or 0) - (low or 0) + 1))
    for i in range(slices):  # files are streamed by their time of writing
        df.where(at == i).repartition(files).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


@query(r"""SELECT min(doc_id) AS doc_id FROM documents GROUP BY regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')""")
def stream_first_seen(spark: SparkSession, sf: str) -> DataFrame:
    """Which document of each text is kept when documents come in the order of their ids."""
    stateful.with_state_store(spark)
    docs = table(spark, sf, "documents").select("doc_id", F.md5(trim_u(F.coalesce("text", F.lit("")))).alias("digest"))
    rows = run_out(stateful.first_seen(in_slices(docs, "doc_id", "stream-texts"), "digest", ["doc_id"]), "stream-firsts", "append")
    return rows.select("doc_id")


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents WHERE source IS NOT NULL) WHERE n <= 30")
def stream_hard_quota(spark: SparkSession, sf: str) -> DataFrame:
    """Which documents fill the quota of their source when documents come in the order of their ids."""
    stateful.with_state_store(spark)
    docs = table(spark, sf, "documents").where("source is not null").select("doc_id", "source")
    return run_out(stateful.capped(in_slices(docs, "doc_id", "stream-sources"), "source", {}, default=30, order=["doc_id"]), "stream-quota", "append")


@query(r"""WITH a AS (SELECT CAST(user_id % 16 AS VARCHAR) AS run, CAST(user_id AS VARCHAR) AS task, regexp_extract(props, '(\d)\D*$', 1) AS step, event_type <> 'error' AS ok, event_id FROM events),
s AS (SELECT run, task, step, count(*) AS tries, count(*) FILTER (ok) AS good, arg_max(ok, event_id) AS fine FROM a GROUP BY ALL)
SELECT run, task, count(*) AS steps, CAST(sum(tries) AS BIGINT) AS attempts, CAST(sum(good) AS BIGINT) AS passes, CAST(sum(tries - good) AS BIGINT) AS failures, count(*) FILTER (NOT fine) AS exhausted, CASE WHEN count(*) FILTER (NOT fine) > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM s GROUP BY run, task""")
def stream_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Every event as a heading and an attempt in the raw log of one of 16 runs; lines arrive up to half a day late."""
    stateful.with_state_store(spark)
    task = F.concat(F.lit("── TASK: "), F.col("user_id").cast("string"), F.lit(" ──────"))
    attempt = F.concat(F.lit("[10:00:00] "), F.when(F.col("event_type") == "error", "FAIL").otherwise("PASS"), F.lit(" step "), F.regexp_extract("props", r"(\d)\D*$", 1))
    lines = table(spark, sf, "events").select((F.col("user_id") % 16).cast("string").alias("run"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.posexplode(F.array(task, attempt)).alias("part", "text"))
    late = F.pmod(F.xxhash64("event_id", "part"), F.lit(43_200))
    lines = lines.select("run", (F.col("event_id") * 2 + F.col("part")).alias("line"), "text", F.col("ts").alias("at"), (F.unix_seconds("ts") + late).alias("arrives"))
    return stateful.newest(run_out(stateful.live_rollup(in_slices(lines, "arrives", "stream-lines"), "at", "1 day"), "stream-rollup", "update"))


@query("""SELECT 'r' AS request_label, concat('t', CAST(event_id AS VARCHAR)) AS text FROM events WHERE event_id % 3 < 2
UNION ALL SELECT 'rejected', CAST(count(*) AS VARCHAR) FROM events WHERE event_id % 3 = 2""")
def stream_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Every event as a response: an array in a fence, an object with samples, or a text that holds none."""
    made = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n[{\"text\": \"t"), F.col("event_id").cast("string"), F.lit("\"}]\n```")))
    made = made.when(F.col("event_id") % 3 == 1, F.concat(F.lit("{\"samples\": [{\"text\": \"t"), F.col("event_id").cast("string"), F.lit("\"}]}"))).otherwise("nothing to see")
    stream = streamed(table(spark, sf, "events").select(F.lit("r").alias("label"), made.alias("content")), "stream-responses")
    out = shared_folder(spark, "stream-samples")
    ingest.ingest(stream, out, f"{out}-checkpoint").awaitTermination()
    samples = spark.read.schema("request_label string, text string").json(out).select("request_label", "text")
    rejects = spark.read.schema("label string, error string").json(f"{out}-rejects").agg(F.count(F.lit(1)).cast("string").alias("text"))
    return samples.unionByName(rejects.select(F.lit("rejected").alias("request_label"), "text"))
