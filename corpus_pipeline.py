"""Documents to training data in five stages; each stage reads what the one before it wrote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowmill.llm import exact_dedup, mixing, ngram_join, pieces, quality_rules
from sparrowmill.llm.storage import materialize

#: Row keys that may be broadcast; more go through a shuffle join.
BROADCAST_IDS = 1_000_000


def row_key(digest: Column, *columns: Column) -> Column:
    """128 bits of a row's text digest and other values; null is a value of its own."""
    marked = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("")) for c in columns]
    return F.substring(F.unhex(F.sha2(F.concat_ws("\0", digest, *marked), 256)), 1, 16)


def text_digest(text: Column) -> Column:
    """Hexadecimal digest of a text; null counts as empty."""
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)


def _few(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys


def without(docs: DataFrame, rows: DataFrame, key: Column, name: str) -> DataFrame:
    """``docs`` without the rows whose ``key`` is a pipeline_key in ``rows``."""
    gone = materialize(rows.select("pipeline_key").distinct(), f"pipeline-{name}")
    return docs.withColumn("pipeline_key", key).join(_few(gone), "pipeline_key", "left_anti").select(*docs.columns)


def once(docs: DataFrame, rows: DataFrame, key: Column, name: str) -> DataFrame:
    """``docs`` with one row for each pipeline_key that ``rows`` repeats; other rows stay as they are."""
    again = materialize(rows.groupBy("pipeline_key").count().where("count > 1").select("pipeline_key"), f"pipeline-{name}")
    if again.isEmpty():
        return docs
    repeats = docs.withColumn("pipeline_key", key).join(_few(again), "pipeline_key", "left_semi").dropDuplicates(["pipeline_key"])
    return without(docs, again, key, f"{name}-left").unionByName(repeats.select(*docs.columns))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    # The verdict depends on the text, the stratum (lang) and the id's labels.
    key = row_key(text_digest(F.col("text")), F.col("doc_id"), F.col("lang"))
    judged = quality_rules.judge_quality(docs.withColumn("pipeline_key", key), labels, carry=["pipeline_key"])
    return without(docs, judged.where("not kept"), key, "rejected")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays; of several such rows one."""
    judged = exact_dedup.exact_duplicates(docs).select(row_key(F.col("text_sha256"), F.col("doc_id")).alias("pipeline_key"), "kept")
    judged = materialize(judged, "pipeline-exact")
    key = row_key(F.sha2(exact_dedup.normalised("text"), 256), F.col("doc_id"))
    return once(without(docs, judged.where("not kept"), key, "copies"), judged.where("kept"), key, "repeats")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by links the one with the smallest doc_id stays (null is the largest), of several such rows the one with the least digest."""
    # Rows go by their key, so that rows of one id, or of none, are told apart.
    digest = text_digest(F.col("text"))
    key = F.hex(row_key(digest, F.col("doc_id")))
    judged = ngram_join.near_duplicates(docs.select(key.alias("pipeline_key"), "text"), doc_id="pipeline_key")
    judged = materialize(judged.withColumnRenamed("doc_id", "pipeline_key"), "pipeline-near")
    linked = judged.where("pipeline_key != component_id").select("pipeline_key", "component_id")
    linked = materialize(linked.unionByName(linked.select(F.col("component_id").alias("pipeline_key"), "component_id")).distinct(), "pipeline-linked")
    ranked = docs.select(key.alias("pipeline_key"), F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", digest.alias("digest")).alias("place"))
    ranked = materialize(ranked.join(_few(linked), "pipeline_key"), "pipeline-places")
    first = ranked.groupBy("component_id").agg(F.min("place").alias("first"))
    left = without(docs, ranked.join(first, "component_id").where("place != first"), key, "near-copies")
    return once(left, judged.where("n_shingles > 0"), key, "near-repeats")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources are repeated towards an even mixture, twice at most; nothing is lost."""
    mixed = mixing.mix_sources(docs, mixing.word_count("text"), repeats=mixing.MOST_REPEATS)
    return mixed.select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, and the digest of the text that they decode to."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    coded = pieces.decode_pieces(materialize(pieces.encode_pieces(docs, path), "pipeline-pieces"), path)
    return coded.select("doc_id", "lang", "source", "n_ids", "ids", F.sha2("text", 256).alias("text_sha256"))


STAGES = [
    ("quality rules", drop_low_quality),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("source mixing", mix_sources),
    ("SentencePiece", encode_pieces),
]

#: The cutoffs of the first stage and the model of the last are beyond SQL; the tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
