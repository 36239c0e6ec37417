"""Token counts as an exact histogram of encoded lengths.

Documents are aggregated by their number of ids, so what follows depends on the number of distinct
lengths only. Suffix sums over the histogram answer, for every context limit, how many documents
and ids lie above it and what is left when texts are cut there; quantiles come from the same sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparrowmill.llm.storage import giving_back, materialize, sliced
from sparrowmill.llm.word_codec import codec
from sparrowmill.llm.words import SCAN_BYTES

#: Neighbouring lengths that are summed before the sums of all such ranges are.
RANGE = 512


def with_token_counts(docs: DataFrame, tokenizer: str, text: str = "text", name: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of ids (long) in place of the text; null counts as empty, 0."""
    others = [c for c in docs.columns if c not in (text, name)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer)
        for batch in sliced(batches, text, SCAN_BYTES):
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in others} | {name: pa.array(own.count(batch.column(text)))})

    return docs.select(*others, F.col(text).cast("string").alias(text)).mapInArrow(giving_back(count), docs.select(*others).withColumn(name, F.lit(0).cast("long")).schema)


def length_histogram(counted: DataFrame, length: str = "n_tokens", by: list[str] | None = None) -> DataFrame:
    """(*by, n_tokens, n_docs) of rows with a length column; a null length counts as 0."""
    return counted.groupBy(*(by or []), F.coalesce(F.col(length), F.lit(0)).cast("long").alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs"))


def limit_answers(histogram: DataFrame, by: list[str] | None = None) -> DataFrame:
    """For each length of the histogram, taken as a context limit:

    docs_over and tokens_over (documents longer than the limit and all their ids), truncated_tokens
    (ids left when every text is cut at the limit), docs_total, tokens_total, and share_within (the
    share of documents within the limit, so the q-quantile of lengths is the least limit with
    share_within >= q). ``by`` names columns that part the histogram. Empty in, empty out.
    """
    by = by or []
    h = histogram.withColumn("range", F.floor(F.col("n_tokens") / RANGE))
    sums = h.groupBy(*by, "range").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    # Ranges are few (the longest text over RANGE), lengths within one are RANGE at most.
    above = Window.partitionBy(*by).orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy(*by)
    zero = F.lit(0).cast("long")
    sums = sums.select(*by, "range", F.coalesce(F.sum("d").over(above), zero).alias("d_above"), F.coalesce(F.sum("t").over(above), zero).alias("t_above"), F.sum("d").over(total).alias("docs_total"), F.sum("t").over(total).alias("tokens_total"))
    over = Window.partitionBy(*by, "range").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    h = h.select("*", F.coalesce(F.sum("n_docs").over(over), zero).alias("d_near"), F.coalesce(F.sum(F.col("n_docs") * F.col("n_tokens")).over(over), zero).alias("t_near"))
    on = [F.col(f"h.{c}").eqNullSafe(F.col(f"s.{c}")) for c in by] + [F.col("h.range") == F.col("s.range")]
    both = h.alias("h").join(sums.alias("s"), on)
    docs_over, tokens_over = F.col("d_above") + F.col("d_near"), F.col("t_above") + F.col("t_near")
    return both.select(
        *[F.col(f"h.{c}").alias(c) for c in by], "n_tokens", "n_docs", docs_over.alias("docs_over"), tokens_over.alias("tokens_over"),
        (F.col("tokens_total") - tokens_over + docs_over * F.col("n_tokens")).alias("truncated_tokens"), "docs_total", "tokens_total",
        ((F.col("docs_total") - docs_over) / F.col("docs_total")).alias("share_within"),
    )


def at_limits(answers: DataFrame, limits: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(*by, limit, docs_over, truncated_tokens) for any limits: (*by, limit), limit a long.

    A limit between two lengths has the documents over it of the longest length within it; below the
    shortest length every document is over it. Limits are looked up in the sorted histogram; limits
    of a group without documents get no row.
    """
    by = by or []
    known = answers.select(*by, F.col("n_tokens").alias("limit"), F.lit(False).alias("asked"), "docs_over", "tokens_over", "docs_total", "tokens_total")
    both = known.unionByName(limits.select(*by, F.col("limit").cast("long"), F.lit(True).alias("asked")), allowMissingColumns=True)
    upto, group = Window.partitionBy(*by).orderBy("limit", "asked"), Window.partitionBy(*by)
    both = both.select(*by, "limit", "asked", F.last("docs_over", True).over(upto).alias("d"), F.last("tokens_over", True).over(upto).alias("t"), F.max("docs_total").over(group).alias("all"), F.max("tokens_total").over(group).alias("whole"))
    d, t = F.coalesce("d", "all"), F.coalesce("t", "whole")
    return both.where("asked and all is not null").select(*by, "limit", d.alias("docs_over"), (F.col("whole") - t + d * F.col("limit")).alias("truncated_tokens"))


NAME, SQL = "op6_length_histogram", None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text")
    counted = with_token_counts(docs, public_tokenizers.path("word_bpe_49k.json"))
    return limit_answers(materialize(length_histogram(counted), "length-histogram"))
