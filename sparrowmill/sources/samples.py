"""Readers that tolerate bad rows, and writers of corpora."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparrowmill.operators.shards import latest_iteration
from sparrowmill.sources.arrays import array_elements, array_files, numbered_elements, probed_files

CORE = "instruction string, input string, output string"
#: Names of array files that may be broadcast; more are joined by shuffle.
BROADCAST_FILES = 100_000
PRODUCT = "company string, category string, series string, sub_series string, name string, alias array<string>, positioning array<string>, talking_points array<string>, generation string, price string, status string"


def _line(argument: int = 0) -> Column:
    """A struct that sorts lines in the order of arguments, files and lines in a file.

    Spark packs parts of files into tasks by size, so a row number over tasks is no order of lines;
    within one part of one file it is.
    """
    return F.struct(F.lit(argument).alias("argument"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("place"))


def undeclared(row: Column, schema: str) -> Column:
    """map<string, variant> of the fields of a VARIANT object that a DDL schema does not name."""
    names = [f.name for f in StructType.fromDDL(schema)]
    return F.map_filter(F.try_variant_get(row, "$", "map<string,variant>"), lambda k, _: ~k.isin(*names))


def json_lines(spark: SparkSession, path: str | list[str], schema: str, meta: str | None = None) -> DataFrame:
    """The fields of ``schema``, _file, _path and _line of each line that is a JSON object; others are left out.

    ``meta`` names a column for the fields that the schema does not name, as in ``undeclared``.
    """
    parsed = F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    rest = [undeclared(F.try_parse_json("value"), schema).alias(meta)] if meta else []
    rows = spark.read.text(path).where(F.trim("value").startswith("{")).select(parsed.alias("j"), *rest, F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_path").alias("_path"), _line().alias("_line"))
    return rows.where("j._bad is null").select("j.*", *([meta] if meta else []), "_file", "_path", "_line").drop("_bad")


def read_samples(spark: SparkSession, path: str, extra: str = "", meta: str | None = None) -> DataFrame:
    """Instruction rows of files of JSON lines or with one JSON array each; blank and bad lines are left out.

    ``extra`` is DDL of further columns; ``meta`` names a map<string, variant> of all fields that nobody
    declared, which ``by_group`` can group by. The data column ``_file`` names the file. Arrays are cut
    by many tasks and their elements parsed one by one; null gives a row of nulls. A bad array, or a path without a row, is an error.
    """
    schema = CORE + (f", {extra}" if extra else "")
    files = probed_files(spark, path)
    arrays, n = files.where("head is not null").drop("filled"), files.agg(F.count("head").alias("arrays"), F.count_if("filled").alias("filled"), F.count(F.lit(1)).alias("all")).first()
    rows = json_lines(spark, path, schema, meta).drop("_line")
    if n.arrays:
        names = arrays.select(F.col("path").alias("_path"))
        rows = rows.join(F.broadcast(names) if n.arrays <= BROADCAST_FILES else names, "_path", "left_anti")
        each = array_elements(arrays).withColumnRenamed("name", "_file")
        if meta:
            each = each.select(F.parse_json("value").alias("v"), "_file")
            fields = [F.try_variant_get("v", f"$['{f.name}']", f.dataType.simpleString()).alias(f.name) for f in StructType.fromDDL(schema)]
            each = each.select(*fields, undeclared(F.col("v"), schema).alias(meta), "_file")
        else:
            each = each.select(F.from_json(F.nullif("value", F.lit("null")), schema, {"mode": "FAILFAST"}).alias("j"), "_file").select("j.*", "_file")
        # Where all files are arrays there are no lines to read.
        rows = rows.drop("_path").unionByName(each) if n.arrays < n.all else each
    else:
        rows = rows.drop("_path")
    if not n.filled and not rows.take(1):
        raise ValueError(f"no samples in {path}")
    return rows


def count_unanswered(samples: DataFrame) -> DataFrame:
    """One row: samples, and those without an output."""
    return samples.agg(F.count(F.lit(1)).alias("samples"), F.count_if(F.col("output").isNull()).alias("unanswered"))


def read_products(spark: SparkSession, path: str) -> DataFrame:
    """Products of files with a JSON array each, with ord, the place in the array; files that hold no array are left out."""
    rows = numbered_elements(array_files(spark, path)).select(F.from_json("value", PRODUCT).alias("p"), "ord")
    return rows.select("p.*", "ord")


def read_seeds(spark: SparkSession, path: str, labels: tuple[str, ...] = ("sarcasm_label", "label")) -> DataFrame:
    """(label, text, line) of seed rows; the label is the first field that is there, else empty, and line sorts them in file order."""
    fields = ", ".join(f"{c} string" for c in dict.fromkeys([*labels, "text"]))
    return json_lines(spark, path, fields).select(F.coalesce(*labels, F.lit("")).alias("label"), "text", F.col("_line").alias("line"))


def read_qa(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, line, instruction, output) of JSON lines that hold both fields; line sorts them in the
    order of the arguments, and of the lines of a file."""
    parsed = F.from_json("value", "instruction string, output string").alias("q")
    each = [spark.read.text(p).select(F.col("_metadata.file_name").alias("file"), _line(i).alias("line"), parsed) for i, p in enumerate(paths)]
    return reduce(DataFrame.unionByName, each).where("q.instruction is not null and q.output is not null").select("file", "line", "q.instruction", "q.output")


def seed_prompt_rows(types: DataFrame, slots: dict[str, str]) -> DataFrame:
    """(type, instruction, output) of rows (type, seed_prompts array): one for each prompt, {slots}
    filled and the output empty."""
    from sparrowmill.operators.generators import fill

    known = F.create_map(*[F.lit(x) for kv in slots.items() for x in kv]) if slots else F.create_map().cast("map<string,string>")
    return types.select("type", F.explode("seed_prompts").alias("t")).select("type", fill(F.col("t"), known).alias("instruction"), F.lit("").alias("output"))


def read_params(spark: SparkSession, path: str) -> DataFrame:
    """A long parameter table (tensor, row, col, pos, value) with values as doubles."""
    return spark.read.parquet(path).withColumn("value", F.col("value").cast("double"))


def read_shards(spark: SparkSession, path: str, iteration: int | None = None) -> DataFrame:
    """Rows of the shards below ``iteration=N/rank=N`` folders, or below ``rank=N`` folders alone.

    Of several iterations one is read, the latest by default; other folders are pruned. No shard is an error.
    """
    rows = spark.read.parquet(path)
    rows = latest_iteration(rows, iteration) if "iteration" in rows.columns else rows
    if rows.isEmpty():
        raise ValueError(f"no shards in {path}" + ("" if iteration is None else f" of iteration {iteration}"))
    return rows


def save_delta(delta: DataFrame, path: str) -> None:
    delta.write.mode("overwrite").partitionBy("task").parquet(path)


def load_delta(spark: SparkSession, path: str, *tasks: str) -> DataFrame:
    """Deltas of some tasks (all by default); other tasks' folders are not read."""
    rows = spark.read.parquet(path)
    return rows.where(F.col("task").isin(*tasks)) if tasks else rows


def save_bucketed(params: DataFrame, table: str, buckets: int = 200) -> None:
    """Stores a parameter table or delta as a table of the catalog, in sorted buckets of (tensor, pos).

    Two tables with as many buckets are joined bucket by bucket, without a shuffle, whatever is compared.
    """
    params.repartition(buckets, "tensor", "pos").write.mode("overwrite").bucketBy(buckets, "tensor", "pos").sortBy("tensor", "pos").saveAsTable(table)


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """(run, line, text) of log files; a run is a file, and line sorts its lines."""
    return spark.read.text(path).select(F.col("_metadata.file_name").alias("run"), _line().alias("line"), F.col("value").alias("text"))


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_corpus(df: DataFrame, path: str) -> None:
    """Overwrites a folder of JSON lines; columns keep their order."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_evaluation(scored: DataFrame, summary: DataFrame, path: str) -> None:
    """Row results and the summary document, side by side below ``path``."""
    scored.write.mode("overwrite").json(f"{path}/rows")
    summary.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(f"{path}/summary")
