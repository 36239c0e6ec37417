import pytest


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{shared}").config("spark.sql.mapKeyDedupPolicy", "LAST_WIN").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeats and ties, and columns whose names operators use inside."""
    long = " ".join(f"wörd{i % 977}" for i in range(30_000))
    rows = [
        (1, "Same Text here", "en", "a"), (2, "same text HERE", "en", "a"), (3, None, None, None), (4, "", "en", "a"), (5, "   \n\t ", "en", "b"), (6, long, "de", "b"), (7, long, "de", "b"),
        (8, "ÄÖ äö İ ſ", "de", "c"), (8, "äö äö İ ſ", "de", "c"), (9, "one two three four five six seven eight " * 4, "en", "c"), (9, "one two three four five six seven eight " * 4, "en", "c"),
        (10, "x # $ % <b>\nx # $ % <b>\n\n  \nx # $ % <b>", None, "c"), (None, "no id", "en", "a"), (None, "no id", "en", "a"), (11, "<|endoftext|> a<|im_end|>b▁c   　 end", "en", "a"),
    ]
    df = spark.createDataFrame([(*r, None) for r in rows], DOCS)
    return df.selectExpr("*", "1 AS shard", "'z' AS fingerprint", "2.5 AS part", "'n' AS norm", "0 AS kept", "'k' AS key")
