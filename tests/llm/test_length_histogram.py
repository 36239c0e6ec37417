from collections import Counter

import public_tokenizers
from pyspark.sql import functions as F

from sparrowmill.llm import length_histogram as h
from sparrowmill.llm.word_codec import codec

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, lengths):
    counts = Counter(lengths)
    assert {r.n_tokens: r.n_docs for r in rows} == counts
    for r in rows:
        over = [x for x in lengths if x > r.n_tokens]
        assert (r.docs_over, r.tokens_over) == (len(over), sum(over))
        assert r.truncated_tokens == sum(min(x, r.n_tokens) for x in lengths)
        assert (r.docs_total, r.tokens_total) == (len(lengths), sum(lengths))
        assert abs(r.share_within - (1 - len(over) / len(lengths))) < 1e-12


def test_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.001"
    lengths = [len(codec(PATH).ids(r.text or "")) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    check(h.query(spark, d).collect(), lengths)


def test_groups_limits_odd_rows_and_empty(spark, odd_docs):
    counted = h.with_token_counts(odd_docs, PATH)
    by_lang = {lang: [len(codec(PATH).ids(r.text or "")) for r in odd_docs.collect() if r.lang == lang] for lang in ("en", "de", None)}
    answers = h.limit_answers(h.length_histogram(counted, by=["lang"]), ["lang"])
    for lang, lengths in by_lang.items():
        check(answers.where(F.col("lang").eqNullSafe(F.lit(lang))).collect(), lengths)
    limits = spark.createDataFrame([(lang, x) for x in (0, 1, 7, 10**6) for lang in ("en", "de", None, "xx")], "lang string, limit long")
    found = h.at_limits(answers, limits, ["lang"]).collect()
    assert len(found) == 12
    for r in found:
        lengths = by_lang[r.lang]
        assert (r.docs_over, r.truncated_tokens) == (sum(x > r.limit for x in lengths), sum(min(x, r.limit) for x in lengths))
    whole = h.limit_answers(h.length_histogram(counted))
    every = [x for lengths in by_lang.values() for x in lengths]
    assert sorted(map(tuple, h.at_limits(whole, limits.select("limit").distinct()).collect())) == [(x, sum(n > x for n in every), sum(min(n, x) for n in every)) for x in (0, 1, 7, 10**6)]
    assert h.limit_answers(h.length_histogram(h.with_token_counts(odd_docs.limit(0), PATH))).count() == 0
