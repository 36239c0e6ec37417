import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sparrowmill.llm import mixing as m

DATA = "/root/testdata/sf0.001"


def brute(rows, keys, exponent, use, totals):
    """Copies {(doc_id, epoch): count}; rows are (doc_id, source, tokens), keys[(doc_id, epoch)] the permuted order."""
    z = sum(t**exponent for t in totals.values() if t)
    out = defaultdict(int)
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    for s, own in by.items():
        runs = round(totals[s] ** exponent / z * use / totals[s], 9) if totals[s] else 1.0
        full = math.floor(runs)
        for e in range(full):
            for r in own:
                out[r[0], e] += 1
        rest, held = (runs - full) * totals[s], 0
        if runs > full and totals[s]:
            for key in sorted({keys[r[0], full] for r in own}):
                same = [r for r in own if keys[r[0], full] == key]
                held += sum(r[2] for r in same)
                if held > rest:
                    break
                for r in same:
                    out[r[0], full] += 1
    return dict(out)


@pytest.mark.parametrize("budget", [None, 30_000])
def test_query_rows_equal_brute_force(spark, budget, monkeypatch):
    monkeypatch.setattr(m, "RANGE_DOCS", 3)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 3 == 0, F.lit("src0")).otherwise(F.col("source")))
    mixed = m.mix_sources(docs, m.word_count("text"), repeats=2.0, budget=budget)
    got = defaultdict(int)
    for r in mixed.select("doc_id", "mix_epoch").collect():
        got[r.doc_id, r.mix_epoch] += 1
    rows = [tuple(r) for r in docs.select("doc_id", "source", m.word_count("text")).collect()]
    totals = defaultdict(int)
    for _, s, t in rows:
        totals[s] += t
    epochs = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("e"))
    keys = {(r.doc_id, r.e): r.k for r in epochs.select("doc_id", "e", m.permuted_key(17, F.col("e"), "doc_id").alias("k")).collect()}
    top = max(totals.values())
    spread = lambda t: (min(totals.values()) / top) ** (t - 1)
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if spread(mid) <= 2.0 else (mid, high)
    exponent = high if spread(0.0) > 2.0 else 0.0
    use = budget or top ** (1 - exponent) * sum(t**exponent for t in totals.values())
    want = brute(rows, keys, exponent, use, totals)
    differ = {k for k in set(got) | set(want) if got.get(k) != want.get(k)}
    assert len(differ) <= 2  # the exponents agree to nine digits, so a document at the very end of a budget may differ
    spent = defaultdict(int)
    for r in mixed.collect():
        spent[r.source] += r.mix_tokens
    if budget is None:
        assert {d for d, _ in got} == {r[0] for r in rows}
        assert max(spent[s] / totals[s] for s in totals) <= 2.0 + 1e-9
    else:
        assert sum(spent.values()) <= budget


def test_entropy_target(spark):
    docs = spark.createDataFrame([(i, s, "w " * 20) for i, s in enumerate(["a"] * 600 + ["b"] * 90 + ["c"] * 30)], "doc_id long, source string, text string")
    spent = defaultdict(int)
    for r in m.mix_sources(docs, m.word_count("text"), entropy=0.9).collect():
        spent[r.source] += r.mix_tokens
    total = sum(spent.values())
    assert abs(-sum(v / total * math.log(v / total) for v in spent.values()) - 0.9) < 0.02


def test_blocks_hold_the_sources_in_proportion(spark):
    docs = spark.createDataFrame([(i, "a" if i % 3 else "b", "w " * 10) for i in range(6000)], "doc_id long, source string, text string")
    rows = m.mix_sources(docs, m.word_count("text"), repeats=1.5, block_tokens=6000).groupBy("mix_block").pivot("source").count().collect()
    assert len(rows) > 5
    assert all(0.5 < (r.a or 0) / r.b / (4000 / 3000) < 2 for r in rows)


def test_odd_rows_and_empty(spark, odd_docs):
    out = m.mix_sources(odd_docs, m.word_count("text"), repeats=2.0)
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in odd_docs.collect()}
    assert [c for c in out.columns if not c.startswith("mix_")] == odd_docs.columns
    assert m.mix_sources(odd_docs.limit(0), m.word_count("text"), repeats=2.0).count() == 0
    empty = odd_docs.withColumn("text", F.lit(""))
    assert m.mix_sources(empty, m.word_count("text"), repeats=2.0).count() == odd_docs.count()
    with pytest.raises(ValueError):
        m.mix_sources(odd_docs, m.word_count("text"))


def test_sources_with_null_tokens_are_used_once(spark):
    docs = spark.createDataFrame([(1, "a", 5), (2, "a", None), (3, "b", None), (4, "b", None), (5, "c", 9)], "doc_id long, source string, n int")
    rows = m.mix_sources(docs, F.col("n"), repeats=1.0).collect()
    assert sorted(r.doc_id for r in rows) == [1, 2, 3, 4, 5] and sorted(r.mix_tokens for r in rows) == [0, 0, 0, 5, 9]
    assert sorted(r.doc_id for r in m.mix_sources(docs.where("source = 'b'"), F.col("n"), repeats=1.0).collect()) == [3, 4]
