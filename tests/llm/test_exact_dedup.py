import hashlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparrowmill.llm import exact_dedup as e

UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(UPPER)].append(i)
    out = []
    for i, t in rows:
        norm = (t or "").translate(UPPER)
        keep = max((x for x in groups[norm] if x is not None), default=None)
        out.append((i, keep, len(groups[norm]), i == keep, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_odd_rows_and_empty(spark, odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert sorted(map(tuple, e.exact_duplicates(odd_docs).collect()), key=repr) == brute(rows)
    assert e.exact_duplicates(odd_docs.limit(0)).count() == 0


def test_hot_group_ranges_and_shuffle_join(spark, monkeypatch):
    monkeypatch.setattr(e, "RANGE_KEYS", 50)
    monkeypatch.setattr(e, "BROADCAST_KEYS", 0)
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "Hot Text").otherwise(F.concat(F.lit("t"), F.floor(F.col("id") / 5).cast("string"))).alias("text")).repartition(7)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert sorted(map(tuple, e.exact_duplicates(df).collect()), key=repr) == brute(rows)


def test_equal_fingerprints_of_different_texts_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    rows = [(1, "a"), (2, "b"), (3, "A"), (4, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, e.exact_duplicates(df).collect()), key=repr) == brute(rows)


prints = st.lists(st.integers(0, (1 << 64) - 1) | st.integers(0, 5) | st.integers((1 << 64) - 4, (1 << 64) - 1), max_size=400)


@settings(max_examples=60, deadline=None)
@given(prints, prints, st.integers(3, 12))
def test_filters_merge_without_loss(a, b, bits):
    build = lambda x: e.QuotientFilter.from_bytes(e.QuotientFilter.build(bits, np.array(x, np.uint64)).to_bytes())
    merged = build(a).merge(build(b))
    values, counts = np.unique(np.array(a + b, np.uint64), return_counts=True)
    assert (merged.prints() == values).all() and (merged.counts == counts).all()
    again = e.QuotientFilter.from_bytes(merged.to_bytes())
    assert (again.prints() == values).all() and (again.counts == counts).all()


def test_large_counts_survive():
    f = e.QuotientFilter.from_bytes(e.QuotientFilter.build(4, np.full(100_000, 9, np.uint64)).to_bytes())
    assert f.counts.tolist() == [100_000] and f.prints().tolist() == [9]


@settings(max_examples=40, deadline=None)
@given(st.lists(prints, min_size=1, max_size=12))
def test_many_filters_merge_as_a_tree(parts):
    merging = e.Merging()
    for part in parts:
        merging.add(e.QuotientFilter.build(5, np.array(part, np.uint64)))
        assert len(merging.waiting) <= 12
    total = merging.total()
    values, counts = np.unique(np.array([x for part in parts for x in part], np.uint64), return_counts=True)
    assert (total.prints() == values).all() and (total.counts == counts).all()


def test_pieces_merge_in_steps(spark):
    assert e.range_steps(0) == [0] and e.range_steps(8) == [8] and e.range_steps(19) == [8, 16, 19]
    rng = np.random.default_rng(5)
    values = np.r_[rng.integers(-(1 << 63), 1 << 63, 400), rng.integers(-(1 << 63), 1 << 63, 90).repeat(3), np.full(300, -1), np.full(2, 0)]
    df = spark.createDataFrame([(int(x),) for x in values] + [(None,)], "p long").repartition(9)
    brute = {int(x): int(n) for x, n in zip(*np.unique(values, return_counts=True), strict=True) if n > 1}
    for bits, step in ((0, 8), (3, 8), (7, 2), (6, 3)):
        got = e.repeated_fingerprints(df, "p", bits, step)
        assert {r.fingerprint: r.copies for r in got.collect()} == brute
        assert got.count() == len(brute)
    assert e.repeated_fingerprints(df.where("p is null"), "p", 5, 2).count() == 0
