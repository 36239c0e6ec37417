from itertools import permutations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparrowmill.llm import filter_audit as a
from sparrowmill.llm.filter_audit import audit_filters, text_filters

LABELS = "doc_id long, quality int, toxic int"
ids = st.lists(st.integers(0, 3000), unique=True).map(lambda x: np.array(sorted(x), np.int64))


@settings(max_examples=150, deadline=None)
@given(ids, ids, st.integers(1, 9))
def test_galloping_merges(x, y, block):
    a.BLOCK, kept = block, a.BLOCK
    try:
        assert a.union(x, y).tolist() == sorted({*x} | {*y})
        assert a.difference(x, y).tolist() == sorted({*x} - {*y})
        assert a.common(x, y) == len({*x} & {*y})
    finally:
        a.BLOCK = kept


def brute(docs, labels):
    """(doc_id, text, part) rows -> the report, order by order on sets of rows."""
    import re

    text = [t or "" for _, t, _ in docs]
    words = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in text]
    least = {}
    for (i, _, _), t in zip(docs, text, strict=True):
        if i is not None:
            least[t] = min(i, least.get(t, i))
    fails = {
        "A": [len(w) < 200 for w in words], "B": [100 * len(set(w)) < 50 * len(w) for w in words], "C": [100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t) for t in text],
        "D": [any(c in "#$%&*|" for c in t) for t in text], "E": [t in least and (i is None or least[t] < i) for (i, _, _), t in zip(docs, text, strict=True)],
    }
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    out = set()
    for part in {p or "" for *_, p in docs}:
        own = {n for n, (*_, p) in enumerate(docs) if (p or "") == part}
        sets = {f: {n for n in own if v[n]} for f, v in fails.items()}
        rows, shapley = [], dict.fromkeys(sets, 0)
        for order in permutations("ABCDE"):
            gone = set()
            for step, f in enumerate(order, 1):
                new = sets[f] - gone
                alone = sets[f] - set().union(*(sets[g] for g in sets if g != f))
                shapley[f] += len(new)
                rows.append([part, "".join(order), step, len(own - gone - new), len(new), len(sets[f] & gone), len(alone), sum(docs[n][0] in good for n in new), sum(docs[n][0] in toxic for n in new), f])
                gone |= new
        out |= {(*r[:-1], shapley[r[-1]]) for r in rows}
    return out


def report(docs, labels):
    return {tuple(r) for r in audit_filters(docs, text_filters(), labels, {"good_lost": F.col("quality") == 1, "toxic_lost": F.col("toxic") == 1}, repeats="E").collect()}


def test_odd_rows_and_empty(spark, odd_docs):
    rows = [(1, 1, 0), (2, 0, 1), (5, None, 1), (9, 1, 1), (9, 0, None), (None, 1, 1), (99, 1, 1)]
    labels = spark.createDataFrame(rows, LABELS).withColumn("part", F.lit("x"))
    assert report(odd_docs, labels) == brute([(r.doc_id, r.text, r.lang) for r in odd_docs.collect()], rows)
    assert report(odd_docs.limit(0), labels) == set()
    assert report(odd_docs, labels.limit(0)) == brute([(r.doc_id, r.text, r.lang) for r in odd_docs.collect()], [])


def test_small_ranges_hot_copies_and_shuffle_joins(spark, monkeypatch):
    monkeypatch.setattr(a, "RANGE_BITS", 3)
    monkeypatch.setattr(a, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(a, "PARTS_HELD", 1)
    texts = ["hot text #1", "AB cd " * 120, "word " * 250, " ".join(f"w{i}" for i in range(220)), ""]
    docs = [(n, texts[0] if n % 3 == 0 else texts[n % 5] + ("" if n % 7 else str(n)), ["en", "de", None, "p4"][n % 4 if n % 2 else 0]) for n in range(400)]
    labels = [(n, n % 2, n % 3 % 2) for n in range(0, 400, 3)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(5)
    assert report(df, spark.createDataFrame(labels, LABELS)) == brute(docs, labels)


def test_orders_may_be_chosen(spark, odd_docs):
    one = audit_filters(odd_docs, text_filters(), spark.createDataFrame([], LABELS), {}, orders=["DA"])
    assert one.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "shapley"]
    assert {(r.filter_order, r.step) for r in one.collect()} == {("DA", 1), ("DA", 2)}
