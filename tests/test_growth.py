"""Work that must follow the input: what is joined, grouped, drawn and streamed."""

from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from sparrowmill.operators import dedup, quota
from sparrowmill.operators import generators as g
from sparrowmill.queries import streams

SCHEMA = "company string, category string, series string, sub_series string, name string, alias array<string>, positioning array<string>, talking_points array<string>, generation string, price string, status string, ord long"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def products(spark):
    rows = [("C", f"c{i % 5}", None if i % 7 == 0 else f"s{i % 3}", "u" if i % 2 else None, "{b_name}" if i == 9 else f"P{i % 38}", [], [], [f"{i}g"], "new", f"¥{100 + i % 11}", "x", i // 2) for i in range(40)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def templates(spark):
    rows = [("compare", 0, None, "{a_name} or {b_name}: {x}{", "{series} {b_short}{b_name}"), ("compare", 1, None, "{b_name}{a_full}", None), ("compare", 2, "c", "no", ""), ("compare", 3, None, None, "{a_short}")]
    return spark.createDataFrame(rows, "generator string, variant int, case string, question string, answer string")


def text_rows(df):
    return Counter(str(r) for r in df.select("generator", "ord", "variant", "instruction", "output", "entities").collect())


@pytest.mark.parametrize("block", [3, 4000])
def test_pairs_are_strung_together_from_the_sides_of_blocks(products, templates, monkeypatch, block):
    monkeypatch.setattr(g, "BLOCK", block)
    ready = g.described(products)
    got = g.generate(products, templates, only="compare")
    assert text_rows(got) == text_rows(g.render(g.pairs(ready), templates, "compare"))
    above_join = plan(got).split("Join")[0]
    assert "split(" not in above_join and "regexp_extract" not in above_join


def test_a_product_is_moved_once_for_both_sides_of_its_pairs(spark, products, templates):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = g.generate(products, templates.where("variant in (1, 3)"), only="compare").select("instruction", "output")
        moves = [x for x in got._jdf.queryExecution().executedPlan().toString().split("\n") if "REPARTITION_BY_NUM" in x]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sorted("ReusedExchange" in x for x in moves) == [False, True]


def test_a_sample_of_pairs_is_drawn_without_making_all(products, templates):
    every = text_rows(g.generate(products, templates, only="compare"))
    for cap in (1, 10, 10_000):
        some = g.generate(products, templates, only="compare", cap=cap)
        rows = text_rows(some)
        assert rows.total() == min(cap, every.total()) and rows <= every
        assert rows == text_rows(g.generate(products, templates, only="compare", cap=cap))
        assert "_a_ord <" not in plan(some) and "a_ord#" not in "".join(x for x in plan(some).split("\n") if "<" in x and "Join" in x)


def test_extremes_group_places_only(products):
    ready = g.described(products)
    rows = [r.asDict() for r in products.collect()]
    want = Counter()
    for c in {r["category"] for r in rows}:
        of = sorted((int(r["price"][1:]), r["ord"], r["name"]) for r in rows if r["category"] == c)
        if of[0][2] != of[-1][2]:
            want.update([("cheapest", of[0][2]), ("priciest", of[-1][2])])
    got = g.price_extremes(ready)
    assert Counter((r.case, r.slots["name"]) for r in got.collect()) == want
    assert "min_by" not in plan(got) and "max_by" not in plan(got)


def test_unseen_rows_are_joined_by_digest(spark):
    new = spark.createDataFrame([(1, " a "), (2, None), (3, "b"), (4, "="), (5, "")], "i int, k string")
    old = spark.createDataFrame([("a",), (None,)], "k string")
    got = dedup.not_seen(new, old, "k")
    assert got.columns == ["i", "k"] and sorted(r.i for r in got.collect()) == [3, 4, 5]
    assert "_digest" in [x for x in plan(got).split("\n") if "LeftAnti" in x][0]


def test_responses_are_parsed_until_samples_are_found(spark):
    df = spark.createDataFrame([("r", '[{"text": "a"}]'), ("r", '```json\n{"data": [{"text": "b"}]}\n```'), ("r", "[] x"), ("q", 'so: [{"text": "c"}] {')], "label string, content string")
    samples, rejects = quota.samples_and_rejects(quota.with_samples(df).persist())
    assert sorted((r.request_label, r.text) for r in samples.collect()) == [("q", "c"), ("r", "a"), ("r", "b")] and rejects.count() == 1


def test_all_cores_take_part_in_a_micro_batch(spark):
    seen = []
    for df in (streams.streamed(spark.range(100).toDF("n"), "t"), streams.in_slices(spark.range(100).toDF("n"), "n", "t")):
        writer = df.writeStream.foreachBatch(lambda b, _: seen.append(len(b.select(F.input_file_name()).distinct().collect()))).trigger(availableNow=True)
        writer.start().awaitTermination()
    assert seen == [spark.sparkContext.defaultParallelism] * 6
