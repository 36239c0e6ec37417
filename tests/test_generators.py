import pytest
from pyspark.sql import functions as F

from sparrowmill.functions.products import describe_full, describe_short, is_high_tier
from sparrowmill.operators import generators as g
from sparrowmill.operators import windows as w

SCHEMA = "company string, category string, series string, sub_series string, name string, alias array<string>, positioning array<string>, talking_points array<string>, generation string, price string, status string, ord long"
ROWS = [
    ("C", "phone", "S1", "x", "P1", ["a1", "a{name}"], ["折叠屏", "top"], ["slim body", "185g light", "5000mAh", "¥99"], "new", "¥7,499起", "在售", 0),
    ("C", "phone", "S1", "x", "P2", None, ["top"], ["fast"], "old", "¥9999", "即将发布", 1),
    ("C", "phone", "S1", None, "P3", ["a3"], None, None, "old", "待定", "在售", 2),
    ("C", "watch", "S2", "折叠系列", "P4", [], [], [], None, "¥7,499", None, 3),
    ("C", "watch", "", "", "P5", ["a5"], ["top"] , ["1.5万 steps"], "new", "¥7,499", "在售", 4),
    ("C", None, None, None, "P6", None, ["top", "rare"], ["40g"], "new", None, "在售", 5),
]


@pytest.fixture(scope="module")
def products(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def rows(df):
    return {(r["slots"].get("name") or r["slots"].get("group") or r["slots"].get("names"), *(r["slots"].get(k) for k in ("alias", "point", "weight") if k in r["slots"]), r["case"]) for r in df.collect()}


def test_descriptions(products):
    got = {r.name: (r.f, r.s, r.h) for r in products.select("name", describe_full().alias("f"), describe_short().alias("s"), is_high_tier(F.col("price")).alias("h")).collect()}
    assert got["P1"] == ("P1是C的一款phone，属于S1，折叠屏、top，主打slim body、185g light、5000mAh，售价¥7,499起，目前在售。", "P1, Cphone, slim body、185g light, ¥7,499起。", False)
    assert got["P3"] == ("P3是C的一款phone，属于S1，目前在售。", "P3是C的一款phone, 待定。", False)
    assert got["P2"][2] is True and got["P5"][1] == "P5, Cwatch, 1.5万 steps, ¥7,499。"


def test_facts(products):
    p = g.described(products)
    assert rows(g.talking_points(p)) == {("P1", "slim body", None), ("P2", "fast", None)}
    assert {r.slots["names"] for r in g.positioning_groups(p).collect()} == {"P1", "P1、P2、P5、P6", "P6"}
    assert {r.slots["names"] for r in g.positioning_groups(p, most=3).collect()} == {"P1", "P6"}
    assert {(r.slots["a_name"], r.slots["b_name"]) for r in g.pairs(p).collect()} == {("P1", "P2")}
    assert {(r.case, r.slots["name"]) for r in g.price_extremes(p).collect()} == {("cheapest", "P1"), ("priciest", "P2"), ("cheapest", "P4"), ("priciest", "P5")}
    assert {(r.slots["weight"], r.slots["name"]) for r in g.weights(p).collect()} == {("185g", "P1")}
    assert {r.slots["names"] for r in g.group_lists(p, "series", 8, least=2).collect()} == {"P1、P2、P3"}
    assert {r.slots["names"] for r in g.group_lists(p, "category", 2, with_price=True).collect()} == {"P1(¥7,499起)、P2(¥9999)", "P4(¥7,499)、P5(¥7,499)"}
    assert [r.slots["names"] for r in g.topic(p, "折叠").collect()] == ["P1(¥7,499起)、P4(¥7,499)"]
    assert g.topic(p, "nothing").count() == 0


def test_all_generators_render(spark, products):
    cases = {"status_query": ["在售", "即将发布"], "extremes": ["weight", "cheapest", "priciest"], "enumeration": ["category", "series"]}
    names = [*g.EVALUATION, *g.TRAINING]
    templates = spark.createDataFrame([(n, v, c, "{name}{alias} q{unknown}", "{short}") for n in names for v, c in enumerate(cases.get(n, [None]))], "generator string, variant int, case string, question string, answer string")
    out = g.generate(products, templates, g.EVALUATION).unionByName(g.generate(products, templates))
    counts = {r.generator: r.n for r in g.generator_shares(out).collect()}
    assert set(counts) == set(names) and counts["intro"] == 6 and counts["alias_direct"] == 4 and counts["status_query"] == 5
    alias = {r.instruction for r in out.where("generator = 'alias_direct'").collect()}
    assert "P1a{name} q{unknown}" in alias
    pair = out.where("generator = 'compare'").first().entities
    assert pair["P1"].price == "¥7,499起" and pair["P2"].series == "S1" and pair["P1"].value is None
    capped = g.generate(products, templates, cap=2)
    assert max(r.n for r in g.generator_shares(capped).collect()) == 2
    assert sorted(map(str, capped.collect())) == sorted(map(str, g.generate(products, templates, cap=2).collect()))
    with pytest.raises(ValueError):
        g.generate(products, templates, only="none")


def test_windows(spark):
    df = spark.createDataFrame([("a", i) for i in range(5)] + [("", 1), (None, 2), ("b", 7)], "k string, o long")
    assert sorted(map(tuple, w.first_rows(df, ["k"], ["o"], 2).collect())) == [("a", 0), ("a", 1), ("b", 7)]
    q = spark.createDataFrame([("x", 7), ("y", 0), ("z", 3)], "label string, need int")
    assert sorted((r.label, r.batch, r.batch_size) for r in w.batches(q, 3).collect()) == [("x", 0, 3), ("x", 1, 3), ("x", 2, 1), ("z", 0, 3)]
    assert w.group_size_between(df, ["k"], 2, 5).count() == 5
    assert [tuple(r) for r in w.shuffled(df, ["k", "o"]).collect()] == [tuple(r) for r in w.shuffled(df.repartition(3), ["k", "o"]).collect()]
