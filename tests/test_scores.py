import json
import math
from collections import Counter

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparrowmill.functions.text import first_number, number_value, render_prompt, trim_u, value_text
from sparrowmill.operators import json_scores as j
from sparrowmill.operators import ngrams
from sparrowmill.operators import scores as s
from sparrowmill.plans import jobs
from sparrowmill.sources.samples import read_samples

PAIRS = [("abcd", "ab"), ("abcdefgh", "abcdxxxx"), ("", ""), ("x", ""), ("", "x"), (" 　ab\n", "ab"), ("🙂é", "é🙂"), ("ab", "abc"), ("aaaa", "aa"), ("同じ文です", "同じ文だ"), ("hello world", "hello world")]


def bleu(p, r):
    def grams(t, n):
        return Counter([t] if 0 < len(t) < n else [t[i : i + n] for i in range(len(t) - n + 1)])

    p, r, vals = p.strip(), r.strip(), []
    for n in range(1, 5):
        a, b = grams(p, n), grams(r, n)
        vals.append(sum(min(c, b[g]) for g, c in a.items()) / sum(a.values()) if a else 0.0)
    return [*vals, min(1.0, math.exp(1 - len(r) / max(len(p), 1))) * math.exp(sum(math.log(max(v, 1e-10)) for v in vals) / 4)]


def f1(p, r):
    p, r = set(p.strip()), set(r.strip())
    return 1.0 if not p and not r else 2 * len(p & r) / (len(p) + len(r)) if p & r else 0.0


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, p, r, None) for i, (p, r) in enumerate(PAIRS)], "sample_id long, prediction string, reference string, error string")


def test_row_scores(rows):
    for r in s.score_rows(rows, ["exact_match", "contains", "char_f1"]).collect():
        p, t = PAIRS[r.sample_id]
        assert r.exact_match == float(p.strip() == t.strip()) and r.contains == float(t.strip() in p.strip())
        assert r.char_f1 == pytest.approx(f1(p, t))


def test_bleu(rows):
    for r in s.char_bleu(rows, "sample_id").collect():
        assert [r.bleu1, r.bleu2, r.bleu3, r.bleu4, r.bleu] == pytest.approx(bleu(*PAIRS[r.sample_id]))


def test_groups_errors_and_isolation(spark):
    df = spark.createDataFrame([(1, "a", "a", None, "test"), (2, "b", "c", None, "test"), (3, "d", "d", None, None), (4, None, "d", "boom", "prod"), (5, "e", "e", None, "prod")], "sample_id long, prediction string, reference string, error string, g string")
    scored = s.score_rows(df, ["exact_match"])
    one = s.summarise(scored, ["exact_match"]).first()
    assert (one.total, one.valid, one.errors, one.all_failed, one.exact_match, one.exact_match_correct) == (5, 4, 1, False, 0.75, 3)
    got = {r.group_value: (r.n, r.exact_match) for r in s.by_group(scored, ["exact_match"], "g").collect()}
    assert got == {None: (4, 0.75), "test": (2, 0.5), "prod": (1, 1.0)}
    empty = s.summarise(scored.limit(0), ["exact_match"]).first()
    assert (empty.total, empty.exact_match) == (0, 0.0)
    with pytest.raises(ValueError):
        s.choose_metrics(["nope"])
    assert s.choose_metrics(["nope", "contains"]) == (["contains"], ["nope"])

    def bad(p: pd.Series, r: pd.Series) -> pd.Series:
        raise RuntimeError("no")

    def length(p: pd.Series, r: pd.Series) -> pd.Series:
        return (p.str.len() == r.str.len()).astype(float)

    s.register_python_metric("bad", bad)
    s.register_python_metric("length", length)
    out = {r.metric: r for r in s.isolated(df.where("error is null"), ["bad", "length", "contains"]).collect()}
    assert out["bad"].failure and out["length"].score == 1.0 and out["contains"].score == 0.75


DOCS = [
    ('{"a": 1}', '{"a": 1}', {"a": 1.0}), ('{"a": 1}', '{"a": 2}', {"a": 0.0}), ('{"level1": "A", "level2": {"sub": "X"}}', '{"level1": "A", "level2": {"sub": "Y"}}', {"level1": 1.0, "level2.sub": 0.0}),
    ("[1, 2, 3]", "[1, 0, 3]", {"[0]": 1.0, "[1]": 0.0, "[2]": 1.0}), ('{"a": 1}', '{"a": 1, "b": 2}', {"a": 1.0, "b": 0.0}), ("{}", "{}", {"value": 1.0}), ("[]", "{}", {"value": 0.0}),
    ('{"a": 1}', '{"a": 1.0}', {"a": 0.0}), ('{"a": null, "b": ""}', "{}", {"a": 1.0, "b": 1.0}), ('{"a": true}', '{"a": "True"}', {"a": 1.0}), ('{"a": {"b": {"c": []}}}', '{"a": {"b": {"c": []}}}', {"a.b.c": 1.0}),
    ('{"a": {"b": 1, "c": 2}}', "{}", {"a": 0.0}), ('text {"k": [1, {"z": 2}]} more', '{"k": [1, {"z": 3}, 4]}', {"k[0]": 1.0, "k[1].z": 0.0, "k[2]": 0.0}), ('{"a": 1.50}', '{"a": 1.5}', {"a": 1.0}), ('{"a": " x "}', '{"a": "x"}', {"a": 1.0}),
]


def test_json_fields(spark):
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(DOCS)], "id long, prediction string, reference string")
    got = {}
    for r in j.json_field_scores(df, "id").select("key", j.path_text(F.col("path")).alias("f"), "score").collect():
        got.setdefault(r.key, {})[r.f] = r.score
    assert got == {i: w for i, (_, _, w) in enumerate(DOCS)}
    means = {r.id: r.json_accuracy for r in j.json_accuracy(df, "id").collect()}
    assert means == pytest.approx({i: sum(w.values()) / len(w) for i, (_, _, w) in enumerate(DOCS)})


def test_json_whole(spark):
    pairs = [('{"a": 1, "b": [1, 2]}', '{"b": [1, 2], "a": 1}', 1.0), ('{"a": 1}', '{"a": 1.0}', 1.0), ('{"a": true}', '{"a": 1}', 1.0), ("[1]", "[1, 2]", 0.0), ("plain", "plain", 1.0), ("plain", "plain ", 0.0), ("{}", "[]", 0.0), ('{"a": "1"}', '{"a": 1}', 0.0), ("3", "3", 1.0)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "id long, prediction string, reference string")
    for a, b, want in pairs:
        try:
            assert (json.loads(a) == json.loads(b)) == bool(want)
        except ValueError:
            pass
    assert {r.id: r.json_exact_match for r in j.json_exact_match(df, "id").collect()} == {i: w for i, (_, _, w) in enumerate(pairs)}
    big = [('{"id": 9007199254740993}', '{"id": 9007199254740992}', 0.0), ('{"id": 9007199254740993}', '{"id": 9007199254740993}', 1.0), (str(10**60), str(10**60), 1.0), (str(10**60), str(10**60 + 1), 0.0), ('{"a": 1, "a": 2}', '{"a": 2}', 1.0)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(big)] + [(9, None, "x")], "id long, prediction string, reference string")
    assert {r.id: r.json_exact_match for r in j.json_exact_match(df, "id").collect()} == {i: w for i, (_, _, w) in enumerate(big)} | {9: None}
    text = spark.createDataFrame([(1, "x", " x "), (2, "x", '{"a": 1}')], "id long, prediction string, reference string")
    assert {r.id: r.json_accuracy for r in j.json_accuracy(text, "id").collect()} == {1: 1.0, 2: 0.0}


def test_prompts_and_numbers(spark):
    df = spark.createDataFrame([(1, " do {input} ", "x"), (2, "do", ""), (3, "", " only "), (4, "", " 　"), (5, None, "x")], "id long, i string, g string")
    got = {r.id: r.p for r in df.select("id", render_prompt(F.col("i"), F.col("g"), "Q: {instruction} / {input}").alias("p")).collect()}
    assert got == {1: "Q: do {input} / x", 2: "Q: do / ", 3: "only", 4: "", 5: "Q: None / x"}
    nums = spark.createDataFrame([("¥7,499起",), ("1.2.3",), (".",), ("none",), ("１２ x",)], "t string").select(first_number(F.col("t")).alias("a"), number_value(F.col("t")).alias("b")).collect()
    assert [r.a for r in nums] == ["7,499", "1.2.3", ".", None, "１２"] and [r.b for r in nums][:4] == [7499.0, None, None, None]
    odd = "\x1c  \x85a b　\r\n"
    assert spark.createDataFrame([(odd,)], "t string").select(trim_u(F.col("t")).alias("t")).first().t == odd.strip()


def flat(a, b, path=""):
    """Field scores of two parsed documents, recursively."""
    if isinstance(a, dict) and isinstance(b, dict) and (a or b):
        return {k: v for name in {*a, *b} for k, v in flat(a.get(name, ""), b.get(name, ""), f"{path}.{name}").items()}
    if isinstance(a, list) and isinstance(b, list) and (a or b):
        return {k: v for i in range(max(len(a), len(b))) for k, v in flat(a[i] if i < len(a) else "", b[i] if i < len(b) else "", f"{path}[{i}]").items()}
    text = lambda x: "" if x is None else str(x).strip()
    return {path.lstrip(".") or "value": float(text(a) == text(b))}


def test_json_of_nine_levels(spark):
    deep = lambda leaf: {"a": {"b": [{"c": {"d": {"e": [{"f": {**{f"k{i}": i for i in range(9)}, "last": leaf}}]}}}]}}
    pairs = [(deep(1), deep(2)), (deep("x"), deep("x")), (deep(1), deep(1.0)), (deep({"g": 1}), deep({"g": 1, "h": None})), ({"a": 1}, {"a": {"b": 2}}), ([1, [2, [3]]], [1, [2, [4, 5]]])]
    rows = spark.createDataFrame([(i, json.dumps(a), json.dumps(b)) for i, (a, b) in enumerate(pairs)], "sample_id long, prediction string, reference string")
    got = {}
    for r in j.json_field_scores(rows, "sample_id").select("key", j.path_text(F.col("path")).alias("field"), "score").collect():
        got.setdefault(r.key, {})[r.field] = r.score
    assert got == {i: flat(a, b) for i, (a, b) in enumerate(pairs)}
    exact = {r.sample_id: r.json_exact_match for r in j.json_exact_match(rows, "sample_id").collect()}
    assert exact == {0: 0.0, 1: 1.0, 2: 1.0, 3: 0.0, 4: 0.0, 5: 0.0}


def test_depth_has_no_part_in_the_plan(spark):
    def nested(depth, leaf):
        for i in range(depth):
            leaf = {"k": leaf, "n": i} if i % 2 else [leaf, i]
        return leaf

    tracker, jobs = spark.sparkContext.statusTracker(), {}
    for depth in (3, 50, 300):
        rows = spark.createDataFrame([(1, json.dumps(nested(depth, 1)), json.dumps(nested(depth, 2)))], "id long, prediction string, reference string")
        spark.sparkContext.setJobGroup(f"depth {depth}", "")
        got = j.json_accuracy(rows, "id").first().json_accuracy
        jobs[depth] = len(tracker.getJobIdsForGroup(f"depth {depth}"))
        assert got == pytest.approx(depth / (depth + 1))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(set(jobs.values())) == 1


def test_documents_too_deep_are_texts(spark):
    deep = "[" * 200_000 + "]" * 200_000
    rows = spark.createDataFrame([(1, deep, deep), (2, deep, "[]")], "id long, prediction string, reference string")
    assert {r.id: r.json_accuracy for r in j.json_accuracy(rows, "id").collect()} == {1: 1.0, 2: 0.0}


values = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False) | st.text(max_size=4), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from(["a", "b", "c", "a.b", "[0]"]), x, max_size=3), max_leaves=12)


@settings(max_examples=300, deadline=None)
@given(values, values)
def test_points_equal_a_recursive_comparison(a, b):
    got = sorted(("".join(path).removeprefix(".") or "value", score) for path, score in j.points(a, b))
    assert got == sorted(pairs_of(a, b))


def pairs_of(a, b, path=""):
    """As ``flat``, with a pair for each point where names make paths collide."""
    if isinstance(a, dict) and isinstance(b, dict) and (a or b):
        return [x for name in {*a, *b} for x in pairs_of(a.get(name), b.get(name), f"{path}.{name}")]
    if isinstance(a, list) and isinstance(b, list) and (a or b):
        return [x for i in range(max(len(a), len(b))) for x in pairs_of(a[i] if i < len(a) else None, b[i] if i < len(b) else None, f"{path}[{i}]")]
    text = lambda x: "" if x is None else str(x).strip()
    return [(path.removeprefix(".") or "value", float(text(a) == text(b)))]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="ab🙂", max_size=9), st.text(alphabet="ab🙂", max_size=9)), max_size=8))
def test_integer_ngrams_equal_counters(pairs):
    got = ngrams.bleu([p for p, _ in pairs], [r for _, r in pairs], 4) if pairs else []
    for one, (p, r) in zip(got, pairs, strict=True):
        assert one.tolist() == pytest.approx(bleu(p, r))


def test_bleu_of_long_texts_in_pieces(spark, monkeypatch):
    long = " ".join(f"word{i % 977}" for i in range(20_000))
    texts = [(long, long), (long, long[::-1]), ("", long), ("ab", "ab"), (long[:5000], long), (None, "x"), ("x", None)]
    rows = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "sample_id long, prediction string, reference string").coalesce(1)
    for r in s.char_bleu(rows, "sample_id").collect():
        p, t = texts[r.sample_id]
        if p is None:
            assert r.bleu is None
        else:
            assert [r.bleu1, r.bleu2, r.bleu3, r.bleu4, r.bleu] == pytest.approx(bleu(p, "None" if t is None else t))


def test_six_metrics_and_metrics_of_lists_by_name(spark):
    """Reference rows with containers, a field that nobody declared, and metrics of sums and of whole lists."""
    samples = [(1, "a", "test"), (2, '{"a": 1, "b": "x"}', "test"), (3, "{}", "prod"), (4, "long text", "prod"), (5, "lost", None)]
    predictions = [(1, "a", None), (2, 'so: {"a": 1, "b": "y"}', None), (3, "[]", None), (4, " long ", None), (5, None, "boom")]
    frame = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    given_ = frame(samples, "sample_id long, output string, g string").select("sample_id", "output", F.expr("""map('tier', parse_json('"' || g || '"'))""").alias("meta"))
    length = lambda c: F.length(c).cast("double")
    s.register_list_metric("length_ratio", lambda p, r: {"p": length(p), "r": length(r)}, lambda x: F.try_divide(x["p"], x["r"]))

    def median(p: pd.Series, r: pd.Series) -> float:
        return float(p.str.len().median())

    s.register_pandas_list_metric("median_length", median)
    names = ["exact_match", "contains", "json_accuracy", "json_exact_match", "char_f1", "bleu", "length_ratio", "median_length", "rouge"]
    out = jobs.evaluate(given_, frame(predictions, "sample_id long, prediction string, error string"), names, "tier")
    assert out.unknown == ["rouge"]
    one = out.summary.first()
    assert (one.total, one.valid, one.errors, one.all_failed, one.exact_match, one.exact_match_correct) == (5, 4, 1, False, 0.25, 1)
    assert (one.json_accuracy, one.json_exact_match, one.length_ratio, one.median_length) == pytest.approx(((1 + 0.5 + 0 + 0) / 4, 0.25, (1 + 22 + 2 + 6) / (1 + 18 + 2 + 9), 4.0))
    want = [bleu(p, t) for (_, p, _), (_, t, _) in zip(predictions[:4], samples[:4], strict=True)]
    assert [one.bleu1, one.bleu2, one.bleu3, one.bleu4, one.bleu] == pytest.approx([sum(x) / 4 for x in zip(*want, strict=True)])
    groups = {r.group_value: r for r in out.groups.collect()}
    assert {k: (r.n, r.exact_match, r.length_ratio, r.median_length) for k, r in groups.items()} == {None: (4, 0.25, pytest.approx(31 / 30), 4.0), "test": (2, 0.5, pytest.approx(23 / 19), 11.5), "prod": (2, 0.0, pytest.approx(8 / 11), 4.0)}
    assert {r.field: (r.score, r.n) for r in out.fields.collect()} == {"a": (1.0, 1), "b": (0.0, 1), "value": (0.0, 1)}
    assert one.asDict().keys() >= {*names[:-1]} and out.rows.where("sample_id = 5").first().bleu is None


def test_references_that_are_containers(spark):
    samples = spark.range(1, 2).select(F.col("id").alias("sample_id"), F.expr("named_struct('x', 1, 'é', array(1.5D, null), 't', true)").alias("output"))
    given_ = spark.createDataFrame([(1, '{"x": 1, "é": [1.5, null], "t": true}')], "sample_id long, prediction string")
    row = jobs.evaluate(samples, given_, ["exact_match", "json_accuracy"]).rows.first()
    assert (row.reference, row.exact_match, row.json_accuracy) == ('{"x": 1, "é": [1.5, null], "t": true}', 1.0, 1.0)
    cases = {"array('p', 'q')": '["p", "q"]', "true": "True", "1e16D": "1e+16", "1.0D": "1.0", "7L": "7", "cast(null as boolean)": None, "'t'": "t", "parse_json('{\"b\": [1, true]}')": '{"b": [1, true]}'}
    for sql, text in cases.items():
        df = spark.range(1).selectExpr(f"{sql} AS v")
        assert df.select(value_text(df, "v").alias("t")).first().t == text


def test_grouping_by_fields_that_nobody_declared(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"instruction": "q", "output": "x", "tier": "gold", "flag": true, "n": 1}\n\nbad\n{"instruction": "q", "output": "y", "tier": "gold", "flag": false}\n{"instruction": "q", "output": "z", "tier": null}\n')
    (tmp_path / "b.json").write_text(json.dumps([{"instruction": "q", "output": "w", "tier": "new", "flag": True, "deep": {"k": [1, 2]}}, {"instruction": "q", "output": "v"}]))
    samples = read_samples(spark, str(tmp_path), meta="meta").withColumn("sample_id", F.col("output"))
    said = spark.createDataFrame([("x", "x"), ("y", "no"), ("z", "z"), ("w", "w"), ("v", "v")], "sample_id string, prediction string")
    of = lambda field: {r.group_value: (r.n, r.exact_match) for r in jobs.evaluate(samples, said, ["exact_match"], field).groups.collect()}
    assert of("tier") == {None: (5, 0.8), "gold": (2, 0.5), "new": (1, 1.0)}
    assert of("flag") == {None: (5, 0.8), "True": (2, 1.0), "False": (1, 0.0)}
    assert of("deep") == {None: (5, 0.8), '{"k":[1,2]}': (1, 1.0)} and of("absent") == {None: (5, 0.8)}
    assert "output" not in samples.where("sample_id = 'x'").first().meta
    (tmp_path / "c.json").write_text('[{"instruction": "q"}, {"ins')
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|Malformed"):
        read_samples(spark, str(tmp_path), meta="meta").collect()
