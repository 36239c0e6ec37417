import math

import pytest
from pyspark.sql import functions as F

from sparrowmill.functions.tensors import layer_key
from sparrowmill.operators import deltas as d
from sparrowmill.operators import shards as h
from sparrowmill.sources.samples import read_shards, save_bucketed


def table(spark, tensors):
    return spark.createDataFrame([(t, i, float(v)) for t, vs in tensors.items() for i, v in enumerate(vs)], "tensor string, pos long, value double")


def test_delta_and_statistics(spark):
    base, target = table(spark, {"a": [1, 2, 0], "only_base": [5]}), table(spark, {"a": [1, 0, 3], "only_target": [2]})
    delta = d.param_delta(base, target)
    got = {(r.tensor, r.pos): r.value for r in delta.collect()}
    assert got == {("a", 0): 0, ("a", 1): -2, ("a", 2): 3, ("only_base", 0): -5, ("only_target", 0): 2}
    back = {(r.tensor, r.pos): r.value for r in d.param_delta(target, base).collect()}
    assert back == {k: -v for k, v in got.items()}
    assert {r.tensor for r in d.param_delta(base, target, F.col("tensor") != "a").collect()} == {"only_base", "only_target"}
    r = d.delta_distance(delta).first()
    assert (r.l1, r.elements, r.increased, r.decreased, r.unchanged) == (12, 5, 40, 40, 20) and r.l2 == pytest.approx(math.sqrt(42)) and r.rms == pytest.approx(math.sqrt(42 / 5))
    assert tuple(d.delta_distance(delta.limit(0)).first()) == (0, 0, 0, 0, 0, 0, 0)
    assert tuple(d.delta_size(delta).first()) == (3, 5)
    assert [(r.tensor, r.direction) for r in d.tensor_stats(delta, 2).collect()] == [("only_base", "-"), ("only_target", "+")]
    assert d.delta_summary(delta).first().zero == 0.2
    strict = d.param_delta_strict(base.where("tensor = 'a'"), target)
    assert {r.pos: r.value for r in strict.collect()} == {0: 0, 1: -2, 2: 3}
    with pytest.raises(Exception, match="target lacks only_base"):
        d.param_delta_strict(base, target).collect()


def test_pairs(spark):
    a, b, c = table(spark, {"x": [1, -2, 0, 4]}), table(spark, {"x": [2, 1, 3, 0]}), table(spark, {"x": [-1, 2, 0, -4]})
    assert d.cosine_similarity(a, c).first().cosine == -1.0
    s = d.sign_agreement(a, b).first()
    assert (s.agreement, s.same_pos, s.same_neg, s.opposite, s.a_only, s.b_only) == (0.5, 0.5, 0, 0.5, 0.25, 0.25)
    zero = table(spark, {"x": [0, 0, 0, 0]})
    assert tuple(d.sign_agreement(zero, zero).first()) == (1, 0, 0, 0, 0, 0) and d.cosine_similarity(a, zero).first().cosine == 0
    with pytest.raises(Exception, match="one side lacks"):
        d.cosine_similarity(a, table(spark, {"x": [1]})).collect()
    all_ = a.withColumn("task", F.lit("a")).unionByName(b.withColumn("task", F.lit("b"))).unionByName(c.withColumn("task", F.lit("c")))
    m = {r.task: r for r in d.compat_matrix(all_, ["a", "b", "c"]).collect()}
    assert m["a"].a == 1 and m["a"].b == m["b"].a == 0.0 and m["a"].c == -1.0
    assert {(r.a, r.b): r["class"] for r in d.pair_cosines(all_).collect()} == {("a", "b"): "neutral", ("a", "c"): "conflicting", ("b", "c"): "neutral"}


def test_layers(spark):
    names = {"model.layers.10.mlp.w": "layers.10", "model.Layers.2.x": "layers.2", "model.embed_tokens.weight": "embeddings", "lm_head.weight": "head", "output_layer.w": "head", "model.norm.weight": "norms", "x": "other", "layers": "other"}
    got = {r.t: r.k for r in spark.createDataFrame([(n,) for n in names], "t string").select("t", layer_key(F.col("t")).alias("k")).collect()}
    assert got == names
    assert [r.layer for r in d.layer_distance(table(spark, {"layers.10.a": [1], "layers.2.a": [3, 4], "z": [0]})).collect()] == ["layers.10", "layers.2", "other"]


def test_merge_and_names(spark):
    def grid(tensor, rank, rows, cols, start):
        return [(1, rank, tensor, r, c, float(start + r * cols + c)) for r in range(rows) for c in range(cols)]

    rows = grid("decoder.layers.0.mlp.linear_fc2.weight", 0, 2, 2, 0) + grid("decoder.layers.0.mlp.linear_fc2.weight", 3, 2, 2, 10) + grid("w", 0, 1, 2, 20) + grid("w", 3, 1, 2, 30)
    rows += grid("part", 3, 1, 1, 40) + grid("odd", 0, 1, 1, 50) + grid("odd", 3, 2, 1, 60)
    df = spark.createDataFrame([*rows, (0, 0, "old", 0, 0, 1.0)], "iteration int, rank int, tensor string, row int, col int, value double")
    merged = h.merge_shards(h.latest_iteration(df))
    got = {}
    for r in merged.collect():
        got.setdefault(r.tensor, {})[r.row, r.col] = r.value
    assert got["w"] == {(0, 0): 20, (0, 1): 21, (1, 0): 30, (1, 1): 31}
    assert got["decoder.layers.0.mlp.linear_fc2.weight"] == {(0, 0): 0, (0, 1): 1, (1, 0): 2, (1, 1): 3, (0, 2): 10, (0, 3): 11, (1, 2): 12, (1, 3): 13}
    assert got["part"] == {(0, 0): 40} and got["odd"] == {(0, 0): 50} and "old" not in got
    assert {(r.tensor, r.row, r.col): r.pos for r in h.with_positions(merged).where("tensor = 'w'").collect()}["w", 1, 1] == 3
    names = ["module.decoder.layers.7.self_attention.linear_qkv.weight", "decoder.layers.7.mlp.linear_fc1.weight", "decoder.layers.7.input_layernorm.weight", "embedding.word_embeddings.weight", "output_layer.weight", "mystery"]
    wide = spark.createDataFrame([(n, r, 0, float(r)) for n in names for r in range(8 if "qkv" in n else 6 if "fc1" in n else 1)], "tensor string, row int, col int, value double")
    split = h.split_names(wide, heads=2, kv_heads=1, head_dim=2, intermediate=3)
    sizes = {r.tensor: r["count"] for r in split.groupBy("tensor").count().collect()}
    p = "model.layers.7."
    assert sizes == {p + "self_attn.q_proj.weight": 4, p + "self_attn.k_proj.weight": 2, p + "self_attn.v_proj.weight": 2, p + "mlp.gate_proj.weight": 3, p + "mlp.up_proj.weight": 3, p + "input_layernorm.weight": 1, "model.embed_tokens.weight": 1, "lm_head.weight": 1, "mystery": 1}
    assert "lm_head.weight" not in {r.tensor for r in h.split_names(wide, 2, 1, 2, 3, tied=True).collect()}
    back = {(r.tensor, r.row): r.value for r in h.fuse_names(split).collect()}
    assert back == {("model.language_model." + n.removeprefix("module."), r): float(r) for n in names if n != "mystery" for r in range(8 if "qkv" in n else 6 if "fc1" in n else 1)}
    assert not [r for r in h.fuse_names(split.where("tensor not like '%k_proj%'")).collect() if "qkv" in r.tensor]


def test_names_without_a_gate_and_of_a_later_stage(spark):
    rows = [("decoder.layers.1.mlp.linear_fc1.weight", r) for r in range(4)] + [("encoder.final_norm.weight", 0), ("model.embedding.word_embedding.weight", 0), ("module.module.x", 0), ("decoder.layers.1.self_attention.linear_qkv.layer_norm_bias", 0)]
    rows += [("decoder.layers.0.mlp.linear_fc1.bias", r) for r in range(4)] + [("decoder.layers.0.self_attention.linear_qkv.weight", r) for r in range(5)] + [(None, 0)]
    df = spark.createDataFrame([(n, r, 0, float(r)) for n, r in rows], "tensor string, row int, col int, value double")
    split = h.split_names(df, heads=2, kv_heads=1, head_dim=1, intermediate=4, gated=False, first_layer=10)
    got = sorted(((r.tensor or "", r.row) for r in split.collect()))
    p = "model.layers.1"
    want = [(f"{p}1.mlp.up_proj.weight", r) for r in range(4)] + [(f"{p}0.mlp.up_proj.bias", r) for r in range(4)] + [(f"{p}1.input_layernorm.bias", 0), ("model.norm.weight", 0), ("model.embed_tokens.weight", 0), ("module.module.x", 0), ("", 0)]
    want += [(f"{p}0.self_attn.{x}_proj.weight", r) for x, r in (("q", 0), ("q", 1), ("k", 0), ("v", 0))] + [("decoder.layers.0.self_attention.linear_qkv.weight", 4)]  # a row beyond the blocks
    assert got == sorted(want)
    back = {(r.tensor, r.row) for r in h.fuse_names(split, gated=False, prefix="").where("tensor like '%fc1%'").collect()}
    assert back == {(f"decoder.layers.1{i}.mlp.linear_fc1.{k}", r) for i, k in ((0, "bias"), (1, "weight")) for r in range(4)}
    assert h.fuse_names(df.where("false")).count() == 0


def test_shards_of_folders(spark, tmp_path):
    rows = [(i, k, "w", r, 0, float(100 * i + 10 * k + r)) for i in (1, 2, 10) for k in (0, 1) for r in range(2)]
    df = spark.createDataFrame(rows, "iteration int, rank int, tensor string, row int, col int, value double")
    df.write.partitionBy("iteration", "rank").parquet(str(tmp_path / "all"))
    df.where("iteration = 1").drop("iteration").write.partitionBy("rank").parquet(str(tmp_path / "flat"))
    latest = read_shards(spark, str(tmp_path / "all"))
    assert {r.value for r in latest.collect()} == {1000, 1001, 1010, 1011}
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(iteration" in plan and "ubquery" in plan.split("PartitionFilters:")[1].split("PushedFilters")[0]
    second = read_shards(spark, str(tmp_path / "all"), 2)
    assert {r.value for r in second.collect()} == {200, 201, 210, 211} and len(second.inputFiles()) >= 2
    assert {(r.row, r.value) for r in h.merge_shards(second).collect()} == {(0, 200), (1, 201), (2, 210), (3, 211)}
    assert read_shards(spark, str(tmp_path / "flat")).count() == 4
    with pytest.raises(ValueError):
        read_shards(spark, str(tmp_path / "all"), 3)


def test_stored_buckets_are_joined_without_a_shuffle(spark, tmp_path):
    size = {"a": range(300), "b": range(40)}
    spark.sql(f"CREATE DATABASE params LOCATION '{tmp_path}/params'")
    try:
        save_bucketed(table(spark, {t: [float(i) for i in n] for t, n in size.items()}), "params.base", 4)
        save_bucketed(table(spark, {t: [i + 1.0 for i in n] for t, n in size.items()}), "params.target", 4)
        before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = d.delta_distance(d.param_delta(spark.table("params.base"), spark.table("params.target")))
        assert (out.first().l1, out.first().elements) == (340, 340)
        plan = out._jdf.queryExecution().executedPlan().toString()
        join = plan[plan.index("SortMergeJoin") :]
        assert "Exchange" not in join and "Bucketed: true" in join
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    finally:
        spark.sql("DROP DATABASE params CASCADE")
