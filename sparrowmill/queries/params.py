"""Parameter statistics over the embeddings: even vectors are the base, odd ones the target."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowmill.functions.tensors import layer_key
from sparrowmill.operators import deltas, shards
from sparrowmill.queries.tables import registry, rounded, table
from sparrowmill.sources.samples import read_shards
from sparrowmill.sources.shared import shared_folder, stored

QUERIES, query = registry()


def elements(spark: SparkSession, sf: str) -> DataFrame:
    """(vec_id, label, pos, value), values as doubles."""
    return table(spark, sf, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("pos", "v")).select("vec_id", "label", F.col("pos").cast("long").alias("pos"), F.col("v").cast("double").alias("value"))


_NAME = "CASE WHEN (vec_id // 2) % 5 = 0 THEN 'model.norm.' ELSE 'layers.' || ((vec_id // 2) % 7) || '.' END || (vec_id // 2)"


def tensors(spark: SparkSession, sf: str, odd: int) -> DataFrame:
    """Of each pair of vectors the even or the odd one, as a tensor."""
    pair = F.floor(F.col("vec_id") / 2)
    name = F.concat(F.when(pair % 5 == 0, "model.norm.").otherwise(F.concat(F.lit("layers."), (pair % 7).cast("string"), F.lit("."))), pair.cast("string"))
    return elements(spark, sf).where(F.col("vec_id") % 2 == odd).select(name.alias("tensor"), "pos", "value")


def delta(spark: SparkSession, sf: str) -> DataFrame:
    return deltas.param_delta(tensors(spark, sf, 0), tensors(spark, sf, 1))


_E = f"e AS (SELECT vec_id, label, {_NAME} AS tensor, u.i - 1 AS pos, CAST(embedding[u.i] AS DOUBLE) AS value FROM embeddings, unnest(range(1, len(embedding) + 1)) AS u(i))"
_D = f"WITH {_E}, d AS (SELECT coalesce(t.tensor, b.tensor) AS tensor, coalesce(t.pos, b.pos) AS pos, coalesce(t.value, 0) - coalesce(b.value, 0) AS value FROM (SELECT * FROM e WHERE vec_id % 2 = 0) b FULL JOIN (SELECT * FROM e WHERE vec_id % 2 = 1) t ON b.tensor = t.tensor AND b.pos = t.pos)"
_LAYER = "CASE WHEN starts_with(tensor, 'layers') THEN 'layers.' || string_split(tensor, '.')[2] ELSE 'norms' END"


@query(_D + " SELECT round(sum(abs(value)), 6) AS l1, round(sqrt(sum(value * value)), 6) AS l2, round(sqrt(avg(value * value)), 6) AS rms, count(*) AS elements, round(100.0 * count(*) FILTER (value > 0) / count(*), 6) AS increased, round(100.0 * count(*) FILTER (value < 0) / count(*), 6) AS decreased, round(100.0 * count(*) FILTER (value = 0) / count(*), 6) AS unchanged FROM d")
def delta_distance(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(deltas.delta_distance(delta(spark, sf)), "l1", "l2", "rms", "increased", "decreased", "unchanged")


@query(_D + f" SELECT {_LAYER} AS layer, round(sqrt(sum(value * value)), 6) AS l2, round(sqrt(avg(value * value)), 6) AS rms, count(*) AS elements FROM d GROUP BY 1")
def layer_distance(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(deltas.layer_distance(delta(spark, sf)), "l2", "rms")


@query(_D + " SELECT tensor, round(avg(abs(value)), 6) AS abs_mean, round(stddev_samp(value), 6) AS std, CASE WHEN avg(value) > 0 THEN '+' ELSE '-' END AS direction, count(*) AS elements FROM d GROUP BY tensor")
def tensor_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(deltas.tensor_stats(delta(spark, sf)), "abs_mean", "std")


@query(_D + " SELECT tensor, round(avg(abs(value)), 6) AS abs_mean FROM d GROUP BY tensor ORDER BY avg(abs(value)) DESC, tensor LIMIT 10")
def top_tensors(spark: SparkSession, sf: str) -> DataFrame:
    """The feature is a top-k report."""
    return rounded(deltas.tensor_stats(delta(spark, sf), 10).select("tensor", "abs_mean"), "abs_mean")


@query(_D + " SELECT round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(1.0 * count(*) FILTER (value > 0) / count(*), 6) AS positive, round(1.0 * count(*) FILTER (value < 0) / count(*), 6) AS negative, round(1.0 * count(*) FILTER (value = 0) / count(*), 6) AS zero FROM d")
def delta_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(deltas.delta_summary(delta(spark, sf)), "mean", "std", "positive", "negative", "zero")


@query(_D + " SELECT count(DISTINCT tensor) AS tensors, count(*) AS elements FROM d")
def delta_size(spark: SparkSession, sf: str) -> DataFrame:
    return deltas.delta_size(delta(spark, sf))


@query(_D + " SELECT tensor, round(sum(value), 6) AS total FROM d WHERE NOT starts_with(tensor, 'model') GROUP BY tensor")
def delta_of_some_tensors(spark: SparkSession, sf: str) -> DataFrame:
    d = deltas.param_delta(tensors(spark, sf, 0), tensors(spark, sf, 1), ~F.col("tensor").startswith("model"))
    return rounded(d.groupBy("tensor").agg(F.sum("value").alias("total")), "total")


@query(f"WITH {_E} SELECT t.tensor, round(sum(t.value - b.value), 6) AS total FROM e b JOIN e t ON b.tensor = t.tensor AND b.pos = t.pos AND b.vec_id % 2 = 0 AND t.vec_id % 2 = 1 GROUP BY 1")
def delta_strict(spark: SparkSession, sf: str) -> DataFrame:
    d = deltas.param_delta_strict(tensors(spark, sf, 0), tensors(spark, sf, 1))
    return rounded(d.groupBy("tensor").agg(F.sum("value").alias("total")), "total")


def tasks(spark: SparkSession, sf: str) -> DataFrame:
    """A mean vector for each label, rounded so that signs and sums do not hang on the order."""
    means = elements(spark, sf).groupBy("label", "pos").agg(F.round(F.avg("value"), 8).alias("value"))
    return means.select(F.col("label").cast("string").alias("task"), F.lit("mean").alias("tensor"), "pos", "value")


_M = f"WITH {_E}, m AS (SELECT CAST(label AS VARCHAR) AS task, pos, round(avg(value), 8) AS value FROM e GROUP BY ALL)"
_COS = _M + ", c AS (SELECT a.task AS a, b.task AS b, sum(a.value * b.value) / (sqrt(sum(a.value * a.value)) * sqrt(sum(b.value * b.value))) AS cosine FROM m a JOIN m b ON a.pos = b.pos AND a.task < b.task GROUP BY ALL)"


@query(_COS + " SELECT a, b, round(cosine, 6) AS cosine, CASE WHEN cosine >= 0.3 THEN 'compatible' WHEN cosine < 0 THEN 'conflicting' ELSE 'neutral' END AS class FROM c")
def task_cosines(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(deltas.pair_cosines(tasks(spark, sf)), "cosine")


@query(_COS + f""", w AS (SELECT a, b, round(cosine, 4) AS v FROM c UNION ALL SELECT b, a, round(cosine, 4) FROM c UNION ALL SELECT DISTINCT task, task, 1.0 FROM m)
SELECT a AS task, {', '.join(f'max(v) FILTER (b = {chr(39)}{i}{chr(39)}) AS "{i}"' for i in range(10))} FROM w GROUP BY a""")
def task_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return deltas.compat_matrix(tasks(spark, sf), [str(i) for i in range(10)])


#: Mean vectors by label of the even and of the odd vectors: two models that cover the whole table.
_HALVES = f"WITH {_E}, m AS (SELECT CAST(label AS VARCHAR) AS task, vec_id % 2 AS side, pos, round(avg(value), 8) AS value FROM e GROUP BY ALL)"


def halves(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """A tensor for each label, of the even vectors and of the odd ones."""
    means = elements(spark, sf).groupBy((F.col("vec_id") % 2).alias("side"), F.col("label").cast("string").alias("tensor"), "pos").agg(F.round(F.avg("value"), 8).alias("value"))
    return means.where("side = 0").drop("side"), means.where("side = 1").drop("side")


@query(_HALVES + """ SELECT round(count(*) FILTER (a.value * b.value > 0) / count(*) FILTER (a.value <> 0 AND b.value <> 0), 6) AS agreement, round(count(*) FILTER (a.value > 0 AND b.value > 0) / count(*) FILTER (a.value <> 0 AND b.value <> 0), 6) AS same_pos,
round(count(*) FILTER (a.value < 0 AND b.value < 0) / count(*) FILTER (a.value <> 0 AND b.value <> 0), 6) AS same_neg, round(count(*) FILTER (a.value * b.value < 0) / count(*) FILTER (a.value <> 0 AND b.value <> 0), 6) AS opposite,
round(count(*) FILTER (a.value <> 0 AND b.value = 0) / count(*), 6) AS a_only, round(count(*) FILTER (a.value = 0 AND b.value <> 0) / count(*), 6) AS b_only FROM m a JOIN m b ON a.task = b.task AND a.pos = b.pos AND a.side = 0 AND b.side = 1""")
def sign_agreement(spark: SparkSession, sf: str) -> DataFrame:
    out = deltas.sign_agreement(*halves(spark, sf))
    return rounded(out, *out.columns)


@query(_HALVES + " SELECT round(sum(a.value * b.value) / (sqrt(sum(a.value * a.value)) * sqrt(sum(b.value * b.value))), 6) AS cosine FROM m a JOIN m b ON a.task = b.task AND a.pos = b.pos AND a.side = 0 AND b.side = 1")
def cosine_of_two(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(deltas.cosine_similarity(*halves(spark, sf)), "cosine")


def sharded(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as rows of tensors over two ranks: one tensor of every five stands side by side."""
    e = elements(spark, sf).withColumns({"pair": F.floor(F.col("vec_id") / 2), "rank": (F.col("vec_id") % 2).cast("int")})
    name = F.concat(F.when(F.col("pair") % 5 == 0, "linear_proj.").otherwise("up."), F.col("pair").cast("string"))
    return e.select("rank", name.alias("tensor"), F.floor(F.col("pos") / 8).cast("int").alias("row"), (F.col("pos") % 8).cast("int").alias("col"), "value")


@query(f"""WITH {_E}, s AS (SELECT vec_id // 2 AS pair, vec_id % 2 AS rank, pos // 8 AS r, pos % 8 AS c, value FROM e)
SELECT CASE WHEN pair % 5 = 0 THEN 'linear_proj.' ELSE 'up.' END || pair AS tensor, CASE WHEN pair % 5 = 0 THEN r * 16 + c + rank * 8 ELSE (r + rank * 8) * 8 + c END AS pos, value FROM s""")
def merged_shards(spark: SparkSession, sf: str) -> DataFrame:
    return shards.with_positions(shards.merge_shards(sharded(spark, sf))).select("tensor", "pos", "value")


def fused(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as fused tensors of 8 by 8: attention for even ones, MLP for odd ones."""
    name = F.concat(F.lit("module.decoder.layers."), F.col("vec_id").cast("string"), F.when(F.col("vec_id") % 2 == 0, ".self_attention.linear_qkv.weight").otherwise(".mlp.linear_fc1.weight"))
    return elements(spark, sf).select(name.alias("tensor"), F.floor(F.col("pos") / 8).cast("int").alias("row"), (F.col("pos") % 8).cast("int").alias("col"), "value")


@query(f"""WITH {_E}, s AS (SELECT vec_id, pos // 8 AS r, pos % 8 AS c, value FROM e),
p AS (SELECT *, CASE WHEN vec_id % 2 = 0 THEN CASE WHEN r < 4 THEN 'self_attn.q_proj' WHEN r < 6 THEN 'self_attn.k_proj' ELSE 'self_attn.v_proj' END WHEN r < 4 THEN 'mlp.gate_proj' ELSE 'mlp.up_proj' END AS part,
CASE WHEN vec_id % 2 = 0 THEN CASE WHEN r < 4 THEN 0 WHEN r < 6 THEN 4 ELSE 6 END WHEN r < 4 THEN 0 ELSE 4 END AS low FROM s)
SELECT 'model.layers.' || vec_id || '.' || part || '.weight' AS tensor, CAST(r - low AS INT) AS "row", CAST(c AS INT) AS col, value FROM p""")
def split_tensors(spark: SparkSession, sf: str) -> DataFrame:
    return shards.split_names(fused(spark, sf), heads=2, kv_heads=1, head_dim=2, intermediate=4)


@query(f"""WITH {_E} SELECT 'model.language_model.decoder.layers.' || vec_id || CASE WHEN vec_id % 2 = 0 THEN '.self_attention.linear_qkv.weight' ELSE '.mlp.linear_fc1.weight' END AS tensor, CAST(pos // 8 AS INT) AS "row", CAST(pos % 8 AS INT) AS col, value FROM e""")
def fused_again(spark: SparkSession, sf: str) -> DataFrame:
    split = stored(shards.split_names(fused(spark, sf), heads=2, kv_heads=1, head_dim=2, intermediate=4), "split-names")
    out = shards.fuse_names(split)
    return out.select("tensor", F.col("row").cast("int").alias("row"), "col", "value")


#: Names of tensors, {} for a number, and the names that splitting gives them (null: the same).
_RENAMED = [
    ("module.decoder.layers.{}.input_layernorm.weight", "model.layers.{}.input_layernorm.weight"), ("encoder.layers.{}.pre_mlp_layernorm.weight", "model.layers.{}.post_attention_layernorm.weight"),
    ("model.decoder.layers.{}.self_attention.linear_proj.bias", "model.layers.{}.self_attn.o_proj.bias"), ("module.language_model.encoder.layers.{}.mlp.linear_fc2.bias", "model.layers.{}.mlp.down_proj.bias"),
    ("model.language_model.decoder.layers.{}.self_attention.linear_qkv.layer_norm_weight", "model.layers.{}.input_layernorm.weight"), ("decoder.layers.{}.mlp.linear_fc1.layer_norm_weight", "model.layers.{}.post_attention_layernorm.weight"),
    ("decoder.layers.{}.self_attention.linear_qkv.bias", "model.layers.{}.self_attn.q_proj.bias"), ("encoder.layers.{}.mlp.linear_fc1.weight", "model.layers.{}.mlp.gate_proj.weight"),
    ("decoder.layers.{}.mystery", None), ("model.layers.{}.self_attn.q_proj.weight", None), ("other.{}", None),
]


def _named(spark: SparkSession, sf: str, names: list[str]) -> DataFrame:
    """Every part as a tensor of one element, under one of the names with its key."""
    name = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("p_partkey") % len(names) + 1).cast("int"))
    name = F.replace(name, F.lit("{}"), F.col("p_partkey").cast("string"))
    return table(spark, sf, "part").select(name.alias("tensor"), F.lit(0).alias("row"), F.lit(0).alias("col"), F.col("p_retailprice").cast("double").alias("value"))


def _replaced(names: list[str | None]) -> str:
    return f"replace([{', '.join('NULL' if n is None else repr(n) for n in names)}][1 + p_partkey % {len(names)}], '{{}}', CAST(p_partkey AS VARCHAR))"


@query(f"SELECT {_replaced([b or a for a, b in _RENAMED])} AS tensor, CAST(p_retailprice AS DOUBLE) AS value FROM part")
def renamed_tensors(spark: SparkSession, sf: str) -> DataFrame:
    return shards.split_names(_named(spark, sf, [n for n, _ in _RENAMED]), heads=1, kv_heads=1, head_dim=1, intermediate=1).select("tensor", "value")


#: Canonical names and the fused ones (null: no counterpart, or a fused tensor that lacks a part).
_FUSED = [
    ("model.layers.{}.input_layernorm.weight", "model.language_model.decoder.layers.{}.input_layernorm.weight"), ("model.layers.{}.self_attn.o_proj.bias", "model.language_model.decoder.layers.{}.self_attention.linear_proj.bias"),
    ("model.layers.{}.mlp.down_proj.bias", "model.language_model.decoder.layers.{}.mlp.linear_fc2.bias"), ("model.layers.{}.self_attn.k_proj.weight", None), ("model.layers.{}.mystery", None), ("other.{}", None),
]


@query(f"SELECT tensor, value FROM (SELECT {_replaced([b for _, b in _FUSED])} AS tensor, CAST(p_retailprice AS DOUBLE) AS value FROM part) WHERE tensor IS NOT NULL")
def fused_names_only(spark: SparkSession, sf: str) -> DataFrame:
    return shards.fuse_names(_named(spark, sf, [n for n, _ in _FUSED])).select("tensor", "value")


@query(f"WITH {_E} SELECT vec_id, CAST((vec_id // 3) % 2 AS INT) AS rank, pos, value FROM e WHERE vec_id % 3 = 2")
def latest_shards(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as shards of three iterations, two ranks each; the last iteration is read."""
    e, path = elements(spark, sf), shared_folder(spark, "shards")
    rows = e.withColumns({"iteration": (F.col("vec_id") % 3).cast("int"), "rank": (F.floor(F.col("vec_id") / 3) % 2).cast("int")})
    rows.select("vec_id", "pos", "value", "iteration", "rank").write.partitionBy("iteration", "rank").parquet(path)
    return read_shards(spark, path).select("vec_id", "rank", "pos", "value")


@query("""WITH n AS (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'model.layers.' || p_size || '.w' WHEN 1 THEN 'x.Embed_tokens' WHEN 2 THEN 'lm_head.weight' WHEN 3 THEN 'final.norm' ELSE 'misc' END AS t, p_size FROM part)
SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'layers.' || p_size WHEN 1 THEN 'embeddings' WHEN 2 THEN 'head' WHEN 3 THEN 'norms' ELSE 'other' END AS layer FROM n""")
def layer_keys(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("p_size")
    name = F.when(s % 5 == 0, F.concat(F.lit("model.layers."), s.cast("string"), F.lit(".w"))).when(s % 5 == 1, "x.Embed_tokens").when(s % 5 == 2, "lm_head.weight").when(s % 5 == 3, "final.norm").otherwise("misc")
    return table(spark, sf, "part").select("p_partkey", layer_key(name).alias("layer"))
