"""Shards of parameter tables: merging ranks, and renaming fused and split tensors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparrowmill.functions.tensors import FUSED_PREFIX, INNER_NORMS, KINDS, OUTER_ALIASES, OUTER_NAMES, STACKS, bare_name, fused_names, layer_names, merge_dimension


def latest_iteration(shards: DataFrame, iteration: int | None = None) -> DataFrame:
    """The rows of an iteration, the latest by default; on a partition column this prunes folders."""
    if iteration is not None:
        return shards.where(F.col("iteration") == iteration)
    return shards.where(F.col("iteration") == shards.agg(F.max("iteration")).scalar())


def merge_shards(shards: DataFrame) -> DataFrame:
    """(tensor, row, col, value) of rows (rank, tensor, row, col, value).

    Shards stand below or beside each other by the tensor's merge dimension. A tensor that some
    rank lacks, or whose shards differ in shape, is the one of the lowest rank that has it. Elements
    stay where they are; only shapes, a row for each tensor and rank, are aggregated and joined.
    """
    shapes = shards.groupBy("tensor", "rank").agg((F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"))
    ranks = shards.select("rank").distinct().agg(F.count(F.lit(1)).alias("ranks"))
    per = shapes.groupBy("tensor").agg(F.count(F.lit(1)).alias("have"), F.min("rank").alias("first"), F.max("rows").alias("rows"), F.max("cols").alias("cols"), (F.countDistinct("rows", "cols") == 1).alias("equal"))
    per = per.crossJoin(F.broadcast(ranks)).withColumn("whole", F.col("equal") & (F.col("have") == F.col("ranks")))  # one row
    place = shapes.select("tensor", "rank").join(per, "tensor")
    number = F.row_number().over(Window.partitionBy("tensor").orderBy("rank")) - 1
    place = place.withColumn("number", number).where("whole or rank = first").select("tensor", "rank", "rows", "cols", "whole", "number")
    out, side = shards.join(place, ["tensor", "rank"]), merge_dimension(F.col("tensor")) == 1
    row = F.when(F.col("whole") & ~side, F.col("row") + F.col("number") * F.col("rows")).otherwise(F.col("row"))
    col = F.when(F.col("whole") & side, F.col("col") + F.col("number") * F.col("cols")).otherwise(F.col("col"))
    return out.select("tensor", row.alias("row"), col.alias("col"), "value")


def with_positions(table: DataFrame) -> DataFrame:
    """``table`` (tensor, row, col, value) with pos, the element's place in row order."""
    widths = table.groupBy("tensor").agg((F.max("col") + 1).alias("width"))
    return table.join(widths, "tensor").withColumn("pos", F.col("row").cast("long") * F.col("width") + F.col("col")).drop("width")


def row_offsets(parts: DataFrame, group: list[str], order: str, rows: str) -> DataFrame:
    """``parts`` with row_offset, the rows of the parts before in the same group."""
    before = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("row_offset", F.coalesce(F.sum(rows).over(before), F.lit(0)))


def _layer(name: Column, stem: str) -> tuple[Column, Column]:
    pattern = rf"^(?:{stem})\.(\d+)\.(.+)$"
    return F.nullif(F.regexp_extract(name, pattern, 1), F.lit("")), F.regexp_extract(name, pattern, 2)


def _mapped(value: Column, pairs: list[tuple[str, str]]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for p in pairs for x in p]), value)


def split_names(table: DataFrame, heads: int, kv_heads: int, head_dim: int, intermediate: int, tied: bool = False, gated: bool = True, first_layer: int = 0) -> DataFrame:
    """``table`` (tensor, row, col, value) with fused tensors split by row ranges and canonical names.

    A meaningless prefix goes. Fused attention rows are query, key and value blocks of heads, kv_heads
    and kv_heads times head_dim rows; fused MLP rows are the gate and the up block, or without a gate
    the up block alone. Norms kept inside a linear module become the norm before it; biases stay
    biases. Layers are numbered from first_layer, where the table is one stage of several. A tied
    output is dropped. Unknown names, and rows beyond the blocks, pass as they are.
    """
    number, inner = _layer(F.col("bare"), rf"(?:{STACKS})\.layers")
    sizes = {"self_attention.linear_qkv": [heads * head_dim, kv_heads * head_dim, kv_heads * head_dim], "mlp.linear_fc1": [intermediate, intermediate]}
    own, shift = _mapped(F.col("inner"), layer_names(gated) + [(a + k, b + k) for a, b in INNER_NORMS for k in KINDS]), F.lit(0)
    for fused, parts in fused_names(gated).items():
        low = 0
        for part, rows in zip(parts, sizes[fused], strict=True):
            for kind in KINDS:
                hit = (F.col("inner") == f"{fused}.{kind}") & (F.col("row") >= low) & (F.col("row") < low + rows)
                own, shift = F.when(hit, f"{part}.{kind}").otherwise(own), F.when(hit, low).otherwise(shift)
            low += rows
    out = table.withColumn("bare", bare_name(F.col("tensor"))).withColumns({"number": number, "inner": inner})
    if tied:
        out = out.where(F.col("bare") != "output_layer.weight")
    layer = F.concat(F.lit("model.layers."), (F.col("number").cast("long") + first_layer).cast("string"), F.lit("."), own)
    return out.select(F.coalesce(layer, _mapped(F.col("bare"), OUTER_NAMES + OUTER_ALIASES), F.col("tensor")).alias("tensor"), (F.col("row") - shift).alias("row"), "col", "value")


def fuse_names(table: DataFrame, gated: bool = True, prefix: str = FUSED_PREFIX) -> DataFrame:
    """``table`` (tensor, row, col, value) the other way: parts are put below each other.

    A fused tensor is made only where all its parts are there, else those parts are dropped, as are
    names that have no fused counterpart. New names begin with ``prefix``.
    """
    number, inner = _layer(F.col("tensor"), r"model\.layers")
    out = table.withColumns({"number": number, "inner": inner})
    parts = [(p, fused, i, len(ps)) for fused, ps in fused_names(gated).items() for i, p in enumerate(ps)]
    kind, stem = F.regexp_extract("inner", r"\.(weight|bias)$", 0), F.regexp_replace("inner", r"\.(weight|bias)$", "")
    pick = lambda k: reduce(lambda c, p: F.when((F.col("stem") == p[0]) & (F.col("kind") != ""), F.lit(p[k])).otherwise(c), parts, F.lit(None))
    out = out.withColumns({"stem": stem, "kind": kind})
    out = out.withColumns({"fused": pick(1).cast("string"), "ord": pick(2).cast("int"), "of": pick(3).cast("int")})
    shapes = out.where("fused is not null").groupBy("number", "fused", "kind", "ord", "of").agg((F.max("row") + 1).alias("rows"))
    shapes = row_offsets(shapes, ["number", "fused", "kind"], "ord", "rows")
    shapes = shapes.withColumn("there", F.count(F.lit(1)).over(Window.partitionBy("number", "fused", "kind"))).where(F.col("there") == F.col("of"))
    layer = lambda c: F.concat(F.lit(f"{prefix}decoder.layers."), F.col("number"), F.lit("."), c)
    joined = out.where("fused is not null").join(shapes.select("number", "fused", "kind", "ord", "row_offset"), ["number", "fused", "kind", "ord"])
    joined = joined.select(layer(F.concat("fused", "kind")).alias("tensor"), (F.col("row") + F.col("row_offset")).alias("row"), "col", "value")
    plain = out.where("fused is null")
    swap = lambda pairs: [(b, a) for a, b in pairs]
    outer = F.concat(F.lit(prefix), _mapped(F.col("tensor"), swap(OUTER_NAMES)))
    name = F.when(F.col("number").isNotNull(), layer(_mapped(F.col("inner"), swap(layer_names(gated))))).otherwise(outer)
    plain = plain.select(name.alias("tensor"), "row", "col", "value").where("tensor is not null")
    return joined.unionByName(plain)
