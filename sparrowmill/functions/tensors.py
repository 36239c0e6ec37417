"""Names of tensors: layer keys, merge dimensions, canonical and fused names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of tensors outside layers, fused side and split side.
OUTER_NAMES = [
    ("embedding.word_embeddings.weight", "model.embed_tokens.weight"),
    ("output_layer.weight", "lm_head.weight"),
    ("decoder.final_layernorm.weight", "model.norm.weight"),
]
#: Other names of the same tensors, on the fused side only.
OUTER_ALIASES = [
    ("embedding.word_embedding.weight", "model.embed_tokens.weight"),
    ("encoder.final_layernorm.weight", "model.norm.weight"),
    ("decoder.final_norm.weight", "model.norm.weight"),
    ("encoder.final_norm.weight", "model.norm.weight"),
]
KINDS = ["weight", "bias"]
#: Modules of a layer that map one to one, fused side and split side.
LAYER_MODULES = [
    ("input_layernorm", "input_layernorm"),
    ("pre_mlp_layernorm", "post_attention_layernorm"),
    ("self_attention.linear_proj", "self_attn.o_proj"),
    ("mlp.linear_fc2", "mlp.down_proj"),
]
#: Norms that are kept inside the linear module behind them, on the fused side only.
INNER_NORMS = [
    ("self_attention.linear_qkv.layer_norm_", "input_layernorm."),
    ("mlp.linear_fc1.layer_norm_", "post_attention_layernorm."),
]
#: Fused tensors of a layer and their parts in row order.
FUSED_NAMES = {
    "self_attention.linear_qkv": ["self_attn.q_proj", "self_attn.k_proj", "self_attn.v_proj"],
    "mlp.linear_fc1": ["mlp.gate_proj", "mlp.up_proj"],
}
#: Prefixes that carry no meaning (one is taken off), the one that fused names get,
#: names of the stack of layers, and names whose tensors are split over columns.
PREFIXES = r"^((model|module)\.language_model|model|module)\."
FUSED_PREFIX = "model.language_model."
STACKS = "decoder|encoder"
COLUMN_SPLIT = "linear_proj|dense|fc2|dense_4h_to_h"


def layer_key(name: Column) -> Column:
    """layers.N for a name with a part ``layers``; else embeddings, head, norms or other."""
    parts, low = F.split(name, r"\."), F.lower(name)
    at = F.array_position(F.transform(parts, F.lower), "layers").cast("int")
    number = F.get(parts, at)
    return (
        F.when((at > 0) & number.isNotNull(), F.concat(F.lit("layers."), number))
        .when(low.contains("embed"), "embeddings").when(low.contains("lm_head") | low.contains("output"), "head").when(low.contains("norm"), "norms").otherwise("other")
    )


def merge_dimension(name: Column) -> Column:
    """1 for tensors whose shards stand side by side, 0 for those that stand below each other."""
    return F.when(F.lower(name).rlike(COLUMN_SPLIT), 1).otherwise(0)


def layer_names(gated: bool = True) -> list[tuple[str, str]]:
    """Names within a layer that map one to one, both ways; an MLP without a gate has only its up block."""
    modules = LAYER_MODULES + ([] if gated else [("mlp.linear_fc1", "mlp.up_proj")])
    return [(f"{a}.{k}", f"{b}.{k}") for a, b in modules for k in KINDS]


def fused_names(gated: bool = True) -> dict[str, list[str]]:
    return FUSED_NAMES if gated else {k: v for k, v in FUSED_NAMES.items() if k != "mlp.linear_fc1"}


def bare_name(name: Column) -> Column:
    """Without a meaningless prefix."""
    return F.regexp_replace(name, PREFIXES, "")
