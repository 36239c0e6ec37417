"""Text as the scoring and corpus operators see it: Unicode trimming, prompts, leading numbers."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_BLANK = r"[\s\p{Z}\x1c-\x1f\x85]+"
#: Prompt templates by name.
PRESETS = {
    "default": "{instruction}\n{input}",
    "chatml": "<|im_start|>user\n{instruction}\n{input}<|im_end|>\n<|im_start|>assistant\n",
    "qwen": "<|im_start|>system\nYou are a helpful assistant.<|im_end|>\n<|im_start|>user\n{instruction}\n{input}<|im_end|>\n<|im_start|>assistant\n",
}


def trim_u(c: Column) -> Column:
    """Without white space of any script at both ends (SQL trim takes the space only)."""
    return F.regexp_replace(c, rf"\A{_BLANK}|{_BLANK}\z", "")


def fill_template(template: str, **values: Column) -> Column:
    """``template`` with each {name} replaced; values are never expanded again."""
    parts = re.split("(" + "|".join(re.escape("{" + k + "}") for k in values) + ")", template)
    return F.concat(*[values[p[1:-1]] if p.startswith("{") and p[1:-1] in values else F.lit(p) for p in parts])


def render_prompt(instruction: Column, given: Column, template: str = "default") -> Column:
    """The prompt of a sample: the filled template, or the bare input where there is no instruction.

    A null field reads as the text None, an absent one should be passed as an empty literal.
    """
    i, g = (trim_u(F.coalesce(c, F.lit("None"))) for c in (instruction, given))
    return F.when(i != "", fill_template(PRESETS.get(template, template), instruction=i, input=g)).otherwise(g)


def reference_text(c: Column) -> Column:
    """A reference as text; null reads as None."""
    return F.coalesce(c.cast("string"), F.lit("None"))


@F.arrow_udf(StringType())
def _python_text(wrapped: pa.Array) -> pa.Array:
    def text(one: str | None) -> str | None:
        value = None if one is None else json.loads(one).get("v")
        return None if value is None else json.dumps(value, ensure_ascii=False) if isinstance(value, dict | list) else str(value)

    return pa.array([text(x) for x in wrapped.to_pylist()], pa.string())


def value_text(df: DataFrame, name: str) -> Column:
    """A column of any type as the text that Python gives its values: containers as JSON with a space after
    commas and colons and nulls kept, True and False, 1.0 and 1e+16. Strings are as they are; null stays."""
    kind = df.schema[name].dataType.typeName()
    if kind in ("string", "varchar", "char", "byte", "short", "integer", "long"):
        return F.col(name).cast("string")
    return _python_text(F.to_json(F.struct(F.col(name).alias("v")), {"ignoreNullFields": "false"}))


def first_number(c: Column) -> Column:
    """The first run of digits, commas and dots, or null."""
    return F.nullif(F.regexp_extract(c, r"(?U)[\d,.]+", 0), F.lit(""))


def number_value(c: Column) -> Column:
    """``first_number`` as a double; null where it is no number."""
    return F.replace(first_number(c), F.lit(","), F.lit("")).try_cast("double")


def characters(c: Column) -> Column:
    """The distinct code points of a text; none for the empty text."""
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(F.split(c, "")))
