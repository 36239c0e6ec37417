"""Quotas of samples by label, and the requests that fill them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrowmill.functions.text import trim_u
from sparrowmill.operators.windows import batches, first_rows, numbered


def combinations(labels: DataFrame, tasks: DataFrame, types: DataFrame) -> DataFrame:
    """(label, task, type, combined): labels with every task and the types that suit their flag.

    Type S is for flagged labels, N and C for the others, further types for all. ``labels`` has
    (label, flagged), ``tasks`` (task), ``types`` (type, target); all three are short dimension tables.
    """
    rows = labels.crossJoin(F.broadcast(tasks)).crossJoin(F.broadcast(types))
    suits = F.when(F.col("type") == "S", F.col("flagged")).when(F.col("type").isin("N", "C"), ~F.col("flagged")).otherwise(True)
    return rows.where(suits).withColumn("combined", F.concat_ws("-", F.lit("BX"), "label", "task", "type"))


def remaining(quotas: DataFrame, existing: DataFrame, label: str = "label", target: str = "target") -> DataFrame:
    """``quotas`` with have and need, what is missing of the target; ``existing`` has (label, n)."""
    have = existing.select(F.col("label").alias("_label"), F.col("n").alias("have"))
    rows = quotas.join(have, quotas[label] == F.col("_label"), "left").drop("_label").withColumn("have", F.coalesce("have", F.lit(0)).cast("long"))
    return rows.withColumn("need", F.greatest(F.lit(0), F.col(target) - F.col("have")).cast("long"))


def unfinished(quotas: DataFrame) -> DataFrame:
    """Quotas that need more."""
    return quotas.where("need > 0")


def rotated(rows: DataFrame, dimensions: dict[str, list[str]], lengths: list[str] | list[tuple[str, int, int]], flagged: str | None = None, flagged_only: str | None = None, kind: list[str] = (), order: str = "slot") -> DataFrame:
    """``rows`` with a value of each dimension and a length by rotation.

    Within each kind the i-th row takes value i mod size of every dimension. Once all dimensions are
    back at their first values together, each time round shifts the length by one, on top of i mod
    the number of lengths. A dimension named by flagged_only is for rows whose ``flagged`` column is
    true. Lengths are names, or (name, least, most), which add min_len and max_len.
    """
    out = numbered(rows, list(kind), [order], "_place").withColumn("_i", F.col("_place") - 1)
    pick = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))
    for name, values in dimensions.items():
        value = pick(values, F.col("_i") % len(values))
        out = out.withColumn(name, F.when(F.col(flagged), value) if name == flagged_only else value)
    cycle = math.lcm(*map(len, dimensions.values()))
    at = (F.col("_i") + F.floor(F.col("_i") / cycle)) % len(lengths)
    fields = [[x] if isinstance(x, str) else x for x in lengths]
    return out.withColumns({n: pick(values, at) for n, values in zip(("length", "min_len", "max_len"), zip(*fields, strict=True), strict=False)}).drop("_i", "_place")


def batch_slots(quotas: DataFrame, batch_size: int = 5) -> DataFrame:
    """``quotas`` with batch and slot, a row for each sample that is to come; slots count on over the batches of a label."""
    rows = batches(quotas, batch_size)
    first = F.col("batch").cast("long") * batch_size
    return rows.withColumn("slot", F.explode(F.sequence(first, first + F.col("batch_size") - 1)))


def constraint_lines(rows: DataFrame, group: list[str], order: str, line: Column) -> DataFrame:
    """(*group, constraints): the rows of a batch as numbered lines; a batch is small by construction."""
    numbered = rows.select(*group, F.col(order).alias("_o"), line.alias("_line"))
    lists = numbered.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("_o", "_line"))).alias("_l"))
    return lists.select(*group, F.array_join(F.transform("_l", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["_line"])), "\n").alias("constraints"))


def seeds_of(seeds: DataFrame, label: str = "label", order: str = "line", most: int = 3) -> DataFrame:
    """(label, seeds): the first seed texts of each label."""
    few = first_rows(seeds, [label], [order], most)
    return few.groupBy(F.col(label).alias("label")).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]).alias("seeds"))


def requests(quotas: DataFrame, dimension: DataFrame, seeds: DataFrame, template: str, batch_size: int = 5, entities: DataFrame | None = None, most_entities: int = 5, constraints: DataFrame | None = None) -> DataFrame:
    """A row for each batch that a quota needs: label, batch, batch_size, request.

    ``quotas`` has (label, need), ``dimension`` (label, name, description), ``seeds`` (label, line,
    text), ``entities`` (kind, ord, value), ``constraints`` (label, batch, constraints). The template
    may hold {label}, {name}, {description}, {count}, {seeds}, {constraints} and {kind} for each kind of entity. Labels that need nothing give no row, and
    labels beyond the dimension keep their own name.
    """
    from sparrowmill.operators.generators import fill

    rows = batches(quotas, batch_size).join(dimension, "label", "left").join(seeds_of(seeds), "label", "left")
    slots = {"label": F.col("label"), "name": F.coalesce("name", "label"), "description": F.coalesce("description", F.lit("")), "count": F.col("batch_size").cast("string"), "seeds": F.coalesce(F.array_join("seeds", "\n"), F.lit(""))}
    if constraints is not None:
        rows = rows.join(constraints, ["label", "batch"], "left")
        slots["constraints"] = F.coalesce("constraints", F.lit(""))
    if entities is not None:
        few = first_rows(entities, ["kind"], ["ord"], most_entities).groupBy("kind").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "value"))), lambda x: x["value"]), ", ").alias("v"))
        kinds = few.agg(F.map_from_entries(F.collect_list(F.struct("kind", "v"))).alias("_entities"))
        rows = rows.crossJoin(F.broadcast(kinds))  # one row
    known = F.map_from_arrays(F.array(*[F.lit(k) for k in slots]), F.array(*slots.values()))
    known = known if entities is None else F.map_concat(known, F.coalesce("_entities", F.create_map().cast("map<string,string>")))
    return rows.select("label", "batch", "batch_size", fill(F.lit(template), known).alias("request"))


def augmentations(labels: DataFrame, templates: DataFrame) -> DataFrame:
    """(label, kind, request): each rewrite instruction of ``templates`` (kind, template) for each label."""
    from sparrowmill.operators.generators import fill

    slots = F.map_from_arrays(F.array(F.lit("label"), F.lit("name")), F.array("label", F.coalesce("name", "label")))
    return labels.crossJoin(F.broadcast(templates)).select("label", "kind", fill(F.col("template"), slots).alias("request"))  # a written list


def described_type(code: Column, texts: dict[str, str]) -> Column:
    """The description of a type; a code without one stays as it is."""
    known = F.create_map(*[F.lit(x) for kv in texts.items() for x in kv])
    return F.coalesce(F.try_element_at(known, code), code)


SAMPLE = "array<struct<text:string,label:string,category:string,is_sarcastic:boolean,cot:string>>"


def with_samples(responses: DataFrame, schema: str = SAMPLE, content: str = "content") -> DataFrame:
    """Responses with _samples, the array of samples that their text holds, or null.

    Tried in turn: the trimmed text, the text within a code fence, what lies between the first [ and
    the last ], between the first { and the last }; each as an array, or as an object whose samples
    or data is one. What comes later is parsed only where nothing was found before.
    """
    t = trim_u(F.col(content))
    fence = F.regexp_replace(t, r"(?s)\A```[a-zA-Z]*\s*(.*?)\s*```\z", "$1")
    texts = [t, fence, F.regexp_extract(t, r"(?s)\[.*\]", 0), F.regexp_extract(t, r"(?s)\{.*\}", 0)]
    within = f"struct<samples:{schema},data:{schema}>"
    tries = []
    for x in texts:
        # An object is parsed once, and taken apart in an array of one.
        inside = F.transform(F.array(F.from_json(x, within)), lambda o: F.coalesce(o["samples"], o["data"]))
        tries += [F.when(F.trim(x).startswith("["), F.from_json(x, schema)), F.when(F.trim(x).startswith("{"), F.get(inside, F.lit(0)))]
    held = [F.get(F.filter(F.array(x), lambda s: F.size(s) > 0), F.lit(0)) for x in tries]
    return responses.withColumn("_samples", F.coalesce(*held))


def samples_and_rejects(found: DataFrame, schema: str = SAMPLE, content: str = "content") -> tuple[DataFrame, DataFrame]:
    """Of responses with _samples: the samples, which keep the other columns of their response, and the
    responses without any, which get an error with the first 500 characters."""
    names = [c for c in found.columns if c not in (content, "_samples")]
    kept = [F.col(c) for c in names]
    rejects = found.where("_samples is null").select(*kept, F.concat(F.lit("no samples in: "), F.substring(F.col(content), 1, 500)).alias("error"))
    names = [f"request_{c}" if c in schema else c for c in names]
    return found.where("_samples is not null").select(*[k.alias(n) for k, n in zip(kept, names, strict=True)], F.explode("_samples").alias("_s")).select(*names, "_s.*"), rejects


def parse_responses(responses: DataFrame, schema: str = SAMPLE, content: str = "content") -> tuple[DataFrame, DataFrame]:
    """Samples of response texts, and the responses that hold none, as of with_samples and samples_and_rejects."""
    return samples_and_rejects(with_samples(responses, schema, content), schema, content)


def fill_defaults(samples: DataFrame, dimension: DataFrame) -> DataFrame:
    """Samples with label, category and flag taken from their request's label where they lack them.

    ``samples`` has request_label; ``dimension`` (label, name, is_sarcastic).
    """
    dim = dimension.select(F.col("label").alias("_l"), F.col("name").alias("_n"), F.col("is_sarcastic").alias("_f"))
    rows = samples.join(F.broadcast(dim), F.col("request_label") == F.col("_l"), "left")  # a written list
    return rows.withColumns({"label": F.coalesce("label", "request_label"), "category": F.coalesce("category", "_n"), "is_sarcastic": F.coalesce("is_sarcastic", "_f")}).drop("_l", "_n", "_f")
