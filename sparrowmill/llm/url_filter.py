"""URL verdicts from rules and from a tree of path templates for each host.

Rules come first: the longest that fits decides. Other urls are judged by their template. Distinct
lexical shapes of paths (digit runs and long hex strings as placeholders) form a tree for each
host. Going down the levels that have work, a segment becomes a wildcard where its node has many children and
the child holds little of it, unless its labels set it apart from the others that do; then, from
the top, sibling branches that differ in one literal segment are merged where their labelled shares
do not differ significantly from the siblings' together. A template is rejected if its smoothed share of good labelled pages is too low. All steps
work on counts of distinct shapes, so a host with any number of pages is a few rows.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StringType, StructType

from sparrowmill.llm.storage import materialize

#: Production rules: (action, host and path prefix).
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty for null or without ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits (null if none does) and its action; of equal ones the first counts."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, text in sorted(rules, key=lambda r: len(r[1])):
        own, slash, rest = text.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(slash + rest))
        longer = rule.isNull() | (F.length(rule) < len(text))
        rule, action = F.when(fits & longer, F.lit(text)).otherwise(rule), F.when(fits & longer, F.lit(act)).otherwise(action)
    return rule, action


def shape(path: Column) -> Column:
    """Segments with placeholders for digit runs and long hex strings."""
    general = F.regexp_replace(F.regexp_replace(path, r"(?i)(?<![0-9a-z])(?=[0-9a-f-]*[0-9])[0-9a-f-]{16,}(?![0-9a-z])", "<hex>"), r"[0-9]+", "<n>")
    return F.split(F.regexp_replace(general, "^/", ""), "/")


_PLACE = StructType().add("level", IntegerType()).add("seg", StringType()).add("node", BinaryType()).add("frame", BinaryType())


def _chained(parts: list[str]) -> list[bytes]:
    """Digests of the starts of a list, from the empty one on."""
    out = [b""]
    for part in parts:
        own = part.encode()
        out.append(hashlib.blake2b(out[-1] + len(own).to_bytes(4, "little") + own, digest_size=16).digest())
    return out


def _all_places(templates: pa.Array) -> pa.Array:
    out = []
    for parts in templates.to_pylist():
        before, after = _chained(parts), _chained(parts[::-1])[::-1]
        size = len(parts).to_bytes(4, "little")
        out.append([{"level": i, "seg": seg, "node": before[i], "frame": size + before[i] + b"|" + after[i + 1]} for i, seg in enumerate(parts)])
    return pa.array(out, pa.list_(pa.struct([("level", pa.int32()), ("seg", pa.string()), ("node", pa.binary()), ("frame", pa.binary())])))


_places = F.arrow_udf(_all_places, ArrayType(_PLACE))


def places(shapes: DataFrame, least: int) -> DataFrame:
    """(host, n, level, seg, node, frame) of each segment from a level on; node and frame are digests of what
    comes before it, and of all but it. Time and space go with the length of paths."""
    each = shapes.select("host", "n", F.explode(_places("t")).alias("x")).select("host", "n", "x.*")
    return each.where(F.col("level") >= least)


def next_wide_level(shapes: DataFrame, least: int, most_children: int, least_share: float) -> int | None:
    """The first level from ``least`` on at which generalise() has a child to look at."""
    children = places(shapes, least).groupBy("host", "level", "node", "seg").agg(F.sum("n").alias("held"))
    nodes = children.groupBy("host", "level", "node").agg(F.count(F.lit(1)).alias("children"), F.min("held").alias("smallest"), F.sum("held").alias("all"))
    return nodes.where((F.col("children") > most_children) & (F.col("smallest") < least_share * F.col("all"))).agg(F.min("level")).first()[0]


def next_alike_level(shapes: DataFrame, least: int) -> int | None:
    """The first level from ``least`` on at which merge_branches() has branches that differ there alone."""
    frames = places(shapes, least).groupBy("host", "level", "frame").agg(F.min("seg").alias("a"), F.max("seg").alias("b"))
    return frames.where("a != b").agg(F.min("level")).first()[0]


def _with_segment(segments: Column, level: int, value: Column) -> Column:
    return F.transform(segments, lambda x, i: F.when(i == level, value).otherwise(x))


def _within(p: Column, z: float) -> Column:
    """Whether the good share of a branch with g good of l labelled pages lies within z standard errors of p."""
    return F.abs(F.col("g") / F.col("l") - p) <= z * F.sqrt(p * (1 - p) / F.col("l")) + 1e-12


def generalise(shapes: DataFrame, level: int, most_children: int, least_share: float, z: float, least_labelled: float) -> DataFrame:
    """``shapes`` (host, t, n, …) with the segment of ``t`` at ``level`` as a wildcard where it varies:
    its node has more than most_children children, this one holds less than least_share of it, and
    its labels don't set it apart. They do if it has least_labelled labelled pages or more, in all
    or below some start of what follows the segment, whose good share lies beyond z standard errors
    of the share that all such children have there."""
    keyed = shapes.withColumns({"node": F.array_join(F.slice("t", 1, level), "/") if level else F.lit(""), "seg": F.get("t", F.lit(level))})
    children = keyed.where("seg is not null").groupBy("host", "node", "seg").agg(F.sum("n").alias("held"))
    nodes = children.groupBy("host", "node").agg(F.count(F.lit(1)).alias("children"), F.sum("held").alias("all"))
    small = children.join(nodes.where(F.col("children") > most_children), ["host", "node"]).where(F.col("held") < least_share * F.col("all")).select("host", "node", "seg")
    below = F.slice("t", level + 2, F.size("t"))
    starts = F.transform(F.sequence(F.lit(0), F.size(below)), lambda k: F.slice(below, F.lit(1), k))
    branches = keyed.where("labelled > 0").join(small, ["host", "node", "seg"]).select("host", "node", "seg", "good", "labelled", F.explode(starts).alias("rest"))
    branches = branches.groupBy("host", "node", "rest", "seg").agg(F.sum("good").alias("g"), F.sum("labelled").alias("l"))
    whole = branches.groupBy("host", "node", "rest").agg((F.sum("g") / F.sum("l")).alias("p"))
    apart = branches.where(F.col("l") >= least_labelled).join(whole, ["host", "node", "rest"]).where(~_within(F.col("p"), z)).select("host", "node", "seg").distinct()
    wild = small.join(apart, ["host", "node", "seg"], "left_anti")
    out = keyed.join(wild.select("host", "node", "seg", F.lit(True).alias("wild")), ["host", "node", "seg"], "left")
    return out.withColumn("t", F.when(F.col("wild"), _with_segment(F.col("t"), level, F.lit("<*>"))).otherwise(F.col("t"))).select(*shapes.columns)


def merge_branches(shapes: DataFrame, level: int, z: float) -> DataFrame:
    """``shapes`` with literal segments at ``level`` joined into one branch where they are alike:
    the branch's good share lies within z standard errors of the share of all branches that have
    the same rest of the template. Branches without labels are alike."""
    seg = F.get("t", F.lit(level))
    keyed = shapes.withColumns({"seg": seg, "frame": F.array_join(_with_segment(F.col("t"), level, F.lit("<|>")), "/")})
    branches = keyed.where("seg is not null").groupBy("host", "frame", "seg").agg(F.sum("good").alias("g"), F.sum("labelled").alias("l"))
    frames = branches.groupBy("host", "frame").agg(F.sum("g").alias("fg"), F.sum("l").alias("fl"), F.count(F.lit(1)).alias("k")).where("k > 1")
    p = F.try_divide(F.col("fg"), F.col("fl"))
    alike = (F.col("l") == 0) | _within(p, z)
    same = branches.join(frames, ["host", "frame"]).where(alike).select("host", "frame", "seg", F.lit(True).alias("alike"))
    out = keyed.join(same, ["host", "frame", "seg"], "left")
    return out.withColumn("t", F.when(F.col("alike"), _with_segment(F.col("t"), level, F.lit("<|>"))).otherwise(F.col("t"))).select(*shapes.columns)


def judge_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]] = RULES, page_id: str = "page_id", url: str = "url", most_children: int = 16, least_share: float = 0.1, z: float = 1.96, prior_weight: float = 8.0, least_purity: float = 0.5) -> DataFrame:
    """One row for each row of ``pages``: page_id, host, path, rule, verdict, template.

    ``labels`` has doc_id (a page_id) and quality; 1 is good, 0 bad, others are ignored, the lowest
    of several counts. The smoothed purity of a template is (good + w p) / (labelled + w), with p the
    good share of all labelled pages and w the prior weight; without labels p counts as 1. From w
    labelled pages on a child is held against its siblings before it becomes a wildcard. Null urls
    and urls without :// have empty host and path and their own template. Other columns are ignored.
    """
    host, path = url_parts(F.col(url).cast("string"))
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumns({"s": shape(F.col("path"))})
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").alias("page_id")).agg(F.min("quality").alias("good"))
    counted = rows.select("page_id", "host", "s").join(known, "page_id", "left")
    counted = counted.groupBy("host", "s").agg(F.count(F.lit(1)).alias("n"), F.count("good").alias("labelled"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    shapes = materialize(counted.withColumn("t", F.col("s")), "url-shapes")
    # Jobs follow the levels that have work, not the depth of paths.
    level = 0
    while (level := next_wide_level(shapes, level, most_children, least_share)) is not None:
        shapes = materialize(generalise(shapes, level, most_children, least_share, z, prior_weight), "url-tree")
        level += 1
    level = 0
    while (level := next_alike_level(shapes, level)) is not None:
        shapes = materialize(merge_branches(shapes, level, z), "url-tree")
        level += 1
    whole = shapes.agg(F.sum("good").alias("g"), F.sum("labelled").alias("l")).first()
    p = whole.g / whole.l if whole.l else 1.0
    templates = shapes.groupBy("host", "t").agg(F.sum("good").alias("good"), F.sum("labelled").alias("labelled"))
    purity = (F.col("good") + F.lit(prior_weight * p)) / (F.col("labelled") + F.lit(prior_weight))
    judged = shapes.select("host", "s", "t").join(templates.select("host", "t", purity.alias("purity")), ["host", "t"])
    judged = judged.select("host", "s", F.array_join("t", "/").alias("template"), (F.col("purity") >= least_purity).alias("pure"))
    rule, action = fitting_rule(F.col("host"), F.col("path"), rules)
    out = rows.join(judged, ["host", "s"], "left")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(action, F.when(F.col("pure"), "allow").otherwise("block")).alias("verdict"), F.concat(F.lit("/"), F.col("template")).alias("template"))


NAME, SQL = "op3_url_filter", None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
