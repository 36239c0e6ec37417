"""Field-level comparison of JSON documents, row by row in one Arrow function.

Each document is laid out as tables: the children of every container, by the container's path and
kind. Two documents meet in the containers they share, so a field is compared where its parent is a
container of one kind on both sides, at the root always, and not where it is such a container itself
(two empty ones are a point). A point scores 1 if the trimmed texts agree; what is missing, or null,
is the empty text. Numbers are exact, whatever their size. Nothing is shuffled or stored, so the depth
of documents has no part in the plan.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructType

from sparrowmill.functions.text import trim_u

_NOTHING = object()


def lenient_json(text: Column) -> Column:
    """A VARIANT of the whole text; else of what lies between the first { and the last }; else
    between [ and ]; null if none of them is JSON."""
    t = trim_u(text)
    tries = [F.try_parse_json(t)]
    for a, b in ("{}", "[]"):
        first, last = F.instr(t, a), F.length(t) - F.instr(F.reverse(t), b) + 1
        tries.append(F.try_parse_json(F.when((first > 0) & F.contains(t, F.lit(b)) & (last > first), F.substring(t, first, last - first + 1))))
    return F.coalesce(*tries)


def document(text: str) -> object:
    """The value of a text, or of what lies between its outer braces or brackets; _NOTHING without any.

    As usual in Python, the last of equal keys counts, and NaN is a number. Documents nested too deep for
    the parser (thousands of levels) are no documents.
    """
    text = text.strip()
    spans = [(0, len(text)), *((text.find(a), text.rfind(b) + 1) for a, b in ("{}", "[]"))]
    for first, end in spans:
        if 0 <= first < end:
            try:
                return json.loads(text[first:end])
            except (ValueError, RecursionError):
                pass
    return _NOTHING


def tables(value: object) -> dict[tuple, dict[str, object]]:
    """The children of each container by its (path, kind); the document is the one child of the top.

    Steps of objects are .name, of arrays [i].
    """
    found: dict[tuple, dict[str, object]] = {}
    waiting: list[tuple] = [((), None, {"": value})]
    while waiting:
        path, kind, children = waiting.pop()
        found[path, kind] = children
        for step, child in children.items():
            if isinstance(child, dict):
                waiting.append(((*path, step), dict, {f".{k}": v for k, v in child.items()}))
            elif isinstance(child, list):
                waiting.append(((*path, step), list, {f"[{i}]": v for i, v in enumerate(child)}))
    return found


def points(left: object, right: object) -> Iterator[tuple[list[str], float]]:
    """The (path, score) of every point at which two documents are compared."""
    text = lambda x: "" if x is None else str(x).strip()
    a, b = tables(left), tables(right)
    for at in a.keys() & b.keys():
        for step in a[at].keys() | b[at].keys():
            x, y = a[at].get(step), b[at].get(step)
            alike = isinstance(x, dict | list) and type(x) is type(y)
            if not alike or not (x or y):
                path = [s for s in (*at[0], step) if s]
                yield [s.encode("utf-8", "backslashreplace").decode() for s in path], float(alike or text(x) == text(y))


_FIELD = StructType().add("path", ArrayType(StringType())).add("score", DoubleType())
_RESULT = StructType().add("fields", ArrayType(_FIELD)).add("accuracy", DoubleType()).add("exact", DoubleType())


def _compare(prediction: pa.Array, reference: pa.Array) -> pa.Array:
    out = []
    for p, r in zip(prediction.to_pylist(), reference.to_pylist(), strict=True):
        if p is None:
            out.append(None)
            continue
        a, b = document(p), document(r)
        fields, accuracy = [], float(p.strip() == r.strip())
        try:
            exact = float((p if a is _NOTHING else a) == (r if b is _NOTHING else b))
            if isinstance(a, dict | list) and isinstance(b, dict | list):
                fields = [{"path": path, "score": score} for path, score in points(a, b)]
                accuracy = sum(f["score"] for f in fields) / len(fields)
        except RecursionError:  # too deep to be compared or printed: texts
            fields, exact = [], float(p == r)
        out.append({"fields": fields, "accuracy": accuracy, "exact": exact})
    field = pa.struct([("path", pa.list_(pa.string())), ("score", pa.float64())])
    return pa.array(out, pa.struct([("fields", pa.list_(field)), ("accuracy", pa.float64()), ("exact", pa.float64())]))


_compared = F.arrow_udf(_compare, _RESULT)


def compared(prediction: Column, reference: Column) -> Column:
    """A struct of fields (path, score; none where a side is no container), accuracy (their mean, or
    equality of the trimmed texts) and exact (parsed values are equal, whatever the order of keys, with
    true as 1 and 1 as 1.0; texts that are no JSON as they are). A null reference is the text None; a
    null prediction has no scores."""
    return _compared(prediction.cast("string"), F.coalesce(reference.cast("string"), F.lit("None")))


def path_text(path: Column) -> Column:
    """a.b[0] of a path; the root is value."""
    return F.when(F.size(path) == 0, F.lit("value")).otherwise(F.regexp_replace(F.array_join(path, ""), r"^\.", ""))


def json_field_scores(rows: DataFrame, key: str, prediction: str = "prediction", reference: str = "reference") -> DataFrame:
    """(key, path, score) of all rows in which both sides are containers."""
    each = rows.select(F.col(key).alias("key"), compared(F.col(prediction), F.col(reference)).alias("c"))
    return each.select("key", F.explode("c.fields").alias("f")).select("key", "f.path", "f.score")


def json_accuracy(rows: DataFrame, key: str, prediction: str = "prediction", reference: str = "reference") -> DataFrame:
    """(key, json_accuracy) of each row: the mean of its field scores, or equality of the trimmed
    texts where a side is no container."""
    return rows.select(key, compared(F.col(prediction), F.col(reference))["accuracy"].alias("json_accuracy"))


def field_accuracy(fields: DataFrame) -> DataFrame:
    """(field, score, n): the mean of each path over the rows in which it is compared."""
    return fields.groupBy(path_text(F.col("path")).alias("field")).agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("n"))


def json_exact_match(rows: DataFrame, key: str, prediction: str = "prediction", reference: str = "reference") -> DataFrame:
    """(key, json_exact_match) of each row, as in ``compared``."""
    return rows.select(key, compared(F.col(prediction), F.col(reference))["exact"].alias("json_exact_match"))
