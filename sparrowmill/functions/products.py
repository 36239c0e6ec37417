"""Texts about products: descriptions, price tiers, weights, entity structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The wording of descriptions and the values of status.
WORDS = {"is": "是", "kind": "的一款", "of": "属于", "point": "主打", "costs": "售价", "unreleased": "目前尚未发布", "selling": "目前在售", "comma": "，", "stop": "。", "and": "、", "open_price": "待", "ten_thousand": "万", "status_unreleased": "即将发布", "status_selling": "在售"}


def is_priced(price: Column) -> Column:
    """A price that is there and settled."""
    return F.coalesce((price != "") & ~price.contains(WORDS["open_price"]), F.lit(False))


def _filled(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False))


def _joined(items: Column, most: int | None = None) -> Column:
    return F.array_join(items if most is None else F.slice(items, 1, most), WORDS["and"])


def describe_full(name="name", company="company", category="category", series="series", positioning="positioning", points="talking_points", price="price", status="status") -> Column:
    """One sentence of clauses, each only where its field is there."""
    w, c = WORDS, F.col
    some = lambda a: F.coalesce(F.size(c(a)) > 0, F.lit(False))
    clauses = [
        F.concat(c(name), F.lit(w["is"]), c(company), F.lit(w["kind"]), c(category)),
        F.when(_filled(c(series)), F.concat(F.lit(w["of"]), c(series))),
        F.when(some(positioning), _joined(c(positioning))),
        F.when(some(points), F.concat(F.lit(w["point"]), _joined(c(points), 3))),
        F.when(is_priced(c(price)), F.concat(F.lit(w["costs"]), c(price))),
        F.when(c(status) == w["status_unreleased"], F.lit(w["unreleased"])).when(c(status) == w["status_selling"], F.lit(w["selling"])),
    ]
    return F.concat(F.concat_ws(w["comma"], *clauses), F.lit(w["stop"]))


def describe_short(name="name", company="company", category="category", points="talking_points", price="price") -> Column:
    """The shortest of three forms that the product's points and price allow."""
    w, c = WORDS, F.col
    pts, text = F.coalesce(_joined(c(points), 2), F.lit("")), lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    cost = F.coalesce(c(price), F.lit(""))
    head = text(c(name), ", ", c(company), c(category), ", ")
    return (
        F.when((pts != "") & is_priced(c(price)), text(head, pts, ", ", cost, w["stop"])).when(pts != "", text(head, w["point"], pts, w["stop"]))
        .otherwise(text(c(name), w["is"], c(company), w["kind"], c(category), ", ", cost, w["stop"]))
    )


def is_high_tier(price: Column, above: int = 8000) -> Column:
    """In ten thousands, or with a number above the limit."""
    numbers = F.regexp_extract_all(price, F.lit(r"([\d,]+)"), F.lit(1))
    return price.contains(WORDS["ten_thousand"]) | F.exists(numbers, lambda x: F.coalesce(F.replace(x, F.lit(","), F.lit("")).try_cast("bigint") > above, F.lit(False)))


def weight(point: Column) -> Column:
    """The first weight in grams in a text, or null."""
    return F.nullif(F.regexp_extract(point, r"(\d+\.?\d*g)", 1), F.lit(""))


def is_figure(point: Column) -> Column:
    """A talking point that begins with a figure or a price."""
    return point.rlike(r"^(\d|¥)")


def entity(mention: Column, value: Column | None = None, prefix: str = "") -> Column:
    """A mention with a text, or with name, category, series and price of a product."""
    of = lambda c: F.col(prefix + c).cast("string")
    none = F.lit(None).cast("string")
    fields = [none] * 4 if value is not None else [of("name"), of("category"), of("series"), F.coalesce(of("price"), F.lit(""))]
    return F.struct(mention.alias("mention"), (value if value is not None else none).alias("value"), *[f.alias(n) for f, n in zip(fields, ("name", "category", "series", "price"), strict=True)])


def format_entities(entities: Column) -> Column:
    """Map from mention to (value, name, category, series, price); of a mention given twice the last counts."""
    body = lambda e: F.struct(*[e[n].alias(n) for n in ("value", "name", "category", "series", "price")])
    last = F.filter(entities, lambda e, i: ~F.exists(F.slice(entities, i + 2, F.size(entities)), lambda later: later["mention"] == e["mention"]))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["mention"], body(e))))
