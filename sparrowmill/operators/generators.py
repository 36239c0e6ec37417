"""Corpus rows from a product table: facts joined with a table of templates.

A generator is a function from products to facts (ord, slots, entities, case): slots are named
texts, entities the mentions that the question holds, and case selects templates that are meant for
one value only. Wording lives in the template table (generator, variant, case, question, answer), in
which {name} stands for a slot. Facts are explodes, groupings and joins; every product's facts are
made where the product is.
"""

from __future__ import annotations

import random
from bisect import bisect_right
from collections.abc import Callable
from functools import partial, reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparrowmill.functions.products import WORDS, describe_full, describe_short, entity, format_entities, is_figure, is_high_tier, is_priced, weight
from sparrowmill.functions.text import number_value
from sparrowmill.operators.windows import joined_names, seeded_sample
from sparrowmill.sources.shared import stored

_NAMES = ["company", "category", "series", "sub_series", "name", "generation", "price", "status"]
#: Products of a group are dealt to blocks of about so many, and pairs of blocks to tasks.
BLOCK = 8000
#: Groups of more than a block that are broadcast, at most.
MOST_BROADCAST = 500_000
#: Buckets of groups that a sample of pairs is spread over; the driver holds a number for each.
SAMPLE_BUCKETS = 4096


def slots(extra: dict[str, Column] | None = None, prefix: str = "") -> Column:
    """Map of a product's fields and descriptions, and what else is given."""
    cols = {n: F.col(prefix + n).cast("string") for n in _NAMES} | {"full": F.col(prefix + "full"), "short": F.col(prefix + "short"), "tier": F.when(F.col(prefix + "high"), "high").otherwise("middle")} | (extra or {})
    return F.map_from_arrays(F.array(*[F.lit(k) for k in cols]), F.array(*[F.coalesce(v, F.lit("")) for v in cols.values()]))


def _plain(extra: dict[str, Column]) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(k) for k in extra]), F.array(*[F.coalesce(v.cast("string"), F.lit("")) for v in extra.values()]))


def described(products: DataFrame) -> DataFrame:
    """Products with full, short and high, the texts and the tier that slots take."""
    return products.withColumns({"full": describe_full(), "short": describe_short(), "high": F.coalesce(is_high_tier(F.col("price")), F.lit(False))})


def _facts(df: DataFrame, slot: Column, entities: list[Column], case: Column | None = None, order: Column | None = None) -> DataFrame:
    return df.select((F.col("ord") if order is None else order).cast("long").alias("ord"), slot.alias("slots"), F.array(*entities).alias("entities"), (F.lit(None).cast("string") if case is None else case.cast("string")).alias("case"))


def aliases(products: DataFrame) -> DataFrame:
    df = products.withColumn("alias", F.explode("alias"))
    return _facts(df, slots({"alias": F.col("alias")}), [entity(F.col("alias"), F.col("name"))])


def each_product(products: DataFrame) -> DataFrame:
    return _facts(products, slots(), [entity(F.col("name"), F.col("name"))])


def positioning_groups(products: DataFrame, most: int = 5) -> DataFrame:
    df = products.select("ord", "name", "company", "category", F.explode("positioning").alias("positioning"))
    lists = joined_names(df, ["positioning"], "ord", F.col("name"), most).where(F.col("members") <= most)
    firsts = df.groupBy("positioning").agg(F.min("ord").alias("ord"), F.min_by("company", "ord").alias("company"), F.min_by("category", "ord").alias("category"))
    df = lists.join(firsts, "positioning")
    return _facts(df, _plain({c: F.col(c) for c in ("positioning", "names", "company", "category")}), [entity(F.col("positioning"), F.col("names"))])


def talking_points(products: DataFrame) -> DataFrame:
    df = products.withColumn("point", F.explode("talking_points")).where(~is_figure(F.col("point")))
    return _facts(df, slots({"point": F.col("point")}), [entity(F.col("point"), F.col("name"))])


def positionings(products: DataFrame) -> DataFrame:
    df = products.withColumn("positioning", F.explode("positioning"))
    return _facts(df, slots({"positioning": F.col("positioning")}), [entity(F.col("positioning"), F.col("name"))])


def points_and_positionings(products: DataFrame) -> DataFrame:
    """Talking points with case point, then positionings with case positioning."""
    return talking_points(products).withColumn("case", F.lit("point")).unionByName(positionings(products).withColumn("case", F.lit("positioning")))


def prices(products: DataFrame) -> DataFrame:
    df = products.where(is_priced(F.col("price")))
    return _facts(df, slots(), [entity(F.col("name"), F.col("price"))], F.when(F.col("high"), "high").otherwise("middle"))


def group_lists(products: DataFrame, group: str, most: int, least: int = 1, with_price: bool = False) -> DataFrame:
    """The first names of each group as one text; case is the name of the group column."""
    name = F.when(is_priced(F.col("price")), F.concat("name", F.lit("("), "price", F.lit(")"))).otherwise(F.col("name")) if with_price else F.col("name")
    lists = joined_names(products, [group], "ord", name, most).where(F.col("members") >= least)
    firsts = products.groupBy(group).agg(F.min("ord").alias("ord"), F.min_by("company", "ord").alias("company"))
    df = lists.join(firsts, group)
    return _facts(df, _plain({"group": F.col(group), "names": F.col("names"), "company": F.col("company")}), [entity(F.col(group), F.col("names"))], F.lit(group))


def category_and_series(products: DataFrame, most_category: int = 10, most_series: int = 8) -> DataFrame:
    return group_lists(products, "category", most_category).unionByName(group_lists(products, "series", most_series))


def statuses(products: DataFrame) -> DataFrame:
    """case is the status."""
    return _facts(products, slots(), [entity(F.col("name"), F.col("status"))], F.col("status"))


def generations(products: DataFrame) -> DataFrame:
    """case is the generation."""
    return _facts(products, slots(), [entity(F.col("name"), F.col("generation"))], F.col("generation"))


def pairs(products: DataFrame) -> DataFrame:
    """Pairs of products of one series and sub-series, the earlier one first."""
    keys = lambda p: F.struct(F.col(p + "series").alias("s"), F.coalesce(p + "sub_series", F.lit("")).alias("u"))
    side = lambda p: products.select(*[F.col(c).alias(p + c) for c in [*_NAMES, "full", "short", "high", "ord"]]).withColumn(p + "key", keys(p))
    a, b = side("a_"), side("b_")
    df = a.join(b, (a["a_key"] == b["b_key"]) & (a["a_ord"] < b["b_ord"]))
    own = {f"{p}{n}": F.col(f"{p}{n}").cast("string") for p in ("a_", "b_") for n in ("name", "short", "full")} | {"series": F.col("a_series")}
    return _facts(df, _plain(own), [entity(F.col("a_name"), prefix="a_"), entity(F.col("b_name"), prefix="b_")], order=F.col("a_ord") * 1_000_003 + F.col("b_ord"))


_KEY = ["_series", "_sub"]
#: Slots of the earlier and of the later product of a pair.
_SIDES = {"a": ("a_name", "a_short", "a_full", "series"), "b": ("b_name", "b_short", "b_full")}


def _keyed(products: DataFrame) -> DataFrame:
    """Products with the key of their series and sub-series."""
    return products.withColumns({"_series": F.coalesce(F.concat(F.lit("="), "series"), F.lit("")), "_sub": F.coalesce("sub_series", F.lit(""))})


def _pair_order(a: Column, b: Column) -> Column:
    return (a * 1_000_003 + b).cast("long").alias("ord")


def _dealt(products: DataFrame, carried: list[Column]) -> DataFrame:
    """(key, _x, _y, _own, ord, carried ...): products dealt to the cells in which their pairs are made.

    A group is dealt in blocks, and every two blocks meet in a cell of their own, so no task holds more
    than two blocks of a group however large that is. Products of a group of one block are moved once.
    """
    keyed = _keyed(products)
    sizes = keyed.groupBy(*_KEY).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_blocks"))
    large = stored(sizes.where("_blocks > 1"), "pair-blocks")
    large = F.broadcast(large) if large.count() <= MOST_BROADCAST else large
    sized = keyed.select(*_KEY, "ord", "name", *carried).join(large, _KEY, "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    sized = sized.withColumns({"_own": F.pmod(F.xxhash64("ord", "name"), F.col("_blocks")).cast("int"), "_other": F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))})
    return sized.withColumns({"_x": F.least("_own", "_other"), "_y": F.greatest("_own", "_other")}).drop("name", "_blocks", "_other")


def render_pairs(products: DataFrame, templates: DataFrame, generator: str) -> DataFrame:
    """What ``render`` makes of ``pairs``.

    Only fields that the templates name are moved. Both sides of a pair have the same columns, so Spark
    moves a product once for a cell, not once for each side.
    """
    own = _for_pairs(templates, generator).select("variant", _pieces(F.col("question")).alias("q"), _pieces(F.coalesce("answer", F.lit(""))).alias("r")).collect()  # a written list
    names = {p["name"] for t in own for p in (*(t.q or ()), *t.r)}
    fields = list(dict.fromkeys(c for p, held in _SIDES.items() for n in held if n in names and (c := n.removeprefix(f"{p}_")) != "series"))
    more = [c for c in ("name", "category", "price") if c not in fields]  # of entities; the series is in the key
    held, rest = (F.array(*[F.col(c).cast("string") for c in x]).cast("array<string>") for x in (fields, more))
    parts = int(products.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = _dealt(products, [held.alias("_fields"), rest.alias("_more")]).repartition(parts, *_KEY, "_x", "_y")
    a, b = (dealt.select(*[F.col(c).alias(f"_{p}{c}") for c in (*_KEY, "_x", "_y", "_own", "ord", "_fields", "_more")]) for p in "ab")
    on = [F.col(f"_a{c}") == F.col(f"_b{c}") for c in (*_KEY, "_x", "_y")]
    met = a.join(b, [*on, F.col("_aord") < F.col("_bord"), (F.col("_a_x") == F.col("_b_y")) | (F.col("_a_own") != F.col("_b_own"))])

    def at(p: str, name: str) -> Column:
        if name == "series":
            return F.when(F.col(f"_{p}_series") != "", F.substr(f"_{p}_series", F.lit(2)))
        return F.get(f"_{p}_fields", F.lit(fields.index(name))) if name in fields else F.get(f"_{p}_more", F.lit(more.index(name)))

    def text(pieces: list | None) -> Column:
        side = lambda name: next((p for p, held in _SIDES.items() if name in held), None)
        filled = [F.coalesce(at(p, x["name"].removeprefix(f"{p}_")), F.lit("")) if (p := side(x["name"])) else F.lit(x["text"]) for x in pieces or ()]
        return F.lit(None).cast("string") if pieces is None else F.concat(F.lit(""), *filled)

    one, two = (F.struct(F.lit(None).cast("string").alias("value"), *[at(p, c).alias(c) for c in ("name", "category", "series")], F.coalesce(at(p, "price"), F.lit("")).alias("price")) for p in "ab")
    last = at("a", "name").isNull() | (at("a", "name") == at("b", "name"))
    entities = F.when(last, F.create_map(at("b", "name"), two)).otherwise(F.create_map(at("a", "name"), one, at("b", "name"), two))
    kind = templates.schema["variant"].dataType
    made = [F.struct(F.lit(t.variant).cast(kind).alias("variant"), text(t.q).alias("instruction"), text(t.r).alias("output")) for t in own]
    made = made or [F.struct(F.lit(None).cast(kind).alias("variant"), text(None).alias("instruction"), text(None).alias("output"))]
    rows = met.select(F.lit(generator).alias("generator"), _pair_order(F.col("_aord"), F.col("_bord")), (F.explode(F.array(*made)) if len(made) > 1 else made[0]).alias("_t"), entities.alias("entities"))
    return rows.where(F.lit(bool(own))).select("generator", "ord", "_t.*", "entities")


def _for_pairs(templates: DataFrame, generator: str) -> DataFrame:
    """The templates of a generator that are for every case; pairs have none."""
    return templates.where((F.col("generator") == generator) & F.col("case").isNull())


def sample_pairs(products: DataFrame, templates: DataFrame, generator: str, cap: int, seed: int = 42) -> DataFrame:
    """At most ``cap`` rows of ``render_pairs``, each set of rows as likely as any other, without making them all.

    Pairs are counted, not made: a product leads as many as there are later ones in its group. Seeded
    ranks are drawn below the number of all rows, and lead to the product, the partner and the template
    that they stand for. The driver holds a number for each of SAMPLE_BUCKETS and the ranks.
    """
    own = _for_pairs(templates, generator)
    variants = [r[0] for r in own.select("variant").orderBy("variant", "question", "answer").collect()]  # a written list
    ids = F.xxhash64(*[F.col(c) for c in products.columns], *[F.col(c).isNull() for c in products.columns])  # a hash alone passes over nulls
    keyed = _keyed(products).select(*_KEY, F.col("ord").cast("long").alias("_ord"), ids.alias("_id")).where("_ord is not null")
    keyed = keyed.withColumn("_bucket", F.pmod(F.xxhash64(*_KEY), F.lit(SAMPLE_BUCKETS)).cast("int")).repartition("_bucket")
    group = Window.partitionBy("_bucket", *_KEY)
    placed = keyed.withColumns({"_place": F.row_number().over(group.orderBy(F.desc("_ord"), "_id")), "_later": F.rank().over(group.orderBy(F.desc("_ord"))) - 1})
    before = Window.partitionBy("_bucket").orderBy(*_KEY, "_place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = stored(placed.withColumn("_until", F.sum(F.col("_later").cast("long")).over(before)), "pair-places")
    sizes = sorted(map(tuple, placed.groupBy("_bucket").agg(F.max("_until")).collect()))
    ends = list(accumulate(n for _, n in sizes))
    total = (ends[-1] if ends else 0) * len(variants)
    drawn = []
    for rank in sorted(random.Random(seed).sample(range(total), min(cap, total))):
        pair, which = divmod(rank, len(variants))
        i = bisect_right(ends, pair)
        drawn.append((sizes[i][0], pair - (ends[i] - sizes[i][1]), variants[which], which))
    spark = products.sparkSession
    picks = spark.createDataFrame(drawn, "_in int, _at long, _variant int, _which int")
    leads = placed.join(F.broadcast(picks), (F.col("_in") == F.col("_bucket")) & (F.col("_until") > F.col("_at")) & (F.col("_until") - F.col("_later") <= F.col("_at")))
    leads = leads.select("_bucket", *_KEY, F.col("_id").alias("_a_id"), (F.col("_at") - F.col("_until") + F.col("_later") + 1).alias("_place"), "_which")
    partners = placed.select("_bucket", *_KEY, "_place", F.col("_id").alias("_b_id"))
    met = stored(partners.join(F.broadcast(leads), ["_bucket", *_KEY, "_place"]).select("_a_id", "_b_id", "_which"), "pair-picks")
    # Products with the same hash are the same row.
    both = met.select(F.explode(F.array("_a_id", "_b_id")).alias("_id")).distinct()
    few = stored(products.withColumn("_id", ids).join(F.broadcast(both), "_id", "left_semi").dropDuplicates(["_id"]), "pair-products")
    sides = [few.select(*[F.col(c).alias(f"{p}_{c}") for c in [*_NAMES, "full", "short", "ord"]], F.col("_id").alias(f"_{p}_id")) for p in "ab"]
    slot = _plain({n: F.col(n if p == "b" or n != "series" else "a_series") for p in "ab" for n in _SIDES[p]})
    facts = reduce(lambda df, s: df.join(F.broadcast(s), next(c for c in s.columns if c.endswith("_id"))), sides, met)  # of the rows drawn
    facts = facts.select(_pair_order(F.col("a_ord"), F.col("b_ord")), slot.alias("slots"), F.array(entity(F.col("a_name"), prefix="a_"), entity(F.col("b_name"), prefix="b_")).alias("entities"), "_which")
    listed = own.withColumn("_which", F.row_number().over(Window.orderBy("variant", "question", "answer")) - 1)
    return _filled(facts.join(F.broadcast(listed), "_which"), generator)


def weights(products: DataFrame) -> DataFrame:
    df = products.withColumn("weight", F.explode(F.transform("talking_points", weight))).where((F.col("weight").isNotNull()) & (F.col("category") != ""))
    return _facts(df, slots({"weight": F.col("weight")}), [entity(F.col("weight"), F.col("name"))], F.lit("weight"))


def price_extremes(products: DataFrame, least: int = 1) -> DataFrame:
    """Cheapest and priciest of each category with ``least`` priced products, where they differ.

    Of equal prices the first is the cheapest and the last the priciest. case is cheapest or priciest.
    """
    priced = products.where(F.col("category") != "").withColumn("_p", number_value(F.coalesce("price", F.lit("")))).where("_p is not null")
    # Only prices and places are grouped; the rows that they lead to, two of a category, are joined back.
    place = F.struct("_p", F.col("ord").alias("_ord"))
    ends = priced.groupBy(F.col("category").alias("_category")).agg(F.min(place).alias("_lo"), F.max(place).alias("_hi"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    ends = ends.select("_category", F.explode(F.array(F.struct(F.lit("cheapest").alias("which"), F.col("_lo").alias("at")), F.struct(F.lit("priciest").alias("which"), F.col("_hi").alias("at")))).alias("_x")).select("_category", "_x.which", "_x.at.*")
    ends = ends.withColumnsRenamed({"_p": "_price"})
    found = priced.join(ends, (F.col("category") == F.col("_category")) & (F.col("_p") == F.col("_price")) & F.col("ord").eqNullSafe(F.col("_ord")))
    one = found.groupBy("_category", "which").agg(F.first(F.struct(*[F.col(c) for c in priced.columns])).alias("p"))
    names = F.collect_set("p.name").over(Window.partitionBy("_category"))
    both = one.withColumn("_names", F.size(names)).where("_names = 2").select("which", "p.*")
    return _facts(both, slots(), [entity(F.col("which"), F.col("name"))], F.col("which"))


def weights_and_extremes(products: DataFrame, least: int = 1) -> DataFrame:
    return weights(products).unionByName(price_extremes(products, least))


def topic(products: DataFrame, word: str, least: int = 2) -> DataFrame:
    """One fact on all products whose positioning or sub-series holds a word, those by positioning
    first; of a name given twice the first counts."""
    by_position = F.coalesce(F.exists("positioning", lambda x: x.contains(word)), F.lit(False))
    hit = products.withColumn("branch", F.when(by_position, 0).when(F.coalesce(F.col("sub_series").contains(word), F.lit(False)), 1)).where("branch is not null")
    one = hit.withColumn("_n", F.row_number().over(Window.partitionBy("name").orderBy("branch", "ord"))).where("_n = 1")
    text = F.when(is_priced(F.col("price")), F.concat("name", F.lit("("), "price", F.lit(")"))).otherwise(F.col("name"))
    listed = one.groupBy().agg(F.sort_array(F.collect_list(F.struct("branch", "ord", text.alias("t"), "name", "company"))).alias("l")).where(F.size("l") >= least)
    df = listed.select(F.lit(0).alias("ord"), F.array_join(F.transform("l", lambda x: x["t"]), WORDS["and"]).alias("names"), F.col("l")[0]["name"].alias("first"), F.col("l")[0]["company"].alias("company"))
    return _facts(df, _plain({c: F.col(c) for c in ("names", "first", "company")}), [entity(F.lit(word), F.col("names"))])


#: Facts of the evaluation corpus and of the training corpus, in registry order.
EVALUATION: dict[str, Callable[[DataFrame], DataFrame]] = {
    "alias_direct": aliases, "alias_sentence": aliases, "reverse_positioning": positioning_groups, "reverse_point": talking_points, "price_query": prices,
    "enumeration": category_and_series, "status_query": statuses, "generation_query": generations, "comparison": pairs, "extremes": weights_and_extremes,
}
TRAINING: dict[str, Callable[[DataFrame], DataFrame]] = {
    "alias_resolve": aliases, "intro": each_product, "category_list": partial(group_lists, group="category", most=12, with_price=True), "series_list": partial(group_lists, group="series", most=8, least=2), "price_ask": prices,
    "reverse_lookup": points_and_positionings, "compare": pairs, "form_factor": partial(topic, word="折叠"), "superlative": partial(weights_and_extremes, least=2), "status_ask": statuses,
}


def _pieces(template: Column) -> Column:
    """The template cut before and behind braces; a piece {name} has that name."""
    return F.transform(F.split(template, r"(?=\{)|(?<=\})"), lambda p: F.struct(p.alias("text"), F.regexp_extract(p, r"^\{(\w+)\}$", 1).alias("name")))


def _filled_pieces(pieces: Column, slot: Column) -> Column:
    return F.array_join(F.transform(pieces, lambda p: F.coalesce(F.try_element_at(slot, p["name"]), p["text"])), "")


def fill(template: Column, slot: Column) -> Column:
    """The template with each {name} replaced by its slot; slots are not expanded again, unknown names stay."""
    return _filled_pieces(_pieces(template), slot)


def _filled(rows: DataFrame, generator: str) -> DataFrame:
    return rows.select(F.lit(generator).alias("generator"), "ord", "variant", fill(F.col("question"), F.col("slots")).alias("instruction"), fill(F.coalesce("answer", F.lit("")), F.col("slots")).alias("output"), format_entities(F.col("entities")).alias("entities"))


def render(facts: DataFrame, templates: DataFrame, generator: str) -> DataFrame:
    """(generator, ord, variant, instruction, output, entities) of facts and the templates of a generator.

    Templates are a small dimension table, cut in pieces before they meet facts; a template with a case
    is for facts of that case.
    """
    own = templates.where(F.col("generator") == generator).select("variant", F.col("case").alias("only"), _pieces(F.col("question")).alias("_q"), _pieces(F.coalesce("answer", F.lit(""))).alias("_r"))
    rows = facts.join(F.broadcast(own), F.col("only").isNull() | (F.col("only") == F.col("case")))  # a written list
    return rows.select(F.lit(generator).alias("generator"), "ord", "variant", _filled_pieces(F.col("_q"), F.col("slots")).alias("instruction"), _filled_pieces(F.col("_r"), F.col("slots")).alias("output"), format_entities(F.col("entities")).alias("entities"))


def generate(products: DataFrame, templates: DataFrame, registry: dict[str, Callable] = TRAINING, only: str | None = None, cap: int | None = None, seed: int = 42) -> DataFrame:
    """The rows of all generators in ``registry`` (or of one), each capped by a seeded sample."""
    ready = described(products)
    chosen = {n: f for n, f in registry.items() if only is None or n == only}
    if not chosen:
        raise ValueError(f"no generator {only}; there are {sorted(registry)}")

    def rows(n: str, f: Callable) -> DataFrame:
        if f is pairs:
            return render_pairs(ready, templates, n) if cap is None else sample_pairs(ready, templates, n, cap, seed)
        out = render(f(ready), templates, n)
        return out if cap is None else seeded_sample(out, ["generator"], ["ord", "variant", "instruction"], cap, seed)

    return reduce(DataFrame.unionByName, [rows(n, f) for n, f in chosen.items()])


def generator_shares(rows: DataFrame) -> DataFrame:
    """(generator, n, percent): rows of each generator and their share of all, rounded half to even."""
    counts = rows.groupBy("generator").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("generator", "n", F.bround(100 * F.col("n") / F.col("total"), 1).alias("percent"))  # one row
