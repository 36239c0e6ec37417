"""What document filters take away alone, after others, and in every order they can be applied.

Every filter keeps sorted posting lists of the rows that fail it, one list for each part of the table
and range of row ids. Within a range the lists of all sets of filters are merged by galloping, each
set from the one that lacks its last filter; sizes of unions and differences add up over ranges. So a
task holds the lists of one range, and the answer for all orders comes from one set of small sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparrowmill.llm.storage import giving_back, materialize

#: Rows of a range (a power of two, as bits of the row id): the longest posting list of a task.
RANGE_BITS = 16
#: Places that are searched together by galloping.
BLOCK = 256
#: Repeated texts and labelled ids that may be broadcast; more go through a shuffle join.
BROADCAST_KEYS = 500_000
#: Parts whose sums a task holds before it passes them on.
PARTS_HELD = 2000


def places(wanted: np.ndarray, within: np.ndarray) -> np.ndarray:
    """Where each of ``wanted`` stands or belongs in ``within``; both are sorted.

    A block of wanted values gallops on from the place of the block before, in steps that double, so
    the cost follows the shorter list and the logarithm of the gaps in the longer one.
    """
    out, at = np.empty(len(wanted), np.int64), 0
    for i in range(0, len(wanted), BLOCK):
        block = wanted[i : i + BLOCK]
        end, step = at, BLOCK
        while end < len(within) and within[end] < block[-1]:
            end, step = end + step, step * 2
        out[i : i + BLOCK] = at + np.searchsorted(within[at:end], block)
        at = int(out[i + len(block) - 1])
    return out


def _held(wanted: np.ndarray, within: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of wanted in within, and whether they are there."""
    at = places(wanted, within)
    there = np.zeros(len(wanted), bool)
    inside = at < len(within)
    there[inside] = within[at[inside]] == wanted[inside]
    return at, there


def union(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Both sorted lists of distinct ids as one."""
    short, long = (a, b) if len(a) < len(b) else (b, a)
    at, there = _held(short, long)
    return np.insert(long, at[~there], short[~there])


def difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What is in ``a`` and not in ``b``."""
    if len(a) <= len(b):
        return a[~_held(a, b)[1]]
    at, there = _held(b, a)
    return np.delete(a, at[there])


def common(a: np.ndarray, b: np.ndarray) -> int:
    """The number of ids in both."""
    short, long = (a, b) if len(a) < len(b) else (b, a)
    return int(_held(short, long)[1].sum())


def range_sizes(failing: list[np.ndarray], marks: list[np.ndarray]) -> np.ndarray:
    """Sizes of one range: [set of filters before, filter] -> removed, size of the union before, all
    that fail the filter, those that fail it alone, and of the removed those with each mark."""
    k = len(failing)
    unions = [np.empty(0, np.int64)]
    for chosen in range(1, 1 << k):
        last = chosen.bit_length() - 1
        unions.append(union(unions[chosen ^ (1 << last)], failing[last]))
    out = np.zeros((1 << k, k, 4 + len(marks)), np.int64)
    for f, ids in enumerate(failing):
        alone = len(difference(ids, unions[((1 << k) - 1) ^ (1 << f)]))
        for before in (s for s in range(1 << k) if not s >> f & 1):
            gone = difference(ids, unions[before])
            out[before, f] = [len(gone), len(unions[before]), len(ids), alone, *[common(gone, m) for m in marks]]
    return out


def few(df: DataFrame) -> DataFrame:
    """A stored table, to be broadcast if its counted rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_KEYS else df


def posting_lists(flags: DataFrame, part: str, names: list[str]) -> DataFrame:
    """(part, range, n_rows, and an array of sorted row ids for each of ``names``) of rows (row long,
    part, a boolean for each name); a null boolean counts as false, a null part as the empty text."""
    lists = [F.sort_array(F.collect_list(F.when(F.col(c), F.col("row")))).alias(c) for c in names]
    held = flags.withColumn(part, F.coalesce(F.col(part).cast("string"), F.lit("")))
    return held.groupBy(F.col(part).alias("part"), F.shiftright("row", RANGE_BITS).alias("range")).agg(F.count(F.lit(1)).alias("n_rows"), *lists)


def interactions(postings: DataFrame, filters: list[str], marks: list[str]) -> DataFrame:
    """Sums over ranges: (part, before, filter, n_rows, removed, gone_before, failing, alone, *marks),
    a row for each part, set of filters before (as bits) and filter not in it."""
    k, cells = len(filters), ["removed", "gone_before", "failing", "alone", *marks]
    schema = "part string, before int, filter int, n_rows long, " + ", ".join(f"`{c}` long" for c in cells)
    pairs = [(before, f) for before in range(1 << k) for f in range(k) if not before >> f & 1]
    at = ([b for b, _ in pairs], [f for _, f in pairs])

    def rows(held: dict[str, list]) -> pa.RecordBatch:
        sums = np.concatenate([s[at] for _, s in held.values()]) if held else np.zeros((0, len(cells)), np.int64)
        cols = [pa.array([p for p in held for _ in pairs], pa.string()), pa.array(at[0] * len(held), pa.int32()), pa.array(at[1] * len(held), pa.int32()), pa.array([n for n, _ in held.values() for _ in pairs], pa.int64())]
        return pa.RecordBatch.from_arrays(cols + [pa.array(sums[:, i]) for i in range(len(cells))], names=["part", "before", "filter", "n_rows", *cells])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in batches:
            own = lambda c, i, b=batch: b.column(c)[i].values.to_numpy(zero_copy_only=False)
            for i, (part, n) in enumerate(zip(batch.column("part").to_pylist(), batch.column("n_rows").to_pylist(), strict=True)):
                sizes = range_sizes([own(c, i) for c in filters], [own(c, i) for c in marks])
                if part not in held and len(held) == PARTS_HELD:
                    yield rows(held)
                    held = {}
                total = held.setdefault(part, [0, np.zeros_like(sizes)])
                total[0] += n
                total[1] += sizes
        yield rows(held)

    each = postings.mapInArrow(giving_back(merge), schema)
    return each.groupBy("part", "before", "filter").agg(*[F.sum(c).alias(c) for c in ("n_rows", *cells)])


def by_order(sums: DataFrame, filters: list[str], marks: dict[str, str], orders: list[str] | None = None) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, *marks, shapley) of each part,
    order (all by default) and step; shapley is over all orders. ``marks`` names output columns by mark."""
    k = len(filters)
    orders = orders if orders is not None else ["".join(p) for p in permutations(filters)]
    steps = [(sum(1 << filters.index(x) for x in o[:i]), filters.index(o[i]), o, i + 1) for o in orders for i in range(len(o))]
    plan = sums.sparkSession.createDataFrame(steps, "before int, filter int, filter_order string, step int")
    # As many orders have just this set before the filter.
    weight = F.element_at(F.array(*[F.lit(factorial(n) * factorial(k - 1 - n)) for n in range(k)]), F.bit_count("before") + 1)
    valued = sums.withColumn("shapley", F.sum(F.col("removed") * weight).over(Window.partitionBy("part", "filter")))
    out = valued.join(F.broadcast(plan), ["before", "filter"])
    cells = {"kept": F.col("n_rows") - F.col("gone_before") - F.col("removed"), "removed": F.col("removed"), "redundant": F.col("failing") - F.col("removed"), "unique_fails": F.col("alone")}
    cells |= {name: F.col(mark) for mark, name in marks.items()} | {"shapley": F.col("shapley")}
    return out.select("part", "filter_order", "step", *[c.cast("long").alias(n) for n, c in cells.items()])


def audit_filters(docs: DataFrame, filters: dict[str, Column], labels: DataFrame, marks: dict[str, Column], repeats: str | None = None, part: str = "lang", doc_id: str = "doc_id", text: str = "text", orders: list[str] | None = None) -> DataFrame:
    """The report of ``by_order`` on whole ``docs``.

    ``filters`` are conditions of failure on the columns of ``docs`` by one-letter name; ``repeats``
    names one more, failed by rows whose text stands in a row of smaller doc_id (null counts as the
    empty text; a null id is larger than any other, and ids that repeat aren't smaller than
    themselves). ``marks`` are conditions on ``labels`` (doc_id and more) by the name of the column that
    counts removed rows with it; a row has a mark if any label of its id has. Rows are counted, so rows
    that share an id, or have none, count one by one. A null part is the empty text. An empty table
    has no parts and so no rows. Extra columns are ignored.
    """
    names = [*filters, *([repeats] if repeats else [])]
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    base = docs.select(F.col(doc_id).alias("id"), F.col(part).cast("string").alias("part"), F.unhex(F.sha2(content, 256)).alias("digest"), *[F.coalesce(c, F.lit(False)).alias(f"fails_{n}") for n, c in filters.items()])
    # Row ids are drawn once and stored with their rows.
    base = materialize(base.withColumn("row", F.monotonically_increasing_id()), "filter-flags")
    flags = base
    if repeats:
        first = base.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").select("digest", "first")
        first = materialize(first, "filter-repeats")
        later = F.col("first").isNotNull() & (F.col("id").isNull() | (F.col("first") < F.col("id")))
        flags = flags.join(few(first), "digest", "left").withColumn(f"fails_{repeats}", later)
    found = [f"mark_{i}" for i in range(len(marks))]
    if marks:
        known = labels.groupBy(F.col(doc_id).alias("id")).agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(m) for m, c in zip(found, marks.values(), strict=True)])
        known = materialize(known.where(f"id is not null and ({' or '.join(found)})"), "filter-labels")
        flags = flags.join(few(known), "id", "left")
    lists = materialize(posting_lists(flags, "part", [f"fails_{n}" for n in names] + found), "filter-postings")
    sums = interactions(lists, [f"fails_{n}" for n in names], found)
    return by_order(materialize(sums, "filter-sums"), names, dict(zip(found, marks, strict=True)), orders)


def text_filters(text: str = "text") -> dict[str, Column]:
    """The four filters on texts alone: A few words, B few distinct ones, C many capitals, D symbols."""
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    words = F.array_remove(F.split(content, "[\\x20\\x09-\\x0D]+"), "")
    capitals = F.length(content) - F.length(F.regexp_replace(content, "[A-Z]+", ""))
    return {"A": F.size(words) < 200, "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words), "C": 100 * capitals.cast("long") > 3 * F.length(content), "D": content.rlike("[#$%&*|]")}


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return audit_filters(docs, text_filters(), labels, {"good_lost": F.col("quality") == 1, "toxic_lost": F.col("toxic") == 1}, repeats="E")


NAME = "op13_filter_audit"
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
r AS (SELECT d.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t),
  regexp_matches(t, '[#$%&*|]'), coalesce(m.first < d.doc_id, m.first IS NOT NULL AND d.doc_id IS NULL)] AS fails FROM d JOIN m USING (t) LEFT JOIN l USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM r GROUP BY ALL),
f AS (SELECT unnest(range(1, 6)) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS p FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
x AS (SELECT c.part, o.p, s.i AS step, o.p[s.i] AS f, sum(n) AS total,
  sum(CASE WHEN len(list_filter(o.p[1:s.i], lambda z: fails[z])) = 0 THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN fails[o.p[s.i]] AND len(list_filter(o.p[1:s.i - 1], lambda z: fails[z])) = 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN fails[o.p[s.i]] AND len(list_filter(o.p[1:s.i - 1], lambda z: fails[z])) > 0 THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN fails[o.p[s.i]] AND len(list_filter(o.p, lambda z: fails[z])) = 1 THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN fails[o.p[s.i]] AND len(list_filter(o.p[1:s.i - 1], lambda z: fails[z])) = 0 THEN c.good ELSE 0 END) AS good_lost,
  sum(CASE WHEN fails[o.p[s.i]] AND len(list_filter(o.p[1:s.i - 1], lambda z: fails[z])) = 0 THEN c.toxic ELSE 0 END) AS toxic_lost
  FROM c, o, f s GROUP BY c.part, o.p, s.i)
SELECT part, array_to_string(list_transform(p, lambda z: chr(CAST(64 + z AS INT))), '') AS filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM x
"""
