"""Shards in order of id, by weight: an id that outweighs a shard has several of its own."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cuts_below(value: F.Column, cuts: list[int]) -> F.Column:
    """How many of the ascending cuts lie at or below a value: among every k-th first, then among the k after it."""
    if not cuts:
        return F.lit(0)
    k = math.isqrt(len(cuts)) + 1
    within = lambda array: F.size(F.filter(array, lambda x: x <= value))
    coarse = within(F.lit(cuts[::k]).cast("array<long>"))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * k + within(F.slice(F.lit(cuts).cast("array<long>"), (coarse - 1) * k + 1, F.lit(k))))


class IdRanges:
    """Shards of ids, nulls first.

    ``cuts`` are ascending; a shard goes from one to the next. A heavy id has as many shards of its
    own as ``heavy`` says, between those of smaller and larger ids; null (key None) may be heavy too,
    otherwise it shares the first shard.
    """

    def __init__(self, cuts: list[int], heavy: dict[int | None, int]):
        self.cuts, self.null_pieces = cuts, heavy.get(None, 0)
        self.ids = sorted(i for i in heavy if i is not None)
        self.own = [heavy[i] for i in self.ids]
        # Shards that null and the first so many heavy ids add; one more each, as smaller and larger ids part there.
        self.added = list(itertools.accumulate((n + 1 for n in self.own), initial=self.null_pieces))

    @property
    def count(self) -> int:
        return len(self.cuts) + 1 + self.added[-1]

    @property
    def splits(self) -> bool:
        return bool(self.null_pieces or self.ids)

    def _long(self, values: list[int], at: F.Column) -> F.Column:
        return F.get(F.lit(values).cast("array<long>"), at)

    def pieces(self, value: F.Column) -> F.Column:
        """How many shards hold rows of an id."""
        if not self.splits:
            return F.lit(1)
        own = F.lit(1)
        if self.ids:
            at = cuts_below(value, self.ids) - 1
            own = F.when(self._long(self.ids, at) == value, self._long(self.own, at)).otherwise(1)
        return F.when(value.isNull(), max(1, self.null_pieces)).otherwise(own).cast("int")

    def first(self, value: F.Column) -> F.Column:
        """The first shard of an id."""
        shard = cuts_below(value, self.cuts) + self.added[0]
        if self.ids:
            at = cuts_below(value, self.ids)
            is_heavy = self._long(self.ids, at - 1) == value
            shard = cuts_below(value, self.cuts) + F.when(is_heavy, self._long(self.added, at - 1) + 1).otherwise(self._long(self.added, at))
        return F.when(value.isNull(), 0).otherwise(shard).cast("int")

    def shard(self, value: F.Column, digest: F.Column) -> F.Column:
        """The shard of a row; of a heavy id by a digest (a long) of its content."""
        first = self.first(value)
        return (first + F.pmod(digest, self.pieces(value))).cast("int") if self.splits else first


def id_ranges(sizes: DataFrame, shard_bytes: int, most: int, row_bytes: int) -> IdRanges:
    """Ranges for rows (id long, n long) into shards of about ``shard_bytes`` of n, ``most`` at most.

    An id with several rows that weigh more than a shard (n and ``row_bytes`` each) is heavy and gets
    a shard for each weight of a shard; fewer than ``most`` ids are, so they fit the driver.
    """
    total = sizes.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows")).first()
    n = int(min(most, max(1, -(-(total.n or 0) // shard_bytes))))
    cuts = sizes.select(F.col("id").cast("double").alias("k")).approxQuantile("k", [i / n for i in range(1, n)], 0.25 / n) if n > 1 else []
    limit = max(shard_bytes, -(-((total.n or 0) + row_bytes * total.rows) // most))
    weights = sizes.groupBy("id").agg(F.sum(F.col("n") + row_bytes).alias("weight"), F.count(F.lit(1)).alias("rows"))
    heavy = weights.where((F.col("weight") > limit) & (F.col("rows") > 1)).collect()
    return IdRanges(sorted({int(x) for x in cuts}), {r.id: -(-r.weight // limit) for r in heavy})
