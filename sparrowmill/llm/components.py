"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowmill.llm.storage import materialize

#: Edges whose least neighbours (two longs for each node) may be broadcast.
BROADCAST_EDGES = 250_000


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a long, b long): root is the least node of its component.

    Rows may repeat, stand in either order or join a node to itself. Edges stay distributed. Of
    BROADCAST_EDGES edges or fewer the least neighbours are broadcast (no step has more edges than
    the one before). Of more they are stored before they are joined to the edges again, so both
    sides of that join come from shuffles of their own and Spark splits the edges of a hub over tasks.
    """

    def least(e: DataFrame) -> DataFrame:
        found = e.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return F.broadcast(found) if few else materialize(found, "components-least")

    known = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    alone = known.where("u = v").select("u", "v")
    now = materialize(known.where("u > v").distinct(), "components")
    few = now.count() <= BROADCAST_EDGES
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = materialize(large, "components-large")
        small = large.join(least(large), "u").select(F.col("v").alias("x"), "m", "u")
        small = small.select(F.explode(F.array(F.struct(F.col("x").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        now = materialize(small.where("u != v").distinct(), "components")
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if state == before:
            break
        before = state
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots).unionByName(alone.select(F.col("u").alias("node"), F.col("v").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
