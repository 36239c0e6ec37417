"""The trie of conversation prefixes, and what sharing their beginnings saves.

A node is a distinct sequence of first turns. Each conversation's nodes get chained digests in one ordered
stream; the weight of a node is the number of nodes that its members pass from it on. Nodes above WEIGHT
are upper nodes: their members reach over many tasks, and their aggregates are merged globally by digest.
What lies below hangs together in shards of at most WEIGHT visits: a task packs the BASE and CHECK arrays
of a shard over dense turn ids, sends every conversation through them and sums up from the leaves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparrowmill.llm.storage import giving_back, materialize

#: Visits of a shard at most, besides those of the node that opens it.
WEIGHT = 20_000
#: Upper nodes that may be broadcast; more go through a shuffle join.
BROADCAST_NODES = 200_000
#: Conversations that end at one node and are joined to one piece of text.
PIECE = 8_192
#: Places that are tried for a set of children before they go to the end of the arrays.
TRIES = 32

_ROOT = bytes(16)


class DoubleArray:
    """BASE and CHECK over dense codes from 0: the child of s by c is BASE[s] + c if CHECK is s there."""

    def __init__(self, room: int) -> None:
        self.base, self.check = np.zeros(room, np.int64), np.full(room, -1, np.int64)
        self.check[0] = 0  # the root; no child ever stands there
        self.free, self.end = 1, 1

    def _room(self, most: int) -> None:
        if most >= len(self.check):
            more = max(most + 1, 2 * len(self.check)) - len(self.check)
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])

    def place(self, state: int, codes: np.ndarray) -> None:
        """Finds a base at which all ``codes`` (sorted, distinct) of a state's children are free."""
        while self.free < self.end and self.check[self.free] >= 0:
            self.free += 1
        at = self.free
        for _ in range(TRIES):
            slots = at + codes - codes[0]
            self._room(int(slots[-1]))
            if (self.check[slots] < 0).all():
                break
            at += 1
        else:
            slots = self.end + codes - codes[0]
            self._room(int(slots[-1]))
        self.base[state] = slots[0] - codes[0]
        self.check[slots] = state
        self.end = max(self.end, int(slots[-1]) + 1)

    def step(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The children of states by codes; -1 where there is none."""
        to = self.base[states] + codes
        known = (to > 0) & (to < len(self.check))
        known[known] = self.check[to[known]] == states[known]
        return np.where(known, to, -1)


def build(walks: np.ndarray, depths: np.ndarray, codes: np.ndarray) -> tuple[DoubleArray, np.ndarray]:
    """The double array of all walks and the state of each visit.

    A visit is (walk, depth from 0, code), in any order; a walk has a visit at each depth up to its last.
    Levels are packed one after another, so the arrays grow from the root.
    """
    trie, states = DoubleArray(2 * len(codes) + 2), np.zeros(len(codes), np.int64)
    order = np.lexsort((walks, depths))
    bounds = np.searchsorted(depths[order], np.arange(depths.max() + 2 if len(depths) else 1))
    at, kinds = np.zeros(walks.max() + 1 if len(walks) else 0, np.int64), codes.max() + 1 if len(codes) else 1
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        level = order[lo:hi]
        above, code = at[walks[level]], codes[level]
        pairs = np.unique(above * kinds + code)
        parents, starts = np.unique(pairs // kinds, return_index=True)
        for parent, children in zip(parents.tolist(), np.split(pairs % kinds, starts[1:]), strict=True):
            trie.place(parent, children)
        states[level] = at[walks[level]] = trie.step(above, code)
    return trie, states


def text_digest(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


_SHARD = "conv_id long, depth long, above binary, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, top boolean"


def shard_nodes(visits: pa.Table) -> pa.Table:
    """The nodes of a shard from its visits: conv_id, depth, turn, bytes, last, top (the depth at which the
    shard opens), above (the node over it) and above_conv (that node's smallest member)."""
    column = lambda c: visits.column(c).to_numpy()
    convs, depths, sizes, tops = (column(c).astype(np.int64) for c in ("conv_id", "depth", "bytes", "top"))
    # Walks below different upper nodes meet in the root only: their first code is of node and turn.
    turns = np.array([a + t if d == k else t for a, t, d, k in zip(visits.column("above").to_pylist(), visits.column("turn").to_pylist(), depths.tolist(), tops.tolist(), strict=True)], object)
    _, walks = np.unique(convs, return_inverse=True)
    # Dense ids in the order of depths and walks: siblings, mostly from neighbouring walks, get near ones.
    order = np.lexsort((walks, depths))
    _, first, kinds = np.unique(turns[order], return_index=True, return_inverse=True)
    codes = np.empty(len(turns), np.int64)
    codes[order] = np.argsort(np.argsort(first))[kinds]
    trie, states = build(walks, depths - tops, codes)

    n = len(trie.check)
    count, least, size, ends = np.bincount(states, minlength=n), np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64), {}
    np.minimum.at(least, states, convs)
    size[states] = sizes
    for i in np.flatnonzero(column("last").astype(bool)).tolist():
        ends.setdefault(int(states[i]), []).append(int(convs[i]))
    some = np.zeros(n, np.int64)
    some[states] = np.arange(len(states))
    nodes = np.flatnonzero(count)
    parent, children = trie.check, np.bincount(trie.check[nodes], minlength=n)
    leaves, saved = np.where(children == 0, 1, 0), (count - 1) * size
    level = (depths - tops)[some]
    for d in range(int(level[nodes].max()), 0, -1):  # a node's sums are whole before they go up
        now = nodes[level[nodes] == d]
        np.add.at(leaves, parent[now], leaves[now])
        np.add.at(saved, parent[now], saved[now])
    opens = level[nodes] == 0
    above, over = visits.column("above").to_pylist(), column("above_conv")
    none = text_digest([])
    return pa.table({
        "conv_id": least[nodes], "depth": depths[some[nodes]], "above": pa.array([above[i] if f else None for i, f in zip(some[nodes].tolist(), opens.tolist(), strict=True)], pa.binary()),
        "parent_conv_id": np.where(opens, over[some[nodes]], least[parent[nodes]]), "n_convs": count[nodes], "n_children": children[nodes], "n_leaves": leaves[nodes], "saved_tokens": saved[nodes],
        "ends_sha256": [text_digest(sorted(ends[s])) if s in ends else none for s in nodes.tolist()], "top": opens,
    })


def chained(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, above, node, turn, bytes) of the sorted turns of conversations, streamed in order.

    Depth 0 opens each conversation with the root. A node's digest is that of the node above and its turn,
    so a conversation of any length is passed with one digest in memory.
    """

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, node = None, _ROOT
        for batch in batches:
            above, nodes = [], []
            for c, d, t in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "depth", "turn")), strict=True):
                if c != conv or d == 0:
                    conv, node = c, _ROOT
                above.append(node if d else None)
                if d:
                    node = hashlib.blake2b(node + t, digest_size=16).digest()
                nodes.append(node)
            cols = [*batch.columns, pa.array(above, pa.binary()), pa.array(nodes, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names, "above", "node"])

    return turns.mapInArrow(giving_back(chain), "conv_id long, depth long, turn binary, bytes long, left long, above binary, node binary")


def ends_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of (node, conv_id): ids of a node in order, joined by commas.

    Ids are sorted in ranges and joined to pieces there; one stream then takes the pieces of a node, not
    its rows. It holds one digest.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids = None, []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"node": pa.array([node], pa.binary()), "first": [ids[0]], "text": [",".join(map(str, ids))]})

        for batch in batches:
            for n, c in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if ids and (n != node or len(ids) == PIECE):
                    yield out()
                    ids = []
                node = n
                ids.append(c)
        if ids:
            yield out()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        shape = lambda n, s: pa.RecordBatch.from_pydict({"node": pa.array([n], pa.binary()), "ends_sha256": [s.hexdigest()]})
        for batch in batches:
            for n, t in zip(batch.column("node").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if n != node:
                    if sha:
                        yield shape(node, sha)
                    node, sha = n, hashlib.sha256(t.encode())
                else:
                    sha.update(b"," + t.encode())
        if sha:
            yield shape(node, sha)

    sorted_ = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    each = sorted_.mapInArrow(giving_back(pieces), "node binary, first long, text string")
    return each.repartition("node").sortWithinPartitions("node", "first").mapInArrow(giving_back(digests), "node binary, ends_sha256 string")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """A row for each node of rows (conv_id long, depth long from 1, turn binary, bytes long), distinct in
    conv_id and depth, with depths that go up by one; a row of depth 0 (turn null, bytes 0) for each
    conversation makes turnless ones members of the root.

    conv_id is the smallest member, parent_conv_id that of the parent (root: null); n_convs, n_children,
    n_leaves (childless nodes of the subtree, the node included), saved_tokens (bytes of the last turn
    times members less one, summed over the subtree) and ends_sha256 (members that end here). Equal
    ``turn`` digests are the same turn. No conversations, no nodes.
    """
    upward = Window.partitionBy("conv_id")
    ordered = turns.withColumn("left", F.max("depth").over(upward) - F.col("depth")).sortWithinPartitions("conv_id", "depth")
    visits = materialize(chained(ordered), "trie-visits")
    weighed = visits.groupBy("node").agg(F.sum(F.col("left") + 1).alias("weight"), F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("least"))
    upper = materialize(weighed.where((F.col("weight") > WEIGHT) | (F.col("node") == F.lit(_ROOT))).select("node", "n_convs", "least"), "trie-upper")
    small = F.broadcast(upper) if upper.count() <= BROADCAST_NODES else upper

    # Upper nodes are the beginning of each conversation's path.
    path = visits.join(small, "node", "left").withColumn("upper", F.col("least").isNotNull())
    down = Window.partitionBy("conv_id").orderBy("depth")
    path = path.withColumns({"top": F.sum(F.col("upper").cast("long")).over(upward), "above_conv": F.lag("least").over(down)})
    path = materialize(path, "trie-path")

    # Shards: nodes that open one are dealt to as many groups as the visits ask for.
    below = path.where("not upper")
    opened = below.where("depth = top").select("conv_id", F.col("node").alias("opens"), F.col("above").alias("over"), "above_conv")
    shards = max(1, -(-below.count() // WEIGHT))
    dealt = below.drop("above", "above_conv").join(opened.withColumnRenamed("over", "above"), "conv_id")
    dealt = dealt.select(F.pmod(F.xxhash64("opens"), F.lit(shards)).alias("shard"), "conv_id", "depth", "turn", "bytes", (F.col("left") == 0).alias("last"), "top", "above", "above_conv")
    lower = materialize(dealt.groupBy("shard").applyInArrow(shard_nodes, _SHARD), "trie-lower")

    # Upper nodes: every member adds what it owns, the nodes whose smallest member it is, from its end up.
    tops = lower.where("top").select("conv_id", F.col("n_leaves").alias("leaves_below"), F.col("saved_tokens").alias("saved_below"))
    own = path.where("upper").join(tops, "conv_id", "left")
    leaf = (F.col("left") == 0) & (F.col("least") == F.col("conv_id"))
    children = path.where("upper and depth > 0").select(F.col("above").alias("node"), F.col("node").alias("child")).distinct().select("node")
    children = children.unionByName(lower.where("top").select(F.col("above").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("n_children"))
    children = materialize(children, "trie-children")
    n_children = F.broadcast(children) if children.count() <= BROADCAST_NODES else children
    own = own.join(n_children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    zero = F.lit(0).cast("long")
    mine = F.col("least") == F.col("conv_id")
    rest = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    saved = F.sum(F.when(mine, (F.col("n_convs") - 1) * F.col("bytes")).otherwise(zero)).over(rest) + F.coalesce("saved_below", zero)
    leaves = F.max(F.when(leaf & (F.col("n_children") == 0), 1).otherwise(0).cast("long")).over(rest) + F.coalesce("leaves_below", zero)
    own = own.withColumns({"saved": saved, "leaves": leaves})
    sums = own.groupBy("node").agg(F.min("least").alias("conv_id"), F.min("depth").alias("depth"), F.min("above_conv").alias("parent_conv_id"), F.max("n_convs").alias("n_convs"), F.max("n_children").alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    ends = ends_digests(path.where("upper and left = 0").select("node", "conv_id"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    merged = sums.join(ends, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(text_digest([]))))
    return merged.select(*columns).unionByName(lower.select(*columns))


#: Conversations that share a beginning in the query, and the most turns that are shared.
FAMILY, SHARED = 5, 8


def rebuilt_turns(conversations: DataFrame) -> DataFrame:
    """Turns of rebuilt conversations for ``prefix_trie``, a row of depth 0 for each conv_id included.

    Turns of a conv_id are ordered by turn (null first), then role, the first 64 characters and the digest of the turn; null roles and texts are empty. The
    first h turns of conversation c - c % FAMILY (all if fewer, none if it isn't there) come before c's own
    turns after its first h, h = crc32 of c in decimal, modulo SHARED + 1. The remainder has the sign of c.
    Rows without a conv_id belong to no conversation and are left out; repeated rows are turns of their own.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.unhex(F.sha2(F.concat_ws(":", F.octet_length(role).cast("string"), F.concat(role, text)), 256)), 1, 16)
    own = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("place"), role.alias("role"), digest.alias("turn"), F.octet_length(text).cast("long").alias("bytes"), F.substring(text, 1, 64).alias("begins"))
    order = Window.partitionBy("conv_id").orderBy(F.col("place").asc_nulls_first(), "role", "begins", "turn")
    own = own.select("conv_id", "turn", "bytes", F.row_number().over(order).cast("long").alias("i"), F.count(F.lit(1)).over(Window.partitionBy("conv_id")).alias("n"))
    own = materialize(own, "turns")
    h = lambda c: F.pmod(F.crc32(F.encode(F.col(c).cast("string"), "utf-8")), F.lit(SHARED + 1))

    ids = own.where("i = 1").select("conv_id", F.col("n").alias("own_turns"))
    first = own.where((F.col("conv_id") % FAMILY == 0) & (F.col("i") <= SHARED)).select(F.col("conv_id").alias("base"), "turn", "bytes", "i", "n")
    family = ids.withColumns({"h": h("conv_id"), "base": F.col("conv_id") - F.col("conv_id") % FAMILY})
    lent = family.join(first, "base").where("i <= h").select("conv_id", F.col("i").alias("depth"), "turn", "bytes")
    had = family.join(first.where("i = 1").select("base", F.col("n").alias("there")), "base", "left").select("conv_id", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("before"))
    kept = own.join(had, "conv_id").where("i > h").select("conv_id", (F.col("before") + F.col("i") - F.col("h")).alias("depth"), "turn", "bytes")
    root = ids.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("turn"), F.lit(0).cast("long").alias("bytes"))
    return root.unionByName(lent).unionByName(kept)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


_TURN = "strlen(role) || ':' || role || text"
NAME = "op11_prefix_trie"
SQL = f"""
WITH o AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, substr(text, 1, 64), sha256({_TURN})) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM o),
c AS (SELECT conv_id, conv_id - conv_id % {FAMILY} AS base, xor(list_reduce(flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: [CAST(ord(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
  lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, (a & 1) * 3988292384) END, CAST(4294967295 AS BIGINT)), 4294967295) % {SHARED + 1} AS h FROM (SELECT DISTINCT conv_id FROM t)),
l AS (SELECT c.conv_id, base, h, least(h, coalesce(max(n), 0)) AS lent FROM c LEFT JOIN t ON t.conv_id = base GROUP BY c.conv_id, base, h),
r AS (SELECT l.conv_id, i AS d, role, text FROM l JOIN t ON t.conv_id = base AND i <= h UNION ALL SELECT l.conv_id, lent + i - h, role, text FROM l JOIN t ON t.conv_id = l.conv_id AND i > h),
p AS (SELECT conv_id, d, strlen(text) AS b, list({_TURN}) OVER (PARTITION BY conv_id ORDER BY d) AS k FROM r UNION ALL SELECT conv_id, 0, 0, [] FROM l),
e AS (SELECT *, d = max(d) OVER (PARTITION BY conv_id) AS ends FROM p),
n AS (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(b) AS b, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM e GROUP BY k, d),
w AS (SELECT n.*, u.conv_id AS parent_conv_id FROM n LEFT JOIN n u ON n.d > 0 AND u.d = n.d - 1 AND u.k = n.k[1:n.d - 1]),
h AS (SELECT k[1:d - 1] AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
x AS (SELECT w.*, coalesce(n_children, 0) AS n_children FROM w LEFT JOIN h USING (k)),
s AS (SELECT p.k, count(*) FILTER (x.n_children = 0) AS n_leaves, sum((x.n_convs - 1) * x.b) AS saved FROM x JOIN p ON p.conv_id = x.conv_id AND p.d <= x.d GROUP BY p.k)
SELECT conv_id, CAST(d AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends_sha256 FROM x JOIN s USING (k)
"""
