"""Temperature mixing of sources, realised as block permutations.

A source with share p of all tokens gets weight p**t, normalised. The exponent is bisected on
aggregates until the mixture meets a target entropy, or is as even as a limit on repetition allows.
A source's weight times the budget is its token budget: whole epochs of it, and of one more
permuted epoch the documents up to a threshold, found by two levels of prefix sums so that a source
of any size is spread over many tasks. Each copy of a document falls into a block by its place in
the source's run of permutations, so every block holds the sources in their proportions.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparrowmill.llm.storage import materialize

#: Sources that may be broadcast; more are joined by shuffle.
BROADCAST_SOURCES = 100_000
#: Documents of a source in a range of permuted keys.
RANGE_DOCS = 5_000
#: Exponents tried at once, and rounds of trying.
GRID, ROUNDS = 32, 6
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: str) -> F.Column:
    """Words of a text as its tokens; null has none."""
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORDS)).cast("long")


def _statistics(sources: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """(entropy of the weights, largest repetition over the smallest) for each exponent."""
    # Shares as logarithms against the largest, so that no power overflows.
    cells = []
    for t in exponents:
        w = F.exp(F.lit(t) * F.col("logp"))
        cells += [F.sum(w), F.sum(w * F.lit(t) * F.col("logp")), F.max(F.lit(t - 1) * F.col("logp")) - F.min(F.lit(t - 1) * F.col("logp"))]
    row = sources.agg(*[c.alias(f"c{i}") for i, c in enumerate(cells)]).first()
    return [(math.log(row[3 * i]) - row[3 * i + 1] / row[3 * i], math.exp(row[3 * i + 2])) for i in range(len(exponents))]


def find_exponent(sources: DataFrame, entropy: float | None, repeats: float | None) -> float:
    """The exponent in [0, 1] for ``sources`` (logp).

    Entropy (in nats) falls with the exponent and so does the spread of repetition. With ``entropy``
    it is the exponent that meets it, with ``repeats`` the least one whose spread of repetition lies
    within it; a target out of reach gives the nearer end.
    """
    reached = (lambda s: s[0] <= entropy) if entropy is not None else (lambda s: s[1] <= repeats)
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        grid = [low + (high - low) * i / GRID for i in range(GRID + 1)]
        hits = [i for i, s in enumerate(_statistics(sources, grid)) if reached(s)]
        if not hits:
            return high
        if hits[0] == 0:
            return low
        low, high = grid[hits[0] - 1], grid[hits[0]]
    return high


def permuted_key(seed: int, epoch: F.Column, doc_id: str) -> F.Column:
    return F.xxhash64(F.lit(seed), epoch.cast("int"), F.col(doc_id))


def mix_sources(docs: DataFrame, tokens: F.Column, source: str = "source", doc_id: str = "doc_id", entropy: float | None = None, repeats: float | None = None, budget: int | None = None, block_tokens: int = 1_000_000, seed: int = 17) -> DataFrame:
    """Copies of the rows of ``docs`` in the mixture, with mix_tokens, mix_epoch, mix_block, mix_order.

    Exactly one of ``entropy`` and ``repeats`` is the target. The budget is in tokens; without one
    it is the least with which every source is used in full at least once, so nothing is lost and
    sources repeat up to ``repeats`` times. With one, sources may be cut. A source never takes more
    tokens than its budget; sources whose documents have no tokens are used once. Null tokens count
    as 0. Within a block, mix_order is the order of use. A null source is a source; rows that repeat a doc_id go together.
    Columns of ``docs`` that begin with mix_ are left out. An empty table stays empty.
    """
    if (entropy is None) == (repeats is None):
        raise ValueError("one of entropy and repeats is the target")
    docs = docs.select(*[c for c in docs.columns if not c.startswith("mix_")])
    named = docs.withColumns({"mix_source": F.coalesce(F.col(source).cast("string"), F.lit("\0")), "mix_tokens": F.coalesce(tokens, F.lit(0))})
    narrow = materialize(named.select("mix_source", F.col(doc_id).alias("doc_id"), "mix_tokens"), "mix-rows")
    totals = narrow.groupBy("mix_source").agg(F.sum("mix_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    sources = materialize(totals, "mix-sources")
    whole = sources.where("tokens > 0").agg(F.sum("tokens").alias("n"), F.max("tokens").alias("top")).first()
    if whole.n is None:
        plan = sources.select("mix_source", F.lit(1.0).alias("runs"), "tokens", "docs")
        use = 0.0
    else:
        known = sources.where("tokens > 0").withColumn("logp", F.log(F.col("tokens") / whole.top))
        t = find_exponent(known, entropy, repeats)
        norm = known.agg(F.sum(F.exp(F.lit(t) * F.col("logp"))).alias("z")).first().z
        # The largest source has the fewest runs, so its weight sets the least budget.
        use = float(whole.top) * norm if budget is None else float(budget)
        own = F.exp(F.lit(t) * F.col("logp")) * F.lit(use / norm)
        runs = F.round(own / F.col("tokens"), 9)  # a run of 0.9999999999 is a whole one
        plan = known.select("mix_source", runs.alias("runs"), "tokens", "docs").unionByName(sources.where("tokens = 0").select("mix_source", F.lit(1.0).alias("runs"), "tokens", "docs"))
    plan = materialize(plan.withColumn("full", F.floor("runs").cast("int")), "mix-plan")
    plan = plan.join(_thresholds(narrow, plan, seed), "mix_source", "left")
    plan = materialize(plan.select("mix_source", F.col("runs").alias("mix_runs"), F.col("full").alias("mix_full"), F.col("threshold").alias("mix_threshold")), "mix-thresholds")
    plan = F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan
    blocks = max(1, math.ceil(use / block_tokens))
    out = named.join(plan, "mix_source")
    out = out.withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), F.col("mix_full"))))
    key = permuted_key(seed, F.col("mix_epoch"), doc_id)
    out = out.withColumn("mix_order", key).where((F.col("mix_epoch") < F.col("mix_full")) | (F.col("mix_order") <= F.col("mix_threshold")))
    place = (F.col("mix_epoch") + (F.col("mix_order") / F.lit(2.0**64) + 0.5)) / F.greatest("mix_runs", F.lit(1e-9))
    block = F.least(F.floor(place * blocks), F.lit(blocks - 1)).cast("int").alias("mix_block")
    return out.select(*docs.columns, "mix_tokens", "mix_epoch", block, "mix_order")


def _thresholds(narrow: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """(mix_source, threshold): of the epoch that isn't whole, keys up to the threshold are used.

    Ranges of keys are summed first; only the range in which a source's budget ends is looked into.
    """
    partial = plan.where("runs > full and tokens > 0").select("mix_source", "full", ((F.col("runs") - F.col("full")) * F.col("tokens")).alias("rest"), F.ceil(F.col("docs") / RANGE_DOCS).alias("ranges"))
    small = partial.count() <= BROADCAST_SOURCES
    rows = narrow.join(F.broadcast(partial) if small else partial, "mix_source")
    rows = rows.withColumn("key", permuted_key(seed, F.col("full"), "doc_id"))
    rows = rows.withColumn("range", F.least(F.floor((F.col("key") / F.lit(2.0**64) + 0.5) * F.col("ranges")), F.col("ranges") - 1))
    sums = rows.groupBy("mix_source", "range").agg(F.sum("mix_tokens").alias("held"), F.max("key").alias("top"), F.first("rest").alias("rest"))
    before = Window.partitionBy("mix_source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("base", F.coalesce(F.sum("held").over(before), F.lit(0))).where(F.col("base") <= F.col("rest"))
    sums = materialize(sums, "mix-ranges")
    whole = sums.where(F.col("base") + F.col("held") <= F.col("rest")).groupBy("mix_source").agg(F.max("top").alias("threshold"))
    cut = sums.where(F.col("base") + F.col("held") > F.col("rest")).select("mix_source", "range", "base")
    inside = rows.join(F.broadcast(cut) if small else cut, ["mix_source", "range"])
    upto = Window.partitionBy("mix_source", "range").orderBy("key")  # equal keys go together
    inside = inside.withColumn("sum", F.col("base") + F.sum("mix_tokens").over(upto)).where(F.col("sum") <= F.col("rest"))
    inside = inside.groupBy("mix_source").agg(F.max("key").alias("threshold"))
    return whole.unionByName(inside).groupBy("mix_source").agg(F.max("threshold").alias("threshold"))


NAME, SQL = "op7_source_mixing", None
#: Sources are evened out as far as no document is used more than so many times as one of the largest source.
MOST_REPEATS = 2.0


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixed = mix_sources(docs, word_count("text"), repeats=MOST_REPEATS)
    return mixed.select("doc_id", "source", "mix_tokens", "mix_epoch", "mix_block", "mix_order")
