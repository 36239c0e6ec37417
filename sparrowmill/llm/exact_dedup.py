"""Exact deduplication with counting quotient filters.

Each partition of the input builds a counting quotient filter over the 64-bit fingerprints of its
normalised texts. Filters are cut into ranges of quotients, in as many steps as pieces stay large,
and ranges of the same quotients merge without loss because a filter keeps its remainders sorted:
merging is a merge of sorted runs that adds counts. Fingerprints whose merged count stays at one are unique for certain; only the others
go to byte verification, which groups the rows by the text itself.
"""

from __future__ import annotations

import itertools
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowmill.llm.storage import giving_back, materialize
from sparrowmill.llm.words import mix

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fingerprints that may be broadcast (16 bytes each in a hash relation); more are joined by shuffle.
BROADCAST_KEYS = 500_000
#: Fingerprints that a range of the merged filter holds on average.
RANGE_KEYS = 250_000
#: A filter is cut into 2 to this power of pieces at most.
STEP_BITS = 8


class QuotientFilter:
    """A counting quotient filter without loss: quotient and remainder give the fingerprint back.

    ``occupied`` has a bit for each quotient in use, ``run_end`` a bit for each slot that ends the
    run of its quotient, ``remainders`` one slot for each distinct fingerprint, sorted within runs,
    and ``counts`` how often it occurs.
    """

    def __init__(self, bits: int, occupied: np.ndarray, run_end: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.bits, self.occupied, self.run_end, self.remainders, self.counts = bits, occupied, run_end, remainders, counts

    @classmethod
    def build(cls, bits: int, prints: np.ndarray, counts: np.ndarray | None = None) -> QuotientFilter:
        """Of fingerprints in any order; ``counts`` says how often each was seen (else once)."""
        order = np.argsort(prints, kind="stable")
        prints = prints[order]
        counts = np.ones(len(prints), np.int64) if counts is None else counts[order]
        if len(prints):
            heads = np.flatnonzero(np.r_[True, prints[1:] != prints[:-1]])
            prints, counts = prints[heads], np.add.reduceat(counts, heads)
        return cls.of_sorted(bits, prints, counts)

    @classmethod
    def of_sorted(cls, bits: int, prints: np.ndarray, counts: np.ndarray) -> QuotientFilter:
        """Of distinct fingerprints in ascending order."""
        quotients = (prints >> np.uint64(64 - bits)).astype(np.int64)
        occupied = np.zeros(1 << bits, dtype=bool)
        occupied[quotients] = True
        run_end = np.r_[quotients[1:] != quotients[:-1], True] if len(prints) else np.zeros(0, bool)
        return cls(bits, occupied, run_end, prints & np.uint64((1 << (64 - bits)) - 1), counts)

    def prints(self) -> np.ndarray:
        """The distinct fingerprints in ascending order."""
        runs = np.cumsum(np.r_[0, self.run_end[:-1]]) if len(self.run_end) else np.zeros(0, np.int64)
        quotients = np.flatnonzero(self.occupied)[runs].astype(np.uint64)
        return (quotients << np.uint64(64 - self.bits)) | self.remainders

    def merge(self, other: QuotientFilter) -> QuotientFilter:
        """Both filters' content: the sorted remainders of one go to their places among the other's, counts of equal ones are added."""
        few, many = sorted((self, other), key=lambda f: len(f.remainders))
        prints, counts, new = many.prints(), many.counts.copy(), few.prints()
        at = np.searchsorted(prints, new)
        same = at < len(prints)
        same[same] = prints[at[same]] == new[same]
        counts[at[same]] += few.counts[same]
        prints, counts = np.insert(prints, at[~same], new[~same]), np.insert(counts, at[~same], few.counts[~same])
        return QuotientFilter.of_sorted(slot_bits(len(prints)), prints, counts)

    def to_bytes(self) -> bytes:
        large = self.counts > 255
        return b"".join((
            struct.pack("<BII", self.bits, len(self.remainders), int(large.sum())),
            np.packbits(self.occupied).tobytes(), np.packbits(self.run_end).tobytes(), self.remainders.astype("<u8").tobytes(),
            np.where(large, 0, self.counts).astype("u1").tobytes(), self.counts[large].astype("<i8").tobytes(),
        ))

    @classmethod
    def from_bytes(cls, raw: bytes) -> QuotientFilter:
        bits, n, m = struct.unpack_from("<BII", raw)
        at = struct.calcsize("<BII")

        def take(dtype: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, dtype=dtype, count=count, offset=at)
            at += out.nbytes
            return out

        occupied = np.unpackbits(take("u1", ((1 << bits) + 7) // 8))[: 1 << bits].astype(bool)
        run_end = np.unpackbits(take("u1", (n + 7) // 8))[:n].astype(bool)
        remainders, counts = take("<u8", n).astype(np.uint64), take("u1", n).astype(np.int64)
        counts[counts == 0] = take("<i8", m)
        return cls(bits, occupied, run_end, remainders, counts)


class Merging:
    """Any number of filters merged as a tree: one waits at each size, so a fingerprint moves a logarithm of times."""

    def __init__(self) -> None:
        self.waiting: list[QuotientFilter] = []

    def add(self, own: QuotientFilter) -> None:
        while self.waiting and len(self.waiting[-1].remainders) <= 2 * len(own.remainders):
            own = self.waiting.pop().merge(own)
        self.waiting.append(own)

    def total(self) -> QuotientFilter:
        while len(self.waiting) > 1:
            self.waiting.append(self.waiting.pop().merge(self.waiting.pop()))
        return self.waiting[0]


def range_steps(range_bits: int, step_bits: int = STEP_BITS) -> list[int]:
    """Bits of the ranges to which filters are cut in each merge: at most ``step_bits`` more than in the one before."""
    return [*range(step_bits, range_bits, step_bits), range_bits]


def repeated_fingerprints(prints: DataFrame, column: str, range_bits: int, step_bits: int = STEP_BITS) -> DataFrame:
    """(fingerprint, copies) of the values of ``column`` that occur more than once.

    The top ``range_bits`` of a fingerprint name the range of the filter it belongs to. Nulls are
    left out. Whatever the number of copies, a partition sends one slot for a fingerprint.

    A filter is cut into 2 ** step_bits pieces at most. Where there are more ranges, it takes several
    merges: the pieces of one coarse range that come from some of the partitions merge to a filter
    of the size of a final range, which is cut again, so that pieces stay large and tasks small.
    """
    steps = range_steps(range_bits, step_bits)

    def cut(merged: np.ndarray, counts: np.ndarray, bits: int, lot: int) -> pa.RecordBatch:
        """The pieces of ascending fingerprints; the lot says with which other pieces one merges."""
        part = (merged >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(merged), np.int64)
        heads = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])[: len(part)]
        ends = np.r_[heads[1:], len(part)].astype(np.int64)
        filters = [QuotientFilter.of_sorted(slot_bits(int(y - x)), merged[x:y] << np.uint64(bits), counts[x:y]).to_bytes() for x, y in zip(heads, ends, strict=True)]
        return pa.RecordBatch.from_pydict({"part": pa.array(part[heads], pa.int64()), "lot": pa.array(np.full(len(heads), lot), pa.int64()), "filter": pa.array(filters, pa.binary())})

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merging = Merging()
        for batch in batches:
            values = batch.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            if len(values):
                merging.add(QuotientFilter.build(slot_bits(len(values)), values))
        if merging.waiting:
            total = merging.total()
            lot = int(mix(np.array([TaskContext.get().partitionId()], np.uint64))[0] & np.uint64((1 << (range_bits - steps[0])) - 1))
            yield cut(total.prints(), total.counts, steps[0], lot)

    def merged(bits: int, key: tuple, batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints of a coarse range, and their counts."""
        merging = Merging()
        for batch in batches:
            for raw in batch.column("filter"):
                merging.add(QuotientFilter.from_bytes(raw.as_py()))
        total = merging.total()
        values = total.prints()
        return ((values >> np.uint64(bits)) | (np.uint64(key[0].as_py()) << np.uint64(64 - bits)) if bits else values), total.counts

    def again(bits: int, finer: int) -> Callable:
        def step(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield cut(*merged(bits, key, batches), finer, key[1].as_py() >> (finer - bits))

        return step

    def last(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, counts = merged(range_bits, key, batches)
        many = counts > 1
        yield pa.RecordBatch.from_pydict({"fingerprint": pa.array(values[many].view(np.int64)), "copies": pa.array(counts[many])})

    pieces = prints.select(column).mapInArrow(giving_back(build), "part long, lot long, filter binary")
    for bits, finer in itertools.pairwise(steps):
        pieces = pieces.groupBy("part", "lot").applyInArrow(giving_back(again(bits, finer)), "part long, lot long, filter binary")
    return pieces.groupBy("part", "lot").applyInArrow(giving_back(last), "fingerprint long, copies long")


def slot_bits(n: int) -> int:
    """Quotient bits for n fingerprints: about one for each quotient."""
    return max(3, int(n).bit_length())


def normalised(text: str) -> F.Column:
    """Null as empty, A-Z in lower case."""
    return F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The row with the
    largest doc_id stays. Rows that repeat a doc_id are rows of their own, and of a tie for the
    largest every row says kept. A null doc_id is smaller than any other; a group of nothing else
    has keep_id null and is kept. Other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), normalised(text).alias("norm"))
    rows = rows.select("doc_id", "norm", F.xxhash64("norm").alias("fingerprint"))
    base = materialize(rows.select("doc_id", "fingerprint", F.sha2("norm", 256).alias("text_sha256")), "exact-dedup")
    range_bits = max(0, (base.count() // RANGE_KEYS).bit_length())
    repeated = materialize(repeated_fingerprints(base, "fingerprint", range_bits), "exact-dedup-filter").select("fingerprint")
    if repeated.count() <= BROADCAST_KEYS:
        repeated = F.broadcast(repeated)
    suspects = rows.join(repeated, "fingerprint")
    # Grouping by the text compares its bytes; the partial aggregation sends one text for a group and task.
    groups = suspects.groupBy("fingerprint", "norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.where("group_size > 1").select("fingerprint", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size")
    alone = F.col("group_size").isNull()
    out = base.join(groups, ["fingerprint", "text_sha256"], "left")
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | F.col("keep_id").eqNullSafe(F.col("doc_id"))).alias("kept"),
        "text_sha256",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


NAME = "op10_exact_dedup"
SQL = f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g USING (norm)
"""
