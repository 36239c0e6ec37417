"""Rows that a stored corpus does not hold yet, told mostly by a Bloom filter kept beside it.

The store is two tables: digests of the corpus' keys, and a blocked Bloom filter over them. A key sets
its bits within one block of 64 bytes; parts of the corpus make their filters alone, and filters merge by
OR. New rows whose bits aren't all set are new, where they stand: their texts never move. Only the
others, the seen ones and few by chance, go to an exact join by digest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from sparrowmill.functions.text import trim_u
from sparrowmill.sources.shared import stored

#: Bytes of a block, and bits that a key sets in it.
BLOCK, SET = 64, 8
#: Bits for each key of the corpus that a filter is made for.
BITS_PER_KEY = 12
#: Blocks of a row of the filter table (4 MB).
CHUNK = 1 << 16
#: A filter up to this size is broadcast; with a larger one all new rows go to the exact join.
BROADCAST_BYTES = 256 << 20


def key_digest(key: str) -> Column:
    """The SHA-256 of a trimmed key; null is a key of its own."""
    return F.unhex(F.sha2(F.coalesce(F.concat(F.lit("="), trim_u(F.col(key).cast("string"))), F.lit("")), 256))


def _block(blocks: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(blocks))


def _places(digests: pa.Array) -> np.ndarray:
    """[key, SET]: the bits of its block that a key sets, from bytes of its digest."""
    raw = np.frombuffer(b"".join(digests.to_pylist()), np.uint8).reshape(-1, 32)
    return (raw[:, : 2 * SET].copy().view(np.uint16) % np.uint16(8 * BLOCK)).astype(np.int64)


def _filters(keys: DataFrame, blocks: int) -> DataFrame:
    """(chunk, bits) of keys: the filter in chunks of at most CHUNK blocks, those without keys left out."""

    def fill(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = key[0].as_py()
        bits = np.zeros(min(CHUNK, blocks - chunk * CHUNK) * BLOCK, np.uint8)
        for batch in rows:
            at = (batch.column("block").to_numpy()[:, None] % CHUNK) * 8 * BLOCK + _places(batch.column("digest"))
            np.bitwise_or.at(bits, (at >> 3).ravel(), (1 << (at & 7)).astype(np.uint8).ravel())
        yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int64()), "bits": pa.array([bits.tobytes()], pa.binary())})

    placed = keys.select("digest", _block(blocks).alias("block")).withColumn("chunk", F.floor(F.col("block") / CHUNK))
    return placed.groupBy("chunk").applyInArrow(fill, "chunk long, bits binary")


def _merged(filters: DataFrame) -> DataFrame:
    """Filters of parts of a corpus as one, by OR."""

    def merge(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None
        for one in (x for batch in parts for x in batch.column("bits")):
            own = np.frombuffer(one.as_buffer(), np.uint8)
            bits = own.copy() if bits is None else np.bitwise_or(bits, own, out=bits)
        yield pa.RecordBatch.from_pydict({"chunk": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([bits.tobytes()], pa.binary())})

    return filters.groupBy("chunk").applyInArrow(merge, "chunk long, bits binary")


def make_store(corpus: DataFrame, key: str, path: str, expected: int | None = None) -> None:
    """Writes a store for ``corpus`` below ``path``, for ``expected`` keys in the end (twice those there are
    by default). With more, more rows go to the exact join; the result stays the same."""
    keys = stored(corpus.select(key_digest(key).alias("digest")).distinct(), "seen-keys")
    blocks = max(1, -(-(expected or 2 * keys.count()) * BITS_PER_KEY // (8 * BLOCK)))
    corpus.sparkSession.createDataFrame([(blocks,)], "blocks long").write.parquet(f"{path}/size")
    add_to_store(keys, path, blocks)


def add_to_store(keys: DataFrame, path: str, blocks: int | None = None) -> None:
    """Adds digests (a column digest) to a store. The filter goes first: a key that is in the table but not
    in the filter would be taken for new."""
    blocks = blocks or keys.sparkSession.read.parquet(f"{path}/size").first().blocks
    _filters(keys, blocks).write.mode("append").parquet(f"{path}/filter")
    keys.select("digest").write.mode("append").parquet(f"{path}/keys")


def unseen_rows(new: DataFrame, key: str, path: str) -> DataFrame:
    """Rows of ``new`` whose trimmed key isn't in the store; repeats among them stay."""
    spark = new.sparkSession
    rows = new.withColumn("digest", key_digest(key)) if "digest" not in new.columns else None
    if rows is None:
        raise ValueError("a column named digest is in the way")
    keys = spark.read.schema("digest binary").parquet(f"{path}/keys")
    exact = lambda df: df.join(keys, "digest", "left_anti").select(*new.columns)
    blocks = spark.read.parquet(f"{path}/size").first().blocks
    if blocks * BLOCK > BROADCAST_BYTES:
        return exact(rows)
    whole = np.zeros(blocks * BLOCK, np.uint8)  # at most BROADCAST_BYTES
    for row in _merged(spark.read.schema("chunk long, bits binary").parquet(f"{path}/filter")).toLocalIterator():
        own = np.frombuffer(row.bits, np.uint8)
        whole[row.chunk * CHUNK * BLOCK :][: len(own)] = own
    shared = spark.sparkContext.broadcast(whole)

    def may_hold(block: pa.Array, digest: pa.Array) -> pa.Array:
        at = block.to_numpy(zero_copy_only=False)[:, None] * 8 * BLOCK + _places(digest)
        return pa.array(((shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1))

    maybe = F.arrow_udf(may_hold, BooleanType())(_block(blocks), F.col("digest"))
    return rows.where(~maybe).select(*new.columns).unionByName(exact(rows.where(maybe)))
