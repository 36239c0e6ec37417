"""Token ids in shard files, with a minimal perfect hash index from document keys to offsets.

A shard holds a range of doc_id in ascending order (nulls first): ``*.ids`` has the raw ids of its
documents one after another, ``*.idx`` the index. The index is a cascade of bit arrays: at each
level a key that hits a place alone sets its bit and is placed, the others go on; a key's slot is
the rank of its bit. Each slot stores a 32-bit fingerprint, which turns away keys that are not in
the shard, and the key's first record and number of records.

File names carry the task attempt, and the manifest lists the files of the attempts that ended
well, so a retried task leaves no trace in the result.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparrowmill.llm.id_ranges import IdRanges, id_ranges
from sparrowmill.llm.storage import giving_back, materialize, new_folder, open_fs, sliced
from sparrowmill.llm.word_codec import codec
from sparrowmill.llm.words import SCAN_BYTES, mix

#: UTF-8 bytes of text for a shard.
SHARD_BYTES = 16 << 20
#: Shards at most; beyond this they get longer.
MOST_SHARDS = 20_000
#: What a row counts besides its text where rows of one id are split.
ROW_BYTES = 64
#: Bytes of ids that a task reads at a time.
STEP_BYTES = 8 << 20
_U = np.uint64
_MAGIC = b"MPHX0001"


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: slot(keys) is a bijection to 0 .. n - 1."""

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest
        self.ranks, total = [], 0
        for bits in levels:
            self.ranks.append(total + np.cumsum(bits, dtype=np.int64) - bits)
            total += int(bits.sum())
        self.placed = total

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + _U((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % _U(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray, spread: float = 2.0, most_levels: int = 48) -> PerfectHash:
        levels: list[np.ndarray] = []
        while len(keys) and len(levels) < most_levels:
            size = max(8, int(len(keys) * spread))
            place = cls._place(keys, len(levels), size)
            alone = np.bincount(place, minlength=size) == 1
            levels.append(alone)
            keys = keys[~alone[place]]
        return cls(levels, np.sort(keys))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; of a key that wasn't built in any slot, or -1."""
        out = np.full(len(keys), -1, dtype=np.int64)
        left = np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            place = self._place(keys[left], level, len(bits))
            hit = bits[place]
            out[left[hit]] = self.ranks[level][place[hit]]
            left = left[~hit]
        if len(self.rest) and len(left):
            at = np.minimum(np.searchsorted(self.rest, keys[left]), len(self.rest) - 1)
            same = self.rest[at] == keys[left]
            out[left[same]] = self.placed + at[same]
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ _U(0xA5A5A5A55A5A5A5A)) >> _U(32)).astype(np.uint32)


class ShardIndex:
    """Index of one shard: records of a key are consecutive; ``ends[i]`` is where record i ends, in ids."""

    def __init__(self, hashing: PerfectHash, prints: np.ndarray, first: np.ndarray, number: np.ndarray, ends: np.ndarray, n_null: int):
        self.hashing, self.prints, self.first, self.number, self.ends, self.n_null = hashing, prints, first, number, ends, n_null

    @classmethod
    def build(cls, keys: np.ndarray, ends: np.ndarray, n_null: int) -> ShardIndex:
        """keys: of all records after the n_null first ones, equal ones side by side."""
        heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        own = keys[heads]
        hashing = PerfectHash.build(own)
        slots = hashing.slots(own)
        prints, first, number = np.zeros(len(own), np.uint32), np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
        prints[slots], first[slots] = fingerprints(own), heads + n_null
        number[slots] = np.diff(np.r_[heads, len(keys)])
        return cls(hashing, prints, first, number, ends, n_null)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First record and number of records of each key; number 0 for keys that are turned away."""
        slots = self.hashing.slots(keys)
        known = slots >= 0
        known[known] = self.prints[slots[known]] == fingerprints(keys[known])
        first, number = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        first[known], number[known] = self.first[slots[known]], self.number[slots[known]]
        return first, number

    def to_bytes(self) -> bytes:
        parts = [np.packbits(b) for b in self.hashing.levels]
        parts += [self.hashing.rest.astype("<u8"), self.prints.astype("<u4"), self.first.astype("<i8"), self.number.astype("<i8"), self.ends.astype("<i8")]
        head = json.dumps({"levels": [len(b) for b in self.hashing.levels], "keys": len(self.prints), "rest": len(self.hashing.rest), "records": len(self.ends), "nulls": self.n_null}).encode()
        return b"".join([_MAGIC, len(head).to_bytes(4, "little"), head, *(p.tobytes() for p in parts)])

    @classmethod
    def from_bytes(cls, raw: bytes) -> ShardIndex:
        if raw[:8] != _MAGIC:
            raise ValueError("not a shard index")
        at = 12 + int.from_bytes(raw[8:12], "little")
        head = json.loads(raw[12:at])

        def take(dtype: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, dtype, n, at)
            at += out.nbytes
            return out

        levels = [np.unpackbits(take("u1", (n + 7) // 8))[:n].astype(bool) for n in head["levels"]]
        rest = take("<u8", head["rest"])
        return cls(PerfectHash(levels, rest), take("<u4", head["keys"]), take("<i8", head["keys"]), take("<i8", head["keys"]), take("<i8", head["records"]), head["nulls"])


def write_store(docs: DataFrame, folder: str, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, IdRanges]:
    """Encode the documents and write the store; its manifest (a row for each shard) and the ranges.

    Null texts are empty; each document ends with end_id. Rows that repeat a doc_id are records of
    their own, null doc_ids come first; where those of one doc_id, or of none, outweigh a shard, they
    spread over several by their texts. An empty table gives an empty manifest.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ranges = id_ranges(docs.select(F.col("doc_id").alias("id"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")), shard_bytes, MOST_SHARDS, ROW_BYTES)
    end = np.array([end_id], codec(tokenizer).dtype).tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer)
        for batch in sliced(batches, "text", SCAN_BYTES):
            ids, cuts = own.encode(batch.column("text"))
            raw, width = ids.tobytes(), own.dtype.itemsize
            packed = [raw[a * width : b * width] + end for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"shard": batch.column("shard"), "doc_id": batch.column("doc_id"), "ids": pa.array(packed, pa.binary())})

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, keys, ends, nulls, out, row = np.dtype(codec(tokenizer).dtype).itemsize, [], [], 0, None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:  # a partition holds one shard
                context = TaskContext.get()
                name = f"{folder}/shard-{batch.column('shard')[0].as_py():05d}-{context.taskAttemptId()}"
                store, path = open_fs(name)
                store.create_dir(path.rpartition("/")[0], recursive=True)
                out, row = store.open_output_stream(path + ".ids"), {"shard": batch.column("shard")[0].as_py(), "name": name}
            nulls += batch.column("doc_id").null_count
            keys.append(batch.column("doc_id").drop_null().to_numpy(zero_copy_only=False).view(np.uint64))
            for ids in batch.column("ids"):
                raw = ids.as_py()
                ends.append(len(raw) // width)
                out.write(raw)
        if out is not None:
            out.close()
            ends_at = np.cumsum(np.array(ends, np.int64))
            with store.open_output_stream(path + ".idx") as f:
                f.write(ShardIndex.build(np.concatenate(keys), ends_at, nulls).to_bytes())
            row |= {"n_docs": len(ends), "n_ids": int(ends_at[-1])}
            yield pa.RecordBatch.from_pylist([row], pa.schema([("shard", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    rows = docs.select(ranges.shard(F.col("doc_id"), F.xxhash64("text")).alias("shard"), "doc_id", "text")
    rows = rows.mapInArrow(giving_back(encode), "shard int, doc_id long, ids binary").repartitionById(ranges.count, "shard")
    rows = rows.sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    manifest = materialize(rows.mapInArrow(giving_back(write), "shard int, name string, n_docs long, n_ids long"), "token-manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # A row for each shard, three times MOST_SHARDS at most.
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0))), ranges


def read_records(keys: DataFrame, manifest: DataFrame, ranges: IdRanges, dtype: str) -> DataFrame:
    """Records of the doc_ids in ``keys`` (one column): doc_id, start, n_tokens, ids.

    Each distinct doc_id is looked up in the index of each of its shards once; a doc_id with several records
    gives a row for each, one without any gives none. ids are raw little-endian values.
    """
    width = np.dtype(dtype).itemsize

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, last = None, "none yet"
        for batch in batches:
            if not batch.num_rows:
                continue
            if index is None:
                base = batch.column("base")[0].as_py()
                store, path = open_fs(batch.column("name")[0].as_py())
                with store.open_input_stream(path + ".idx") as f:
                    index = ShardIndex.from_bytes(f.read())
                payload = store.open_input_file(path + ".ids")
            asked = []
            for k in batch.column("doc_id").to_pylist():  # in order, so repeated ones are neighbours
                if k != last:
                    asked.append(k)
                last = k
            present = np.array([k for k in asked if k is not None], np.int64)
            first, number = index.find(present.view(np.uint64))
            records, owners = np.repeat(first, number) + _counters(number), np.repeat(present, number).tolist()
            if None in asked:
                records, owners = np.r_[np.arange(index.n_null), records], [None] * index.n_null + owners
            starts = np.r_[0, index.ends][records]
            ends = index.ends[records]
            at = 0
            while at < len(records):
                stop = max(at + 1, int(np.searchsorted(ends, starts[at] + STEP_BYTES // width, side="right")))
                raw = payload.read_at(int(ends[stop - 1] - starts[at]) * width, int(starts[at]) * width)
                origin = starts[at]
                ids = [raw[(a - origin) * width : (b - origin) * width] for a, b in zip(starts[at:stop].tolist(), ends[at:stop].tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(owners[at:stop], pa.int64()), "start": pa.array(starts[at:stop] + base), "n_tokens": pa.array(ends[at:stop] - starts[at:stop]), "ids": pa.array(ids, pa.binary())})
                at = stop

    asked = keys.toDF("doc_id").select(F.col("doc_id").cast("long"))
    first, pieces = ranges.first(F.col("doc_id")), ranges.pieces(F.col("doc_id"))
    if ranges.splits:  # an id with several shards asks each of them, once for all its rows
        several = asked.where(pieces > 1).distinct().select(F.explode(F.sequence(first, first + pieces - 1)).alias("shard"), "doc_id")
        asked = asked.where(pieces == 1).select(first.alias("shard"), "doc_id").unionByName(several)
    else:
        asked = asked.select(first.alias("shard"), "doc_id")
    asked = asked.repartitionById(ranges.count, "shard")
    # The manifest is small, see above. The join goes first: the optimizer takes away a sort below a join.
    asked = asked.join(F.broadcast(manifest.select("shard", "name", "base")), "shard").sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    return asked.mapInArrow(giving_back(look_up), "doc_id long, start long, n_tokens long, ids binary")


def _counters(number: np.ndarray) -> np.ndarray:
    """0 .. n - 1 for each n, one after another."""
    ends = np.cumsum(number)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - number, number)


def checksums(records: DataFrame, dtype: str) -> DataFrame:
    """ids replaced by the unsigned CRC-32 of their values as little-endian 32-bit integers."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [zlib.crc32(np.frombuffer(x.as_py(), dtype).astype("<u4").tobytes()) for x in batch.column("ids")]
            yield pa.RecordBatch.from_pydict({n: batch.column(n) for n in ("doc_id", "start", "n_tokens")} | {"ids_crc32": pa.array(found, pa.int64())})

    return records.mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


NAME, SQL = "op1_token_store", None


def query(spark: SparkSession, sf_dir: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest, ranges = write_store(docs, new_folder(spark, "token-store"), path, 1, shard_bytes=shard_bytes)
    dtype = codec(path).dtype.str
    return checksums(read_records(docs.select("doc_id"), manifest, ranges, dtype), dtype)
