"""WARC archives from a table of pages, written in parallel with the same bytes on every run.

Records are sorted by range of page_id over shards. Each task writes its shard to files that roll
at a compressed size, under temporary names, and renames them when it is done; a manifest lists
the files that count. Headers, record ids, digests and dates come from the row alone, so a retried
task writes the same file. A payload that occurs several times is written once, as a response;
the others are revisit records that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowmill.llm.id_ranges import id_ranges
from sparrowmill.llm.storage import giving_back, materialize, new_folder, open_fs

#: Payload bytes for a shard, and compressed bytes at which a task starts another file.
SHARD_BYTES, FILE_BYTES = 16 << 20, 4 << 20
#: What a row counts besides its payload where rows of one id are split.
ROW_BYTES = 256
MOST_SHARDS = 20_000
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_DATE = "1970-01-01T00:00:00Z"
MANIFEST = "name string, n_records long, n_bytes long, sha256 string"


def _one_line(value: str) -> str:
    return " ".join(value.split())


def record_id(page_id: int | None, sha: str, ordinal: int, url: str | None = None) -> str:
    """The record's URN; ordinal tells rows with the same page_id and payload apart, of pages without an id those with the same url and payload."""
    name = f"{page_id}/{sha}/{ordinal}"
    return f"<urn:uuid:{uuid.uuid5(_SPACE, name if page_id is not None or url is None else f'{name}/{url}')}>"


def record_bytes(page_id: int | None, sha: str, ordinal: int, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record with its HTTP head; a revisit (refers_to set) holds the head only."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if refers_to is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, sha, ordinal, url)}", f"WARC-Date: {_DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_one_line(url)}")
    if page_id is not None:
        lines.append(f"WARC-Page-ID: {page_id}")
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}", f"WARC-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {record_id(refers_to, sha, 0)}", f"WARC-Refers-To-Page-ID: {refers_to}", f"WARC-Profile: {_PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _gzip(raw: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


class _Roller:
    """Files of one shard: opened under temporary names, renamed by commit()."""

    def __init__(self, folder: str, shard: int, limit: int):
        self.store, self.path = open_fs(f"{folder}/part-{shard:05d}")
        self.store.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.attempt, self.limit, self.file, self.done = TaskContext.get().taskAttemptId(), limit, None, []

    def add(self, member: bytes) -> None:
        if self.file is not None and self.size + len(member) > self.limit:
            self.close()
        if self.file is None:
            self.name = f"{self.path}-{len(self.done):05d}.warc.gz"
            self.file, self.size, self.number, self.digest = self.store.open_output_stream(f"{self.name}.tmp-{self.attempt}", compression=None), 0, 0, hashlib.sha256()
        self.file.write(member)
        self.digest.update(member)
        self.size, self.number = self.size + len(member), self.number + 1

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.done.append((self.name, self.number, self.size, self.digest.hexdigest()))
            self.file = None

    def commit(self, folder: str) -> list[dict]:
        self.close()
        for name, _, size, _ in self.done:
            there = self.store.get_file_info(name)
            if there.type != pafs.FileType.NotFound and there.size == size:
                # An earlier attempt got as far as this; its bytes are the same.
                self.store.delete_file(f"{name}.tmp-{self.attempt}")
                continue
            if there.type != pafs.FileType.NotFound:
                self.store.delete_file(name)
            self.store.move(f"{name}.tmp-{self.attempt}", name)
        return [{"name": f"{folder}/{name.rpartition('/')[2]}", "n_records": k, "n_bytes": size, "sha256": digest} for name, k, size, digest in self.done]


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record for each row of ``pages``; the manifest, a row for each file.

    Null payloads are empty, null urls leave the header out. Of equal payloads of min_bytes or more,
    the row with the largest page_id is the response and the others revisit it (of several rows with
    that page_id the first in order of url). Rows with a null page_id are always responses.
    Rows of a page_id that outweighs a shard, or of none, spread over shards by payload, those of
    none by url too; equal ones stay together. An empty table writes no file.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("html"))
    size = F.octet_length("html")
    small = rows.select("page_id", size.alias("n"), F.when(size >= min_bytes, F.sha2("html", 256)).alias("sha"))
    small = materialize(small, "warc-digests")
    ranges = id_ranges(small.select(F.col("page_id").alias("id"), "n"), shard_bytes, MOST_SHARDS, ROW_BYTES)
    content = lambda sha: F.when(F.col("page_id").isNull(), F.xxhash64("url", sha)).otherwise(F.xxhash64(sha))
    # Who refers to whom travels as small rows to the shard of the page, so payloads move once.
    equal = small.where("sha is not null and page_id is not null")
    last = equal.groupBy("sha").agg(F.max("page_id").alias("target"), F.count(F.lit(1)).alias("many")).where("many > 1")
    links = equal.join(last, "sha").select("page_id", F.lit(None).cast("string").alias("url"), F.col("sha").alias("html"), F.col("target"), F.lit(0).alias("kind")).distinct()
    whole = rows.select("page_id", "url", "html", F.lit(None).cast("long").alias("target"), F.lit(1).alias("kind"))
    # In a link html is the digest already.
    sha = F.when(F.col("kind") == 0, F.col("html")).otherwise(F.sha2("html", 256))
    both = links.unionByName(whole).withColumn("shard", ranges.shard(F.col("page_id"), content(sha)))
    both = both.repartitionById(ranges.count, "shard").sortWithinPartitions(F.col("page_id").asc_nulls_first(), "kind", F.col("url").asc_nulls_first(), F.xxhash64("html"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, last, url, links, seen = None, object(), object(), {}, {}
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    out = _Roller(folder, row["shard"], file_bytes)
                if row["page_id"] != last:
                    last, links, seen = row["page_id"], {}, {}
                if last is None and row["url"] != url:
                    seen = {}
                url = row["url"]
                if row["kind"] == 0:  # here html is the digest of the payload that the link is for
                    links[row["html"]] = row["target"]
                    continue
                payload = row["html"].encode()
                sha = hashlib.sha256(payload).hexdigest()
                ordinal, target = seen.get(sha, 0), links.get(sha)
                seen[sha] = ordinal + 1
                refers = target if target is not None and (target != last or ordinal) else None
                out.add(_gzip(record_bytes(last, sha, ordinal, row["url"], payload, refers)))
        if out is not None:
            yield pa.RecordBatch.from_pylist(out.commit(folder), pa.schema([("name", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64()), ("sha256", pa.string())]))

    return materialize(both.mapInArrow(giving_back(write), MANIFEST), "warc-manifest")


def _members(stream, digest, step: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a file, each unpacked; ``digest`` gets the bytes of the file."""
    packed, unpack, parts = b"", zlib.decompressobj(31), []
    while True:
        if not packed:
            packed = stream.read(step)
            if not packed:
                break
            digest.update(packed)
        parts.append(unpack.decompress(packed))
        packed = b""
        if unpack.eof:
            yield b"".join(parts)
            packed, unpack, parts = unpack.unused_data, zlib.decompressobj(31), []


def parse_record(raw: bytes) -> dict:
    """A record's headers, and its payload where it has one."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if base64.b32encode(hashlib.sha1(block).digest()).decode() != fields["WARC-Block-Digest"].removeprefix("sha1:"):
        raise ValueError(f"block digest of {fields['WARC-Record-ID']} does not hold")
    payload = block.partition(b"\r\n\r\n")[2]
    if fields["WARC-Type"] == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != fields["WARC-Payload-Digest"].removeprefix("sha1:"):
        raise ValueError(f"payload digest of {fields['WARC-Record-ID']} does not hold")
    return fields | {"payload": payload}


def read_archives(manifest: DataFrame) -> DataFrame:
    """Records of the manifest's files: page_id, url, payload_bytes, payload_digest, record_type,
    refers_to, payload (null for revisits). Every digest is checked, and each file against its row
    of the manifest."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for file in batch.to_pylist():
                store, path = open_fs(file["name"])
                rows, held, records, digest = [], 0, 0, hashlib.sha256()
                with store.open_input_stream(path, compression=None) as f:
                    for raw in _members(f, digest):
                        r = parse_record(raw)
                        number = lambda k, r=r: int(r[k]) if k in r else None
                        rows.append({"page_id": number("WARC-Page-ID"), "url": r.get("WARC-Target-URI"), "payload_bytes": number("WARC-Payload-Length"), "payload_digest": r["WARC-Payload-Digest"].removeprefix("sha1:"), "record_type": r["WARC-Type"], "refers_to": number("WARC-Refers-To-Page-ID"), "payload": r["payload"] if r["WARC-Type"] == "response" else None})
                        held, records = held + len(raw), records + 1
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if (records, store.get_file_info(path).size, digest.hexdigest()) != (file["n_records"], file["n_bytes"], file["sha256"]):
                    raise ValueError(f"{file['name']} is not what the manifest says")
                yield pa.RecordBatch.from_pylist(rows, schema)

    files = manifest.select("name", "n_records", "n_bytes", "sha256")
    files = files.repartition(max(1, min(MOST_SHARDS, files.count())), "name")
    return files.mapInArrow(giving_back(read), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


NAME = "op9_warc"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), new_folder(spark, "warc"))
    return read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_HEX = "0123456789abcdef"
_FIVES = ", ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((strpos('{_HEX}', substr(h, {1 + i * 5 // 4}, 1)) - 1) * {1 << 4} + (CASE WHEN {i * 5 // 4 + 1} < 40 THEN strpos('{_HEX}', substr(h, {2 + i * 5 // 4}, 1)) - 1 ELSE 0 END) AS INTEGER) // {1 << (3 - i * 5 % 4)} % 32, 1)" for i in range(32))
SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT html, max(page_id) AS last FROM p GROUP BY html)
SELECT p.page_id, CAST(octet_length(encode(p.html)) AS BIGINT) AS payload_bytes, concat({_FIVES}) AS payload_digest,
  CASE WHEN p.page_id = m.last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN p.page_id = m.last THEN NULL ELSE m.last END AS refers_to
FROM p JOIN m USING (html)
"""
