"""Elements of JSON arrays in files of any size, cut by many tasks.

A file is dealt in byte ranges. What a range changes is known before the state it starts in is: the
parity of its unescaped quotes, and how much deeper it leads if it starts outside of a string, or
inside. Sums of these over the ranges before tell each range its state. It then cuts the elements
that start in it, and reads on where the last one ends beyond it.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparrowmill.sources.shared import stored

#: Bytes of a range; a task works on one at a time, in a few times the memory (most if few bytes are letters).
CHUNK_BYTES = 4 << 20
#: Tasks of a pass over the ranges.
MOST_TASKS = 20_000
PACKED = (".gz", ".bz2", ".zst", ".lz4")
SPACE, MARK = b" \t\r\n", b"\xef\xbb\xbf"
#: For each byte, whether it can matter outside or inside of a string, and its step in depth.
MATTERS, STEPS = np.zeros(256, bool), np.zeros(256, np.int8)
MATTERS[list(b'"\\,[]{}')] = True
STEPS[list(b"[{")], STEPS[list(b"]}")] = 1, -1


def _read(uri: str, start: int, size: int) -> bytes:
    """Bytes of a range, less at the end of the file; of a compressed file all that it unpacks to, from 0."""
    known = quote("s3" + uri[3:] if uri.startswith("s3a:") else uri, safe=string.punctuation)
    fs, path = pafs.FileSystem.from_uri(known)
    if uri.endswith(PACKED):
        with fs.open_input_stream(path, compression="detect") as f:
            return b"" if start else f.read()
    with fs.open_input_file(path) as f:
        return f.read_at(size, start) if start < f.size() else b""


def _slashes_before(uri: str, start: int, step: int = 256) -> int:
    """Backslashes that stand directly before a place."""
    n = 0
    while n < start:
        block = _read(uri, max(0, start - n - step), min(step, start - n))
        other = block.rstrip(b"\\")
        n += len(block) - len(other)
        if other:
            break
    return n


def _structure(data: np.ndarray, slashes: int, quoted: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Places of the bytes that can matter; for each whether it stands in a string, and the step in depth that it would be outside of one; and the state at the end."""
    places = np.flatnonzero(MATTERS[data])
    found = data[places]
    mark, slash = found == ord('"'), found == ord("\\")
    if len(places) and (slashes or slash.any()):
        n, behind = np.arange(len(places)), np.r_[False, slash[:-1] & (np.diff(places) == 1)]
        first = np.maximum.accumulate(np.where(behind, 0, n))
        mark &= (n - first + np.where(places[first] == 0, slashes, 0)) % 2 == 0
    state = np.cumsum(mark, dtype=np.int32) + quoted
    return places, (state & 1).astype(bool), STEPS[found], int(state[-1]) & 1 if len(places) else quoted


def _marks(data: np.ndarray, slashes: int, quoted: int, depth: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Places of the array's own brackets and commas, the step of each, and the state at the end."""
    places, inside, step, quoted = _structure(data, slashes, quoted)
    step = np.where(inside, 0, step)
    level = np.r_[depth, depth + np.cumsum(step, dtype=np.int64)]
    before, level = level[:-1], level[1:]
    # Outside of the array stands white space only, also between the bytes that matter.
    wrong = ((level <= 0) & (step >= 0)).any()
    for i in np.flatnonzero(np.r_[before, level[-1:] if len(level) else depth] <= 0).tolist():
        begin, end = places[i - 1] + 1 if i else 0, places[i] if i < len(places) else len(data)
        wrong = wrong or bool(data[begin:end].tobytes().strip(SPACE))
    if wrong:
        raise ValueError("Malformed array: text outside of the array")
    own = ~inside & (((level == 1) & ((step == 1) | (data[places] == ord(",")))) | ((level == 0) & (step == -1)))
    return places[own], step[own], quoted, int(level[-1]) if len(level) else depth


def _trailing(data: bytes, before: int) -> int:
    n = len(data) - len(data.rstrip(b"\\"))
    return n + before if n == len(data) else n


def cut(uri: str, head: int, start: int, size: int, quoted: int, depth: int) -> Iterator[str]:
    """Texts of the elements that start in a range of an array whose first bracket is at ``head``."""
    data = _read(uri, start, size)
    slashes = _slashes_before(uri, start)
    shown = np.frombuffer(data, np.uint8).copy()
    shown[: max(0, head - start)] = ord(" ")  # a byte order mark
    places, steps, quoted, depth = _marks(shown, slashes, quoted, depth)
    for place, step in zip(places, steps, strict=True):
        if step == 1 and start + place != head:
            raise ValueError("Malformed array: more than one array")
    ends, closing = places[1:].tolist(), steps[1:].tolist()
    if len(places) and steps[-1] != -1:  # the last element that starts here ends further on
        slashes, more = _trailing(data, slashes), 1 << 16
        while True:
            block = _read(uri, start + len(data), more)
            if not block:
                raise ValueError("Malformed array: it doesn't end")
            found, kind, quoted, depth = _marks(np.frombuffer(block, np.uint8), slashes, quoted, depth)
            if len(found):
                ends.append(len(data) + int(found[0]))
                closing.append(int(kind[0]))
            data, slashes, more = data + block, _trailing(block, slashes), min(2 * more, CHUNK_BYTES)
            if len(found):
                break
    elif not len(_read(uri, start + len(data), 1)) and (quoted or depth):
        raise ValueError("Malformed array: it doesn't end")
    for place, step, end, last in zip(places.tolist(), steps.tolist(), ends, closing, strict=False):
        text = data[place + 1 : end].strip(SPACE)
        if text:
            yield text.decode("utf-8", "replace")
        elif (step, last) not in ((1, -1), (-1, -1)):
            raise ValueError("Malformed array: an element is missing")


def probed_files(spark: SparkSession, path: str | list[str], chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(path, name, head, chunks, filled) of all files, head null where one doesn't start with a bracket, white space aside.

    head is the bracket's place; filled says whether something but its closing bracket comes next, so
    that the array, if it is one, has an element. Files are listed by Spark and their first bytes read
    by tasks. A compressed file is one range.
    """

    def first_byte(uri: str, place: int) -> tuple[int, bytes]:
        """The next place with something but white space, and the byte there; none at the end."""
        packed = _read(uri, 0, 0) if uri.endswith(PACKED) else None
        while block := _read(uri, place, 4096) if packed is None else packed[place:]:
            first = (b"   " + block[3:] if not place and block.startswith(MARK) else block).lstrip(SPACE)
            place += len(block) - len(first)
            if first:
                return place, first[:1]
        return place, b""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for uri, name, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                head, byte = first_byte(uri, 0)
                if byte == b"[":
                    rows.append((uri, name, head, 1 if uri.endswith(PACKED) else -(-length // chunk_bytes), first_byte(uri, head + 1)[1] not in (b"", b"]")))
                else:
                    rows.append((uri, name, None, None, None))
            types = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["path", "name", "head", "chunks", "filled"])

    files = spark.read.format("binaryFile").load(path).select("_metadata.file_path", "_metadata.file_name", "_metadata.file_size")
    return stored(files.mapInArrow(probe, "path string, name string, head long, chunks long, filled boolean"), "arrays")


def array_files(spark: SparkSession, path: str | list[str], chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(path, name, head, chunks) of the files that start with a bracket, white space aside; see probed_files."""
    return probed_files(spark, path, chunk_bytes).where("head is not null").drop("filled")


def array_elements(files: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(path, name, chunk, at, value): the text of each element of the arrays in ``files``, as of array_files with these chunk_bytes.

    chunk and at, the place in it, sort the elements of a file. What isn't one array, with white
    space around it, is an error; the text of an element isn't looked into further.
    """
    total = files.agg(F.sum("chunks").alias("n")).first().n or 0
    tasks = max(1, min(total, MOST_TASKS))

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for uri, chunk in zip(batch.column("path").to_pylist(), batch.column("chunk").to_pylist(), strict=True):
                start = chunk * chunk_bytes
                data = np.frombuffer(_read(uri, start, chunk_bytes), np.uint8)
                _, inside, step, odd = _structure(data, _slashes_before(uri, start), 0)
                found.append((bool(odd), int(step[~inside].sum()), int(step[inside].sum())))
            columns = [pa.array([r[i] for r in found], t) for i, t in enumerate((pa.bool_(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "odd", "outside", "inside"])

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "name", "chunk", "at", "value"]
        types = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
        for batch in batches:
            for row in batch.to_pylist():
                out, held = [], 0
                for at, text in enumerate(cut(row["path"], row["head"], row["chunk"] * chunk_bytes, chunk_bytes, row["quoted"], row["depth"])):
                    out.append((row["path"], row["name"], row["chunk"], at, text))
                    held += len(text)
                    if held > CHUNK_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)
                        out, held = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

    ranges = files.select("path", "name", "head", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")).repartition(tasks)
    schema = "path string, name string, head long, chunk long"
    known = stored(ranges.mapInArrow(survey, f"{schema}, odd boolean, outside long, inside long"), "array-ranges")
    before = Window.partitionBy("path").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    known = known.withColumn("quoted", F.coalesce(F.sum(F.col("odd").cast("int")).over(before) % 2, F.lit(0)))
    known = known.withColumn("depth", F.coalesce(F.sum(F.when(F.col("quoted") == 1, F.col("inside")).otherwise(F.col("outside"))).over(before), F.lit(0)))
    return known.select("path", "name", "head", "chunk", "quoted", "depth").repartition(tasks).mapInArrow(elements, "path string, name string, chunk long, at long, value string")


def numbered_elements(files: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(path, name, ord, value): array_elements with ord, the place in the array."""
    each = array_elements(files, chunk_bytes)
    before = Window.partitionBy("path").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = each.groupBy("path", "chunk").agg(F.count(F.lit(1)).alias("n")).select("path", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return each.join(counts, ["path", "chunk"]).select("path", "name", (F.col("first") + F.col("at")).alias("ord"), "value")


def write_arrays(df: DataFrame, path: str) -> None:
    """Overwrites a folder with a file for each task that holds the task's rows as one JSON array; null fields are left out."""

    def bracketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = "["
        for batch in batches:
            lines = batch.column(0).to_pylist()
            if lines:
                yield pa.RecordBatch.from_pydict({"value": pa.array([lead + lines[0], *("," + x for x in lines[1:])], pa.string())})
                lead = ","
        yield pa.RecordBatch.from_pydict({"value": pa.array(["]" if lead == "," else "[]"], pa.string())})

    df.select(F.to_json(F.struct("*")).alias("value")).mapInArrow(bracketed, "value string").write.mode("overwrite").text(path)
