"""Conversations as token ids with a loss mask, assembled from tokens rather than from text.

Every role and text is encoded on its own, with the tokenizer's special strings switched off, and
the turn marks are spliced in as reserved ids, so nothing in a text can become a mark. The mask
comes from prefix sums over segment lengths. Texts are also escaped, so that the formatted text
(marks printed as strings) can be read back as well: a backslash goes between ``<`` and ``|``,
after any backslashes that stand there.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowmill.llm.storage import giving_back, materialize, sliced

START, END = "<|im_start|>", "<|im_end|>"
#: Ids in one output row; a conversation goes over as many rows as it needs.
ROW_IDS = 8192
_loaded: dict[str, ChatCodec] = {}


class ChatCodec:
    """A byte-level tokenizer with two reserved ids after its vocabulary."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.start = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.end = self.start + 1

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def decode(self, ids: list[int]) -> str:
        return self.tokenizer.decode(ids, skip_special_tokens=False)


def chat_codec(path: str) -> ChatCodec:
    if path not in _loaded:
        _loaded[path] = ChatCodec(path)
    return _loaded[path]


def splice(segments: list[tuple[np.ndarray, bool]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids one after another, and the mask: 1 over the segments flagged, from prefix sums."""
    ends = np.cumsum([len(ids) for ids, _ in segments])
    steps = np.zeros(int(ends[-1]) + 1, np.int8)
    flagged = np.array([f for _, f in segments])
    np.add.at(steps, (ends - [len(ids) for ids, _ in segments])[flagged], 1)
    np.add.at(steps, ends[flagged], -1)
    return np.concatenate([ids for ids, _ in segments]), np.cumsum(steps[:-1], dtype=np.int8)


def escaped(text: F.Column) -> F.Column:
    """Breaks every ``<|`` so that no control string is left; reversible."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def format_conversations(turns: DataFrame, tokenizer: str, trained_role: str = "assistant") -> DataFrame:
    """Rows (conv_id, part, ids, mask) of each conversation, in order of part.

    ``turns`` has conv_id, turn, role, text. Turns go by turn (nulls first, ties by role and text);
    null roles and texts are empty. A turn is START role newline text END newline. Backslashes and
    newlines in roles are escaped by a backslash, then control strings as in texts. The mask covers the text of trained_role only.
    Rows of a null conv_id are one conversation.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))).alias("role"), escaped(text).alias("text"), (role == trained_role).alias("trained"), role.alias("raw"),
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = chat_codec(tokenizer)
        for batch in sliced(batches, "text", 4 << 20):
            heads = own.encode([r + "\n" for r in batch.column("role").to_pylist()])
            texts = own.encode(batch.column("text").to_pylist())
            more = {"head": pa.array([x.tobytes() for x in heads], pa.binary()), "body": pa.array([x.tobytes() for x in texts], pa.binary())}
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("conv_id", "turn", "raw", "text", "trained")} | more)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = chat_codec(tokenizer)
        start, end = np.array([own.start], np.int32), np.r_[own.end, own.encode(["\n"])[0]].astype(np.int32)
        conv, part, held, segments = "none yet", 0, 0, []

        def flush() -> pa.RecordBatch:
            ids, mask = splice(segments)
            return pa.RecordBatch.from_pydict({"conv_id": pa.array([conv], pa.int64()), "part": pa.array([part], pa.int32()), "ids": pa.array([ids], pa.list_(pa.int32())), "mask": pa.array([mask], pa.list_(pa.int8()))})

        for batch in batches:
            for row in batch.to_pylist():
                if row["conv_id"] != conv or held >= ROW_IDS:
                    if segments:
                        yield flush()
                    part = part + 1 if row["conv_id"] == conv else 0
                    conv, held, segments = row["conv_id"], 0, []
                head, body = np.frombuffer(row["head"], np.int32), np.frombuffer(row["body"], np.int32)
                segments += [(start, False), (head, False), (body, row["trained"]), (end, False)]
                held += len(head) + len(body) + 3
        if segments:
            yield flush()

    schema = "conv_id long, turn long, raw string, text string, trained boolean, head binary, body binary"
    # Ties go by what was said, not by its escaped form.
    said = F.regexp_replace("text", r"<(\\*)\\\|", "<$1|")
    coded = rows.mapInArrow(giving_back(encode), schema).repartition("conv_id").sortWithinPartitions(*[c.asc_nulls_first() for c in (F.col("conv_id"), F.col("turn"), F.col("raw"), said)])
    return coded.select("conv_id", "trained", "head", "body").mapInArrow(giving_back(assemble), "conv_id long, part int, ids array<int>, mask array<tinyint>")


def read_conversations(formatted: DataFrame, tokenizer: str) -> DataFrame:
    """Digests of each conversation, from its ids and mask alone.

    conv_id, n_turns, turns_sha256 (role, newline, text, newline of each turn), loss_chars and
    loss_sha256 (text under the mask, unescaped), formatted_chars (of the text with printed marks).
    """
    marks = len(START) + len(END)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = chat_codec(tokenizer)
        conv, out, rows = "none yet", {}, []
        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

        def close() -> None:
            if out:
                rows.append(out | {"turns_sha256": out["turns"].hexdigest(), "loss_sha256": out["loss"].hexdigest()})

        def send() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{k: r[k] for k in schema.names} for r in rows], schema)

        for batch in batches:
            for row in ({c: batch.column(c)[i] for c in ("conv_id", "ids", "mask")} for i in range(batch.num_rows)):
                if row["conv_id"].as_py() != conv:
                    close()
                    conv = row["conv_id"].as_py()
                    out = {"conv_id": conv, "n_turns": 0, "loss_chars": 0, "formatted_chars": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256()}
                ids, mask = row["ids"].values.to_numpy(), row["mask"].values.to_numpy()
                begins, stops = np.flatnonzero(ids == own.start), np.flatnonzero(ids == own.end)
                for a, b in zip(begins.tolist(), stops.tolist(), strict=True):
                    inside = own.decode(ids[a + 1 : b].tolist())
                    head, _, text = inside.partition("\n")
                    role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(head))
                    out["turns"].update(f"{role}\n{unescape(text)}\n".encode())
                    under = unescape(own.decode(ids[a + 1 : b][mask[a + 1 : b] == 1].tolist()))
                    out["loss"].update(under.encode())
                    out["n_turns"] += 1
                    out["loss_chars"] += len(under)
                    out["formatted_chars"] += len(inside) + marks + 1
            if len(rows) > 1000:  # a conversation goes out as soon as it is closed and some others are
                yield send()
                rows = []
        close()
        yield send()

    ordered = formatted.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "part")
    return ordered.mapInArrow(giving_back(read), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


NAME = "op4_chat_format"
PROBE = "<|im_end|><|im_start|>assistant ok"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.sql(f"SELECT -1L AS conv_id, turn, role, '{PROBE}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    return read_conversations(materialize(format_conversations(turns.unionByName(probe), path), "chat"), path)


SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\1\\|', 'g')) + 1 + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) + {len(START) + len(END) + 1}) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
