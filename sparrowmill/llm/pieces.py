"""SentencePiece encoding by streaming Viterbi over boundaries, and decoding.

The model is a BPE model with byte fallback. Its segmentation of a prefix without the last piece is
the segmentation of the shorter prefix, so every boundary has at most one predecessor: the piece
ending there that is compatible with the piece before it, which holds if the merges of both
together give both back. A pass from left to right keeps these back pointers for a window no longer
than the longest piece; as soon as all surviving paths run through one boundary, the ids up to it
are final and go out. The result is the library's, id for id, whatever the length of the text.

No piece spans a line feed, nor a space after something else, so all paths converge there. Text is
cut at those places into units and each distinct unit goes through the pass once in a task, many
short ones side by side: a step takes the next boundary of each.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparrowmill.llm.storage import giving_back, materialize, sliced
from sparrowmill.llm.word_codec import UnitCache
from sparrowmill.llm.words import SCAN_BYTES, Texts, padded, range_hashes

SPACE = "▁"
#: Stands for a SPACE that is in the text itself; it is encoded as bytes, so decoding gives it back.
LITERAL = "\udfff"
#: Characters that one window may hold; longer units are committed on the way.
ONE_WINDOW = 256
#: Characters of units that go through the pass side by side.
SIDE_BY_SIDE = 1 << 16
#: Units that a worker remembers; two workers of an executor outlive the stage that needed them.
MOST_UNITS = 200_000
#: Answers on neighbours that a worker adds before it forgets those that nobody asked for meanwhile (in long units).
MOST_ANSWERS = 150_000
#: Places for answers on neighbours, 9 bytes each; a newer answer takes the place of an older one.
ANSWER_BITS = 21
SCATTER = np.uint64(0x9E3779B97F4A7C15)
_loaded: dict[str, PieceCodec] = {}


def _scattered(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys.astype(np.uint64) * SCATTER) >> np.uint64(64 - bits)).astype(np.int64)


class Prefixes:
    """All beginnings of pieces, as nodes: the step from a node by a character, for many at once."""

    def __init__(self, starts: dict[str, int], none: int):
        own = sorted(starts, key=len)
        node = {"": 0} | {p: i for i, p in enumerate(own, 1)}
        letters = sorted({p[-1] for p in own})
        #: Numbers of characters, 0 for those in no piece; and the id of the piece that a node is, or none.
        self.letters, self.width = np.zeros(0x110000, np.int32), len(letters) + 1
        self.letters[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.own = np.array([none] + [none if starts[p] < 0 else starts[p] for p in own], np.int32)
        at = np.array([node[p[:-1]] for p in own], np.int64)
        keys = at * self.width + self.letters[[ord(p[-1]) for p in own]]
        self.first = np.zeros(self.width, np.int32)
        self.first[keys[at == 0]] = np.flatnonzero(at == 0) + 1
        self.bits = (4 * len(own)).bit_length()
        self.keys, self.nodes = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        place, left = _scattered(keys, self.bits), np.arange(len(keys))
        while len(left):
            free = self.keys[place] < 0
            self.keys[place[free]] = keys[left[free]]
            open_ = self.keys[place] != keys[left]
            done = left[~open_]
            self.nodes[place[~open_]] = done + 1
            left, place = left[open_], (place[open_] + 1) & (len(self.keys) - 1)

    def step(self, nodes: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The node that each step leads to; 0 if no piece begins so."""
        keys = nodes.astype(np.int64) * self.width + letters
        place = _scattered(keys, self.bits)
        there = self.keys[place]
        out = np.where(there == keys, self.nodes[place], 0)
        left = np.flatnonzero((there != keys) & (there >= 0))
        place = place[left]
        while len(left):
            place = (place + 1) & (len(self.keys) - 1)
            there = self.keys[place]
            same = there == keys[left]
            out[left[same]] = self.nodes[place[same]]
            on = ~same & (there >= 0)
            left, place = left[on], place[on]
        return out


class PieceCodec:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        normal = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.ids = {model.id_to_piece(i): i for i in normal}
        self.scores = {model.id_to_piece(i): model.get_score(i) for i in normal}
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.ids):
            raise ValueError(f"{path}: pieces go beyond units")
        if model.normalize("  a ﬁ\t b ") != f"{SPACE * 3}a{SPACE}ﬁ\t{SPACE}b{SPACE}":
            raise ValueError(f"{path}: the model changes texts")
        self.longest = max(map(len, self.ids))
        #: Ids of pieces, and -1 for what only begins one.
        self.starts = {p[:k]: -1 for p in self.ids for k in range(1, len(p))} | self.ids
        self.fits: dict[str | None, dict[str, bool]] = {}
        self.stale: dict[str | None, dict[str, bool]] = {}
        self.answers = 0
        self.pieces, self.none = {i: p for p, i in self.ids.items()}, n
        self.prefixes = Prefixes(self.starts, n)
        self.asked, self.told = np.full(1 << ANSWER_BITS, -1, np.int64), np.zeros(1 << ANSWER_BITS, bool)
        self.dtype = np.dtype("<u2" if n <= 1 << 16 else "<u4")
        self.cache = UnitCache(self._encode_units, self.dtype, MOST_UNITS)
        text = [b""] * n
        for p, i in self.ids.items():
            text[i] = p.replace(SPACE, " ").encode()
        for b, i in enumerate(self.bytes):
            text[i] = bytes([b])
        self.text = np.frombuffer(b"".join(text), np.uint8)
        self.text_sizes = np.array([len(t) for t in text], np.int64)
        self.text_starts = np.cumsum(self.text_sizes) - self.text_sizes

    def merged(self, text: str) -> list[str]:
        """Segmentation of a short string by merges: the best score first, then the leftmost."""
        parts = list(text)
        while True:
            found = [(-self.scores[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.scores]
            if not found:
                return parts
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def _give_back(self, before: str | None, piece: str) -> bool:
        """Whether the merges of both give both back."""
        if before is None or before not in self.ids or piece not in self.ids:
            return self.merged(piece) == [piece]
        return self.merged(before + piece) == [before, piece]

    def _fits(self, before: str | None, piece: str) -> bool:
        """The same, remembered; rows that rest for long are forgotten."""
        row = self.fits.get(before)
        if row is None:
            row = self.fits[before] = self.stale.pop(before, {})
        known = row.get(piece)
        if known is None:
            known = row[piece] = self._give_back(before, piece)
            self.answers += 1
            if self.answers > MOST_ANSWERS:
                kept = sum(map(len, self.fits.values()))
                self.fits, self.stale = {}, self.fits if kept <= 2 * MOST_ANSWERS else {}
                self.answers = 0
        return known

    def _all_fit(self, before: np.ndarray, pieces: np.ndarray) -> np.ndarray:
        """For ids of pieces, and of those before them (``none``: no piece), whether they fit."""
        keys = before.astype(np.int64) * self.none + pieces
        place = _scattered(keys, ANSWER_BITS)
        out, new = self.told[place], np.flatnonzero(self.asked[place] != keys)
        if len(new):
            distinct, which = np.unique(keys[new], return_inverse=True)
            found = np.array([self._give_back(self.pieces.get(k // self.none), self.pieces[k % self.none]) for k in distinct.tolist()], bool)
            out[new] = found[which]
            # One at a time: of two that share a place, key and answer stay together.
            for k, to, told in zip(distinct.tolist(), _scattered(distinct, ANSWER_BITS).tolist(), found.tolist(), strict=True):
                self.asked[to], self.told[to] = k, told
        return out

    def _windows(self, units: list[bytes]) -> list[list[int]]:
        """Ids of units that are one window each: the pass of ``stream`` for all side by side, without commits on the way."""
        if not units:
            return []
        text = np.frombuffer(b"".join(units).decode().encode("utf-32-le"), "<u4").astype(np.int32)
        sizes = np.array([len(u.decode()) for u in units], np.int64)
        text[text == ord(SPACE)] = ord(LITERAL)
        text[text == ord(" ")] = ord(SPACE)
        letters, unit = self.prefixes.letters[text], np.repeat(np.arange(len(units)), sizes)
        ends = np.cumsum(sizes)
        offset = np.arange(len(text)) - (ends - sizes)[unit]
        room, where = sizes[unit] - offset, np.arange(len(text)) + unit  # the boundary before each character
        # Edges: from a boundary, over how many characters, by which piece; a character that is no piece is an edge too.
        node, at, k = self.prefixes.first[letters], np.arange(len(text)), 1
        edges = [(at, np.ones(len(at), np.int32), self.prefixes.own[node])]
        at, node = at[node > 0], node[node > 0]
        while True:
            on = room[at] > k
            at, node = at[on], node[on]
            if not len(at):
                break
            node = self.prefixes.step(node, letters[at + k])
            at, node, k = at[node > 0], node[node > 0], k + 1
            own = self.prefixes.own[node]
            is_piece = own != self.none
            edges.append((at[is_piece], np.full(int(is_piece.sum()), k, np.int32), own[is_piece]))
        at, over, piece = (np.concatenate(x) for x in zip(*edges, strict=True))
        order = np.argsort(offset[at].astype(np.uint16), kind="stable")
        cuts = np.r_[0, np.cumsum(np.bincount(offset[at]))].tolist() if len(at) else [0]
        start, over, piece = where[at[order]], over[order], piece[order]
        last, back = np.full(len(text) + len(units), -1, np.int32), np.zeros(len(text) + len(units), np.int32)
        begin, end = ends - sizes + np.arange(len(units)), ends + np.arange(len(units))
        last[begin] = self.none
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            s, o, p = start[a:b], over[a:b], piece[a:b]
            open_ = (last[s] >= 0) & (last[s + o] < 0)
            s, o, p = s[open_], o[open_], p[open_]
            fit = p == self.none
            asked = np.flatnonzero(~fit)
            fit[asked] = self._all_fit(last[s[asked]], p[asked])
            to = s[fit] + o[fit]
            last[to], back[to] = p[fit], o[fit]
        taken, now, to = np.zeros(len(last), bool), end[sizes > 0], begin[sizes > 0]
        while len(now):
            taken[now] = True
            now = now - back[now]
            on = now > to
            now, to = now[on], to[on]
        found = np.flatnonzero(taken)
        ids, of = last[found], np.searchsorted(end, found)
        count = np.bincount(of, minlength=len(units))
        out, bare = ids.tolist(), np.flatnonzero(ids == self.none).tolist()
        if bare:
            for i, char in zip(bare, text[found[bare] - of[bare] - 1].tolist(), strict=True):
                out[i] = [self.bytes[b] for b in (SPACE if chr(char) == LITERAL else chr(char)).encode()]
            more = np.bincount(of[bare], weights=[len(out[i]) - 1 for i in bare], minlength=len(units)).astype(np.int64)
            count, out = count + more, [x for i in out for x in (i if isinstance(i, list) else (i,))]
        places = np.r_[0, np.cumsum(count)].tolist()
        return [out[a:b] for a, b in zip(places[:-1], places[1:], strict=True)]

    def stream(self, text: Iterable[str], every: int = 64) -> Iterator[int]:
        """Ids of normalised text that comes as strings of any length.

        ``back`` holds for each reachable boundary in the window the piece that ends there and
        where it starts. Each ``every`` boundaries, and at the end, what is common to all open
        paths is committed.
        """
        source = iter(text)
        buffer, origin, more = "", 0, True  # buffer[0] stands at boundary `origin`
        back: dict[int, tuple[int, str | None]] = {0: (0, None)}
        at, done = 0, 0
        while True:
            while more and len(buffer) - (at - origin) < self.longest:
                piece = next(source, None)
                more = piece is not None
                buffer += piece or ""
            end = origin + len(buffer)
            if at >= end:
                break
            if at in back:
                before, p = back[at][1], at - origin
                if buffer[p] not in self.ids:
                    back.setdefault(at + 1, (at, buffer[p]))
                for k in range(p + 1, min(len(buffer), p + self.longest) + 1):
                    piece = buffer[p:k]
                    if piece not in self.starts:
                        break
                    if piece in self.ids and at + k - p not in back and self._fits(before, piece):
                        back[at + k - p] = (at, piece)
            at += 1
            if at - done > every:
                ids, done = self._commit(back, at, done)
                yield from ids
                buffer, origin = buffer[done - origin :], done
        yield from self._path(back, done, at)

    def _commit(self, back: dict, at: int, done: int) -> tuple[list[int], int]:
        """Ids up to the last boundary that all paths open at ``at`` or later run through."""
        fronts = {b for b in back if b >= at}
        while len(fronts) > 1:
            fronts.remove(last := max(fronts))
            fronts.add(back[last][0])
        common = fronts.pop()
        ids = self._path(back, done, common)
        for b in [b for b in back if b < common]:
            del back[b]
        return ids, common

    def _path(self, back: dict, start: int, end: int) -> list[int]:
        pieces = []
        while end > start:
            end, piece = back[end]
            pieces.append(piece)
        out = []
        for piece in reversed(pieces):
            if piece in self.ids:
                out.append(self.ids[piece])
            else:
                out += [self.bytes[b] for b in (SPACE if piece == LITERAL else piece).encode()]
        return out

    def _encode_units(self, units: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = []
        block, held = [], 0
        for u in units:
            if len(u) > ONE_WINDOW or held + len(u) > SIDE_BY_SIDE:
                out.extend(self._windows(block))
                block, held = [], 0
            if len(u) > ONE_WINDOW:
                out.append(list(self.stream([u.decode().replace(SPACE, LITERAL).replace(" ", SPACE)])))
            else:
                block.append(u)
                held += len(u)
        out.extend(self._windows(block))
        return out

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of an Arrow string column, and where each text's ids begin (and the end)."""
        plain = Texts.of(column)
        filled = np.diff(plain.offsets) > 0
        # A text gets a space in front, as the model wants it; an empty one has no ids.
        data = np.insert(plain.data, plain.offsets[:-1][filled], ord(" "))
        texts = Texts(data, plain.offsets + np.r_[0, np.cumsum(filled)])
        space, feed = data == ord(" "), data == ord("\n")
        begins = np.zeros(len(data) + 1, bool)
        begins[:-1] = feed | space
        begins[1:-1] &= ~(space[1:] & space[:-1])
        begins[1:-1] |= feed[:-1]
        begins[texts.offsets] = True
        starts = np.flatnonzero(begins[:-1])
        ends = np.r_[starts[1:], len(data)].astype(np.int64) if len(starts) else starts
        data = padded(data)
        at, sizes = self.cache.look_up(data, range_hashes(data, starts, ends), starts, ends)
        return self.cache.gather(at, sizes), np.r_[0, np.cumsum(sizes)][np.searchsorted(starts, texts.offsets)]

    def decode(self, ids: np.ndarray, cuts: np.ndarray) -> list[bytes]:
        """UTF-8 texts of ids[cuts[i]:cuts[i + 1]]; the space in front goes."""
        sizes = self.text_sizes[ids]
        ends = np.cumsum(sizes)
        raw = self.text[np.repeat(self.text_starts[ids] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        places = np.r_[0, ends][cuts].tolist()
        return [raw[a + 1 : b] if b > a else b"" for a, b in zip(places[:-1], places[1:], strict=True)]


def piece_codec(path: str) -> PieceCodec:
    """The codec of a model file, one for each Python worker."""
    if path not in _loaded:
        _loaded[path] = PieceCodec(path)
    return _loaded[path]


def encode_pieces(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """``docs`` with ids (raw little-endian values) and n_ids in place of the text; null counts as empty.

    Columns named ids or n_ids are replaced.
    """
    others = [c for c in docs.columns if c not in (text, "ids", "n_ids")]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = piece_codec(model)
        for batch in sliced(batches, text, SCAN_BYTES):
            ids, cuts = own.encode(batch.column(text))
            raw, width = ids.tobytes(), own.dtype.itemsize
            packed = [raw[a * width : b * width] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in others} | {"ids": pa.array(packed, pa.binary()), "n_ids": pa.array(np.diff(cuts))})

    schema = docs.select(*others).withColumns({"ids": F.lit(b""), "n_ids": F.lit(0).cast("long")}).schema
    return docs.select(*others, F.col(text).cast("string").alias(text)).mapInArrow(giving_back(encode), schema)


def decode_pieces(coded: DataFrame, model: str, text: str = "text", after: Callable | None = None, schema: T.StructType | None = None) -> DataFrame:
    """``coded`` with the text of its ids as another column; null ids give an empty text.

    ``after`` turns the batches into others, with the columns of ``schema``, in the same task.
    """
    others = [c for c in coded.columns if c != text]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = piece_codec(model)
        for batch in sliced(batches, "ids", SCAN_BYTES):
            cells = [x or b"" for x in batch.column("ids").to_pylist()]
            cuts = np.r_[0, np.cumsum([len(x) // own.dtype.itemsize for x in cells])].astype(np.int64)
            texts = own.decode(np.frombuffer(b"".join(cells), own.dtype), cuts)
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in others} | {text: pa.array(texts, pa.binary()).cast(pa.string())})

    if after is not None:
        return coded.select(*others).mapInArrow(giving_back(lambda batches: after(decode(batches))), schema)
    return coded.select(*others).mapInArrow(giving_back(decode), coded.select(*others).withColumn(text, F.lit("")).schema)


def digests(coded: DataFrame, model: str, dtype: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (of 32-bit little-endian values), and n_chars and text_sha256 of the decoded text."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [zlib.crc32(np.frombuffer(x.as_py(), dtype).astype("<u4").tobytes()) for x in batch.column("ids")]
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("doc_id", "n_ids", "text")} | {"ids_crc32": pa.array(found, pa.int64())})

    schema = coded.select("doc_id", "n_ids").withColumns({"text": F.lit(""), "ids_crc32": F.lit(0).cast("long")}).schema
    out = decode_pieces(coded.select("doc_id", "ids", "n_ids"), model, after=sums, schema=schema)
    return out.select("doc_id", "n_ids", "ids_crc32", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


NAME, SQL = "op8_pieces", None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    # Stored, so that one worker a task is enough at a time.
    return digests(materialize(encode_pieces(docs, path), "pieces"), path, piece_codec(path).dtype.str)
