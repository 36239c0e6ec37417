"""Token ids of whole texts, put together from the ids of units that never influence each other.

``UnitCache`` finds each distinct unit (a word, say) in a hash table of flat arrays, compares its
bytes, has the new ones encoded once and keeps their ids, so that a text costs a few array
operations. ``WordCodec`` uses it with the tokenizers library for tokenizers whose tokens never
touch white space: there the ids of a text are the ids of its words, one after another.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from sparrowmill.llm.words import Texts, equal_ranges, find_words, padded, range_hashes

#: Units that a worker remembers (about 70 bytes each), and bytes of them; beyond it the less frequent half goes.
REMEMBERED_UNITS, REMEMBERED_BYTES = 500_000, 32 << 20
_codecs: dict[str, WordCodec] = {}


def _with_room(array: np.ndarray, used: int, more: int) -> np.ndarray:
    """``array`` if ``more`` values fit after the ``used`` ones, else a longer copy."""
    if used + more <= len(array):
        return array
    out = np.zeros(used + more + used // 2, array.dtype)
    out[:used] = array[:used]
    return out


class UnitCache:
    """Ids of units; ``encode`` gets the new units as bytes and returns their ids.

    An entry has its hash, its bytes in ``raw``, its ids in ``pool`` and how often it was met.
    ``slots`` is an open hash table of entry numbers. A unit that shares the hash of an entry but not
    its bytes has an entry outside the table, in ``odd``.
    """

    FIELDS = ("hashes", "starts", "sizes", "raw_starts", "raw_sizes", "hits")

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], dtype: np.dtype, most: int = REMEMBERED_UNITS):
        self.encode, self.dtype, self.most = encode, dtype, most
        self.n, self.used, self.raw_used, self.odd = 0, 0, 0, {}
        self.hashes, self.starts, self.raw_starts = np.zeros(1024, np.uint64), np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.sizes, self.raw_sizes, self.hits = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.pool, self.raw = np.zeros(1 << 12, dtype), np.zeros(1 << 12, np.uint8)
        self.slots = np.zeros(1 << 12, np.int32)

    def _place(self, entries: np.ndarray) -> None:
        """Puts entries into the table; of several that want a slot one gets it, the others try the next."""
        place = (self.hashes[entries] & np.uint64(len(self.slots) - 1)).astype(np.int64)
        while len(entries):
            free = self.slots[place] == 0
            self.slots[place[free]] = entries[free] + 1
            open_ = self.slots[place] != entries + 1
            entries, place = entries[open_], (place[open_] + 1) & (len(self.slots) - 1)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The entry of each hash, or -1."""
        entry = np.full(len(hashes), -1, np.int64)
        place, left = (hashes & np.uint64(len(self.slots) - 1)).astype(np.int64), np.arange(len(hashes))
        while len(left):
            found = self.slots[place].astype(np.int64) - 1
            taken = found >= 0
            same = taken & (self.hashes[found] == hashes[left])
            entry[left[same]] = found[same]
            on = taken & ~same
            left, place = left[on], (place[on] + 1) & (len(self.slots) - 1)
        return entry

    def _learn(self, hashes: np.ndarray, units: list[bytes], listed: bool) -> np.ndarray:
        """Adds entries, into the table if ``listed``; their numbers."""
        ids = self.encode(units)
        sizes, raw_sizes = np.array([len(x) for x in ids], np.int64), np.array([len(u) for u in units], np.int64)
        m, total, raw_total = len(units), int(sizes.sum()), int(raw_sizes.sum())
        for name in self.FIELDS:
            setattr(self, name, _with_room(getattr(self, name), self.n, m))
        self.pool, self.raw = _with_room(self.pool, self.used, total), _with_room(self.raw, self.raw_used, raw_total + 8)
        new = slice(self.n, self.n + m)
        self.hashes[new], self.sizes[new], self.raw_sizes[new], self.hits[new] = hashes, sizes, raw_sizes, 0
        self.starts[new] = self.used + np.cumsum(sizes) - sizes
        self.raw_starts[new] = self.raw_used + np.cumsum(raw_sizes) - raw_sizes
        if total:
            self.pool[self.used : self.used + total] = np.fromiter((i for x in ids for i in x), self.dtype, total)
        self.raw[self.raw_used : self.raw_used + raw_total] = np.frombuffer(b"".join(units), np.uint8)
        self.n, self.used, self.raw_used = self.n + m, self.used + total, self.raw_used + raw_total
        entries = np.arange(self.n - m, self.n)
        if listed:
            if 2 * self.n > len(self.slots):
                self.slots = np.zeros(1 << (4 * self.n).bit_length(), np.int32)
                odd = np.fromiter(self.odd.values(), np.int64, len(self.odd))
                self._place(np.setdiff1d(np.arange(self.n), odd))
            else:
                self._place(entries)
        return entries

    def _forget(self) -> None:
        """Keeps half of the units that was met most often; old meetings count half from then on."""
        keep = np.argsort(-self.hits[: self.n], kind="stable")[: self.most // 2]
        keep = np.sort(keep[np.cumsum(self.raw_sizes[keep]) <= REMEMBERED_BYTES // 2])
        odd = np.fromiter(self.odd.values(), np.int64, len(self.odd))
        keep, self.odd = np.setdiff1d(keep, odd), {}
        sizes, raw_sizes = self.sizes[keep], self.raw_sizes[keep]
        pool, raw = self.gather(self.starts[keep], sizes), _ranges(self.raw, self.raw_starts[keep], raw_sizes)
        self.hits[: len(keep)] = self.hits[keep] // 2
        for name in ("hashes", "sizes", "raw_sizes"):
            getattr(self, name)[: len(keep)] = getattr(self, name)[keep]
        self.n, self.used, self.raw_used = len(keep), len(pool), len(raw)
        self.pool[: self.used], self.raw[: self.raw_used] = pool, raw
        self.starts[: self.n], self.raw_starts[: self.n] = np.cumsum(sizes) - sizes, np.cumsum(raw_sizes) - raw_sizes
        self.slots[:] = 0
        self._place(np.arange(self.n))

    def look_up(self, data: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For units data[starts[i]:ends[i]] of padded data in order: where their ids begin in the pool, and how many."""
        if not len(hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if self.n > self.most or self.raw_used > REMEMBERED_BYTES:
            self._forget()
        text = lambda i: [data[a:b].tobytes() for a, b in zip(starts[i].tolist(), ends[i].tolist(), strict=True)]
        entry = self._find(hashes)
        unknown = np.flatnonzero(entry < 0)
        if len(unknown):
            distinct, first, which = np.unique(hashes[unknown], return_index=True, return_inverse=True)
            entry[unknown] = self._learn(distinct, text(unknown[first]), True)[which]
        sizes = ends - starts
        same = self.raw_sizes[entry] == sizes
        same[same] = equal_ranges(data, starts[same], self.raw, self.raw_starts[entry[same]], sizes[same])
        others = np.flatnonzero(~same)
        if len(others):
            units = text(others)
            new = [u for u in dict.fromkeys(units) if u not in self.odd]
            if new:
                self.odd.update(zip(new, self._learn(np.zeros(len(new), np.uint64), new, False).tolist(), strict=True))
            entry[others] = [self.odd[u] for u in units]
        self.hits[: self.n] += np.bincount(entry, minlength=self.n)
        return self.starts[entry], self.sizes[entry]

    def gather(self, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The ids of units one after another."""
        return _ranges(self.pool, starts, sizes)


def _ranges(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return pool[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


class WordCodec:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        sample = ["a", "don't", "É.", "12", "(x)", "<", "Ünï"]
        apart = [i for w in sample for i in self.ids(w)]
        if any(self.ids(s.join(sample)) != apart for s in (" ", "\n", "\t \r", " \x0b\x0c ")):
            raise ValueError(f"{path}: white space takes part in its tokens")
        #: A-Z may be folded and stops at word ends parted before the look-up if the tokenizer does so itself.
        self.folds = self.ids("AZ. Q9,") == self.ids("az . q9 ,")
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.folded, self.exact = UnitCache(self._encode, self.dtype), UnitCache(self._encode, self.dtype)

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _encode(self, words: list[bytes]) -> list[list[int]]:
        out = []
        for i in range(0, len(words), 4096):
            out += [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in words[i : i + 4096]], add_special_tokens=False)]
        return out

    def units(self, texts: Texts) -> tuple[UnitCache, np.ndarray, np.ndarray, np.ndarray]:
        """The cache, the start and number of ids of each unit, and the first unit of each text."""
        # Added tokens are found in the text as it stands, so texts that may hold one aren't folded.
        raw = texts.data.tobytes()
        fold = self.folds and not any(t[:2] in raw for t in self.special)
        words, cache = find_words(texts), self.folded if fold else self.exact
        starts, ends, first = words.starts, words.ends, words.first
        if fold and len(starts):
            last, before = texts.data[ends - 1], texts.data[np.maximum(ends - 2, 0)]
            stop = ((last == ord(".")) | (last == ord(","))) & (ends - starts > 1)
            stop &= ((before | 32) >= ord("a")) & ((before | 32) <= ord("z")) | (before >= ord("0")) & (before <= ord("9"))
            own = np.repeat(np.arange(len(starts)), 1 + stop)
            second = np.r_[False, own[1:] == own[:-1]]
            parted = stop[own]
            starts, ends = np.where(second, ends[own] - 1, starts[own]), np.where(parted & ~second, ends[own] - 1, ends[own])
            first = first + np.r_[0, np.cumsum(stop)][first]
        data = padded(texts.data, fold)
        return cache, *cache.look_up(data, range_hashes(data, starts, ends), starts, ends), first

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of an Arrow string column, and where each text's ids begin (and the end)."""
        cache, starts, sizes, first = self.units(Texts.of(column))
        return cache.gather(starts, sizes), np.r_[0, np.cumsum(sizes)][first]

    def count(self, column: pa.Array) -> np.ndarray:
        """The number of ids of each text of an Arrow string column."""
        _, _, sizes, first = self.units(Texts.of(column))
        return np.diff(np.r_[0, np.cumsum(sizes)][first])


def codec(path: str) -> WordCodec:
    """The codec of a tokenizer file, one for each Python worker."""
    if path not in _codecs:
        _codecs[path] = WordCodec(path)
    return _codecs[path]
