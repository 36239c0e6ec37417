"""Vectorised word scanning over the UTF-8 bytes of many texts at once.

A word is a run of bytes other than space and 0x09-0x0D, so word borders never fall inside a
UTF-8 sequence. Byte ranges get 64-bit hashes from their 8-byte chunks, mixed one after another
with secret values drawn from a key, so that nobody who doesn't know the key can make two ranges
collide; ranges longer than LONG bytes go through keyed BLAKE2b. Who must not rely on hashes at all
compares bytes with ``equal_ranges``.
"""

from __future__ import annotations

import hashlib
import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are scanned together.
SCAN_BYTES = 1 << 20
#: Bytes of a range that are hashed chunk by chunk for many ranges at once.
LONG = 256

_U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: The low n bytes of a chunk.
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers with good avalanche."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def new_key() -> bytes:
    """A random key. Hashes that meet across tasks need one key, drawn by the driver."""
    return os.urandom(16)


#: Key of hashes that never leave this process.
_OWN_KEY = new_key()


@dataclass
class Texts:
    """Bytes of consecutive texts; text i is data[offsets[i]:offsets[i + 1]]."""

    data: np.ndarray
    offsets: np.ndarray

    @classmethod
    def of(cls, column: pa.Array) -> Texts:
        """Of an Arrow string column; nulls count as empty."""
        column = column.cast(pa.large_string()).fill_null("")
        n, start = len(column), column.offset
        buffers = column.buffers()
        offsets = np.frombuffer(buffers[1], dtype=np.int64, count=start + n + 1)[start:] if n else np.zeros(1, np.int64)
        data = np.frombuffer(buffers[2], dtype=np.uint8) if n and buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
        return cls(data[offsets[0] : offsets[-1]], offsets - offsets[0])


@dataclass
class Words:
    """Words of texts: byte ranges, and for text i the words first[i]:first[i + 1]."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray


def find_words(texts: Texts) -> Words:
    """The words of all texts, in order."""
    solid = ~_SPACE[texts.data]
    n = len(solid)
    edge = np.zeros(n + 1, dtype=bool)
    edge[texts.offsets] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:n]
    stops = solid.copy()
    stops[:-1] &= ~solid[1:] | edge[1:n]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return Words(starts, ends, np.searchsorted(starts, texts.offsets))


def padded(data: np.ndarray, fold_case: bool = False) -> np.ndarray:
    """A copy of ``data`` with eight bytes after it, as the functions on ranges want it; A-Z in lower case if asked."""
    out = np.zeros(len(data) + 8, np.uint8)
    if fold_case:
        np.take(_FOLD, data, out=out[: len(data)])
    else:
        out[: len(data)] = data
    return out


def _chunks(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a view."""
    return np.ndarray(len(data) - 7, "<u8", data, strides=(1,))


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: bytes = _OWN_KEY) -> np.ndarray:
    """Hashes of the byte ranges of padded ``data``; equal bytes give equal hashes wherever they stand."""
    secret = np.frombuffer(hashlib.blake2b(key, digest_size=64).digest(), "<u8")
    chunks, sizes = _chunks(data), ends - starts
    out = mix(sizes.astype(np.uint64) + secret[0])
    out ^= chunks[starts] & _LOW[np.minimum(sizes, 8)]
    out = mix(out + secret[1])
    rest, at = np.flatnonzero((sizes > 8) & (sizes <= LONG)), 8
    while len(rest):
        part = out[rest] ^ (chunks[starts[rest] + at] & _LOW[np.minimum(sizes[rest] - at, 8)])
        out[rest] = mix(part + secret[1 + (at // 8) % 7])
        at += 8
        rest = rest[sizes[rest] > at]
    for i in np.flatnonzero(sizes > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8, key=key).digest(), "little")
    return out


def equal_ranges(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each i whether a and b (both padded) hold the same sizes[i] bytes from a_starts[i] and b_starts[i] on."""
    in_a, in_b = _chunks(a), _chunks(b)
    out = ((in_a[a_starts] ^ in_b[b_starts]) & _LOW[np.minimum(sizes, 8)]) == 0
    rest, at = np.flatnonzero((sizes > 8) & (sizes <= LONG)), 8
    while len(rest):
        out[rest] &= ((in_a[a_starts[rest] + at] ^ in_b[b_starts[rest] + at]) & _LOW[np.minimum(sizes[rest] - at, 8)]) == 0
        at += 8
        rest = rest[sizes[rest] > at]
    for i in np.flatnonzero(sizes > LONG).tolist():
        n = sizes[i]
        out[i] = np.array_equal(a[a_starts[i] : a_starts[i] + n], b[b_starts[i] : b_starts[i] + n])
    return out


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive values; len(hashes) - width + 1 of them."""
    total = np.zeros(len(hashes) - width + 1, dtype=np.uint64)
    for j in range(width):
        total += mix(hashes[j : j + len(total)] + _U((j + 1) * 0xD6E8FEB86659FD93 & (1 << 64) - 1))
    return mix(total)


def shingle_sets(texts: Texts, width: int, key: bytes) -> list[np.ndarray]:
    """For each text its sorted distinct shingle hashes, A-Z folded.

    A text with fewer words than ``width`` has its whole word sequence as its one shingle; a text
    without words has none.
    """
    words = find_words(texts)
    hashes = range_hashes(padded(texts.data, True), words.starts, words.ends, key)
    windows = window_hashes(hashes, width) if len(hashes) >= width else hashes[:0]
    sets = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= width:
            own = np.sort(windows[a : b - width + 1])
            keep = np.empty(len(own), dtype=bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            sets.append(own[keep])
        elif b > a:
            whole = window_hashes(hashes[a:b], b - a)
            sets.append(mix(whole + _U(b - a)))
        else:
            sets.append(hashes[:0])
    return sets
