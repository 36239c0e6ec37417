"""Exact Jaccard join of word n-gram sets with PartEnum signatures.

Two sets with Jaccard of p/100 or more differ in at most k(a) = a (100 - p)/p elements, where a is
the size of either. Sets fall into bands of sizes, each twice as wide as the one before. A band
partitions the feature domain into first-level parts, and each of these into SECOND second-level
parts. Its signatures are the contents of all subsets of SECOND - 1 second-level parts of each
first-level part (empty contents left out): where two sets differ in one element at most in a
first-level part, one of its subsets has equal content. From the numbers of parts in use follows how
many signatures k(a) differences can spoil at most; a band has so many parts that some are left, and
if a set has none left by chance, its fewest features that must meet (a prefix in hash order) sign
for it as well. Only the rarest signatures that are needed for MEETINGS meetings travel; content is
as rare as its rarest feature, by counts of all features in a sketch of fixed size. That keeps
passages that many texts share out of signatures and never changes the result. A set whose partners
may lie in the next band signs there too.

Groups with one signature are small or large. In small ones pairs are counted; in large ones sets
meet under the least of them, their lead. Of the n signatures that two partners share at least,
either half lies in small groups, so that their count shows them, or more than half in large ones,
so that both have that many of those; all else goes. What met is compared in blocks of bounded size:
first by parities, which prove most pairs apart and take a fraction of the bytes, the rest by exact
counts of common features, and in rounds, each between the components that the one before left. Equal sets are one set throughout, so copies cost nothing after the first scan.

Features are 64-bit hashes with a key drawn for each run. Sets are told apart by 128 bits of them;
where they only meet, by short names of 48, and sets with one name add candidates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparrowmill.llm.components import connected_components
from sparrowmill.llm.storage import giving_back, materialize, sliced
from sparrowmill.llm.words import SCAN_BYTES, Texts, mix, new_key, shingle_sets

_U = np.uint64
#: Sizes up to which the first band goes; each other band ends at twice the size.
FIRST_BORDER = 8
#: Features that a first-level part of the largest set of a band holds on average, for percent = 75: by band, the last for all others.
PART_FEATURES = (1, 2, 3, 3.5, 4, 4.5, 5)
#: Second-level parts; all subsets of one less are enumerated, so that a first-level part bears one difference.
SECOND = 3
#: Signatures that partners share at least, where sets have enough of them.
MEETINGS = 12
#: Counters of the sketch of feature frequencies; its size is fixed.
SKETCH_BITS = 18
_CHUNKS = 16
#: Sets of a group whose pairs are counted one by one.
SMALL_GROUP = 32
#: Shingles for a bucket, buckets at least, signatures that a task holds before it sends them, sets in a block, ids that may be broadcast.
BUCKET_SHINGLES, LEAST_BUCKETS, HELD_SIGNATURES, BLOCK_SETS, BROADCAST_IDS = 1 << 20, 128, 2 << 20, 512, 500_000
#: Sets of a component of a large group that are compared with those of its other components before all are.
FEW_SETS = 8
#: Sets whose names a task remembers so as not to send copies again.
REMEMBERED_SETS = 100_000
_SHORT = (1 << 48) - 1


def set_digest(features: np.ndarray) -> bytes:
    """128 bits of a set of features."""
    n = _U(len(features))
    both = np.array([mix(features).sum(dtype=np.uint64) + n, mix(features ^ _U(0xA0761D6478BD642F)).sum(dtype=np.uint64) - n], np.uint64)
    return mix(both).astype("<u8").tobytes()


#: The same of a column named digest.
SHORT_NAME = "conv(hex(substring(digest, 1, 6)), 16, 10)"


def short_name(digest: bytes) -> int:
    """48 bits of a digest."""
    return int.from_bytes(digest[:6], "big")


def part_count(band: int, percent: int) -> int:
    """First-level parts of a band; fewer differences allow for larger parts."""
    mean = PART_FEATURES[min(band, len(PART_FEATURES) - 1)] * percent / (3 * (100 - percent))
    return max(2, math.ceil(FIRST_BORDER * 2**band / max(mean, 0.5)))


def band_of(size: int) -> int:
    band = 0
    while size > FIRST_BORDER << band:
        band += 1
    return band


def sign_sets(sets: list[np.ndarray], levels: np.ndarray, percent: int) -> list[tuple[np.ndarray, int]]:
    """For each set its signatures in its one or two bands, and how many it shares with any partner at least.

    ``levels`` has for each sketch slot how frequent its features are. Sets that can have no
    partner but their equals have no signatures.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    signing, bands = [], []
    for i, size in enumerate(sizes.tolist()):
        if size * (100 - percent) // percent:
            own = band_of(size)
            signing.append(i)
            bands.append(own)
            if 100 * size >= percent * ((FIRST_BORDER << own) + 1):
                signing.append(i)
                bands.append(own + 1)
    if not signing:
        return [(np.zeros(0, np.uint64), 0) for _ in sets]
    who, band = np.array(signing), np.array(bands)
    n, differences = sizes[who], sizes[who] * (100 - percent) // percent
    parts = np.array([part_count(b, percent) for b in bands])
    salt = mix(band.astype(np.uint64) + _U(0xC2B2AE3D27D4EB4F))
    features = np.concatenate([sets[i] for i in signing])
    owner = np.repeat(np.arange(len(who)), n)
    first = np.cumsum(parts) - parts
    cell = SECOND * first[owner] + (((features >> _U(32)) * (SECOND * parts)[owner].astype(np.uint64)) >> _U(32)).astype(np.int64)
    heads = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])  # features are sorted, so cells are too
    level = levels[(features & _U(len(levels) - 1)).astype(np.int64)]
    total = int(parts.sum())
    content, rarity, used = np.zeros(SECOND * total, np.uint64), np.full(SECOND * total, 63, np.uint8), np.zeros(SECOND * total, bool)
    content[cell[heads]] = np.add.reduceat(mix(features + salt[owner]), heads)
    rarity[cell[heads]] = np.minimum.reduceat(level, heads)
    used[cell[heads]] = True
    content, rarity, used = content.reshape(total, SECOND), rarity.reshape(total, SECOND), used.reshape(total, SECOND)
    part_owner = np.repeat(np.arange(len(who)), parts)
    place = mix((np.arange(total) - first[part_owner]).astype(np.uint64) + salt[part_owner])
    keys, owners = [], []
    for out in range(SECOND):  # the subset without second-level part `out`
        rest = [j for j in range(SECOND) if j != out]
        some = used[:, rest].any(axis=1)
        token = place[some] + _U(out)
        for j in rest:
            token = mix(token + np.where(used[some, j], content[some, j], _U(0)))
        keys.append((rarity[some][:, rest].min(axis=1).astype(np.uint64) << _U(58)) | (token >> _U(6)))
        owners.append(part_owner[some])
    keys, owners = np.concatenate(keys), np.concatenate(owners)
    filled = used.sum(axis=1)
    several, single = np.bincount(part_owner[filled > 1], minlength=len(who)), np.bincount(part_owner[filled == 1], minlength=len(who))
    # A difference spoils all but one of the subsets of a part, a second one the last; all of them where one second-level part holds everything.
    spoiled = (SECOND - 1) * np.minimum(differences, several + single) + np.clip(differences - several - single, 0, several)
    held = np.bincount(owners, minlength=len(who))
    need, keep = np.minimum(MEETINGS, held - spoiled), np.minimum(held, spoiled + MEETINGS)
    order = np.lexsort((keys, owners))
    ends = np.cumsum(held)
    chosen = order[np.arange(len(order)) - np.repeat(ends - held, held) < np.repeat(keep, held)]
    cuts = np.r_[0, np.cumsum(keep)]
    keys = mix(keys[chosen])
    found: list[list[np.ndarray]] = [[] for _ in sets]
    least = np.full(len(sets), MEETINGS)
    for x, i in enumerate(signing):
        found[i].append(keys[cuts[x] : cuts[x + 1]])
        if need[x] < 1:  # no signature is sure to be shared: a prefix of features is
            prefix = sets[i][: int(n[x]) - -(-int(n[x]) * percent // 100) + 1]
            found[i].append(mix(mix(prefix + salt[x]) + _U(1)))
        least[i] = min(least[i], max(1, need[x]))
    return [(np.concatenate(f), int(m)) if f else (np.zeros(0, np.uint64), 0) for f, m in zip(found, least, strict=True)]


def _named_sets(batches: Iterator[pa.RecordBatch], width: int, key: bytes) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in sliced(batches, "text", SCAN_BYTES):
        yield batch, shingle_sets(Texts.of(batch.column("text")), width, key)


class _Seen:
    """Digests met lately: those since the last or the last but one time that REMEMBERED_SETS were full."""

    def __init__(self) -> None:
        self.new, self.old = set(), set()

    def add(self, digest: bytes) -> bool:
        """Whether the digest is new here."""
        if digest in self.new or digest in self.old:
            return False
        if len(self.new) >= REMEMBERED_SETS:
            self.new, self.old = set(), self.new
        self.new.add(digest)
        return True


def survey(rows: DataFrame, width: int, key: bytes) -> DataFrame:
    """(doc_id, n_shingles, digest) of each row, and parts of the sketch: (slot, counts)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, seen, waiting, kind = np.zeros(1 << SKETCH_BITS, np.int64), _Seen(), [], None

        def count() -> None:
            if waiting:
                sketch[:] += np.bincount((np.concatenate(waiting) & _U(len(sketch) - 1)).astype(np.int64), minlength=len(sketch))
                waiting.clear()

        def schema() -> pa.Schema:
            return pa.schema([("doc_id", kind), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("slot", pa.int32()), ("counts", pa.binary())])

        for batch, sets in _named_sets(batches, width, key):
            digests = [set_digest(s) if len(s) else None for s in sets]
            for digest, s in zip(digests, sets, strict=True):
                if digest is not None and seen.add(digest):  # copies count once
                    waiting.append(s)
            if sum(map(len, waiting)) > len(sketch) * 4:
                count()
            n, kind = batch.num_rows, batch.column("doc_id").type
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=schema())
        count()
        if kind is not None and sketch.any():
            parts = [p.astype("<u4").tobytes() for p in np.split(sketch, _CHUNKS)]
            nulls = [pa.nulls(_CHUNKS, t) for t in (kind, pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*nulls, pa.array(range(_CHUNKS), pa.int32()), pa.array(parts, pa.binary())], schema=schema())

    others = T.StructType.fromDDL("n_shingles long, digest binary, slot int, counts binary")
    return rows.mapInArrow(giving_back(scan), T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), *others]))


def frequency_levels(surveyed: DataFrame) -> np.ndarray:
    """The sketch as 64 levels of frequency against its mean; _CHUNKS rows come to the driver."""

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << SKETCH_BITS) // _CHUNKS, np.int64)
        for batch in batches:
            for raw in batch.column("counts"):
                total += np.frombuffer(raw.as_py(), "<u4")
        yield pa.RecordBatch.from_pydict({"slot": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    parts = surveyed.where("slot is not null").select("slot", "counts").groupBy("slot").applyInArrow(add, "slot int, counts binary").collect()
    if not parts:
        return np.zeros(1 << SKETCH_BITS, np.uint8)
    counts = np.concatenate([np.frombuffer(bytes(r.counts), np.int64) for r in sorted(parts, key=lambda r: r.slot)])
    return np.minimum(63, 4 * np.log2(1 + counts / max(counts.mean(), 1e-9))).astype(np.uint8)


def _cells(where: np.ndarray, places: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each place in use the items that go there, in order."""
    order = np.argsort(where, kind="stable")
    cuts = np.searchsorted(where[order], np.arange(places + 1, dtype=where.dtype))
    for i in np.flatnonzero(np.diff(cuts)).tolist():
        yield i, order[cuts[i] : cuts[i + 1]]


def signed(rows: DataFrame, width: int, key: bytes, percent: int, levels: np.ndarray, buckets: int) -> DataFrame:
    """(bucket, packed) of many sets in a row: runs, then 32 bits of each signature.

    A run is eight bytes for the signatures of one set in the bucket, up to 255 of them: the short
    name, how many of its signatures it shares with a partner at least, and their number.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, found, held, seen = [], [], 0, _Seen()

        def send() -> pa.RecordBatch:
            keys, which, packed = np.concatenate(found), [], []
            tags = np.repeat(np.array(names, np.uint64), [len(f) for f in found])
            for b, own in _cells(((keys >> _U(32)) * _U(buckets)) >> _U(32), buckets):
                heads = np.flatnonzero(np.r_[True, tags[own][1:] != tags[own][:-1]])
                runs = np.diff(np.r_[heads, len(own)])
                again = -(-runs // 255)
                heads = np.repeat(heads, again) + 255 * (np.arange(again.sum()) - np.repeat(np.cumsum(again) - again, again))
                runs = np.diff(np.r_[heads, len(own)])
                which.append(b)
                packed.append(len(heads).to_bytes(4, "little") + (tags[own][heads] | runs.astype(np.uint64) << _U(56)).astype("<u8").tobytes() + keys[own].astype("<u4").tobytes())
            return pa.RecordBatch.from_pydict({"bucket": pa.array(which, pa.int32()), "packed": pa.array(packed, pa.binary())})

        for _, sets in _named_sets(batches, width, key):
            new = [(d, s) for s in sets if len(s) and seen.add(d := set_digest(s))]
            for (digest, _), (keys, need) in zip(new, sign_sets([s for _, s in new], levels, percent), strict=True):
                if len(keys):
                    names.append(short_name(digest) | need << 48)
                    found.append(keys)
                    held += len(keys)
            if held > HELD_SIGNATURES:
                yield send()
                names, found, held = [], [], 0
        if found:
            yield send()

    return rows.select("text").mapInArrow(giving_back(scan), "bucket int, packed binary")


def _unpack_signatures(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signature, short name and need of each entry of a bucket, in order of signature and name, once each, where a signature has several names."""
    keys, tags = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint64)]
    for batch in batches:
        for cell in batch.column("packed"):
            raw = cell.as_py()
            runs = np.frombuffer(raw, "<u8", int.from_bytes(raw[:4], "little"), 4)
            tags.append(np.repeat(runs & _U((1 << 56) - 1), (runs >> _U(56)).astype(np.int64)))
            keys.append(np.frombuffer(raw, "<u4", -1, 4 + 8 * len(runs)))
    keys, tags = np.concatenate(keys), np.concatenate(tags)
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    order = order[(np.r_[same, False] | np.r_[False, same])[: len(order)]]
    keys, names, need = keys[order], (tags[order] & _U(_SHORT)).astype(np.int64), (tags[order] >> _U(48)).astype(np.int64)
    order = np.lexsort((names, keys))
    keys, names, need = keys[order], names[order], need[order]
    once = np.r_[True, (keys[1:] != keys[:-1]) | (names[1:] != names[:-1])][: len(keys)]  # a set comes once from each partition that has it
    return keys[once], names[once], need[once]


def _pack(large: int, a: np.ndarray, b: np.ndarray, times: np.ndarray, need: np.ndarray) -> bytes:
    """A kind, and for each pair two names of six bytes and two counts of one."""
    pairs = np.zeros((len(a), 14), np.uint8)
    pairs[:, :6], pairs[:, 6:12] = a.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :6], b.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :6]
    pairs[:, 12], pairs[:, 13] = np.minimum(times, 255), need
    return bytes([large]) + pairs.tobytes()


def _unpack(raw: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    pairs = np.frombuffer(raw, np.uint8, -1, 1).reshape(-1, 14)
    names = np.zeros((2, len(pairs), 8), np.uint8)
    names[0, :, :6], names[1, :, :6] = pairs[:, :6], pairs[:, 6:12]
    names = names.view("<i8")[:, :, 0]
    return raw[0], names[0], names[1], pairs[:, 12].astype(np.int64), pairs[:, 13].astype(np.int64)


def _summed(a: np.ndarray, b: np.ndarray, times: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct (a, b) in order of b, with their times added and the largest need."""
    if not len(a):
        return a, b, times, need
    order = np.lexsort((a, b))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    return a[first], b[first], np.add.reduceat(times[order], first), np.maximum.reduceat(need[order], first)


def meetings(packed: DataFrame, places: int) -> DataFrame:
    """(large, a, b): pairs a < b that met often enough in small groups, and the sets b that are in
    enough large groups under each of their leads a, by short names.

    Counts travel packed, by places that b falls to, so that all counts of a set meet.
    """

    def meet(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, names, need = _unpack_signatures(batches)
        if not len(keys):
            return
        heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        many = np.diff(np.r_[heads, len(keys)])
        group = np.repeat(np.arange(len(heads)), many)
        found = []
        for gap in range(1, SMALL_GROUP):  # the pairs of small groups, by how far apart they stand
            left = np.flatnonzero((group[gap:] == group[:-gap]) & (many[group[gap:]] <= SMALL_GROUP))
            right = left + gap
            found.append((names[left], names[right], (np.maximum(need[left], need[right]) + 1) // 2))
        pairs = [np.concatenate(c) for c in zip(*found, strict=True)]
        big = many[group] > SMALL_GROUP
        lead = np.repeat(names[heads], many)
        where, rows = [], []
        for large, (a, b, n) in enumerate((pairs, (lead[big], names[big], need[big] - (need[big] + 1) // 2 + 1))):
            a, b, times, n = _summed(a, b, np.ones(len(a), np.int64), n)
            for i, own in _cells(((mix(b.view(np.uint64)) >> _U(32)) * _U(places)) >> _U(32), places):
                where.append(i)
                rows.append(_pack(large, a[own], b[own], times[own], n[own]))
        yield pa.RecordBatch.from_pydict({"place": pa.array(where, pa.int32()), "counts": pa.array(rows, pa.binary())})

    def settle(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[list] = [[], []]
        for batch in batches:
            for cell in batch.column("counts"):
                large, *columns = _unpack(cell.as_py())
                kinds[large].append(columns)
        for large, parts in enumerate(kinds):
            if parts:
                a, b, times, need = _summed(*[np.concatenate(c) for c in zip(*parts, strict=True)])
                if large:  # what counts is in how many large groups a set is, under whatever leads
                    first = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
                    each = np.diff(np.r_[first, len(b)])
                    times, need = np.repeat(np.add.reduceat(times, first), each), np.repeat(np.maximum.reduceat(need, first), each)
                keep = times >= need
                yield pa.RecordBatch.from_pydict({"large": pa.array(np.full(int(keep.sum()), bool(large))), "a": pa.array(a[keep]), "b": pa.array(b[keep])})

    counts = packed.groupBy("bucket").applyInArrow(giving_back(meet), "place int, counts binary")
    return counts.groupBy("place").applyInArrow(giving_back(settle), "large boolean, a long, b long")


def linked(sets: list[np.ndarray], percent: int, columns: int = 4096) -> np.ndarray:
    """For each pair of sets whether they link, from exact counts of common features."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, feature, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    place = np.cumsum(shared) - 1
    keep = shared[feature]
    owner, column = owner[keep], place[feature[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(sets), len(sets)), np.float64)
    for first in range(0, int(shared.sum()), columns):
        a, b = np.searchsorted(column, [first, first + columns])
        part = np.zeros((len(sets), min(columns, int(shared.sum()) - first)), np.float32)
        part[owner[a:b], column[a:b] - first] = 1
        common += part @ part.T  # at most `columns` ones meet, so single precision is exact
    sizes = np.array([len(s) for s in sets], np.float64)
    return 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)


def forest(link: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join what the link matrix joins, one for each set that isn't the first of its component."""
    left, edges = np.ones(len(link), bool), []
    for root in range(len(link)):
        if left[root]:
            left[root] = False
            front = np.array([root])
            while len(front):
                reached = link[front].any(axis=0) & left
                left &= ~reached
                front = np.flatnonzero(reached)
                edges += [(root, int(i)) for i in front]
    return edges


def parities(features: np.ndarray) -> bytes:
    """A bit for each of at least four cells a feature: whether an odd number of features falls there."""
    cells = 64 << max(0, int(len(features) * 4 - 1).bit_length() - 6)
    odd = np.bincount((features & _U(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def may_link(bits: list[bytes], sizes: np.ndarray, percent: int, columns: int = 4096) -> np.ndarray:
    """For each pair of sets whether their sizes and parities allow a link.

    Each element that two sets don't share changes one parity, so they differ in at least as many
    elements as parities. Of different numbers of cells, the larger one folds to the smaller.
    """
    cells = np.array([8 * len(x) for x in bits])
    odd = [np.unpackbits(np.frombuffer(x, np.uint8), bitorder="little") for x in bits]
    apart = np.zeros((len(bits), len(bits)), np.int32)
    for m in np.unique(cells).tolist():
        own, at_least = np.flatnonzero(cells == m), np.flatnonzero(cells >= m)
        folded = np.stack([np.bitwise_xor.reduce(odd[i].reshape(-1, m), axis=0) for i in at_least])
        mine, common = folded[np.isin(at_least, own)], np.zeros((len(own), len(at_least)), np.float32)  # whole numbers, exact up to 2^24
        for first in range(0, m, columns):
            common += mine[:, first : first + columns].astype(np.float32) @ folded[:, first : first + columns].astype(np.float32).T
        ones = folded.sum(axis=1, dtype=np.int32)
        differ = mine.sum(axis=1, dtype=np.int32)[:, None] + ones[None, :] - 2 * common.astype(np.int32)
        apart[np.ix_(own, at_least)] = differ
        apart[np.ix_(at_least, own)] = differ.T
    near = 100 * np.minimum(sizes[:, None], sizes[None, :]) >= percent * np.maximum(sizes[:, None], sizes[None, :])
    return near & (apart.astype(np.int64) * (100 + percent) <= (sizes[:, None] + sizes[None, :]) * (100 - percent))


def _groups(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[list[tuple]]:
    """Runs of rows with one (lead, i, j); of each row those three and the columns, a node once."""
    rows: dict[int, tuple] = {}
    group = None
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("lead", "i", "j", "node", *columns)), strict=True):
            if row[:3] != group:
                if len(rows) > 1:
                    yield list(rows.values())
                group, rows = row[:3], {}
            rows[row[3]] = row
    if len(rows) > 1:
        yield list(rows.values())


def _compared(dealt: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) between components that join what links within each group of rows with one (lead, i, j).

    ``dealt`` has the digest, node and component so far of each row too; pairs of one component
    don't matter. Features travel only for sets that parities allow to link with one of another
    component.
    """

    def allowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []
        schema = pa.schema([("lead", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("node", pa.int64()), ("digest", pa.binary()), ("component", pa.int64())])

        def send() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[x] for r in kept], t) for x, t in enumerate(schema.types)], schema=schema)

        for rows in _groups(batches, ("digest", "component", "n", "bits")):
            component = np.array([r[5] for r in rows])
            open_ = may_link([r[7] for r in rows], np.array([r[6] for r in rows]), percent) & (component[:, None] != component[None, :])
            kept += [r for r, some in zip(rows, open_.any(axis=1).tolist(), strict=True) if some]
            if len(kept) > 10_000:
                yield send()
                kept = []
        yield send()

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []

        def send() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

        for rows in _groups(batches, ("component", "features")):
            joined = forest(linked([np.frombuffer(r[5], "<u8") for r in rows], percent))
            out += {(rows[x][4], rows[y][4]) for x, y in joined if rows[x][4] != rows[y][4]}
            if len(out) > 10_000:
                yield send()
                out = []
        yield send()

    def together(rows: DataFrame) -> DataFrame:
        return rows.repartition("lead", "i", "j").sortWithinPartitions("lead", "i", "j", "node")

    rows = together(dealt.join(sets.select("digest", "n", "bits"), "digest").select("lead", "i", "j", "node", "digest", "component", "n", "bits"))
    rows = materialize(rows.mapInArrow(giving_back(allowed), "lead long, i int, j int, node long, digest binary, component long"), "join-allowed")
    few = rows.select("digest").distinct()
    own = sets.select("digest", "features").join(F.broadcast(few), "digest", "left_semi") if rows.count() <= BROADCAST_IDS else sets.select("digest", "features")
    rows = together(rows.join(own, "digest").select("lead", "i", "j", "node", "component", "features"))
    return materialize(rows.mapInArrow(giving_back(check), "a long, b long"), "join-links")


def _blocks(rows: F.Column) -> F.Column:
    return F.ceil(F.count(rows) / BLOCK_SETS).cast("int")


def _own_block(name: str, blocks: str) -> F.Column:
    return F.pmod(F.xxhash64("lead", name), F.col(blocks)).cast("int")


def verified_stars(pairs: DataFrame, known: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) between components: of each set under a lead and the first one there, if they link, and some more.

    ``pairs`` has (lead, member) in short names, ``known`` (name, digest, node, component) of all sets,
    ``sets`` (digest, n, bits, features). The sets under a lead are dealt to blocks of about
    BLOCK_SETS, to each of which the first goes too; all pairs of a block are compared.
    """
    counted = pairs.groupBy("lead").agg(_blocks(F.lit(1)).alias("blocks"), F.min("member").alias("head"))
    under = pairs.select("lead", F.col("member").alias("name")).join(counted, "lead").join(known, "name")
    to = F.when(F.col("name") == F.col("head"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(_own_block("name", "blocks")))
    return _compared(under.select("lead", "digest", "node", "component", F.explode(to).alias("i"), F.lit(0).alias("j")), sets, percent)


def verified_across(pairs: DataFrame, known: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) between components that join all that links under a lead, where sets with ``aside`` false are one component already.

    ``pairs`` has (lead, member, aside). Sets aside are compared with all sets: each block of those
    meets each block of these in a group, so no group grows with the data.
    """
    counted = pairs.groupBy("lead").agg(_blocks(F.lit(1)).alias("blocks"), _blocks(F.when(F.col("aside"), 1)).alias("aside_blocks"))
    under = materialize(pairs.withColumnRenamed("member", "name").join(counted, "lead").join(known, "name"), "join-under")
    columns = ["lead", "digest", "node", "component"]
    alone = under.where("aside").select(*columns, _own_block("node", "aside_blocks").alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    every = under.select(*columns, F.explode(F.sequence(F.lit(0), F.col("aside_blocks") - 1)).alias("i"), _own_block("name", "blocks").alias("j"))
    return _compared(alone.unionByName(every), sets, percent)


def linked_components(met: DataFrame, known: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, root) of the sets in ``known``; ``met`` as of ``meetings``.

    In three rounds, each on what the one before left in several components: each set and the least
    it met; pairs of small groups, and a few sets of each component of a large group; and the large
    groups in full, those with the same largest component together. Each round joins the components
    of the one before, so its graph has nodes only for what still moves.
    """
    with_lead = lambda pairs: pairs.unionByName(pairs.select("lead", F.col("lead").alias("member")).distinct())

    def placed(now: DataFrame, edges: DataFrame) -> DataFrame:
        """``now`` with the components joined along the edges between them."""
        if edges.isEmpty():
            return now
        roots = connected_components(edges).where("node != root").withColumnRenamed("node", "component")
        return materialize(now.join(roots, "component", "left").select("name", "digest", "node", F.coalesce("root", "component").alias("component")), "join-placed")

    def result(now: DataFrame) -> DataFrame:
        return now.select("node", F.col("component").alias("root"))

    def at(now: DataFrame, c: str) -> DataFrame:
        """The least and largest component of a short name, which several sets may have."""
        return now.groupBy(F.col("name").alias(c)).agg(F.min("component").alias(f"{c}_low"), F.max("component").alias(f"{c}_high"))

    def mixed(now: DataFrame) -> DataFrame:
        """(a, b, low, high, most): the large groups a in several components, their sets, and the component of most."""
        large = met.where("large").join(at(now, "b"), "b").select("a", "b", F.col("b_low").alias("low"), F.col("b_high").alias("high"))
        sizes = large.groupBy("a", "low").agg(F.count(F.lit(1)).alias("n"), F.max("high").alias("top"))
        most = sizes.groupBy("a").agg(F.max_by("low", F.struct("n", -F.col("low"))).alias("most"), F.min("low").alias("least"), F.max("top").alias("top"))
        return large.join(most.where("least != top").select("a", "most"), "a")

    stars = met.where("a != b").groupBy(F.col("b").alias("member")).agg(F.min("a").alias("lead")).select("lead", "member")
    now = known.select("name", "digest", "node", F.col("node").alias("component"))
    now = placed(now, verified_stars(with_lead(materialize(stars, "join-stars")), now, sets, percent))

    pairs = met.where("not large").join(at(now, "a"), "a").join(at(now, "b"), "b").where("least(a_low, b_low) != greatest(a_high, b_high)").select(F.col("a").alias("lead"), F.col("b").alias("member"))
    # Sets that share a short name don't meet as a pair: their name leads itself.
    twice = at(now, "lead").where("lead_low != lead_high").select("lead", F.col("lead").alias("member"))
    place = F.row_number().over(Window.partitionBy("a", "low").orderBy(F.xxhash64("a", "b")))
    few = mixed(now).withColumn("place", place).where(F.col("place") <= FEW_SETS).select(F.col("a").alias("lead"), F.col("b").alias("member"))
    some = materialize(with_lead(pairs).unionByName(twice).unionByName(few).distinct(), "join-apart")
    if some.isEmpty():
        return result(now)
    now = placed(now, verified_stars(some, now, sets, percent))

    aside = (F.col("low") != F.col("most")) | (F.col("high") != F.col("most"))
    whole = materialize(mixed(now).select(F.col("most").alias("lead"), F.col("b").alias("member"), aside.alias("aside")).distinct(), "join-mixed")
    if not whole.isEmpty():
        now = placed(now, verified_across(whole, now, sets, percent))
    return result(now)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id.

    Sets are those of words.shingle_sets. Two rows link when 100 * common >= percent * union; a row
    whose text is null or has no words has an empty set, links with nothing and is its own
    component. component_id is the smallest doc_id that can be reached by links (null only if all
    of them are). doc_id may have any type with an order. Rows that repeat a doc_id are rows of
    their own. Other columns are ignored.
    """
    key = new_key()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    surveyed = materialize(survey(rows, width, key), "join-survey")
    named = surveyed.where("slot is null").select("doc_id", "n_shingles", "digest")
    known = named.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    # Numbers are stored so that they stay.
    known = materialize(known.select("*", F.expr(SHORT_NAME).cast("long").alias("name"), F.monotonically_increasing_id().alias("node")), "join-sets")
    levels = frequency_levels(surveyed)
    total = named.agg(F.sum("n_shingles").alias("n")).first().n or 0
    buckets = max(LEAST_BUCKETS, math.ceil(total / BUCKET_SHINGLES))
    met = materialize(meetings(signed(rows, width, key, percent, levels, buckets), buckets), "join-meetings")
    twice = known.groupBy("name").count().where("count > 1").select("name")
    wanted = met.select(F.explode(F.array("a", "b")).alias("name")).unionByName(twice).distinct()
    wanted = materialize(known.join(wanted, "name", "left_semi"), "join-wanted")
    ids = wanted.select("doc_id").distinct()
    some = F.broadcast(ids) if wanted.count() <= BROADCAST_IDS else ids
    chosen = rows.where("doc_id is not null").join(some, "doc_id", "left_semi").unionByName(rows.where("doc_id is null"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for _, sets in _named_sets(batches, width, key):
            new = {d: s for s in sets if len(s) and seen.add(d := set_digest(s))}
            columns = {"n": pa.array(map(len, new.values()), pa.int64()), "bits": pa.array(map(parities, new.values()), pa.binary()), "features": pa.array([s.tobytes() for s in new.values()], pa.binary())}
            yield pa.RecordBatch.from_pydict({"digest": pa.array(list(new), pa.binary())} | columns)

    sets = materialize(chosen.select("text").mapInArrow(giving_back(features), "digest binary, n long, bits binary, features binary"), "join-features")
    roots = linked_components(met, wanted, sets, percent)
    joined = materialize(roots.join(wanted, "node").select("digest", "doc_id", "root"), "join-components")
    least = joined.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    classes = known.select("digest", F.col("doc_id").alias("alone")).join(joined.join(least, "root").select("digest", "component_id"), "digest", "left")
    # A set that links to nothing has the least doc_id of its copies.
    classes = classes.select("digest", F.coalesce("component_id", "alone").alias("component_id"))
    out = named.join(classes, "digest", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


NAME, SQL = "op2_ngram_join", None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
