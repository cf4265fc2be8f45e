"""Array kernels shared by the text operators: word splitting and hashing over Arrow buffers.

Everything here works on the UTF-8 bytes of a column of strings. Word separators are single ASCII
bytes, so bytes and code points split alike. A null text counts as the empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4 << 20
SHORT_SLICE = 1 << 20  # where stages of one session keep their workers' memory on the same executors
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULT = np.uint64(0x9E3779B97F4A7C15)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True  # capitals are lower-cased later
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of the multiplier, modulo 2**64."""
    global _powers
    if n > len(_powers):
        size = 1 << (n - 1).bit_length()
        grown = np.full(size, _MULT, np.uint64)
        grown[0] = 1
        _powers = np.multiply.accumulate(grown)
    return _powers[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every input bit over the word."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about ``limit`` bytes; nulls are empty.

    A single longer text makes a run of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_bounds(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each text the index of its first word (one more entry at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~separators[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word's bytes, A-Z lower-cased first if ``lower``."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    total = np.cumsum(lengths)
    into = np.arange(total[-1]) - np.repeat(total - lengths, lengths)
    picked = data[np.repeat(starts, lengths) + into]
    table = _BYTE[LOWER] if lower else _BYTE
    values = table[picked] * powers(int(lengths.max()))[into]
    return mix(np.add.reduceat(values, total - lengths) + lengths.astype(np.uint64))


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n neighbouring word hashes; runs over text edges are included."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out = out * _MULT + words[k : len(words) - n + 1 + k]
    return mix(out + np.uint64(n))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its n-word shingles; a shorter text is one shingle, no word none."""
    starts, ends, first = word_bounds(data, offsets)
    words = word_hashes(data, starts, ends)
    grams = ngram_hashes(words, n)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            out.append(ngram_hashes(words[a:b], b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def pack(a: np.ndarray, delta: bool = False) -> bytes:
    """Bytes of an integer array, planes of equal significance together, compressed; ``delta`` for sorted arrays."""
    a = np.ascontiguousarray(a)
    if delta and len(a):
        a = np.diff(a, prepend=a.dtype.type(0))
    planes = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T if len(a) else np.zeros(0, np.uint8)
    head = np.array([len(a)], np.int64).tobytes() + a.dtype.str.encode().ljust(8)
    return head + pa.compress(np.ascontiguousarray(planes).tobytes(), "zstd", asbytes=True)


def unpack(b: bytes, delta: bool = False) -> np.ndarray:
    """The array that ``pack`` was given."""
    n, kind = int(np.frombuffer(b, np.int64, 1)[0]), np.dtype(b[8:16].decode().strip())
    if not n:
        return np.zeros(0, kind)
    raw = np.frombuffer(pa.decompress(b[16:], decompressed_size=n * kind.itemsize, codec="zstd", asbytes=True), np.uint8)
    a = np.ascontiguousarray(raw.reshape(kind.itemsize, n).T).view(kind).reshape(n)
    return np.cumsum(a, dtype=kind) if delta else a


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of every run, one run after the other."""
    total = np.cumsum(counts)
    if not len(total) or not total[-1]:
        return np.zeros(0, np.int64)
    return np.arange(total[-1]) + np.repeat(starts - (total - counts), counts)


def local_components(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest node reachable over the edges a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


HELD = 3_000_000  # keys that a task holds before it sends them out
WIDE = 1024  # ranges that one task deals to; beyond that dealing takes two steps


def hash_edges(ranges: int) -> np.ndarray:
    """The lower ends of equal ranges of 64-bit hashes."""
    return np.array([(b << 64) // ranges for b in range(ranges)], np.uint64)


def merge_counts(k: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the sum of the counts of each."""
    order = np.argsort(k)
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(k) else c


class Tally:
    """Sums counts of keys and deals them, sorted and packed, to ranges of keys."""

    schema = "block int, k binary, c binary"

    def __init__(self):
        self.held: list[tuple[np.ndarray, np.ndarray | None]] = []
        self.n = 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        """Without counts each key counts one."""
        self.held.append((keys, counts))
        self.n += len(keys)

    def flush(self, edges: np.ndarray, first: int = 0) -> Iterator[pa.RecordBatch]:
        if self.n:
            if all(c is None for _, c in self.held):
                k, c = np.unique(np.concatenate([k for k, _ in self.held]), return_counts=True)
            else:
                k, c = merge_counts(np.concatenate([k for k, _ in self.held]), np.concatenate([c if c is not None else np.ones(len(k), np.int64) for k, c in self.held]))
            self.held, self.n = [], 0
            cut = [*np.searchsorted(k, edges), len(k)]
            kind = np.uint32 if c.max() < 2**32 else np.uint64
            out = [(first + b, pack(k[x:y], delta=True), pack(c[x:y].astype(kind))) for b, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if y > x]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["block", "k", "c"])


def dealt(make, ranges: int, edges: np.ndarray):
    """Counts dealt to ``ranges`` by key, as rows of (block, k, c): ``make(edges)`` gives those of a map side that deals by the edges it is told.

    Above ``WIDE`` ranges the map side deals to runs of neighbouring ranges only, and a second pass, in which a task
    holds no more than the first, splits each run: rows grow with the square root of the ranges for each key sent,
    not with their number.
    """
    if ranges <= WIDE:
        return make(edges)
    step = int(np.ceil(np.sqrt(ranges)))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies: dict[int, Tally] = {}
        for batch in batches:
            for r in batch.to_pylist():
                t = tallies.setdefault(r["block"], Tally())
                t.add(unpack(r["k"], delta=True), unpack(r["c"]).astype(np.int64))
                if t.n > HELD:
                    yield from t.flush(edges[r["block"] * step : (r["block"] + 1) * step], r["block"] * step)
        for b in sorted(tallies):
            yield from tallies[b].flush(edges[b * step : (b + 1) * step], b * step)

    coarse = make(edges[::step])
    return coarse.repartition(-(-ranges // step), "block").sortWithinPartitions("block").mapInArrow(split, Tally.schema)
