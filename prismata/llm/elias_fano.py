"""Elias-Fano coding of monotone sequences in flat arrays that can be memory-mapped.

The low bits of the values lie packed side by side; the high bits are unary, one set bit a value and
one clear bit a step. Every 512 bits a count of set bits is kept, and within them one before each word,
which select and successor search use.
"""

from __future__ import annotations

import numpy as np

_SELECT = np.zeros((256, 8), np.uint8)
for _b in range(256):
    _SELECT[_b, : _b.bit_count()] = [k for k in range(8) if _b >> k & 1]
_U = np.uint64
_EACH, _HIGH = _U(0x0101010101010101), _U(0x8080808080808080)
_LANES, _TOPS = _U(0x0001000100010001), _U(0x8000800080008000)
_FULL = (_U(0x00C0008000400000), _U(0x01C0018001400100))  # bits before each of eight words


class EliasFano:
    """n ascending values below 2**63: random access and membership of many values at once."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray, sub: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.ones, self.sub = n, low_bits, low, high, ones, sub

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        values = values.astype(_U)
        top = int(values[-1]) + 1 if n else 1
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        high = (values >> _U(bits)).astype(np.int64)
        length = -(-(n + (int(high[-1]) if n else 0) + 2) // 512) * 512
        marks = np.zeros(length, np.uint8)
        marks[high + np.arange(n)] = 1
        words = np.packbits(marks, bitorder="little").view(_U)
        counts = np.bitwise_count(words).reshape(-1, 8).astype(np.uint16)
        upto = np.cumsum(counts, axis=1, dtype=np.uint16)
        ones = np.concatenate([[0], np.cumsum(upto[:, -1], dtype=np.int64)]).astype(np.int64)
        return cls(n, bits, cls._pack(values & _U((1 << bits) - 1), bits), words, ones, np.ascontiguousarray(upto - counts).view(_U).ravel())

    @staticmethod
    def _pack(v: np.ndarray, bits: int) -> np.ndarray:
        words = np.zeros(len(v) * bits // 64 + 2, _U)
        if bits and len(v):
            at = np.arange(len(v), dtype=np.int64) * bits
            word, off = at >> 6, (at & 63).astype(_U)
            first = np.flatnonzero(np.diff(word, prepend=-1))
            words[word[first]] |= np.bitwise_or.reduceat(v << off, first)
            over = np.flatnonzero(off.astype(np.int64) + bits > 64)
            words[word[over] + 1] |= v[over] >> (_U(64) - off[over])  # a word has one value that runs over its end
        return words

    def lows(self, k: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(k), _U)
        at = k * self.low_bits
        word, off = at >> 6, (at & 63).astype(_U)
        v = self.low[word] >> off
        over = off > 0
        v = np.where(over, v | (self.low[word + 1] << ((_U(64) - off) & _U(63))), v)
        return v & _U((1 << self.low_bits) - 1)

    def _select(self, k: np.ndarray, zeros: bool) -> np.ndarray:
        """The place of the k-th (from 0) set or clear bit."""
        before = np.arange(len(self.ones)) * 512 - self.ones if zeros else self.ones
        block = np.searchsorted(before, k, "right") - 1
        rest = k - before[block]
        # how many of the eight words begin at or before the bit: their counts lie side by side in two numbers
        lanes = [self.sub[block * 2 + j] for j in (0, 1)]
        if zeros:
            lanes = [full - x for full, x in zip(_FULL, lanes, strict=True)]
        asked = rest.astype(_U) * _LANES | _TOPS
        which = sum(np.bitwise_count((asked - x) & _TOPS) for x in lanes).astype(np.int64) - 1
        begun = np.where(which < 4, lanes[0], lanes[1]) >> ((which & 3) << 4).astype(_U) & _U(0xFFFF)
        rest = rest.astype(_U) - begun
        w = self.high[block * 8 + which]
        if zeros:
            w = ~w
        # counts of the bytes side by side in a word, summed up by a product
        c = w - ((w >> _U(1)) & _U(0x5555555555555555))
        c = (c & _U(0x3333333333333333)) + ((c >> _U(2)) & _U(0x3333333333333333))
        c = ((c + (c >> _U(4))) & _U(0x0F0F0F0F0F0F0F0F)) * _EACH
        shift = np.bitwise_count(((rest * _EACH | _HIGH) - c) & _HIGH).astype(_U) << _U(3)  # of the bytes before the one asked for
        rest = rest - (((c << _U(8)) >> shift) & _U(255))
        return block * 512 + which * 64 + shift.astype(np.int64) + _SELECT[((w >> shift) & _U(255)).astype(np.int64), rest.astype(np.int64)]

    def access(self, k: np.ndarray) -> np.ndarray:
        """The k-th values, as int64."""
        return self._values(k, self._select(k, False))

    def _values(self, k: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (((at - k).astype(_U) << _U(self.low_bits)) | self.lows(k)).astype(np.int64)

    def access_both(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k-th values and the ones after them, whose set bit is the next."""
        at = self._select(k, False)
        word, later = at >> 6, at + 1
        w = np.where(later & 63, self.high[word] >> (later & 63).astype(_U) << (later & 63).astype(_U), _U(0))
        dry = np.flatnonzero(w == 0)
        while len(dry):  # on to the next word
            word[dry] += 1
            w[dry] = self.high[word[dry]]
            dry = dry[w[dry] == 0]
        after = word * 64 + np.bitwise_count((w & (~w + _U(1))) - _U(1))
        return self._values(k, at), self._values(k + 1, after)

    def _run_before(self, at: np.ndarray) -> np.ndarray:
        """How many set bits stand together right before each place."""
        word, p = at >> 6, at & 63
        w = np.where(p > 0, ~self.high[word] << ((64 - p) & 63).astype(_U), _U(0))  # the first clear bit below is now the highest set one
        out, run = np.zeros(len(at), np.int64), p.copy()
        dry = np.flatnonzero(w == 0)
        while len(dry):  # set bits down to the word's beginning
            out[dry] += run[dry]
            dry = dry[word[dry] > 0]
            word[dry] -= 1
            w[dry], run[dry] = ~self.high[word[dry]], 64
            dry = dry[w[dry] == 0]
        some = np.flatnonzero(w)
        v = w[some]
        for k in (1, 2, 4, 8, 16, 32):
            v |= v >> _U(k)
        out[some] += 64 - np.bitwise_count(v).astype(np.int64)
        return out

    def find(self, x: np.ndarray) -> np.ndarray:
        """The index of each x among the values, or -1: a successor search in the run of values that share its high bits."""
        found = np.full(len(x), -1, np.int64)
        if not self.n:
            return found
        h = (x.astype(_U) >> _U(self.low_bits)).astype(np.int64)
        most = len(self.high) * 64 - self.n
        ask = np.flatnonzero((h >= 0) & (h < most))
        h = h[ask]
        at = self._select(h, True)  # the clear bit that ends the run of a value's high bits
        end = at - h
        start = end - self._run_before(at)
        low = x[ask].astype(_U) & _U((1 << self.low_bits) - 1)
        stop = end.copy()
        live = np.flatnonzero(stop - start > 1)  # halve the run of equal high bits: a frequent context's run is long
        while len(live):
            mid = (start[live] + stop[live]) >> 1
            upto = self.lows(mid) <= low[live]
            start[live] = np.where(upto, mid, start[live])
            stop[live] = np.where(upto, stop[live], mid)
            live = live[stop[live] - start[live] > 1]
        inside = np.flatnonzero(start < end)
        hit = inside[self.lows(start[inside]) == low[inside]]
        found[ask[hit]] = start[hit]
        return found

    def arrays(self) -> dict[str, np.ndarray]:
        return {"head": np.array([self.n, self.low_bits], np.int64), "low": self.low, "high": self.high, "ones": self.ones, "sub": self.sub}

    @classmethod
    def of(cls, a: dict[str, np.ndarray], name: str) -> EliasFano:
        n, bits = (int(v) for v in a[f"{name}.head"])
        return cls(n, bits, a[f"{name}.low"], a[f"{name}.high"], a[f"{name}.ones"], a[f"{name}.sub"])
