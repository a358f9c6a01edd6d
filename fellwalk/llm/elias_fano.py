"""Elias-Fano coding of sorted integers in numpy, with vectorised access and successor search.

Each value is split into low bits, packed one after the other, and a high part, written in unary: the
i-th value sets bit (high + i). Directories of the ones and of the zeros before every 64-bit word answer
select in a binary search and a few word operations. All arrays may be memory-mapped; queries touch what they need.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_ONES = _U(0x0101010101010101)


def _byte_table() -> np.ndarray:
    """Place of the k-th set bit (k from 0) of every byte."""
    out = np.zeros((256, 8), np.uint8)
    for b in range(256):
        at = [i for i in range(8) if b >> i & 1]
        out[b, : len(at)] = at
    return out


_IN_BYTE = _byte_table()


def select_in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th set bit (from 0) of each word, which must have that many."""
    c = word - ((word >> _U(1)) & _U(0x5555555555555555))
    c = (c & _U(0x3333333333333333)) + ((c >> _U(2)) & _U(0x3333333333333333))
    c = ((c + (c >> _U(4))) & _U(0x0F0F0F0F0F0F0F0F)) * _ONES  # byte j: ones in bytes 0..j
    upto = np.ascontiguousarray(c).view(np.uint8).reshape(-1, 8)
    byte = (upto <= k[:, None].astype(np.uint8)).sum(1)
    before = np.where(byte > 0, np.take_along_axis(upto, np.maximum(byte - 1, 0)[:, None], 1)[:, 0], 0)
    held = (word >> (byte.astype(_U) * _U(8))) & _U(255)
    return byte * 8 + _IN_BYTE[held.astype(np.int64), k.astype(np.int64) - before]


class EliasFano:
    def __init__(self, n: int, low_bits: int, high: np.ndarray, ones: np.ndarray, zeros: np.ndarray, low: np.ndarray):
        self.n, self.low_bits, self.high, self.ones, self.zeros, self.low = n, low_bits, high, ones, zeros, low

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        """values: non-negative, not falling."""
        v = np.asarray(values).astype(np.uint64)
        n = len(v)
        top = int(v[-1]) if n else 0
        low_bits = max(0, (top // max(1, n)).bit_length() - 1)
        place = (v >> _U(low_bits)) + np.arange(n, dtype=np.uint64)
        words = int((top >> low_bits) + n + 2) // 64 + 1
        high = np.zeros(words, np.uint64)
        if n:
            which = (place >> _U(6)).astype(np.int64)
            start = np.flatnonzero(np.concatenate(([True], which[1:] != which[:-1])))
            high[which[start]] = np.bitwise_or.reduceat(_U(1) << (place & _U(63)), start)
        ones = np.concatenate(([0], np.cumsum(np.bitwise_count(high), dtype=np.int64)))
        kind = np.uint32 if 64 * words < 1 << 32 else np.int64
        zeros = (64 * np.arange(words + 1) - ones).astype(kind)
        ones = ones.astype(kind)
        low = np.zeros((n * low_bits) // 64 + 2, np.uint64)
        if low_bits and n:
            bits = v & ((_U(1) << _U(low_bits)) - _U(1))
            at = np.arange(n, dtype=np.uint64) * _U(low_bits)
            word, shift = (at >> _U(6)).astype(np.int64), at & _U(63)
            start = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            low[word[start]] |= np.bitwise_or.reduceat(bits << shift, start)
            over = np.flatnonzero(shift + _U(low_bits) > _U(64))  # at most one for each word
            low[word[over] + 1] |= bits[over] >> (_U(64) - shift[over])
        return cls(n, low_bits, high, ones, zeros, low)

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * _U(self.low_bits)
        word, shift = (at >> _U(6)).astype(np.int64), at & _U(63)
        # the upper word is moved in two steps, as a shift by 64 is none
        out = self.low[word] >> shift | self.low[word + 1] << _U(1) << (_U(63) - shift)
        return out & ((_U(1) << _U(self.low_bits)) - _U(1))

    def select(self, i: np.ndarray) -> np.ndarray:
        """Place of the i-th set bit."""
        word = np.searchsorted(self.ones, i.astype(self.ones.dtype), "right") - 1
        return word * 64 + select_in_word(self.high[word], i - self.ones[word].astype(np.int64))

    def access(self, i: np.ndarray) -> np.ndarray:
        """The i-th values."""
        if not len(i):
            return np.zeros(0, np.int64)
        return ((self.select(i) - i).astype(np.uint64) << _U(self.low_bits) | self.lows(i)).astype(np.int64)

    def ones_from(self, place: np.ndarray) -> np.ndarray:
        """How many bits are set in a row from a place on, 64 for that many and more."""
        word, shift = place >> 6, (place & 63).astype(np.uint64)
        seen = self.high[word] >> shift | self.high[np.minimum(word + 1, len(self.high) - 1)] << _U(1) << (_U(63) - shift)
        return np.bitwise_count(seen & ~(seen + _U(1))).astype(np.int64)

    def below(self, h: np.ndarray) -> np.ndarray:
        """How many values have a high part below h: the ones before the h-th zero."""
        out = np.full(len(h), self.n, np.int64)
        out[h <= 0] = 0
        zeros = len(self.high) * 64 - self.n
        some = np.flatnonzero((h > 0) & (h <= zeros))
        if not len(some):
            return out
        k = h[some] - 1
        word = np.searchsorted(self.zeros, k.astype(self.zeros.dtype), "right") - 1
        place = word * 64 + select_in_word(~self.high[word], k - self.zeros[word].astype(np.int64))
        out[some] = place - k
        return out

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first value >= x, whether it equals x). Looked up in order, which touches memory in order."""
        order = np.argsort(x)
        at, found = self._successor(x[order])
        back = np.empty_like(order)
        back[order] = np.arange(len(x))
        return at[back], found[back]

    def _successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = (x.astype(np.uint64) >> _U(self.low_bits)).astype(np.int64)
        lo = self.below(h)
        # values with the same high part are a run of ones; only a run beyond 63 is looked up by its end
        inside = np.flatnonzero(lo < self.n)
        run = self.ones_from(lo[inside] + h[inside])
        end = lo.copy()
        end[inside] += run
        long = inside[run > 63]
        end[long] = self.below(h[long] + 1)
        hi, want = end.copy(), x.astype(np.uint64) & ((_U(1) << _U(self.low_bits)) - _U(1))
        active = np.flatnonzero(lo < hi)
        a, b, w = lo[active], hi[active], want[active]
        while len(active):
            mid = (a + b) >> 1
            less = self.lows(mid) < w
            a, b = np.where(less, mid + 1, a), np.where(less, b, mid)
            lo[active] = a
            more = np.flatnonzero(a < b)
            active, a, b, w = active[more], a[more], b[more], w[more]
        inside = lo < end
        return lo, inside & (self.lows(np.minimum(lo, max(0, self.n - 1))) == want)

    def arrays(self) -> dict[str, np.ndarray]:
        return {"shape": np.array([self.n, self.low_bits], np.int64), "high": self.high, "ones": self.ones, "zeros": self.zeros, "low": self.low}

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray], name: str) -> EliasFano:
        n, low_bits = arrays[f"{name}.shape"].tolist()
        return cls(n, low_bits, arrays[f"{name}.high"], arrays[f"{name}.ones"], arrays[f"{name}.zeros"], arrays[f"{name}.low"])
