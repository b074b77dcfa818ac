"""Elias-Fano sequences as flat bytes: memory-mapped, and searched for many values at once."""

from __future__ import annotations

import numpy as np

_U = np.uint64
BLOCK = 512
#: Sequences of up to so many entries for each value that is asked for are unpacked as a whole; longer ones are searched by buckets.
DENSE = 32


class EliasFano:
    """A sequence of unsigned 64-bit values that never fall.

    Layout, in 8-byte words: n, base, low width, buckets, words of highs, blocks, words of lows;
    then the unary high bits, the zeros before each block of 512 of them, and the packed low bits.
    """

    def __init__(self, buffer: np.ndarray):
        words = buffer.view("<u8")
        self.n, self.base, self.width, self.buckets, highs, blocks, lows = (int(x) for x in words[:7])
        self.highs = words[7 : 7 + highs]
        self.zeros = words[7 + highs : 7 + highs + blocks]
        start = 8 * (7 + highs + blocks)
        self.nbytes = start + 8 * lows
        packed = buffer[start : self.nbytes]
        # Eight bytes from any byte on; the last word is padding.
        self.windows = np.ndarray(max(0, len(packed) - 7), "<u8", packed, 0, (1,)) if len(packed) >= 8 else np.zeros(1, "<u8")

    @staticmethod
    def encode(values: np.ndarray) -> bytes:
        n = len(values)
        base = values[0] if n else _U(0)
        v = values - base
        top = int(v[-1]) if n else 0
        width = min(56, max(0, ((top + 1) // max(1, n)).bit_length() - 1))
        high = (v >> _U(width)).astype(np.int64)
        buckets = int(high[-1]) + 1 if n else 1
        bits = np.zeros(-(-(n + buckets) // BLOCK) * BLOCK, np.uint8)
        bits[high + np.arange(n)] = 1
        zeros = BLOCK - bits.reshape(-1, BLOCK).sum(1, dtype=np.int64)
        ahead = np.concatenate(([0], np.cumsum(zeros)[:-1])).astype("<u8")
        highs = np.packbits(bits, bitorder="little").view("<u8")
        parts = []
        for at in range(0, n, 1 << 18):  # a multiple of 8 values, so parts end on a byte
            low = (v[at : at + (1 << 18)] & _U((1 << width) - 1)).astype("<u8")
            parts.append(np.packbits(np.unpackbits(low.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :width], bitorder="little").tobytes())
        lows = b"".join(parts)
        lows += bytes(8 + -len(lows) % 8)
        head = np.array([n, int(base), width, buckets, len(highs), len(ahead), len(lows) // 8], "<u8")
        return b"".join((head.tobytes(), highs.tobytes(), ahead.tobytes(), lows))

    def _select0(self, k: np.ndarray) -> np.ndarray:
        """Place of the kth zero, from 0."""
        block = np.searchsorted(self.zeros, k.astype(_U), side="right") - 1
        left = k - self.zeros[block].astype(np.int64)
        word = block * (BLOCK // 64)
        open_ = np.ones(len(k), bool)
        for _ in range(BLOCK // 64 - 1):
            here = 64 - np.bitwise_count(self.highs[word]).astype(np.int64)
            open_ &= left >= here
            if not open_.any():
                break
            left = np.where(open_, left - here, left)
            word = np.where(open_, word + 1, word)
        value = ~self.highs[word]
        at = np.zeros(len(k), np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            here = np.bitwise_count((value >> at.astype(_U)) & _U((1 << width) - 1)).astype(np.int64)
            beyond = left >= here
            left = np.where(beyond, left - here, left)
            at = np.where(beyond, at + width, at)
        return word * 64 + at

    def _select1(self, k: np.ndarray) -> np.ndarray:
        """Place of the kth one, from 0."""
        ahead = np.arange(len(self.zeros)) * BLOCK - self.zeros.astype(np.int64)
        block = np.searchsorted(ahead, k, side="right") - 1
        left = k - ahead[block]
        word = block * (BLOCK // 64)
        for _ in range(BLOCK // 64 - 1):
            here = np.bitwise_count(self.highs[word]).astype(np.int64)
            beyond = left >= here
            if not beyond.any():
                break
            left = np.where(beyond, left - here, left)
            word = np.where(beyond, word + 1, word)
        value = self.highs[word]
        at = np.zeros(len(k), np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            here = np.bitwise_count((value >> at.astype(_U)) & _U((1 << width) - 1)).astype(np.int64)
            beyond = left >= here
            left = np.where(beyond, left - here, left)
            at = np.where(beyond, at + width, at)
        return word * 64 + at

    def get(self, i: np.ndarray) -> np.ndarray:
        """The entries at places ``i``."""
        if len(i) * DENSE >= self.n:
            return self.all()[i]
        return (((self._select1(i) - i).astype(_U) << _U(self.width)) | self._low(i)) + _U(self.base)

    def all(self) -> np.ndarray:
        """Every entry."""
        ones = np.flatnonzero(np.unpackbits(self.highs.view(np.uint8), bitorder="little"))[: self.n]
        i = np.arange(self.n)
        return (((ones - i).astype(_U) << _U(self.width)) | self._low(i)) + _U(self.base)

    def _low(self, i: np.ndarray) -> np.ndarray:
        bit = i * self.width
        return (self.windows[bit >> 3] >> (bit & 7).astype(_U)) & _U((1 << self.width) - 1)

    def sparse(self, asked: int) -> bool:
        """Whether so few values are searched by buckets."""
        return asked * DENSE < self.n

    def find(self, values: np.ndarray, within: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """Index of each value, -1 if it is not there: the successor within its bucket of high bits, and between places where these are given."""
        out = np.full(len(values), -1, np.int64)
        if not self.n:
            return out
        if not self.sparse(len(values)):
            entries = self.all()
            at = np.minimum(np.searchsorted(entries, values), self.n - 1)
            return np.where(entries[at] == values, at, out)
        x = values - _U(self.base)
        high = x >> _U(self.width)
        live = np.flatnonzero((values >= _U(self.base)) & (high < _U(self.buckets)))
        if not len(live):
            return out
        h, low = high[live].astype(np.int64), x[live] & _U((1 << self.width) - 1)
        hi = self._select0(h) - h
        lo = np.zeros(len(live), np.int64)
        later = np.flatnonzero(h)
        lo[later] = self._select0(h[later] - 1) - (h[later] - 1)
        if within is not None:
            lo, hi = np.maximum(lo, within[0][live]), np.minimum(hi, within[1][live])
        end = hi.copy()
        todo = np.flatnonzero(lo < hi)
        while len(todo):
            mid = (lo[todo] + hi[todo]) >> 1
            less = self._low(mid) < low[todo]
            lo[todo[less]] = mid[less] + 1
            hi[todo[~less]] = mid[~less]
            todo = todo[lo[todo] < hi[todo]]
        there = np.flatnonzero(lo < end)
        there = there[self._low(lo[there]) == low[there]]
        out[live[there]] = lo[there]
        return out
