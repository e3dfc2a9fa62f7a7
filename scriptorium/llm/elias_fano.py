"""Elias-Fano sequences of whole numbers that don't fall, in arrays that can be memory-mapped; all questions are vectorised.

A number's low bits stand in a packed array, its high bits in unary: number i sets bit (high + i) of a bit vector. A
directory has the ones before each 64-bit word of it.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

#: Place of the r-th one of a byte.
_PLACES = np.full((256, 8), 8, np.uint8)
for _b in range(256):
    _ones = [i for i in range(8) if _b >> i & 1]
    _PLACES[_b, : len(_ones)] = _ones
_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)


class EliasFano:
    """n numbers below universe, over the arrays low, high and before."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, before: np.ndarray):
        self.n, self.bits, self.low, self.high, self.before = n, bits, low, high, before

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        n, top = len(values), int(values[-1]) + 1 if len(values) else 1
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        low = np.zeros((n * bits + 7) // 8 + 8, np.uint8)
        if bits:
            columns = np.unpackbits((values & ((1 << bits) - 1)).astype("<u8").view(np.uint8).reshape(n, 8), axis=1, count=bits, bitorder="little")
            packed = np.packbits(columns.ravel(), bitorder="little")
            low[: len(packed)] = packed
        places = (values >> bits) + np.arange(n)
        words = (int(places[-1]) if n else 0) // 64 + 2
        high = np.zeros(words * 64, bool)
        high[places] = True
        high = np.packbits(high, bitorder="little")
        before = np.r_[0, np.cumsum(_ONES[high].reshape(words, 8).sum(1, dtype=np.int64))]
        return cls(n, bits, low, high, before)

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.bits], np.int64), self.low, self.high, self.before]

    @classmethod
    def of(cls, arrays: list[np.ndarray]) -> EliasFano:
        return cls(int(arrays[0][0]), int(arrays[0][1]), *arrays[1:])

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """The place of the k-th one, or zero, of the high bits."""
        below = self.before if ones else np.arange(len(self.before)) * 64 - self.before
        word = np.searchsorted(below, k, "right") - 1
        rest = k - below[word]
        data = self.high.reshape(-1, 8)[word]
        if not ones:
            data = ~data
        upto = np.cumsum(_ONES[data], axis=1, dtype=np.int64)
        byte = (upto <= rest[:, None]).sum(1)
        rest = rest - np.where(byte > 0, np.take_along_axis(upto, np.maximum(byte - 1, 0)[:, None], 1)[:, 0], 0)
        return word * 64 + byte * 8 + _PLACES[data[np.arange(len(k)), byte], rest]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.int64)
        at = i * self.bits
        words = np.ndarray(len(self.low) - 7, "<u8", self.low, strides=(1,))[at >> 3]
        low = words >> (at & 7).astype(np.uint64)
        if self.bits > 56:
            more = self.low[(at >> 3) + 8].astype(np.uint64)
            low |= np.where((at & 7) > 0, more << (64 - (at & 7)).astype(np.uint64), 0).astype(np.uint64)
        return (low & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The numbers at the places i."""
        return (self._select(i, True) - i) << self.bits | self._low(i)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of the first number that isn't smaller than x (n: none), and whether it equals x."""
        high, zeros = x >> self.bits, len(self.high) * 8 - self.n
        beyond = high >= zeros - 1
        high = np.where(beyond, 0, high)
        start = np.where(high > 0, self._select(np.maximum(high - 1, 0), False) + 1 - high, 0)
        stop = self._select(high, False) - high
        wanted = x & ((1 << self.bits) - 1)
        low, up = start.copy(), stop.copy()
        open_ = np.flatnonzero(low < up)
        while len(open_):
            mid = (low[open_] + up[open_]) >> 1
            less = self._low(mid) < wanted[open_]
            low[open_] = np.where(less, mid + 1, low[open_])
            up[open_] = np.where(less, up[open_], mid)
            open_ = open_[low[open_] < up[open_]]
        inside = low < stop
        same = np.zeros(len(x), bool)
        at = np.flatnonzero(inside & ~beyond)
        same[at] = self._low(low[at]) == wanted[at]
        return np.where(beyond, self.n, low), same


class MappedArrays:
    """Arrays in one temporary file of this task, memory-mapped and gone with the block."""

    def __init__(self, arrays: list[np.ndarray]):
        self.arrays = arrays

    def __enter__(self) -> list[np.ndarray]:
        handle, self.path = tempfile.mkstemp(suffix=".trie")
        places, at = [], 0
        with os.fdopen(handle, "wb") as f:
            for a in self.arrays:
                f.write(bytes(-at % 64))
                at += -at % 64
                places.append((at, a.dtype, len(a)))
                f.write(a.tobytes())
                at += a.nbytes
            f.write(bytes(8))
        self.arrays = []
        whole = np.memmap(self.path, np.uint8, "r")
        return [np.ndarray(n, kind, whole, offset) for offset, kind, n in places]

    def __exit__(self, *_) -> None:
        os.unlink(self.path)
