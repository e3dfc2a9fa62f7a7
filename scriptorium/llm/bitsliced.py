"""Exact top-k inner products by a bit-sliced index.

Components are whole numbers. A block holds, for each attribute, bitmaps of the high bits of the component's distance
from the block's lowest (and from its highest, for negative weights). A query adds its attributes' slices, weighted by
the bits of its own components, with bitmap adders into the slices of a sum; the k-th largest sum is found from the
most significant slice downward. What the dropped low bits can add is bounded, so every row whose sum lies within that
bound of the k-th may belong to the answer: those boundary rows are scored exactly. The answer is exact.

Null vectors and vectors with null or non-finite components take no part. Rows of the query's own id are no candidates.
Repeated ids, vectors of several lengths and empty tables: see `blocks`. Fewer rows than k give all of them. Ties go to
the smaller id. Components and scores beyond 64 bits count as the nearest 64-bit number; where a score could pass
them, a block is scored in whole numbers of any size. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.blocks import search, top, usable


def _bitmaps(values: np.ndarray, bits: int) -> list[list[np.ndarray]]:
    """For each attribute its slices, least significant first, as words of 64 rows."""
    rows = -(-len(values) // 64) * 64
    padded = np.zeros((values.shape[1], rows), np.int64)
    padded[:, : len(values)] = values.T
    return [list(np.stack([np.packbits((a >> b) & 1, bitorder="little").view(np.uint64) for b in range(bits)])) for a in padded]


#: From this size of a component on, sums of slices could pass 64 bits.
LARGE = 1 << 31
LEAST, MOST = -(1 << 63), (1 << 63) - 1


class SliceIndex:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, keep_bits: int = 6):
        self.ids, self.order, self.vectors = ids, np.argsort(ids, kind="stable"), vectors
        self.widest = max(int(vectors.max()), -int(vectors.min()))
        if self.widest >= LARGE:
            return
        low, high = vectors.min(axis=0), vectors.max(axis=0)
        widest = int((high - low).max()).bit_length()
        self.shift, self.bits = max(0, widest - keep_bits), max(1, min(widest, keep_bits))
        self.rising = _bitmaps((vectors - low) >> self.shift, self.bits)
        self.falling = _bitmaps((high - vectors) >> self.shift, self.bits)
        all_rows = np.zeros(-(-len(vectors) // 64) * 64, np.uint8)
        all_rows[: len(vectors)] = 1
        self.all_rows = np.packbits(all_rows, bitorder="little").view(np.uint64)

    def summed(self, weights: np.ndarray) -> list[np.ndarray]:
        """Slices of the weighted sum, least significant first."""
        total: list[np.ndarray] = []
        sizes = np.abs(weights)
        for bit in range(int(sizes.max()).bit_length() - 1, -1, -1):
            if total:
                total.insert(0, np.zeros_like(self.all_rows))
            for d in np.flatnonzero((sizes >> bit) & 1):
                self._add(total, self.rising[d] if weights[d] > 0 else self.falling[d])
        return total

    @staticmethod
    def _add(total: list[np.ndarray], more: list[np.ndarray]) -> None:
        carry = None
        for i in range(max(len(total), len(more))):
            if i >= len(total):
                total.append(np.zeros_like(more[0]))
            a = total[i]
            if i < len(more):
                b = more[i]
                either = a ^ b
                if carry is None:
                    total[i], carry = either, a & b
                else:
                    total[i], carry = either ^ carry, (a & b) | (either & carry)
            else:
                total[i], carry = a ^ carry, a & carry
                if not carry.any():
                    return
        if carry is not None and carry.any():
            total.append(carry)

    @staticmethod
    def kth(total: list[np.ndarray], rows: np.ndarray, k: int) -> int:
        """The k-th largest sum among rows, from the most significant slice downward."""
        above, level, value = 0, rows, 0
        for i in range(len(total) - 1, -1, -1):
            ones = level & total[i]
            n = int(np.bitwise_count(ones).sum())
            value <<= 1
            if above + n >= k:
                level, value = ones, value | 1
            else:
                above, level = above + n, level & ~total[i]
        return value

    @staticmethod
    def at_least(total: list[np.ndarray], rows: np.ndarray, value: int) -> np.ndarray:
        greater, equal = np.zeros_like(rows), rows
        for i in range(len(total) - 1, -1, -1):
            if (value >> i) & 1:
                equal = equal & total[i]
            else:
                greater, equal = greater | (equal & total[i]), equal & ~total[i]
        return greater | equal

    def candidates(self, weights: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
        """Places of all rows that may be among the k best; own: places that take no part."""
        rows = self.all_rows
        if len(own):
            rows = rows.copy()
            np.bitwise_and.at(rows, own >> 6, ~(np.uint64(1) << (own & 63).astype(np.uint64)))
        total = self.summed(weights)
        if total and int(np.bitwise_count(rows).sum()) > k:
            slack = int(np.abs(weights).sum()) * ((1 << self.shift) - 1) >> self.shift
            rows = self.at_least(total, rows, max(0, self.kth(total, rows, k) - slack))
        return np.flatnonzero(np.unpackbits(rows.view(np.uint8), bitorder="little"))

    def best(self, query_id: int, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and exact scores of the k best rows of other ids."""
        first, last = (np.searchsorted(self.ids, query_id, side, sorter=self.order) for side in ("left", "right"))
        own = self.order[first:last]
        heaviest = max(int(weights.max()), -int(weights.min()))
        if self.widest >= LARGE or heaviest >= LARGE or self.widest * heaviest * len(weights) >= 1 << 62:
            places = np.setdiff1d(np.arange(len(self.ids)), own)
            exact = [sum(a * b for a, b in zip(row, weights.tolist(), strict=True)) for row in self.vectors[places].tolist()]
            ranked = sorted(range(len(places)), key=lambda i: (-exact[i], self.ids[places[i]]))[:k]
            return places[ranked], np.array([min(max(exact[i], LEAST), MOST) for i in ranked], np.int64)
        places = self.candidates(weights, own, k)
        scores = self.vectors[places] @ weights
        first = top(self.ids[places], scores, k)
        return places[first], scores[first]


def bit_sliced_top_k(
    vectors: DataFrame, is_query: Column, k: int, scale: int = 256, id_column: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """The k best rows for each query by the inner product of floor(scale * component)."""
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    usable_rows = vectors.filter(usable(F.col(vector)))
    return search(usable_rows.select(F.col(id_column).alias("_id"), whole.alias("_v")), is_query, k, SliceIndex, "long")
