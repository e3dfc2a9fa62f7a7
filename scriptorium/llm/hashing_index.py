"""Approximate nearest neighbours by multi-index hashing.

Codes: signs of a learned rotation (principal axes, then iterative quantisation) of the centred vector, one bit an
axis, fitted on a bounded sample of `sample` rows. A code is cut into substrings of eight bits; every block indexes
every row once for each substring. If two codes differ in at most r bits, then by the pigeonhole principle some
substring differs in few: with r = m * s + a, one of the first a + 1 substrings in at most s bits or another one in at
most s - 1. Probing those values in each substring's postings so finds every code within r. The codes found are
checked by their whole distance and their rows ranked by inner products of the original vectors.

The radius is measured on the sample: the distance that `cover` of the true neighbours keep. A block that holds fewer
than k rows within it widens the radius until k are found or all rows are in, so no query lacks neighbours. Vectors of
a length that the sample lacks are few; all of them are candidates.

Null and zero vectors and those with null or non-finite components take no part. Rows of the query's own id are no
candidates. Repeated ids, vectors of several lengths and empty tables: see `blocks`. Fewer rows than k give all. Ties
go to the smaller id. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.blocks import search, top, usable

POPCOUNT = np.bitwise_count(np.arange(256, dtype=np.uint8))
NEAR = POPCOUNT[np.arange(256)[:, None] ^ np.arange(256)[None, :]]


class Rotation:
    """Binary codes of eight bits a byte, learned from a sample."""

    def __init__(self, sample: np.ndarray, rounds: int = 40, seed: int = 7):
        self.scale = float(np.abs(sample).max()) or 1.0
        self.mean = (sample / self.scale).mean(axis=0)
        centred = sample / self.scale - self.mean
        axes = np.linalg.eigh(centred.T @ centred)[1][:, ::-1]
        projected = centred @ axes
        turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(axes.shape[1],) * 2))[0]
        for _ in range(rounds):
            left, _, right = np.linalg.svd(np.where(projected @ turn > 0, 1.0, -1.0).T @ projected)
            turn = (left @ right).T
        self.axes = axes @ turn
        self.bits = -(-self.axes.shape[1] // 8) * 8

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        return np.packbits((vectors / self.scale - self.mean) @ self.axes > 0, axis=1)


def neighbour_radius(rotation: Rotation, sample: np.ndarray, k: int, cover: float, queries: int = 400) -> int:
    """The Hamming distance within which `cover` of the sample's true k nearest neighbours lie."""
    sample = sample / rotation.scale
    asked = sample[: min(queries, len(sample))]
    scores = asked @ sample.T
    np.fill_diagonal(scores, -np.inf)
    n = min(k, len(sample) - 1)
    if n < 1:
        return rotation.bits
    nearest = np.argpartition(-scores, n - 1, axis=1)[:, :n]
    codes = rotation.codes(sample * rotation.scale)
    apart = np.bitwise_count(codes[: len(asked), None, :] ^ codes[nearest]).sum(axis=2)
    return int(np.quantile(apart, cover, method="higher"))


class SubstringIndex:
    """Postings of a block's codes by the value of each substring.

    Where the probes of a substring are more than DENSE of its 256 values, most postings would be read: the values of
    the substring are looked up in the table of probes instead, which finds the same rows.
    """

    DENSE = 24

    def __init__(self, codes: np.ndarray):
        self.columns = np.ascontiguousarray(codes.T)
        self.words = self.as_words(codes)
        self.order = [np.argsort(c, kind="stable").astype(np.int32) for c in self.columns]
        self.ends = [np.concatenate([[0], np.cumsum(np.bincount(c, minlength=256))]) for c in self.columns]

    @staticmethod
    def as_words(codes: np.ndarray) -> np.ndarray:
        """Codes in words of 64 bits."""
        padded = np.zeros((len(codes), -(-codes.shape[1] // 8) * 8), np.uint8)
        padded[:, : codes.shape[1]] = codes
        return padded.view(np.uint64)

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Places of all codes that differ in at most radius bits."""
        s, a = divmod(radius, len(code))
        hit = np.zeros(len(self.words), bool)
        for j, value in enumerate(code):
            near = NEAR[value] <= (s if j <= a else s - 1)
            probes = np.flatnonzero(near)
            if len(probes) > self.DENSE:
                hit |= near[self.columns[j]]
                continue
            for v in probes:
                hit[self.order[j][self.ends[j][v] : self.ends[j][v + 1]]] = True
        places = np.flatnonzero(hit)
        apart = np.bitwise_count(self.words[places] ^ self.as_words(code[None, :])).sum(axis=1)
        return places[apart <= radius]


class HashedBlock:
    """Vectors with the postings of their codes; without a rotation every vector is a candidate."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, rotation: Rotation | None, radius: int):
        self.ids, self.values, self.rotation, self.radius = ids, values, rotation, radius
        self.index = SubstringIndex(rotation.codes(values)) if rotation else None

    def near(self, query_id: int, query: np.ndarray, k: int) -> np.ndarray:
        if self.index is None:
            return np.flatnonzero(self.ids != query_id)
        code, reach = self.rotation.codes(query[None, :])[0], self.radius
        while True:
            places = self.index.within(code, reach)
            places = places[self.ids[places] != query_id]
            if len(places) >= k or reach >= self.rotation.bits:
                return places
            reach += 4

    def best(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        places = self.near(query_id, query, k)
        scores = self.values.take(places, axis=0) @ query
        first = top(self.ids[places], scores, k)
        return places[first], scores[first]


def nearest_neighbours(
    vectors: DataFrame, is_query: Column, k: int = 20, sample: int = 20_000, cover: float = 0.97,
    id_column: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """The k rows of largest inner product found for each query."""
    spark = vectors.sparkSession
    valid = vectors.filter(usable(F.col(vector)) & F.exists(vector, lambda x: x != 0))
    valid = valid.select(F.col(id_column).alias("_id"), F.transform(vector, lambda x: x.cast("double")).alias("_v"))
    fit = valid.orderBy(F.xxhash64("_id"), "_id", "_v").limit(sample).toPandas()
    learned = {}
    for _, own in fit["_v"].groupby(fit["_v"].map(len)) if len(fit) else ():
        known = np.stack(own.to_numpy()).astype(float)
        rotation = Rotation(known)
        learned[known.shape[1]] = rotation, neighbour_radius(rotation, known, k, cover)
    sent = spark.sparkContext.broadcast(learned)

    def build(ids: np.ndarray, values: np.ndarray) -> HashedBlock:
        return HashedBlock(ids, values, *sent.value.get(values.shape[1], (None, 0)))

    return search(valid, is_query, k, build, "double")
