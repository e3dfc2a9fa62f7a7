"""A stated query set against all rows, in blocks.

Candidates are indexed once: blocks of at most `rows` vectors of one length are built where they are read and written
to the shared folder, a row for each block. Queries go to the blocks in chunks of at most `chunk` vectors, the only
thing that is broadcast. Every block answers every query of a chunk with its own best k, and the best k of those are
the answer.

An id asks once: repeated query rows are one query, and of an id's different vectors the smallest, component by
component, asks. Candidate rows stand for themselves: equal rows are as many neighbours. Vectors meet vectors of their
own length only; rows without an id take no part. An empty table, or one without queries, gives no rows.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scriptorium.session import map_batches, materialise


class Index(Protocol):
    """A block of vectors, ready to be asked."""

    ids: np.ndarray

    def best(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the block's k best rows whose id is not the query's."""


#: From the ids and vectors of a block to its index.
Build = Callable[[np.ndarray, np.ndarray], Index]


def usable(vector: Column) -> Column:
    """Neither null nor holding null or non-finite components."""
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def rows_of(vectors: pa.Array, kind: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: the places of the vectors of that length, and the vectors as a matrix."""
    ends = vectors.offsets.to_numpy()
    sizes, flat = np.diff(ends), vectors.values.to_numpy(zero_copy_only=False)
    out = {}
    for n in np.unique(sizes).tolist():
        places = np.flatnonzero(sizes == n)
        out[n] = places, flat[ends[places][:, None] + np.arange(n)].astype(kind)
    return out


def index_blocks(vectors: DataFrame, build: Build, kind: str, rows: int) -> DataFrame:
    """A row for each block: its vectors' length and its index."""

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, values, held = defaultdict(list), defaultdict(list), defaultdict(int)

        def block(n: int) -> pa.RecordBatch:
            index = build(np.concatenate(ids.pop(n)), np.concatenate(values.pop(n)))
            del held[n]
            return pa.RecordBatch.from_arrays(
                [pa.array([n], pa.int32()), pa.array([pickle.dumps(index, protocol=5)], pa.binary())],
                names=["length", "block"],
            )

        for batch in batches:
            for at in range(0, len(batch), rows):
                part = batch.slice(at, rows)
                own = part.column("_id").to_numpy()
                for n, (places, matrix) in rows_of(part.column("_v"), kind).items():
                    if held[n] and held[n] + len(places) > rows:
                        yield block(n)
                    ids[n].append(own[places])
                    values[n].append(matrix)
                    held[n] += len(places)
        for n in list(held):
            if held[n]:
                yield block(n)

    return materialise(map_batches(vectors.select("_id", "_v"), built, "length int, block binary"), "blocks")


def search(vectors: DataFrame, is_query: Column, k: int, build: Build, score_type: str, chunk: int = 4096, rows: int = 16_384) -> DataFrame:
    """vectors: columns _id (long) and _v (array of doubles or longs). Returns query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    kind, score = ("int64", pa.int64()) if score_type == "long" else ("float64", pa.float64())
    vectors = vectors.filter(F.col("_id").isNotNull())
    asked = materialise(vectors.filter(is_query).groupBy("_id").agg(F.min("_v").alias("_v")), "queries")
    blocks = index_blocks(vectors, build, kind, rows)
    n = asked.count()
    chunks = 1 if n <= chunk else -(-n // chunk) * 2
    found = []
    for c in range(chunks):
        own = asked.filter(F.pmod(F.xxhash64("_id"), F.lit(chunks)) == c).toPandas()
        by_length = defaultdict(list)
        for i, v in zip(own["_id"].tolist(), own["_v"], strict=True):
            by_length[len(v)].append((i, np.asarray(v, kind)))
        sent = spark.sparkContext.broadcast(dict(by_length))

        def answered(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for length, packed in zip(batch.column("length").to_pylist(), batch.column("block"), strict=True):
                    if length not in sent.value:
                        continue
                    index = pickle.loads(packed.as_py())
                    out = []
                    for q, query in sent.value[length]:
                        places, scores = index.best(q, query, k)
                        out.append((np.full(len(places), q), index.ids[places], scores))
                    columns = [np.concatenate(x) for x in zip(*out, strict=True)]
                    kinds = (pa.int64(), pa.int64(), score)
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=["query_id", "vec_id", "score"])

        part = map_batches(blocks, answered, f"query_id long, vec_id long, score {score_type}")
        found.append(part if chunks == 1 else materialise(best(part, k), "answers"))
    return best(reduce(DataFrame.union, (f.select("query_id", "vec_id", "score") for f in found)), k)


def best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def top(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]
