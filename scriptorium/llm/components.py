"""Connected components of a large edge table, by rounds of joins; labels are the smallest vertex of a component."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from scriptorium.session import discard, materialise


def least_by(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The smallest value of each key, as key and m.

    The key's hash beside it in the grouping keeps the result from being dealt by the key alone: a join with it then
    has an exchange of its own on both sides, whose large partitions adaptive execution can split.
    """
    return rows.groupBy(key, F.xxhash64(key).alias("_hash")).agg(F.min(value).alias("m")).drop("_hash")


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long). Returns vertex, component for every vertex that has an edge to another one.

    Alternates large-star and small-star steps until nothing changes; each round is written to the shared folder. A
    star step links a vertex's neighbours to its smallest neighbour, so paths halve from round to round. A hub's edges
    are summed by partial aggregation, and joined to their minimum in partitions that can be split.
    """
    ends = (F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = materialise(edges.filter("a <> b").select(*ends).distinct(), "edges")
    before = None
    while True:
        # large star: for each vertex, its larger neighbours go to the smallest of its neighbours and itself
        both = now.union(now.select("b", "a")).toDF("u", "v")
        least = least_by(both, "u", "v").select("u", F.least("m", "u").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        small = large.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
        # small star: for each vertex, its smaller neighbours and itself go to the smallest of them
        lowest = least_by(small, "u", "v")
        linked = small.join(lowest, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        linked = linked.union(lowest.select(F.col("u").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct()
        seen = Observation()
        total = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        old, now = now, materialise(linked.observe(seen, F.count(F.lit(1)).alias("n"), total.alias("total")), "edges")
        discard(old)
        state = (seen.get["n"], seen.get["total"])
        if state == before:
            break
        before = state
    roots = now.select(F.col("b").alias("vertex"), F.col("b").alias("component")).distinct()
    return now.groupBy(F.col("a").alias("vertex")).agg(F.min("b").alias("component")).union(roots)
