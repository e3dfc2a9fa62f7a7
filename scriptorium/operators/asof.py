"""As-of join of two tables: each row meets the last row of the other table at or before its own place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scriptorium.session import materialise


def asof_join(left: DataFrame, right: DataFrame, key: str, place: tuple[str, str], carried: Sequence[str], tie: str | None = None) -> DataFrame:
    """Each row of left with the columns `carried` of the last row of right of its key whose place is at most its own.

    place names the column of left and that of right; of rows of right at one place the greatest by tie counts. Where
    there is none, or key or place is null, carried is null. Names of carried must not be left's.

    Both tables are ranged together by key and place, so a hot key lies over as many partitions as it has rows for, and a
    hot place too (rows of left at one place are told apart by a number of their own). Within a partition the last row of
    right is carried on; over its border goes one row at most, for only its first key can have begun before it. These
    border rows, no more than partitions, are what is broadcast. The ranged rows are written once, so that partitions
    are the same for both passes and for a task that runs again; `session.clean_up` deletes them.
    """
    if clash := sorted(set(carried) & set(left.columns)):
        raise ValueError(f"columns of both sides: {', '.join(clash)}")
    found = F.struct(*carried)
    ranged = F.col(tie) if tie else F.lit(0)
    rows = right.filter(F.col(key).isNotNull() & F.col(place[1]).isNotNull())
    rows = rows.select(F.col(key).alias("_key"), F.col(place[1]).alias("_place"), F.lit(0).alias("_side"), ranged.alias("_tie"), F.lit(0).cast("long").alias("_own"), found.alias("_found"))
    asking = left.select(
        F.col(key).alias("_key"),
        F.col(place[0]).alias("_place"),
        F.lit(1).alias("_side"),
        F.monotonically_increasing_id().alias("_own"),
        F.struct(*left.columns).alias("_row"),
    )
    order = ["_place", "_side", "_tie", "_own"]
    both = rows.unionByName(asking, allowMissingColumns=True).repartitionByRange("_key", *order)
    both = materialise(both.withColumn("_part", F.spark_partition_id()), "ranged")

    here = Window.partitionBy("_part", "_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = both.withColumn("_last", F.last("_found", ignorenulls=True).over(here)).filter("_side = 1")

    of_right = F.when(F.col("_side") == 0, F.struct("_place", "_tie"))
    ends = both.groupBy("_part", "_key").agg(F.max_by("_found", of_right).alias("_end"))
    earlier = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    borders = ends.select("_part", "_key", F.last("_end", ignorenulls=True).over(earlier).alias("_before")).filter("_before is not null")

    met = within.join(F.broadcast(borders), ["_part", "_key"], "left").withColumn("_met", F.coalesce("_last", "_before"))
    return met.select("_row.*", *(F.col(f"_met.{c}").alias(c) for c in carried))


def sections_at(offsets: DataFrame, nodes: DataFrame) -> DataFrame:
    """offsets (paper_id, position in bytes, and more) with ordinal and section of the node that each stands in.

    nodes: paper_id, ordinal, start_offset, heading_raw. Before a paper's first node the ordinal is null and the section a dash.
    """
    sections = nodes.select("paper_id", "ordinal", "start_offset", F.col("heading_raw").alias("section"))
    found = asof_join(offsets, sections, "paper_id", ("position", "start_offset"), ["ordinal", "section"], "ordinal")
    return found.withColumn("section", F.coalesce("section", F.lit("—")))
