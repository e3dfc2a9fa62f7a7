"""A layout of papers that lookups skip through: files in ranges of the hash, with Bloom filters of hash and id.

A lookup by hash opens the one file whose range holds it; within and beyond, Bloom filters rule row groups out, for ids
as well, which lie anywhere. Hashes are even, so ranges are.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Beyond this many values a list is one `isin`, of which the scan tests only the range.
EACH_ASKED = 200


def write_by_hash(papers: DataFrame, path: str, distinct: int = 1_000_000, files: int | None = None, **options) -> None:
    """Write papers (hash, paper_id and more) in ranges of the hash; distinct: papers expected in a row group.

    With more papers than distinct in a row group its Bloom filters let more in than their hundredth; results stay right.
    Rows of one hash, or of none, are spread by their id. files: how many ranges; the session decides unless told.
    """
    ranges = [files] if files else []
    writer = papers.repartitionByRange(*ranges, "hash", "paper_id").sortWithinPartitions("hash", "paper_id").write.options(**options)
    for column in ("hash", "paper_id"):
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true").option(f"parquet.bloom.filter.expected.ndv#{column}", str(distinct))
    writer.parquet(path)


def one_of(column: str, values: Sequence) -> Column:
    """Equality with any of values, in a form that the scan can test value by value."""
    if not values:
        return F.lit(False)
    if len(values) > EACH_ASKED:
        return F.col(column).isin(list(values))
    return reduce(or_, (F.col(column) == F.lit(v) for v in values))


def find_hashes(spark: SparkSession, path: str, hashes: Sequence[str]) -> DataFrame:
    """The papers of a list of hashes; an empty hash is no paper's."""
    return spark.read.parquet(path).filter(one_of("hash", sorted({h for h in hashes if h})))


def find_ids(spark: SparkSession, path: str, ids: Sequence) -> DataFrame:
    """The papers of a list of ids."""
    return spark.read.parquet(path).filter(one_of("paper_id", sorted({i for i in ids if i is not None})))
