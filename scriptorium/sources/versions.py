"""Tables whose schema has versions: old and new files in one scan, backfill, and checks of what is written.

A table is a folder `version=<n>/<batch>` for each batch, in the shape that it was written in. A reader brings each batch
to the newest version by the migrations after its own; `migrate` stores what readers compute. A batch that is there in
two versions is read in the higher one, so readers never see a row twice, and a migration that stops halfway loses nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators.ingest import markdown_hash


@dataclass(frozen=True)
class Migration:
    """What leads to a version from the one before it, and the condition that rows of that version meet."""

    name: str
    change: Callable[[DataFrame], DataFrame] = lambda df: df
    check: str = "true"


def _with_hash(papers: DataFrame) -> DataFrame:
    own = F.when(F.coalesce("markdown", F.lit("")) != "", markdown_hash(F.col("markdown"))).otherwise("")
    return papers.withColumn("markdown_hash", own)


#: Versions from 1 on; the first is the initial shape.
PAPERS = (Migration("initial"), Migration("markdown hash", _with_hash))
NODES = (
    Migration("initial", check="method is null or method in ('rule', 'structural')"),
    Migration("inherited roles", check="method is null or method in ('rule', 'structural', 'inherited')"),
    Migration("consensus of children", check="method is null or method in ('rule', 'structural', 'inherited', 'child_consensus')"),
    Migration(
        "source of headings",
        lambda nodes: nodes.withColumn("heading_source", F.lit(None).cast("string")),
        """(method is null or method in ('rule', 'structural', 'inherited', 'child_consensus'))
            and (heading_source is null or heading_source in ('detected', 'inferred'))""",
    ),
)


def _folder(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def batches(spark: SparkSession, path: str) -> dict[str, int]:
    """The batches of a table that were written to their end, each with the highest version that it is there in."""
    store, where = _folder(spark, f"{path}/version=*/*/_SUCCESS")
    found: dict[str, int] = {}
    for x in store.globStatus(where):
        batch = x.getPath().getParent()
        version = int(batch.getParent().getName().split("=")[1])
        found[batch.getName()] = max(version, found.get(batch.getName(), 0))
    return found


def checked(df: DataFrame, migrations: Sequence[Migration], version: int) -> DataFrame:
    """df, failing at the first row that breaks the version's check; a check that is null holds, as in SQL."""
    check = migrations[version - 1].check
    if check == "true":
        return df
    fault = F.raise_error(F.lit(f"version {version} ({migrations[version - 1].name}) refuses a row: not {check}"))
    return df.filter(F.when(F.coalesce(F.expr(check), F.lit(True)), True).otherwise(fault.cast("boolean")))


def write_version(df: DataFrame, path: str, migrations: Sequence[Migration], version: int, batch: str | None = None) -> str:
    """Append rows in the shape of a version; the batch's name. Rows that break its check fail the write as a whole.

    What a write that fails leaves is deleted; nobody has read it.
    """
    if not 1 <= version <= len(migrations):
        raise ValueError(f"no version {version}: there are {len(migrations)}")
    batch = batch or uuid.uuid4().hex
    target = f"{path}/version={version}/{batch}"
    try:
        checked(df, migrations, version).write.mode("overwrite").parquet(target)
    except BaseException:
        store, where = _folder(df.sparkSession, target)
        store.delete(where, True)
        raise
    return batch


def brought_up(df: DataFrame, migrations: Sequence[Migration], version: int, to: int | None = None) -> DataFrame:
    """Rows of a version in the shape of a later one, the newest unless told."""
    return reduce(lambda rows, m: m.change(rows), migrations[version : to or len(migrations)], df)


def read_versions(spark: SparkSession, path: str, migrations: Sequence[Migration]) -> DataFrame:
    """All rows of a table in its newest shape, one scan for each version that is there. An empty table is an error."""
    by_version: dict[int, list[str]] = {}
    for batch, version in sorted(batches(spark, path).items()):
        by_version.setdefault(version, []).append(f"{path}/version={version}/{batch}")
    if not by_version:
        raise LookupError(f"no batches in {path}")
    if newest := [v for v in by_version if v > len(migrations)]:
        raise ValueError(f"{path} holds version {max(newest)}, but only {len(migrations)} are known")
    rows = [brought_up(spark.read.parquet(*paths), migrations, version) for version, paths in sorted(by_version.items())]
    return reduce(DataFrame.unionByName, rows)


def migrate(spark: SparkSession, path: str, migrations: Sequence[Migration]) -> int:
    """Store every old batch in the newest shape, then delete its old files; the number of batches. It may be run again."""
    last, moved = len(migrations), 0
    for batch, version in sorted(batches(spark, path).items()):
        if version < last:
            rows = brought_up(spark.read.parquet(f"{path}/version={version}/{batch}"), migrations, version)
            write_version(rows, path, migrations, last, batch)
            moved += 1
        for old in range(1, last):
            store, where = _folder(spark, f"{path}/version={old}/{batch}")
            store.delete(where, True)
    return moved
