"""Tables bucketed by paper: joins on the paper read them as they lie, so no text crosses an exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_bucketed(df: DataFrame, table: str, path: str, buckets: int, key: str = "paper_id") -> DataFrame:
    """Write df as a new table of the catalogue in a folder, in buckets of the key, and return the table.

    Each bucket is one file, for its rows meet in one task first; take so many that a bucket of papers fits a task, the
    same number for all tables that meet, and no fewer than the session's shuffle partitions: a side that lies in fewer
    is shuffled like any other. Null keys share a bucket. A bucket isn't split, so this is for tables whose keys have few
    rows each, as papers have. A table or folder that exists is an error, and stays as it is.
    """
    spark = df.sparkSession
    spread = df.repartition(buckets, key)
    spread.write.mode("error").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    return spark.table(table)


def drop_bucketed(spark: SparkSession, table: str) -> None:
    """Take a table out of the catalogue; its files stay, and belong to whoever owns the folder."""
    spark.sql(f"DROP TABLE IF EXISTS {table}")
