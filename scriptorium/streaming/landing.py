"""Papers as they land, as a stream: the first paper of a content hash stays, whatever lands later.

The store is the state: each micro-batch is one folder of new papers, told by its number. A batch that runs again after a
failure meets only the papers of the batches before it and overwrites its own folder, so every paper is kept exactly once.
A store belongs to one checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scriptorium.operators.ingest import content_hash, dedupe


def arriving_pdfs(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of the PDFs of a folder: paper_id (of its url), url, hash, created_at and length. The bytes are only hashed."""
    shape = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(shape).option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true")
    return files.option("maxFilesPerTrigger", files_per_batch).load(path).select(
        F.md5("path").alias("paper_id"),
        F.col("path").alias("url"),
        content_hash(F.col("content")).alias("hash"),
        F.col("modificationTime").alias("created_at"),
        "length",
    )


def _epochs(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches that were written to their end."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/epoch=*/_SUCCESS")
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
    return sorted(int(x.getPath().getParent().getName().split("=")[1]) for x in found)


def landed_papers(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The papers of a store, with the epoch that brought them; before: only of earlier batches. None if there is no batch."""
    epochs = [e for e in _epochs(spark, path) if before is None or e < before]
    if not epochs:
        return None
    return spark.read.option("basePath", path).parquet(*(f"{path}/epoch={e}" for e in epochs))


def land(arrivals: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the new papers of a stream (paper_id, hash, created_at and more) to a store, all that is there now.

    Within a batch the earliest paper of a hash stays, by created_at, then paper_id; across batches the one that is stored.
    A null hash is nobody's: such arrivals are all kept. A hot hash is aggregated before it is shuffled; the rest is one
    join of the batch's hashes with the hash column of the store.
    """

    def settle(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        hashed = dedupe(batch.filter("hash is not null"))
        known = landed_papers(spark, path, epoch)
        if known is not None:
            hashed = hashed.join(known.select("hash"), "hash", "left_anti")
        hashed.select(*batch.columns).union(batch.filter("hash is null")).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return arrivals.writeStream.foreachBatch(settle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def resolved(arrivals: DataFrame, papers: DataFrame) -> DataFrame:
    """arrivals with kept_id: the stored paper of their hash, their own or an earlier one; null for a null hash."""
    return arrivals.join(papers.select("hash", F.col("paper_id").alias("kept_id")), "hash", "left")
