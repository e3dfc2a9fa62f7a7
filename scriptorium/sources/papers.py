"""Where papers come from and go to: landed PDFs, markdown files, exports and published runs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators.ingest import content_hash


def landed_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """PDFs of a folder: url, hash and content. Hashing is native; the bytes go no further than they are asked for."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path)
    return files.select(
        F.col("path").alias("url"),
        content_hash(F.col("content")).alias("hash"),
        F.col("modificationTime").alias("created_at"),
        "length",
        "content",
    )


def markdown_files(spark: SparkSession, path: str) -> DataFrame:
    """Markdown files of a folder, each whole: url and markdown."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("url"), F.decode("content", "UTF-8").alias("markdown"))


def export_markdown(papers: DataFrame, paper_id, target: str) -> int:
    """Write one paper's markdown byte for byte to a local file; the number of bytes. A missing paper is an error."""
    rows = papers.filter(F.col("paper_id") == F.lit(paper_id)).select(F.col("markdown").cast("binary")).take(1)
    if not rows or rows[0][0] is None:
        raise LookupError(f"no markdown for paper {paper_id}")
    with open(target, "wb") as f:
        return f.write(bytes(rows[0][0]))


def _files(spark: SparkSession, path: str):
    """The store of a path, and the path in it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _commits(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """Number and batch of each commit, in their order: the names of empty files."""
    store, where = _files(spark, f"{path}/commits")
    names = [x.getPath().getName() for x in store.listStatus(where)] if store.exists(where) else []
    return sorted((int(n.split("-", 1)[0]), n.split("-", 1)[1]) for n in names if "-" in n and n[0].isdigit())


def publish(path: str, key: str, head: str, **relations: DataFrame) -> str:
    """Publish a batch of any number of entries at once: each relation has the key, and head has a row for each entry.

    A batch is written by one job for each relation into a folder that nobody reads yet; then one empty file, made
    atomically, commits all its entries. What readers see of an entry is its latest committed batch, so one that is
    written again stays as it was until then, and the files of all others stay as they are. If a job fails, nothing is
    committed and what was written is deleted.
    """
    spark = relations[head].sparkSession
    batch = uuid.uuid4().hex
    try:
        for name, df in relations.items():
            df.withColumn("_batch", F.lit(batch)).sortWithinPartitions(key).write.parquet(f"{path}/batches/{batch}/{name}")
    except BaseException:
        store, where = _files(spark, f"{path}/batches/{batch}")
        store.delete(where, True)
        raise
    number = max((n for n, _ in _commits(spark, path)), default=0) + 1
    store, where = _files(spark, f"{path}/commits/{number:012d}-{batch}")
    if not store.createNewFile(where):
        raise RuntimeError(f"batch {batch} is committed already")
    return batch


def publish_runs(path: str, **relations: DataFrame) -> str:
    """Publish a batch of runs: each relation has run_id, and one is `runs` with a row for each run."""
    return publish(path, "run_id", "runs", **relations)


def published(spark: SparkSession, path: str, relation: str = "runs", key: str = "run_id", head: str = "runs") -> DataFrame:
    """The rows of a relation of all published entries, each entry as its latest committed batch has it.

    An entry's batch replaces all that earlier ones had of it, rows of relations that it doesn't have included. A relation
    that no committed batch has is an error.
    """
    commits = _commits(spark, path)
    store, _ = _files(spark, path)
    having = [b for _, b in commits if store.exists(_files(spark, f"{path}/batches/{b}/{relation}")[1])]
    if not having:
        raise LookupError(f"no published {relation} in {path}")
    numbers = spark.createDataFrame(commits, "_number long, _batch string")
    heads = spark.read.parquet(*(f"{path}/batches/{b}/{head}" for _, b in commits)).select(key, "_batch").join(F.broadcast(numbers), "_batch")
    latest = heads.groupBy(key).agg(F.max_by("_batch", "_number").alias("_batch"))
    rows = spark.read.parquet(*(f"{path}/batches/{b}/{relation}" for b in having))
    return rows.join(latest, [key, "_batch"], "left_semi").drop("_batch")


def compact(spark: SparkSession, path: str, key: str, head: str, *others: str) -> str:
    """Publish what readers see now as one batch, then delete the batches before it; the new batch.

    Not to be run beside another writer or long readers: a batch that is committed meanwhile would be replaced, and
    readers that began before lose their files. Stopped halfway, it leaves what readers see as it is.
    """
    old = _commits(spark, path)
    batch = publish(path, key, head, **{r: published(spark, path, r, key, head) for r in (head, *others)})
    for number, b in old:
        store, where = _files(spark, f"{path}/commits/{number:012d}-{b}")
        store.delete(where, False)
        store, where = _files(spark, f"{path}/batches/{b}")
        store.delete(where, True)
    return batch


def read_run(spark: SparkSession, path: str, run_id: str, relation: str) -> DataFrame:
    """A relation of one published run; row groups of other runs are skipped. An unpublished run is an error."""
    if published(spark, path).filter(F.col("run_id") == run_id).isEmpty():
        raise LookupError(f"run {run_id} is not published")
    return published(spark, path, relation).filter(F.col("run_id") == run_id)
