"""Target-distribution importance resampling by a dictionary of distinct features.

Features of a text are all runs of low to high consecutive words; words are runs of a-z, 0-9 and characters beyond ASCII,
with A-Z in lower case. Each distinct feature string is counted over all documents and hashed once; its bucket's gain is
the logarithm of the ratio between its share in the target texts and in the documents. The gains go back to the
features of each document, whose counts stay packed in blocks of documents; a document's weight is the mean gain of its
features. Documents are drawn by the largest weights with Gumbel noise: a sample without replacement by importance.

Null texts have no features, and weight 0. Rows are told apart by their place in the table, so repeated ids are rows of
their own (with the same noise). A null id draws the noise of an empty id and goes last among equal scores. Of equal
scores and ids the rows take their order from their place. An empty table gives an empty result, an empty target counts 0
in each bucket. Columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.word_blocks import Block, blocks, gathered, pack, row_structs, runs, splitter, string_structs, unpack
from scriptorium.session import map_batches, materialise

#: Digits, letters, and all beyond ASCII.
WORDS = splitter(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)


def count_vectors(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many distinct strings each document has, which, and how often, document after document."""
    keys = np.sort(block.owners() << 32 | block.ids)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    sizes = np.bincount(keys[first] >> 32, minlength=len(block.lengths))
    return sizes, keys[first] & 0xFFFFFFFF, np.diff(np.r_[first, len(keys)])


def feature_blocks(docs: DataFrame, id_column: str, text: str, ngrams: tuple[int, int]) -> DataFrame:
    """Blocks of documents: features (list of feature and count), docs (list of the id) and packed count vectors."""
    strings_of = runs(*ngrams)
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text, WORDS, strings_of):
            sizes, places, counts = count_vectors(block)
            total = np.bincount(block.ids, minlength=len(block.strings))
            packed = [pack(x) for x in (block.words, sizes, places, counts)]
            columns = [pa.array([block.number]), row_structs(block), string_structs(block, total, ("feature", "count")), *(pa.array([x], pa.binary()) for x in packed)]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "docs", "features", "words", "sizes", "places", "counts"])

    schema = f"block long, docs array<struct<doc: {kind}>>, features array<struct<feature: string, count: long>>, words binary, sizes binary, places binary, counts binary"
    return map_batches(docs.select(F.col(id_column).alias("doc"), F.col(text).alias(text)), run, schema)


def dictionary(features: DataFrame, buckets: int) -> DataFrame:
    """feature, count, bucket: each distinct string once."""
    counted = features.select(F.inline("features")).groupBy("feature").agg(F.sum("count").alias("count"))
    return counted.withColumn("bucket", F.crc32(F.col("feature").cast("binary")) % buckets)


def bucket_gains(own: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """bucket, gain: whole thousandths of the logarithm of a bucket's share in the target over its share in the documents.

    own, target: dictionaries. There are at most as many rows as buckets.
    """
    sums = own.groupBy("bucket").agg(F.sum("count").alias("s"), F.lit(0).cast("long").alias("t"))
    sums = sums.unionByName(target.groupBy("bucket").agg(F.lit(0).cast("long").alias("s"), F.sum("count").alias("t")))
    sums = sums.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    whole = sums.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    real = lambda c: F.col(c).cast("double") + 1.0
    ratio = real("t") * F.lit(float(whole.s + buckets)) / (real("s") * F.lit(float(whole.t + buckets)))
    return sums.select("bucket", F.floor(F.log(ratio) * 1000.0).cast("long").alias("gain"))


def _weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of each block with their counts and weight; a block's row with its vectors has no gain."""
    for rows in gathered(batches, "block"):
        whole = rows.filter(pc.is_valid(rows["sizes"])).to_pylist()[0]
        own = rows.filter(pc.is_valid(rows["gain"]))
        gains = np.zeros(own.num_rows, np.int64)
        gains[own["at"].to_numpy()] = own["gain"].to_numpy()
        sizes, places, counts = (unpack(whole[n]) for n in ("sizes", "places", "counts"))
        owner = np.repeat(np.arange(len(sizes)), sizes)
        n, gained = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        np.add.at(n, owner, counts)
        np.add.at(gained, owner, counts * gains[places])
        weight = np.where(n > 0, gained // np.maximum(n, 1), 0)
        docs = rows.filter(pc.is_valid(rows["sizes"])).column("docs").combine_chunks()
        docs = (docs.chunk(0) if isinstance(docs, pa.ChunkedArray) else docs).flatten().field("doc")
        key = np.arange(len(sizes))
        yield pa.RecordBatch.from_arrays(
            [docs, pa.array(np.full(len(sizes), whole["block"])), pa.array(key), pa.array(unpack(whole["words"])), pa.array(n), pa.array(weight)],
            names=["doc", "block", "place", "n_words", "n_features", "weight"],
        )


def importance_weights(docs: DataFrame, target: DataFrame, ngrams: tuple[int, int] = (1, 2), buckets: int = 10000, id_column: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """doc, block and place (a key of the row), n_words, n_features and weight of each row of docs."""
    whole = materialise(feature_blocks(docs, id_column, text, ngrams), "features")
    wanted = feature_blocks(target.withColumn("_none", F.lit(0)), "_none", target_text, ngrams)
    own = materialise(dictionary(whole, buckets), "dictionary")
    gains = bucket_gains(own, dictionary(wanted, buckets), buckets)
    known = own.join(F.broadcast(gains), "bucket").select("feature", "gain")
    asked = whole.select("block", F.posexplode("features").alias("at", "f")).select("block", "at", F.col("f.feature").alias("feature"))
    answers = asked.join(known, "feature").select("block", "at", "gain")
    vectors = ["docs", "words", "sizes", "places", "counts"]
    rows = whole.select("block", F.lit(None).cast("int").alias("at"), F.lit(None).cast("long").alias("gain"), *vectors)
    rows = rows.unionByName(answers, allowMissingColumns=True).repartition("block").sortWithinPartitions("block")
    kind = docs.schema[id_column].dataType.simpleString()
    return map_batches(rows, _weigh, f"doc {kind}, block long, place long, n_words long, n_features long, weight long")


def gumbel(key: Column) -> Column:
    """Gumbel noise in whole thousandths, from the first 32 bits of the key's SHA-256."""
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000.0).cast("long")


def draw(weighed: DataFrame, share: tuple[int, int], least_words: int, seed: str) -> DataFrame:
    """weighed with score and rank: the floor of share of the rows with enough words is drawn, the best first.

    Scores are whole numbers between the logarithms' bounds (under 120,000 different ones), so their histogram goes to the
    driver. Only rows from the last drawn score on are sorted, and they get their rank from their sorted partition.
    """
    rows = materialise(weighed.withColumn("score", F.col("weight") + gumbel(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc").cast("string"), F.lit(""))))), "scored")
    fit = F.col("n_words") >= least_words
    found = rows.filter(fit).groupBy("score").count().toPandas().sort_values("score", ascending=False)
    wanted = int(found["count"].sum()) * share[0] // share[1]
    none = F.lit(None).cast("long")
    if not wanted:
        return rows.withColumn("rank", none)
    last = int(found["score"].iloc[int(np.searchsorted(found["count"].cumsum().to_numpy(), wanted))])
    high = fit & (F.col("score") >= last)
    order = [F.desc("score"), F.asc_nulls_last("doc"), "block", "place"]
    ranked = materialise(rows.filter(high).orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_at", 33)
    sizes = sorted(tuple(r) for r in ranked.groupBy(part.alias("part")).count().collect())
    before, starts = 0, []
    for number, count in sizes:
        starts.append((number, before))
        before += count
    offsets = rows.sparkSession.createDataFrame(starts, "_part long, _before long")
    rank = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    taken = ranked.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    taken = taken.select(*rows.columns, F.when(rank <= wanted, rank).alias("rank"))
    return taken.unionByName(rows.filter(~high).withColumn("rank", none))


def resample(docs: DataFrame, target: DataFrame, share: tuple[int, int] = (10, 100), least_words: int = 20, seed: str = "2024", **how) -> DataFrame:
    """Each row of docs with n_words, n_features, weight, score and rank (null: not drawn), under doc, block and place."""
    return draw(importance_weights(docs, target, **how), share, least_words, seed)
