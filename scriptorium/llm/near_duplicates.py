"""N-gram Jaccard join by chosen paths.

Words are runs of letters and digits, lower-cased; a text's set holds the hashes of its shingles of five words (a
shorter text's single shingle is all of it). Texts of the same words are one copy class, joined through one
representative. Texts without words are joined with nothing but texts equal to them; null and empty ones with nothing.

Search: a set is embedded as `COORDINATES` minhash values, so that two sets agree in a coordinate with the
probability of their similarity. A run takes its first steps at once: it sends each set down the path of its values in
a few coordinates, and sets that share a path meet in its bucket. Small buckets are compared by brute force on
sketches; large ones recurse, sampling BRANCHING / (similarity * coordinates) of the coordinates at each node, so that
a similar pair is expected to stay together at BRANCHING children. A large bucket that kept at least half of its
parent's sets holds sets that agree with each other, so splitting it further gains nothing: it is compared in blocks at
once, like what is still large at the last level.

Recall: a batch has as many runs as find a pair at the threshold with probability `recall` even if all its buckets
split down to the last of `LEVELS` levels. It is measured too: `SAMPLE` sets, drawn by a hash, are compared exactly with
all sets on the way, and batches with fresh coordinates are repeated until no more than 1 - recall of their links are
missing. If that takes more than `MOST_BATCHES`, or the coordinates can't give the recall, it is an error.

The sketches' links only make candidate groups. Within a group all pairs are compared exactly on whole shingle sets:
its sets are dealt into blocks, whose size grows with the square root of the group's, each block is packed into one row,
and blocks meet in pairs: a group of k sets moves some k / 16 packed rows, k ** 1.5 / 4 sets, until blocks have their
full size at 65,536 sets. A comparison returns each set's number of links and a spanning forest, never pairs.

Result: a row for each document: its class (the smallest id linked to it over any path), copy_of (the smallest id of
texts of the same words), the number of different texts of similarity >= threshold, and class_row, which tells classes
apart where ids repeat or are null: rows are told apart by a key of their own, ids are mere attributes. Repeated rows
belong to the same copy class. Other columns are not looked at. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import count
from math import comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.caches import forget_newest
from scriptorium.llm.components import connected_components
from scriptorium.session import discard, map_batches, materialise

COORDINATES, LIMIT, LEVELS, BRANCHING = 64, 2048, 4, 3
#: Rows that a block of a bucket or group holds, at least and at most, and how many of its shingles on average at most.
LEAST_BLOCK, MOST_BLOCK, BLOCK_SHINGLES = 128, 1024, 2_000_000
SAMPLE, SAMPLE_BYTES, MOST_BATCHES = 64, 100_000, 4
WORD = re.compile(r"[^\W_]+")
_WORDS: dict[str, int] = {}
MIX = np.uint64(0x9E3779B97F4A7C15)


def coordinates(batch: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and addends of the minhash functions of a batch."""
    rng = np.random.default_rng([5, batch])
    odd = rng.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return odd, rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)


def word_hashes(text: str) -> np.ndarray:
    forget_newest(_WORDS, 100_000)
    out, known = [], _WORDS
    for w in WORD.findall(text.lower()):
        h = known.get(w)
        if h is None:
            digest = hashlib.blake2b(w.encode("utf-8", "replace"), digest_size=8).digest()
            h = known[w] = int.from_bytes(digest, "little")
        out.append(h)
    return np.array(out, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    return x ^ (x >> np.uint64(29))


def shingles(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of runs of size words."""
    if not len(words):
        return words
    n, out = max(1, len(words) - size + 1), np.zeros(1, np.uint64)
    for i in range(min(size, len(words))):
        out = mixed(out * np.uint64(3) + words[i : i + n])
    return np.unique(out)


def words_digest(text: str, words: np.ndarray) -> bytes:
    """What texts of the same words have in common; without words, the text itself."""
    own = words.tobytes() if len(words) else b"text" + text.encode("utf-8", "replace")
    return hashlib.blake2b(own, digest_size=16).digest()


def minhashes(own: np.ndarray, functions: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The smallest hash in each coordinate."""
    multipliers, addends = functions
    least = np.full(COORDINATES, ~np.uint64(0))
    for at in range(0, len(own), 4096):
        part = own[at : at + 4096, None] * multipliers + addends
        least = np.minimum(least, (part ^ (part >> np.uint64(32))).min(axis=0))
    return mixed(least)


def first_steps(similarity: float) -> int:
    """Coordinates of a run's first bucket: a pair at the threshold meets there about every other time."""
    return max(1, round(log(0.5) / log(similarity)))


def paths_of(least: np.ndarray, runs: int, steps: int) -> np.ndarray:
    """The first bucket of each run."""
    out = np.arange(1, runs + 1, dtype=np.uint64) * MIX
    for values in least[: runs * steps].reshape(runs, steps).T:
        out = mixed(out * np.uint64(3) + values)
    return out.view(np.int64)


def needed_agreement(threshold: float) -> int:
    """Coordinates that a pair at the threshold fails to reach once in thirty thousand; a byte agrees by chance at times too."""
    spread = np.sqrt(COORDINATES * threshold * (1 - threshold))
    return int(np.floor(COORDINATES * threshold - 4 * spread))


def loss(similarity: float, runs: int, levels: int) -> float:
    """At most how probably a pair of that similarity is not linked, if all its buckets split down to the last level.

    All nodes draw from the same coordinates, so it counts in how many of them the pair agrees: a run starts well if it
    agrees in all of the run's first steps, a node passes the pair on to as many children at most as it agrees in, and
    the sketches' test asks for that number.
    """
    steps, out, chance = first_steps(similarity), 0.0, BRANCHING / (similarity * COORDINATES)
    for agreed in range(COORDINATES + 1):
        ways = comb(COORDINATES, agreed)
        shared = 1.0 if agreed >= needed_agreement(similarity) else 0.0
        for _ in range(levels - 1):
            shared = 1 - (1 - min(1.0, chance) * shared) ** agreed
        # inclusion and exclusion over the runs whose first steps agree
        missed = sum(
            comb(runs, j) * (-shared) ** j * (comb(COORDINATES - steps * j, agreed - steps * j) / ways)
            for j in range(min(runs, agreed // steps) + 1)
        )
        out += ways * similarity**agreed * (1 - similarity) ** (COORDINATES - agreed) * missed
    return out


def runs_needed(similarity: float, recall: float, levels: int) -> int:
    """Runs after which a pair at the threshold is linked with probability recall, whatever splits."""
    for runs in range(1, COORDINATES // first_steps(similarity) + 1):
        if loss(similarity, runs, levels) <= 1 - recall:
            return runs
    raise ValueError(f"{COORDINATES} coordinates and {levels} levels do not reach recall {recall} at similarity {similarity}")


class ExactSample:
    """A bounded number of sets, found exactly among all others while those pass by."""

    def __init__(self, texts: Sequence[str], threshold: float):
        of = {}
        for text in texts:
            words = word_hashes(text)
            if len(words):
                of[words_digest(text, words)] = shingles(words)
        self.threshold, self.digests = threshold, list(of)
        self.sizes = np.array([len(s) for s in of.values()], np.int64)
        tokens = np.concatenate([*of.values(), np.zeros(0, np.uint64)])
        owners = np.repeat(np.arange(len(of)), self.sizes)
        order = np.argsort(tokens, kind="stable")
        self.tokens, self.owners = tokens[order], owners[order]

    def linked(self, digest: bytes, own: np.ndarray) -> list[int] | None:
        """Places of the sampled sets, other than its own, that a set is similar to."""
        first, last = (np.searchsorted(self.tokens, own, side) for side in ("left", "right"))
        many = last - first
        if not many.any():
            return None
        hits = np.flatnonzero(many)
        places = np.concatenate([np.arange(first[i], last[i]) for i in hits])
        common = np.bincount(self.owners[places], minlength=len(self.sizes))
        near = np.flatnonzero(common >= self.threshold * (len(own) + self.sizes - common) - 1e-9)
        return [int(i) for i in near if self.digests[i] != digest] or None


SKETCHED = "_row long, _id long, words binary, shingles int, sketch binary, paths array<long>, near array<int>"


def sketched(rows: DataFrame, runs: int, steps: int, batch: int, sample: ExactSample) -> DataFrame:
    """For each row: words (digest of the word sequence; null for null and empty texts), the number of shingles, sketch
    (a byte of the minhash in each coordinate; null without words), paths (the first bucket of each run), near (the
    sampled sets that it is similar to)."""
    functions = coordinates(batch)

    def described(text: str | None) -> tuple:
        if not text:
            return None, 0, None, None, None
        words = word_hashes(text)
        digest, own = words_digest(text, words), shingles(words)
        if not len(own):
            return digest, 0, None, None, None
        least = minhashes(own, functions)
        sketch = (least >> np.uint64(56)).astype(np.uint8).tobytes()
        return digest, len(own), sketch, paths_of(least, runs, steps), sample.linked(digest, own)

    kinds = (pa.binary(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()))
    names = ["_row", "_id", "words", "shingles", "sketch", "paths", "near"]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 256):
                part = whole.slice(at, 256)
                columns = zip(*map(described, part.column("_text").to_pylist()), strict=True)
                new = [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("_row"), part.column("_id"), *new], names=names)

    return map_batches(rows, made, SKETCHED)


def agreeing(sketches: np.ndarray, others: np.ndarray) -> np.ndarray:
    """How many coordinates agree, for all pairs of two sets of sketches."""
    out = np.zeros((len(sketches), len(others)), np.uint8)
    for a, b in zip(np.ascontiguousarray(sketches.T), np.ascontiguousarray(others.T), strict=True):
        out += a[:, None] == b[None, :]
    return out


def forest(n: int, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """The smallest place in each place's component, for links between places."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[rows], root[columns])
        new = root.copy()
        np.minimum.at(new, rows, low)
        np.minimum.at(new, columns, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


# -- rows that meet: within a block, and blocks in pairs ---------------------------------------------------------------

#: A comparison: from the payloads of two blocks (or of one, twice) to which pairs are linked.
Compare = Callable[[list[bytes], list[bytes]], np.ndarray]
LINKS = "id long, links long, root long"


def blocks_of(n: Column) -> Column:
    """The number of blocks of n rows."""
    size = F.greatest(F.lit(float(LEAST_BLOCK)), F.least(F.lit(float(MOST_BLOCK)), 4 * F.sqrt(n)))
    return F.ceil(n / size)


def dealt(rows: DataFrame, parts: Column) -> DataFrame:
    """rows (bucket, id) with the number of the bucket's parts and the part that a hash deals the row to."""
    part = F.pmod(F.xxhash64("id", F.lit("part")), F.col("parts")).cast("int")
    return rows.withColumn("parts", F.greatest(F.lit(1), parts).cast("int")).withColumn("part", part)


def together(rows: DataFrame, *keys: str, then: str = "id") -> DataFrame:
    """The rows of a key in one task, next to each other."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *keys).sortWithinPartitions(*keys, then)


def grouped(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], least: int = 2) -> Iterator[pa.Table]:
    """The groups of at least so many rows in batches that are sorted by keys."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        at = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in keys])
        starts = [0, *(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1).tolist(), len(batch)]
        for first, last in zip(starts, starts[1:], strict=False):
            if waiting and (first or any(waiting[-1].column(k)[0] != batch.column(k)[0] for k in keys)):
                if sum(map(len, waiting)) >= least:
                    yield pa.Table.from_batches(waiting)
                waiting = []
            waiting.append(batch.slice(first, last - first))
    if sum(map(len, waiting)) >= least:
        yield pa.Table.from_batches(waiting)


def linked_rows(ids: np.ndarray, near_rows: np.ndarray, near_columns: np.ndarray, links: np.ndarray) -> pa.RecordBatch | None:
    root = forest(len(ids), near_rows, near_columns)
    to = np.flatnonzero(links)
    return pa.RecordBatch.from_arrays([pa.array(ids[to]), pa.array(links[to]), pa.array(ids[root[to]])], names=["id", "links", "root"]) if len(to) else None


def within_parts(rows: DataFrame, compare: Compare) -> DataFrame:
    """rows: bucket, part, id, payload. All pairs within each part: id, links, root (of the part's forest)."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, ("bucket", "part")):
            ids, own = table.column("id").to_numpy(), table.column("payload").to_pylist()
            near = compare(own, own)
            np.fill_diagonal(near, False)
            found = linked_rows(ids, *np.nonzero(near), near.sum(axis=1))
            if found is not None:
                yield found

    return map_batches(together(rows.select("bucket", "part", "id", "payload"), "bucket", "part"), compared, LINKS)


def pack_block(ids: np.ndarray, payloads: list[bytes]) -> tuple[bytes, bytes]:
    sizes = struct.pack(f"<{len(payloads)}I", *map(len, payloads))
    return ids.tobytes(), zlib.compress(sizes + b"".join(payloads), 1)


def unpack_block(ids: bytes, packed: bytes) -> tuple[np.ndarray, list[bytes]]:
    own, whole = np.frombuffer(ids, np.int64), zlib.decompress(packed)
    ends = np.cumsum([4 * len(own), *struct.unpack_from(f"<{len(own)}I", whole)]).tolist()
    return own, [whole[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def across_parts(rows: DataFrame, compare: Compare) -> DataFrame:
    """rows: bucket, part, parts, id, payload. All pairs of different parts of a bucket: id, links, root.

    A part travels as one packed row, to each other part of its bucket.
    """
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    names = ["bucket", "part", "parts", "ids", "packed"]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, ("bucket", "part"), least=1):
            own = [table.column(c)[0].as_py() for c in names[:3]]
            own += pack_block(table.column("id").to_numpy(), table.column("payload").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(own, kinds, strict=True)], names=names)

    blocks = map_batches(
        together(rows.select("bucket", "part", "parts", "id", "payload"), "bucket", "part"),
        packed, "bucket long, part int, parts int, ids binary, packed binary",
    )
    other = F.explode(F.array_remove(F.sequence(F.lit(0), F.col("parts") - 1), F.col("part")))
    pairs = materialise(blocks, "blocks").withColumn("_other", other)
    pairs = pairs.withColumns({"low": F.least("part", "_other"), "high": F.greatest("part", "_other")}).drop("_other", "parts")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, ("bucket", "low", "high")):
            (a, own), (b, others) = (unpack_block(*(table.column(c)[i].as_py() for c in ("ids", "packed"))) for i in (0, 1))
            near = compare(own, others)
            places = np.nonzero(near)
            links = np.concatenate([near.sum(axis=1), near.sum(axis=0)])
            found = linked_rows(np.concatenate([a, b]), places[0], places[1] + len(a), links)
            if found is not None:
                yield found

    return map_batches(together(pairs, "bucket", "low", "high", then="part"), compared, LINKS)


def all_pairs(rows: DataFrame, compare: Compare) -> DataFrame:
    """rows (materialised): bucket, part, parts, id, payload. Every pair of a bucket is compared once."""
    inner, several = within_parts(rows, compare), rows.filter("parts > 1")
    return inner if several.isEmpty() else inner.union(across_parts(several, compare))


# -- candidates ---------------------------------------------------------------------------------------------------------


def counted(rows: DataFrame, key: str, *sums: Column) -> DataFrame:
    """Sums of each key, grouped with the key's hash beside it: see `components.least_by`."""
    return rows.groupBy(key, F.xxhash64(key).alias("_hash")).agg(*sums).drop("_hash")


def sketch_comparison(threshold: float) -> Compare:
    least = needed_agreement(threshold)

    def compare(own: list[bytes], others: list[bytes]) -> np.ndarray:
        a, b = (np.frombuffer(b"".join(x), np.uint8).reshape(-1, COORDINATES) for x in (own, others))
        return agreeing(a, b) >= least

    return compare


def candidate_links(sets: DataFrame, threshold: float) -> DataFrame:
    """sets: id, sketch, paths. Links (a, b) between sets whose sketches agree enough, found along chosen paths."""
    sketches = sets.select("id", "sketch")
    paths = sets.select(F.explode("paths").alias("bucket"), "id", F.lit(None).cast("long").alias("above"))
    chance, found, written = int(1_000_000 * min(1.0, BRANCHING / (threshold * COORDINATES))), [], []
    for level in range(LEVELS):
        met = materialise(paths.join(counted(paths, "bucket", F.count(F.lit(1)).alias("n")).filter("n > 1"), "bucket"), f"paths{level}")
        written.append(met)
        splits = (F.col("n") > LIMIT) & (F.col("above").isNull() | (F.col("n") * 2 < F.col("above")))
        large = met.filter(splits)
        last = level == LEVELS - 1 or large.isEmpty()
        found.append(met if last else met.filter(~splits))
        if last:
            break
        # a node samples a coordinate by a hash of its path, so all its sets agree on it
        places = F.sequence(F.lit(0), F.lit(COORDINATES - 1))
        drawn = F.filter(places, lambda i: F.pmod(F.xxhash64(F.col("bucket"), i), F.lit(1_000_000)) < chance)
        value = F.substring("sketch", F.col("i") + 1, F.lit(1))
        down = large.withColumn("i", F.explode(drawn)).join(sketches, "id")
        paths = down.select(F.xxhash64("bucket", "i", value).alias("bucket"), "id", F.col("n").alias("above"))
    rows = reduce(DataFrame.union, (f.select("bucket", "id", "n") for f in found))
    rows = dealt(rows, blocks_of(F.col("n"))).join(sketches.withColumnRenamed("sketch", "payload"), "id")
    rows = materialise(rows, "met")
    links = all_pairs(rows, sketch_comparison(threshold)).select(F.col("id").alias("a"), F.col("root").alias("b"))
    links = materialise(links.filter("a <> b").distinct(), "candidates")
    discard(rows, *written)
    return links


# -- exact comparison ---------------------------------------------------------------------------------------------------


def intersections(own: list[np.ndarray], others: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """Sizes of the common part for all pairs of sets: products of 0/1 matrices over the tokens that both sides have."""
    tokens = np.intersect1d(*(np.unique(np.concatenate(x)) for x in (own, others)), assume_unique=True)
    sides = []
    for sets in (own, others):
        whole, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        place = np.searchsorted(tokens, whole)
        known = place < len(tokens)
        known[known] = tokens[place[known]] == whole[known]
        place, row = place[known], row[known]
        order = np.argsort(place, kind="stable")
        sides.append((place[order], row[order], len(sets)))
    out = np.zeros((len(own), len(others)), np.float64)
    for at in range(0, len(tokens), columns):
        width = min(columns, len(tokens) - at)
        hits = []
        for place, row, n in sides:
            i, j = np.searchsorted(place, (at, at + width))
            hit = np.zeros((n, width), np.float32)
            hit[row[i:j], place[i:j] - at] = 1
            hits.append(hit)
        out += hits[0] @ hits[1].T
    return out


def exact_comparison(threshold: float) -> Compare:
    def compare(own: list[bytes], others: list[bytes]) -> np.ndarray:
        a, b = ([np.frombuffer(x, np.uint64) for x in side] for side in (own, others))
        common = intersections(a, b)
        sizes = np.array([len(s) for s in a])[:, None] + np.array([len(s) for s in b])[None, :]
        return common >= threshold * (sizes - common) - 1e-9

    return compare


def exact_links(rows: DataFrame, groups: DataFrame, threshold: float) -> DataFrame:
    """groups: id (a row's key), component, shingles. For each set of a group and comparison, written: id, links, root."""
    sizes = counted(groups, "component", F.count(F.lit(1)).alias("n"), F.sum("shingles").alias("total"))
    members = groups.join(sizes, "component")
    parts = F.greatest(blocks_of(F.col("n")), F.least("n", F.ceil(F.col("total") / BLOCK_SHINGLES)))
    members = dealt(members.select("id", F.col("component").alias("bucket"), "n", "total"), parts)

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                sets = [shingles(word_hashes(t)).tobytes() for t in batch.column("_text").to_pylist()]
                columns = [*(batch.column(c) for c in names[:-1]), pa.array(sets, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["bucket", "part", "parts", "id", "payload"]
    texts = rows.select(F.col("_row").alias("id"), "_text").join(members, "id")
    sets = map_batches(texts.select(*names[:-1], "_text"), shingled, "bucket long, part int, parts int, id long, payload binary")
    sets = materialise(sets, "sets")
    links = materialise(all_pairs(sets, exact_comparison(threshold)), "links")
    discard(sets)
    return links


# -- the join -----------------------------------------------------------------------------------------------------------


def missing_links(known: DataFrame, copies: DataFrame, groups: DataFrame, sample: ExactSample) -> float:
    """The share of the sampled sets' exact links whose two sets are in no common group."""
    if not sample.digests:
        return 0.0
    spark = known.sparkSession
    names = spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(sample.digests)], "place int, words binary")
    keyed = copies.select("words", "id")
    own = keyed.join(F.broadcast(names), "words").join(groups, "id", "left").select("place", F.col("component").alias("wanted"))
    linked = known.filter("near is not null").select("words", F.explode("near").alias("place")).distinct()
    found = linked.join(keyed, "words").join(groups, "id", "left").join(F.broadcast(own), "place")
    apart = ~F.coalesce(F.col("component") == F.col("wanted"), F.lit(False))
    return found.agg(F.coalesce(F.avg(apart.cast("double")), F.lit(0.0))).first()[0]


def near_duplicates(
    docs: DataFrame, threshold: float = 0.8, recall: float = 0.9999, id_column: str = "doc_id", text: str = "text", row_key: str | None = None
) -> DataFrame:
    """id column, class_id, copy_of, n_links, class_row, and the row key if one is named.

    row_key: a column of longs, never null and never twice, of a table that gives the same rows whenever it is read;
    without one the ids and texts are written to the shared folder with a key.
    """
    key = F.col(row_key) if row_key else F.monotonically_increasing_id()
    rows = docs.select(key.alias("_row"), F.col(id_column).cast("long").alias("_id"), F.col(text).alias("_text"))
    rows = rows if row_key else materialise(rows, "rows")
    short = rows.filter(F.octet_length("_text") <= SAMPLE_BYTES)
    sample = ExactSample([r[0] for r in short.orderBy(F.xxhash64("_row"), "_row").limit(SAMPLE).select("_text").collect()], threshold)
    runs, steps, links, groups = runs_needed(threshold, recall, LEVELS), first_steps(threshold), None, None
    for batch in count():
        known = materialise(sketched(rows, runs, steps, batch, sample), "sketches")
        copies = known.filter("words is not null").groupBy("words").agg(
            F.min("_row").alias("id"), F.min("_id").alias("copy_of"), F.max("shingles").alias("shingles"),
            F.max("sketch").alias("sketch"), F.max("paths").alias("paths"),
        )
        copies = materialise(copies, "copies")
        more = candidate_links(copies.filter("sketch is not null").select("id", "sketch", "paths"), threshold)
        links = more if links is None else links.union(more)
        groups = materialise(connected_components(links).toDF("id", "component"), "groups")
        missing = missing_links(known, copies, groups, sample)
        if missing <= 1 - recall:
            break
        if batch + 1 == MOST_BATCHES:
            raise RuntimeError(f"{missing:.4f} of the sampled links are missing after {MOST_BATCHES} batches of {runs} runs")
    sized = groups.join(copies.select("id", "shingles"), "id")
    exact = exact_links(rows, sized, threshold)
    classes = connected_components(exact.select(F.col("id").alias("a"), F.col("root").alias("b"))).toDF("id", "class_row")
    linked = exact.groupBy("id").agg(F.sum("links").alias("n_links"))
    judged = copies.select("words", "id", "copy_of").join(classes, "id", "left").join(linked, "id", "left")
    judged = materialise(judged.withColumn("class_row", F.coalesce("class_row", "id")), "judged")
    named = counted(judged, "class_row", F.min("copy_of").alias("class_id"))
    # a text's words may be a third of all rows: both sides are read from tables, so that adaptive execution can split
    found = known.filter("words is not null").select("_row", "_id", "words").join(judged.join(named, "class_row").drop("id"), "words")
    alone = known.filter("words is null").select(
        "_row",
        "_id",
        F.col("_row").alias("class_row"),
        F.col("_id").alias("copy_of"),
        F.col("_id").alias("class_id"),
        F.lit(0).alias("n_links"),
    )
    columns = [
        F.col("_id").alias(id_column),
        "class_id",
        "copy_of",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        "class_row",
    ]
    return found.unionByName(alone, allowMissingColumns=True).select(*columns, *([F.col("_row").alias(row_key)] if row_key else []))
