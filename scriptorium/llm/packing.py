"""Best-fit decreasing packing of token sequences, over a whole corpus.

Best fit decides by length alone, so the packing runs on the histogram of lengths (at most `capacity` entries) with a
segment tree over remaining capacities. Items of one length are placed in runs: the tightest bins that fit, each
filled with as many as it holds, exactly as one item after another would go. The plan that comes back says for each
length which ranks go to which bins; items find their place by their rank within their length. A length that many
pieces share is dealt to as many buckets as hold about `bucket_rows` pieces each, so it is no hot key.

To the driver come the histogram (at most `capacity` rows) and the buckets' sizes (at most MOST_BUCKETS more). The plan
has few more runs than lengths, however large the corpus; both go out as broadcasts only up to BROADCAST_ROWS rows.

Only documents longer than the capacity are cut; an empty or null text is its end token alone. Repeated rows are
packed as often as they come, whatever their id. Columns beside id and text are not looked at. An empty table gives no
rows.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from scriptorium.llm.caches import forget_newest
from scriptorium.session import map_batches, materialise

#: What the tokenizer's own normalizer takes as white space; str.split() also takes U+001C to U+001F.
SPACES = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
SEPARATORS = re.compile("[\x1c-\x1f]")
#: _salt numbers a task's pieces; it deals pieces of one length to buckets, even if all ids are the same.
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, _salt long"
NAMES = ("doc_id", "piece", "start", "length", "ids_crc32", "_salt")
KINDS = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
BUCKET_ROWS, MOST_BUCKETS, BROADCAST_ROWS = 1000, 100_000, 1_000_000


class WordTokenizer:
    """Token ids of whole texts as little-endian 32-bit integers, for a lower-casing BPE that drops white space.

    Nothing is merged across white space, nor across the splits of the tokenizer's own pattern. So each word between
    white space is encoded once from its pieces, each piece is merged once by the tokenizer's model, and both are kept
    in caches of at most about `cache_words` entries. Words with letters beyond Latin go to the whole tokenizer,
    whose normalizer composes and lower-cases them. The file's added tokens are found in the raw text before all else,
    as the library finds them, and stand for themselves.
    """

    #: The pattern that the tokenizer file names.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str, cache_words: int = 250_000):
        self.path, self.cache_words, self.tokenizer, self.cache, self.pieces = path, cache_words, None, {}, {}

    def __reduce__(self):
        return shared_tokenizer, (self.path, self.cache_words)

    def _load(self) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(self.path)
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.normalized or t.single_word or t.lstrip or t.rstrip for t in added.values()):
            raise ValueError(f"{self.path} has added tokens that are not found as they stand")
        self.added = {t.content: self._bytes([i]) for i, t in added.items()}
        longest = sorted(self.added, key=len, reverse=True)
        self.apart = re.compile("(" + "|".join(map(re.escape, longest)) + ")").split if added else lambda text: [text]
        self.model, self.split = self.tokenizer.model, regex.compile(self.PATTERN).findall
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        self.letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}

    def _words(self, text: str) -> list[str]:
        """The words between white space, and the added tokens."""
        out = []
        for i, part in enumerate(self.apart(text)):
            if i % 2:
                out.append(part)
            else:
                out += [w for w in SPACES.split(part) if w] if SEPARATORS.search(part) else part.split()
        return out

    def _word(self, word: str) -> bytes:
        if word in self.added:
            return self.added[word]
        if not word.isascii() and max(word) >= "\u0250":
            return self._bytes(self.tokenizer.encode(word, add_special_tokens=False).ids)
        known, out = self.pieces, []
        for piece in self.split(word.lower()):
            ids = known.get(piece)
            if ids is None:
                ids = known[piece] = self._bytes([t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))])
            out.append(ids)
        return b"".join(out)

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def __call__(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        if self.tokenizer is None:
            self._load()
        cache = self.cache
        for text in texts:
            words = self._words(text) if text else []
            forget_newest(cache, self.cache_words)
            forget_newest(self.pieces, self.cache_words)
            for w in set(words).difference(cache):
                cache[w] = self._word(w)
            yield b"".join(map(cache.__getitem__, words))


_SHARED: dict[tuple[str, int], WordTokenizer] = {}


def shared_tokenizer(path: str, cache_words: int) -> WordTokenizer:
    """A Python worker keeps one tokenizer, and its cache, from task to task."""
    return _SHARED.setdefault((path, cache_words), WordTokenizer(path, cache_words))


def tokenized_pieces(docs: DataFrame, tokenize: Callable[[Iterable[str | None]], Iterator[bytes]], end_id: int, capacity: int, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, the CRC-32 of their ids, and _salt."""
    end = end_id.to_bytes(4, "little")
    step = capacity * 4

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts = count()
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                rows = []
                for doc, ids in zip(part.column("_id").to_pylist(), tokenize(part.column("_text").to_pylist()), strict=True):
                    ids += end
                    for piece, first in enumerate(range(0, len(ids), step)):
                        own = ids[first : first + step]
                        rows.append((doc, piece, first // 4, len(own) // 4, zlib.crc32(own), next(salts)))
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), KINDS, strict=True)], names=NAMES)

    return map_batches(docs.select(F.col(id_column).alias("_id"), F.col(text).alias("_text")), cut, PIECES)


class Capacities:
    """A segment tree over remaining capacities 0..top: how many open bins have each; finds the tightest that fits."""

    def __init__(self, top: int):
        self.size = 1 << top.bit_length()
        self.tree = [0] * (2 * self.size)

    def add(self, room: int, n: int) -> None:
        i = room + self.size
        while i:
            self.tree[i] += n
            i >>= 1

    def tightest(self, need: int) -> int:
        """The smallest room of an open bin that is at least need, or -1."""
        i = need + self.size
        if self.tree[i]:
            return need
        while i > 1:
            if not i & 1 and self.tree[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.tree[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return -1


def best_fit_plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, items, first bin, items in each bin, offset): bins are numbered from 0.

    Longest first; within a length the items go by rank.
    """
    rooms, free, bins, plan = Capacities(capacity), defaultdict(list), 0, []
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = rooms.tightest(length)
            if room < 0:
                room, fill = capacity, capacity // length
                first, many = bins, -(-left // fill)
                bins += many
            else:
                fill = room // length
                first, many = free[room].pop()
                use = min(many, -(-left // fill))
                rooms.add(room, -use)
                if use < many:
                    free[room].append((first + use, many - use))
                many = use
            items = min(left, many * fill)
            plan.append((length, rank, items, first, fill, capacity - room))
            rank, left = rank + items, left - items
            whole, over = divmod(items, fill)
            for at, n, rest in ((first, whole, room - fill * length), (first + whole, 1 if over else 0, room - over * length)):
                if n and rest:
                    free[rest].append((at, n))
                    rooms.add(rest, n)
    return plan


def sent(rows: list, kind: T.StructType | str, spark: SparkSession) -> DataFrame:
    """Rows of the driver as a table, broadcast if they are few."""
    df = spark.createDataFrame(rows, kind)
    return F.broadcast(df) if len(rows) <= BROADCAST_ROWS else df


def pack(pieces: DataFrame, capacity: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """pieces (materialised; columns as in PIECES) with sequence_id and offset."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    each = max(bucket_rows, -(-sum(histogram.values()) // MOST_BUCKETS))
    parts = {length: -(-n // each) for length, n in histogram.items() if n > each}
    # the number of buckets by length, as a literal array of capacity + 1 entries
    many = F.split(F.lit(",".join(str(parts.get(n, 1)) for n in range(capacity + 1))), ",").cast("array<int>")
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "_salt"), F.get(many, F.col("length").cast("int")))
    dealt = pieces.withColumn("_bucket", bucket.cast("int"))
    firsts = [(length, 0, 0) for length in histogram if length not in parts]
    if parts:
        before = defaultdict(int)
        counts = dealt.filter(F.col("length").isin(*parts)).groupBy("length", "_bucket").count().collect()
        for length, bucket, n in sorted(map(tuple, counts)):
            firsts.append((length, bucket, before[length]))
            before[length] += n
    by_length, runs = defaultdict(list), 0
    for length, rank, items, first, fill, offset in best_fit_plan(histogram, capacity):
        by_length[length].append((rank, items, first, fill, offset))
        runs += 1
    kind = T.StructType.fromDDL("length long, runs array<struct<rank:long,items:long,first:long,fill:long,offset:long>>")
    starts = sent(firsts, "length long, _bucket int, _before long", spark)
    planned = spark.createDataFrame(sorted(by_length.items()), kind)
    planned = F.broadcast(planned) if runs <= BROADCAST_ROWS else planned
    local = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "_salt")) - 1
    ranked = dealt.withColumn("_local", local).join(starts, ["length", "_bucket"]).withColumn("_rank", F.col("_before") + F.col("_local"))
    found = F.filter("runs", lambda r: (r["rank"] <= F.col("_rank")) & (F.col("_rank") < r["rank"] + r["items"]))[0]
    placed = ranked.join(planned, "length").withColumn("_run", found)
    within = F.col("_rank") - F.col("_run.rank")
    own = [c for c in pieces.columns if c != "_salt"]
    return placed.select(
        *own,
        (F.col("_run.first") + F.floor(within / F.col("_run.fill"))).cast("long").alias("sequence_id"),
        (F.col("_run.offset") + within % F.col("_run.fill") * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 4096, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenize, cut and pack documents."""
    pieces = materialise(tokenized_pieces(docs, WordTokenizer(tokenizer_path), end_id, capacity, id_column, text), "pieces")
    return pack(pieces, capacity)
