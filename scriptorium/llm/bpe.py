"""Byte-level BPE encoding and decoding.

`fold` and `encode_folded` are higher-order functions only: the ranks are a literal in the plan, a perfect hash table
of flat arrays; a word is an array of one-byte pieces, and a fold merges the leftmost pair of the lowest rank until no
pair has one. They are right but took more than 6500 CPU seconds a GB (README), so `encode` folds the same ranked
merges over the distinct words of Arrow batches in Python; each worker keeps what it has folded in a bounded cache.
Decoding concatenates pieces from a literal table, in the JVM.

Null text counts as empty and gives no ids. Texts are processed whole. Repeated rows give repeated results. Columns of the
new names are replaced. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator, Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.llm.caches import forget_newest
from scriptorium.session import map_batches

#: The Unicode White_Space class, for Java's \s knows ASCII only.
SPACE = r"\t-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
NO_RANK = 2147483647


def java_pattern(pattern: str) -> str:
    """The splitting pattern with Unicode white space spelled out."""
    return pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^{SPACE}\p{{L}}\p{{N}}]").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]")


def read_ranks(spark: SparkSession, path: str) -> list[bytes]:
    """Tokens in the order of their ids, from a rank file that the driver or Spark can read."""
    lines = spark.read.text(path if "://" in path else f"file://{path}").collect() if "://" in path else open(path, "rb").read().splitlines()
    pairs = (bytes(x[0], "ascii").split() if not isinstance(x, bytes) else x.split() for x in lines)
    return [t for _, t in sorted((int(n), base64.b64decode(b)) for b, n in (p for p in pairs if len(p) == 2))]


def _literal(values: Sequence, kind: str) -> Column:
    """A literal array: the optimizer folds the split of one long string once, on the driver."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _get(array: Column, index: Column) -> Column:
    return F.get(array, index)


class HashedLiteral:
    """A literal map from string keys to a value, looked up in constant time.

    keys is placed by hash and displace: a key's bucket names a displacement that sends the bucket's keys to slots of
    their own. Lookups compare the key itself, so a foreign key never matches.
    """

    def __init__(self, spark: SparkSession, keys: Sequence[str], values: Sequence, kind: str):
        hashed = [r[0] for r in spark.createDataFrame([(k,) for k in keys], "k string").select(F.xxhash64("k")).collect()] if keys else []
        self.buckets = max(1, len(keys) // 3)
        self.slots = max(11, int(len(keys) * 1.35) | 1)
        g = np.array(hashed, dtype=np.int64) & 0x7FFFFFFFFFFF
        first, step, bucket = (g >> 16) % self.slots, (g >> 3) % (self.slots - 1) + 1, g % self.buckets
        order = np.argsort(bucket, kind="stable")
        ends = np.cumsum(np.bincount(bucket, minlength=self.buckets)) if len(g) else np.zeros(self.buckets, int)
        groups = sorted((order[(ends[b - 1] if b else 0) : ends[b]] for b in range(self.buckets)), key=len, reverse=True)
        at, moves = np.full(self.slots, -1, dtype=np.int64), np.zeros(self.buckets, dtype=np.int64)
        for own in groups:
            if not len(own):
                break
            d = 0
            while True:
                to = (first[own] + d * step[own]) % self.slots
                if (at[to] < 0).all() and len(set(to.tolist())) == len(to):
                    break
                d += 1
                if d > 1_000_000:
                    raise ValueError("keys that can't be placed: repeated keys?")
            at[to] = own
            moves[bucket[own[0]]] = d
        self.moves = _literal(moves.tolist(), "int")
        self.keys = _literal([keys[i] if i >= 0 else "" for i in at], "string")
        self.values = F.split(F.lit(",".join(str(values[i]) if i >= 0 else "" for i in at)), ",") if kind == "string" else _literal([values[i] if i >= 0 else NO_RANK for i in at], kind)

    def lookup(self, keys: Column, default: Column) -> Column:
        """The values of an array of keys, in order; default for a key that isn't held."""

        def one(k: Column, h: Column) -> Column:
            g = h.bitwiseAND(F.lit(0x7FFFFFFFFFFF))
            return F.struct(
                k.alias("k"),
                (
                    (
                        (F.shiftright(g, 16) % self.slots + _get(self.moves, (g % self.buckets).cast("int")) * (F.shiftright(g, 3) % (self.slots - 1) + 1)) % self.slots
                    )
                    .cast("int")
                    .alias("s")
                ),
            )

        slotted = F.zip_with(keys, F.transform(keys, lambda k: F.xxhash64(k)), one)
        return F.transform(slotted, lambda x: F.when(_get(self.keys, x["s"]) == x["k"], _get(self.values, x["s"])).otherwise(default))


class RankedMerges:
    """The ids of texts as little-endian 32-bit integers, by folding ranked merges over distinct words."""

    def __init__(self, tokens: Sequence[bytes], pattern: str, cache_words: int = 250_000, long_word: int = 400):
        import regex

        self.ranks = {t: i for i, t in enumerate(tokens)}
        self.words = regex.compile(pattern).findall
        self.cache, self.cache_words, self.long_word = {}, cache_words, long_word

    def merge(self, word: bytes) -> list[int]:
        """A whole token, or the leftmost pair of the lowest rank merged again and again."""
        ranks = self.ranks
        if word in ranks:
            return [ranks[word]]
        if len(word) > self.long_word:
            return self.merge_long(word)
        parts = [word[i : i + 1] for i in range(len(word))]
        pairs = [ranks.get(a + b, NO_RANK) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs and (least := min(pairs)) < NO_RANK:
            i = pairs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], NO_RANK)
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], NO_RANK)
        return [ranks[p] for p in parts]

    def merge_long(self, word: bytes) -> list[int]:
        """The same merges from a heap, for words so long that scanning the pairs would take quadratic time."""
        ranks, n = self.ranks, len(word)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that begins at each byte; 0: merged away
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not end[i] or end[i] >= n or end[end[i]] != stop:
                continue
            end[end[i]], end[i] = 0, stop
            if stop < n:
                before[stop] = i
                if (r := ranks.get(word[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if before[i] >= 0 and (r := ranks.get(word[before[i] : stop])) is not None:
                heapq.heappush(heap, (r, before[i], stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : end[i]]])
            i = end[i]
        return out

    def __call__(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        cache = self.cache
        for text in texts:
            words = self.words(text) if text else []
            forget_newest(cache, self.cache_words)
            for w in set(words).difference(cache):
                cache[w] = np.array(self.merge(w.encode()), dtype="<i4").tobytes()
            yield b"".join(map(cache.__getitem__, words))


_SHARED: dict[str, RankedMerges] = {}


def shared_merges(key: str, sent: Broadcast, pattern: str) -> RankedMerges:
    """A Python worker keeps one encoder, and its cache, from task to task. key: a digest of tokens and pattern."""
    if key not in _SHARED:
        _SHARED.clear()
        _SHARED[key] = RankedMerges(sent.value, pattern)
    return _SHARED[key]


class BytePairCodec:
    """Encodes and decodes columns by a rank file.

    tokens: the byte strings in the order of their ids (every single byte must be one).
    """

    def __init__(self, spark: SparkSession, tokens: Sequence[bytes], pattern: str):
        self.spark, self.pattern = spark, java_pattern(pattern)
        self.tokens = list(tokens)
        self.pieces = _literal([t.hex() for t in self.tokens], "string")

    @cached_property
    def ranks(self) -> HashedLiteral:
        return HashedLiteral(self.spark, [t.hex() for t in self.tokens], range(len(self.tokens)), "int")

    def encode(self, docs: DataFrame, text: str = "text", out: str = "ids") -> DataFrame:
        """docs with a column out of type array<int>: the ids of the whole text, as encode_ordinary gives them."""
        sent, pattern = self.spark.sparkContext.broadcast(self.tokens), self.pattern
        key = hashlib.sha256(b"|".join([*(t.hex().encode() for t in self.tokens), pattern.encode()])).hexdigest()
        rest = docs.drop(out)
        schema = T.StructType([*rest.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType(), False), False)])

        def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            merges = shared_merges(key, sent, pattern)
            for whole in batches:
                for at in range(0, len(whole), 256):
                    batch = whole.slice(at, 256)
                    ids = list(merges(batch.column(text).to_pylist()))
                    ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int64)
                    lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                    yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=schema.names)

        return map_batches(rest, encoded, schema)

    def words(self, text: Column) -> Column:
        return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(self.pattern), F.lit(0))

    def fold(self, word: Column) -> Column:
        """The ids of one word, array<int>: ranked merges folded over its bytes, held as hex pieces."""
        raw = F.lower(F.hex(F.encode(word, "UTF-8")))
        n = (F.length(raw) / 2).cast("int")
        missing = F.lit(NO_RANK)
        split = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(raw, i * 2 - 1, F.lit(2)))
        start = F.transform(
            F.array(split),
            lambda p: F.struct(p.alias("p"), self.ranks.lookup(F.zip_with(F.slice(p, F.lit(1), n - 1), F.slice(p, F.lit(2), n), lambda a, b: F.concat(a, b)), missing).alias("r")),
        )[0]

        def merged(state: Column, _: Column) -> Column:
            def at(i: Column) -> Column:
                p = F.concat(
                    F.slice(state["p"], F.lit(1), i - 1),
                    F.array(F.concat(_get(state["p"], i - 1), _get(state["p"], i))),
                    F.slice(state["p"], i + 2, F.size(state["p"])),
                )

                def ranked(q: Column) -> Column:
                    pair = F.concat(
                        F.when(i > 1, F.array(F.concat(_get(q, i - 2), _get(q, i - 1)))).otherwise(F.array().cast("array<string>")),
                        F.when(i < F.size(q), F.array(F.concat(_get(q, i - 1), _get(q, i)))).otherwise(F.array().cast("array<string>")),
                    )
                    r = F.concat(
                        F.when(i > 2, F.slice(state["r"], F.lit(1), i - 2)).otherwise(F.array().cast("array<int>")),
                        self.ranks.lookup(pair, missing),
                        F.slice(state["r"], i + 2, F.size(state["p"])),
                    )
                    return F.struct(q.alias("p"), r.alias("r"))

                return F.transform(F.array(p), ranked)[0]

            best = F.array_min(state["r"])
            return F.when(best.isNull() | (best == NO_RANK), state).otherwise(
                F.transform(F.array(F.array_position(state["r"], best).cast("int")), at)[0],
            )

        folded = F.aggregate(F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>")), start, merged)
        whole = self.ranks.lookup(F.array(raw), missing)
        return F.when(whole[0] != NO_RANK, whole).otherwise(self.ranks.lookup(folded["p"], missing))

    def frequent_words(self, docs: DataFrame, text: str, cache_words: int) -> HashedLiteral:
        """A literal dictionary of the most frequent distinct words over all documents; ids joined by commas."""
        spark = docs.sparkSession
        counted = docs.select(F.explode(self.words(F.col(text))).alias("word")).groupBy("word").count()
        top = counted.orderBy(F.desc("count"), "word").limit(cache_words).repartition(spark.sparkContext.defaultParallelism)
        rows = top.select(F.hex(F.encode("word", "UTF-8")).alias("k"), F.array_join(self.fold(F.col("word")), " ").alias("v")).collect()
        return HashedLiteral(spark, [r["k"] for r in rows], [r["v"] for r in rows], "string")

    def encode_folded(self, docs: DataFrame, text: str = "text", out: str = "ids", cache_words: int = 65_536) -> DataFrame:
        """docs with a column out of type array<int>: the ids of the whole text, as encode_ordinary gives them."""
        known = self.frequent_words(docs, text, cache_words)
        words = self.words(F.col(text))
        looked = F.zip_with(
            words,
            known.lookup(F.transform(words, lambda w: F.hex(F.encode(w, "UTF-8"))), F.lit(None).cast("string")),
            lambda w, v: F.coalesce(v, F.array_join(self.fold(w), " ")),
        )
        return docs.withColumn(out, F.filter(F.split(F.array_join(looked, " "), " "), lambda x: x != "").cast("array<int>"))

    def decode(self, ids: Column) -> Column:
        """The bytes of an array of ids: binary pieces from a literal table, concatenated."""
        return F.unhex(F.array_join(F.transform(ids, lambda i: _get(self.pieces, i)), ""))
