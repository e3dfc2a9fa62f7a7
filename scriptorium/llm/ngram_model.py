"""A word-pair language model in Elias-Fano tries, one for each shard of contexts.

Tokens are runs of all but white space, with A-Z in lower case, and one end after each text, which is the context of the
next text's first token too. The base probability of a token is (c + 0.5) / (N + 0.5 * (V + 1)) by its count among the N
training tokens of V kinds. A token after a context has the probability (c(context, token) + M * base) /
(c(context) + M): Dirichlet smoothing, whose sum over all tokens is 1.

Documents go into blocks with a dictionary of their own. A block's distinct words go, packed, to the shard of the corpus's
dictionary that their hash names, which gives their number and count; then its distinct pairs go, packed with the
documents that have them, to the shard of their context. Pairs of a context with a large share of all tokens are dealt out by their second word as well. A shard merges
the counts of all blocks into a trie: contexts, pointers to where their words begin, the words, each relative to its
context's base, and the smoothed probability in thousandths of its logarithm. The levels are Elias-Fano coded and
memory-mapped. Each pair is looked up in it by a successor search among its context's words, and what goes back are
sums by document.

Null texts are empty: their only token is the end. Rows are told apart by their place, so repeated ids are rows of their
own; ids may be null. Without training texts each token has probability 0.5 / 0.5 = 1 (N = V = 0), and the score is 0.
An empty table gives an empty result. Columns other than the id, the text and those that the training condition reads
are not used.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.elias_fano import EliasFano, MappedArrays
from scriptorium.llm.word_blocks import blocks, gathered, pack, pack_all, row_structs, splitter, unpack, unpack_all
from scriptorium.session import map_batches, materialise

#: All but white space.
WORDS = splitter(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: The end of a text: no word, as it is white space.
END = b"\n"
#: Weight of the base probability, in tokens.
MASS = 64.0
#: Logarithms are kept in whole parts of one.
PARTS = 1000
#: Training tokens for each shard, at most about.
SHARD_TOKENS = 1 << 21
#: Questions to a trie at once.
AT_ONCE = 1 << 18


def _parts(p: np.ndarray) -> np.ndarray:
    return np.rint(-PARTS * np.log10(p)).astype(np.int64)


def token_blocks(docs: DataFrame, shards: int) -> DataFrame:
    """Blocks of docs (doc, held, text) as two kinds of rows.

    With a null shard: docs, and packed lengths and places of their tokens, where frequent words of the block have low
    places. With a shard: its words, one a line, and packed, their places (differences) and training counts.
    """
    kind = docs.schema["doc"].dataType.simpleString()
    names = ["block", "shard", "docs", "lengths", "places", "words", "at", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", WORDS, lambda words: [*words, END]):
            size = len(block.strings)
            by_use = np.argsort(-np.bincount(block.ids, minlength=size), kind="stable")
            place = np.empty(size, np.int64)
            place[by_use] = np.arange(size)
            trained = ~block.rows.column("held").to_numpy(zero_copy_only=False).astype(bool)
            counts = np.bincount(block.ids, np.repeat(trained, block.lengths), size).astype(np.int64)[by_use]
            strings = [block.strings[i] for i in by_use.tolist()]
            shard = np.fromiter(map(zlib.crc32, strings), np.int64, size) % shards
            dealt = np.argsort(shard, kind="stable")
            cuts = np.flatnonzero(np.diff(shard[dealt], prepend=-1)).tolist()
            packed: list[list] = [[], [], [], []]
            for start, stop in zip(cuts, [*cuts[1:], size], strict=True):
                own = dealt[start:stop]
                line = b"\n".join([b"" if strings[i] == END else strings[i] for i in own.tolist()])
                parts = int(shard[own[0]]), pa.compress(line, codec="zstd", asbytes=True), pack(np.diff(own, prepend=0)), pack(counts[own])
                for column, x in zip(packed, (parts[0], len(line).to_bytes(8, "little") + parts[1], *parts[2:]), strict=True):
                    column.append(x)
            n, docs_of = len(cuts), row_structs(block)
            none = [None] * n
            rows = [[block.number] * (n + 1), [None, *packed[0]], [pack(block.lengths), *none], [pack(place[block.ids]), *none], *([None, *x] for x in packed[1:])]
            columns = [pa.array(x, k) for x, k in zip(rows, (pa.int64(), pa.int64(), *[pa.binary()] * 5), strict=True)]
            columns.insert(2, pa.concat_arrays([docs_of, pa.nulls(n, docs_of.type)]))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_batches(docs, run, f"block long, shard long, docs array<struct<doc: {kind}, held: boolean>>, lengths binary, places binary, words binary, at binary, counts binary")


def _number(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """For the words that each block asks of a shard: their numbers and counts in training; tokens and kinds of the shard.

    Frequent words have low numbers. Words that training has not have no number and the count 0.
    """
    for rows in gathered(batches, "shard"):
        place: dict[bytes, int] = defaultdict()
        place.default_factory = place.__len__
        asked = []
        for x in rows["words"]:
            data = x.as_buffer()
            size = int.from_bytes(data[:8].to_pybytes(), "little")
            words = pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True).split(b"\n")
            asked.append(np.fromiter(map(place.__getitem__, words), np.int64, len(words)))
        counts = [unpack(x.as_py()) for x in rows["counts"]]
        total = np.bincount(np.concatenate(asked), np.concatenate(counts), len(place)).astype(np.int64)
        number = np.empty(len(total), np.int64)
        number[np.argsort(-total, kind="stable")] = np.arange(len(total))
        number = number * shards + rows["shard"][0].as_py()
        blocks_, shard, at = (pa.concat_arrays(rows[n].chunks) for n in ("block", "shard", "at"))
        tokens, kinds = np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64)
        tokens[0], kinds[0] = total.sum(), (total > 0).sum()
        packed = [pa.array([pack(v[x]) for x in asked], pa.binary()) for v in (number, total)]
        yield pa.RecordBatch.from_arrays([blocks_, at, *packed, pa.array(tokens), pa.array(kinds)], names=["block", "at", "numbers", "totals", "tokens", "kinds"])


class Model:
    """Totals: tokens N and kinds V in training, shards, and the weight of the base probability."""

    def __init__(self, tokens: int, kinds: int, shards: int, mass: float = MASS):
        self.tokens, self.kinds, self.shards, self.mass = tokens, kinds, shards, mass

    @property
    def below(self) -> float:
        return self.tokens + 0.5 * (self.kinds + 1)

    def chance(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 0.5) / self.below

    def smoothed(self, pairs: np.ndarray | float, contexts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return (pairs + self.mass * self.chance(counts)) / (contexts + self.mass)

    def shard(self, context: np.ndarray, word: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The shard of pairs: by their context; of contexts with over half a shard's share of tokens by the word too."""
        hot = count > self.tokens / (2 * self.shards)
        mixed = context.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.where(hot, word + 1, 0).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        return ((mixed ^ (mixed >> np.uint64(32))) % np.uint64(self.shards)).astype(np.int64)


def _whole_row(rows: pa.Table, column: str) -> tuple[pa.Table, dict]:
    own = rows.filter(pc.is_valid(rows[column]))
    return own, {n: own[n][0].as_py() for n in own.column_names if n != "docs"}


def _documents(own: pa.Table) -> pa.StructArray:
    lists = own["docs"]
    return (lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists).flatten()


def _ask(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """The packed pairs of each block for each shard, and a row with its documents and what is known of them without."""
    for rows in gathered(batches, "block"):
        own, whole = _whole_row(rows, "places")
        lengths, places = unpack(whole["lengths"]), unpack(whole["places"])
        size = int(places.max()) + 1
        number, count = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for x in rows.filter(pc.is_valid(rows["numbers"])).select(["at", "numbers", "totals"]).to_pylist():
            at = np.cumsum(unpack(x["at"]))
            number[at], count[at] = unpack(x["numbers"]), unpack(x["totals"])
        docs = _documents(own)
        held = docs.field("held").to_numpy(zero_copy_only=False).astype(bool)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        stops = np.cumsum(lengths)
        context = np.r_[places[-1:], places[:-1]]  # a text's last token is the end, which stands before the next one
        c, c0 = count[places], count[context]
        logs = np.add.reduceat(np.log10(model.chance(c)), stops - lengths)
        asked = (c > 0) & (c0 > 0)
        alone = np.where(asked, 0, _parts(model.smoothed(0.0, c0, c)))
        known = [np.add.reduceat(x, stops - lengths) for x in (alone, (c > 0).astype(np.int64))]
        yield pa.RecordBatch.from_arrays(
            [pa.array([whole["block"] % model.shards]), pa.array([whole["block"]]), pa.array([None], pa.binary()), own["docs"].combine_chunks() if not isinstance(own["docs"], pa.ChunkedArray) else own["docs"].chunk(0), pa.array([pack_all([lengths, *known])]), pa.array([logs.tolist()])],
            names=["shard", "block", "pairs", "docs", "known", "logs"],
        )
        rank = np.empty(size, np.int64)
        by_number = np.argsort(number)
        rank[by_number] = np.arange(size)
        at = np.flatnonzero(asked)
        keys = rank[context[at]] << 32 | rank[places[at]]
        order = np.argsort(keys)
        keys, doc = keys[order], owner[at[order]]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        times = np.diff(np.r_[first, len(keys)])
        trained = np.add.reduceat((~held)[doc].astype(np.int64), first) if len(first) else first
        a, b = by_number[keys[first] >> 32], by_number[keys[first] & 0xFFFFFFFF]
        shard = model.shard(number[a], number[b], count[a])
        dealt = np.argsort(shard.astype(np.uint16 if model.shards <= 1 << 16 else np.int64), kind="stable")
        ends = np.cumsum(times[dealt])
        moved = np.repeat(first[dealt] - (ends - times[dealt]), times[dealt]) + np.arange(len(keys))
        doc, a, b, trained, times, shard = doc[moved], a[dealt], b[dealt], trained[dealt], times[dealt], shard[dealt]
        cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(shard) else []
        out: dict[str, list] = {"shard": [], "pairs": []}
        for start, stop in zip(cuts, np.r_[cuts[1:], len(shard)] if len(shard) else [], strict=True):
            own_a = a[start:stop]
            heads = np.flatnonzero(np.r_[True, own_a[1:] != own_a[:-1]])
            low = ends[start] - times[start]
            out["shard"].append(int(shard[start]))
            out["pairs"].append(
                pack_all([
                    np.diff(number[own_a[heads]], prepend=0), np.diff(np.r_[heads, stop - start]), count[own_a[heads]],
                    number[b[start:stop]], count[b[start:stop]], trained[start:stop], times[start:stop], doc[low : ends[stop - 1]],
                ])
            )
        n = len(out["shard"])
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["shard"], pa.int64()), pa.array([whole["block"]] * n), pa.array(out["pairs"], pa.binary()), pa.nulls(n, own.schema.field("docs").type), pa.nulls(n, pa.binary()), pa.nulls(n, pa.list_(pa.float64()))],
                names=["shard", "block", "pairs", "docs", "known", "logs"],
            )


def build_trie(context: np.ndarray, word: np.ndarray, pairs: np.ndarray, contexts: np.ndarray, counts: np.ndarray, model: Model) -> list[np.ndarray]:
    """The arrays of a trie of pairs (repeated ones are summed): numbers of context and word, and counts of all three."""
    heads, a = np.unique(context, return_inverse=True)
    words, b = np.unique(word, return_inverse=True)
    key = a << 32 | b
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    summed = np.add.reduceat(pairs[order], first) if len(first) else first
    own, word = key[first] >> 32, words[key[first] & 0xFFFFFFFF]
    starts = np.r_[np.flatnonzero(np.r_[True, own[1:] != own[:-1]]), len(own)] if len(own) else np.zeros(1, np.int64)
    bases = np.r_[0, np.cumsum(word[starts[1:] - 1] + 1)[:-1]] if len(own) else own
    values = word + np.repeat(bases, np.diff(starts))
    codes = _parts(model.smoothed(summed, contexts[order][first], counts[order][first])).astype(np.uint16)
    levels = [EliasFano.build(x).arrays() for x in (heads, starts, values)]
    return [*levels[0], *levels[1], *levels[2], codes]


class Trie:
    """Questions to the arrays of `build_trie`."""

    def __init__(self, arrays: list[np.ndarray]):
        self.heads, self.starts, self.words = (EliasFano.of(arrays[4 * i : 4 * i + 4]) for i in range(3))
        self.codes = arrays[12]

    def look_up(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The code of each pair, and whether the trie has it."""
        codes, there = np.zeros(len(word), np.int64), np.zeros(len(word), bool)
        node, known = self.heads.successor(context)
        at = np.flatnonzero(known)
        start, stop = self.starts.get(node[at]), self.starts.get(node[at] + 1)
        base = np.where(start > 0, self.words.get(np.maximum(start - 1, 0)) + 1, 0)
        place, same = self.words.successor(base + word[at])
        good = same & (place < stop)
        there[at[good]] = True
        codes[at[good]] = self.codes[place[good]]
        return codes, there


def _answer(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """Sums by document of what a shard's trie says of the pairs of each block; rows with documents go through."""
    names = ["block", "sums", "docs", "known", "logs"]
    for rows in gathered(batches, "shard"):
        head = rows.filter(pc.is_valid(rows["known"]))
        if head.num_rows:
            for batch in head.drop_columns(["shard", "pairs"]).append_column("sums", pa.nulls(head.num_rows, pa.binary())).select(names).combine_chunks().to_batches():
                yield batch
        own = rows.filter(pc.is_valid(rows["pairs"]))
        asks = [unpack_all(x.as_py()) for x in own["pairs"]]
        if not asks:
            continue
        context = np.concatenate([np.repeat(np.cumsum(x[0]), x[1]) for x in asks])
        contexts = np.concatenate([np.repeat(x[2], x[1]) for x in asks])
        word, counts, trained = (np.concatenate([x[i] for x in asks]) for i in (3, 4, 5))
        kept = np.flatnonzero(trained)
        codes = np.empty(len(word), np.int64)
        with MappedArrays(build_trie(context[kept], word[kept], trained[kept], contexts[kept], counts[kept], model)) as arrays:
            trie = Trie(arrays)
            for at in range(0, len(word), AT_ONCE):
                part = slice(at, at + AT_ONCE)
                found, there = trie.look_up(context[part], word[part])
                codes[part] = np.where(there, found, _parts(model.smoothed(0.0, contexts[part], counts[part])))
            del trie, arrays
        at, sums = 0, []
        for x in asks:
            n = len(x[3])
            total = np.bincount(x[7], np.repeat(codes[at : at + n], x[6])).astype(np.int64)
            there = np.flatnonzero(total)
            sums.append(pack_all([there, total[there]]))
            at += n
        n = len(asks)
        yield pa.RecordBatch.from_arrays([own["block"].combine_chunks() if not isinstance(own["block"], pa.ChunkedArray) else pa.concat_arrays(own["block"].chunks), pa.array(sums, pa.binary()), pa.nulls(n, rows.schema.field("docs").type), pa.nulls(n, pa.binary()), pa.nulls(n, pa.list_(pa.float64()))], names=names)


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in gathered(batches, "block"):
        own, whole = _whole_row(rows, "known")
        docs = _documents(own)
        lengths, total, known = unpack_all(whole["known"])
        for x in rows.filter(pc.is_valid(rows["sums"]))["sums"]:
            there, sums = unpack_all(x.as_py())
            total[there] += sums
        columns = [docs.field("doc"), docs.field("held"), pa.array(lengths), pa.array(known), pa.array(whole["logs"], pa.float64()), pa.array(-total / PARTS)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc", "held_out", "n_tokens", "n_known", "base_score", "score"])


def score_texts(documents: DataFrame, held_out: Column, id_column: str = "doc_id", text: str = "text", mass: float = MASS) -> DataFrame:
    """doc, held_out, n_tokens, n_known, train_tokens, base_score and score of each row; texts not held out train the model."""
    spark = documents.sparkSession
    docs = documents.select(F.col(id_column).alias("doc"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text).alias("text"))
    kind = docs.schema["doc"].dataType.simpleString()
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = materialise(token_blocks(docs, shards), "tokens")
    asked = own.filter("shard is not null").select("block", "shard", "words", "at", "counts").repartition(shards, "shard").sortWithinPartitions("shard")
    answers = "block long, at binary, numbers binary, totals binary, tokens long, kinds long"
    words = materialise(map_batches(asked, lambda batches: _number(batches, shards), answers), "words")
    sums = words.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "kinds"))).first()
    model = Model(sums.tokens, sums.kinds, max(shards, sums.tokens // SHARD_TOKENS), mass)
    rows = own.filter("shard is null").select("block", "docs", "lengths", "places").unionByName(words.drop("tokens", "kinds"), allowMissingColumns=True)
    rows = rows.repartition("block").sortWithinPartitions("block")
    held = f"docs array<struct<doc: {kind}, held: boolean>>, known binary, logs array<double>"
    asks = map_batches(rows, lambda batches: _ask(batches, model), f"shard long, block long, pairs binary, {held}")
    near = asks.repartition(model.shards, "shard").sortWithinPartitions("shard")
    told = map_batches(near, lambda batches: _answer(batches, model), f"block long, sums binary, {held}")
    back = told.repartition("block").sortWithinPartitions("block")
    scored = map_batches(back, _score, f"doc {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.withColumn("train_tokens", F.lit(sums.tokens).cast("long"))
