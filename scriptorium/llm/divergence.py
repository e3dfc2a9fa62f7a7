"""How far the sources of a language differ in their use of words.

Terms are runs of letters a-z and of characters beyond ASCII, with A-Z in lower case. A language keeps the terms that
stand in at least `least_documents` of its documents. A group (a source within a language) and each language as a whole
give each kept term a smoothed share p in billionths, exact whole numbers. The divergence of p from q is
floor((p - q) ** 2 / q). Pairs of sources are compared over all kept terms; single terms of a group are compared with
their language, and the terms that the group overuses are ranked.

Terms that a language's sources use equally often have the same count vector, and so the same shares. Vectors are kept
sparse, deduplicated with their multiplicity, and each pair is evaluated once for each distinct vector.

Null texts have no terms, null languages and sources are empty strings. Groups without terms, or of a language that
keeps none, take part with a count of 0. Repeated rows and ids are documents of their own. Equal values are ranked by the
item's bytes. An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scriptorium.llm.word_blocks import Block, blocks, splitter
from scriptorium.session import map_batches, materialise

UNIT = 1_000_000_000
TERMS = splitter(lambda b: 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)
#: Sources on each side of a cell of the pairs' matrix, and elements of the cube that is evaluated at once.
CELL, CUBE = 512, 1 << 21
#: A count vector as bytes: source (a hash) and count for each source with the term, by source.
ENTRY = np.dtype([("source", "<i8"), ("count", "<i8")])


def _firsts(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    changed = np.zeros(len(columns[0]), bool)
    changed[0] = True
    for c in columns:
        changed[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(changed)


def _vectors(entries: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Runs of entries as binary values; starts: of each run."""
    offsets = np.r_[starts, len(entries)].astype(np.int64) * ENTRY.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(entries.tobytes())]).cast(pa.binary())


def _entries(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The entries of all of a column's vectors, and how many each has."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(column) and column.buffers()[2] else np.zeros(0, np.uint8)
    return data.view(ENTRY), np.diff(offsets) // ENTRY.itemsize


def _count(block: Block) -> pa.RecordBatch:
    """A row for each language and term of a block: its documents and its count in each source."""
    langs, lang = np.unique(np.array(block.rows.column("lang").to_pylist(), object).astype(str), return_inverse=True)
    source = block.rows.column("source").to_numpy(zero_copy_only=False)
    owner = block.owners()
    order = np.sort(owner << 32 | block.ids)
    first = _firsts(order)
    doc, term, count = order[first] >> 32, order[first] & 0xFFFFFFFF, np.diff(np.r_[first, len(order)])
    by = np.lexsort((source[doc], term, lang[doc]))
    doc, term, count = doc[by], term[by], count[by]
    cell = _firsts(lang[doc], term, source[doc])
    entries = np.zeros(len(cell), ENTRY)
    entries["source"] = source[doc[cell]]
    entries["count"] = np.add.reduceat(count, cell) if len(cell) else 0
    row = _firsts(lang[doc], term)
    documents = np.diff(np.r_[row, len(doc)])
    strings = pa.array(block.strings, pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays(
        [pa.array(langs.astype(object), pa.string()).take(pa.array(lang[doc[row]])), strings.take(pa.array(term[row])), pa.array(documents, pa.int64()), _vectors(entries, np.searchsorted(cell, row))],
        names=["lang", "term", "documents", "vector"],
    )


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, "text", TERMS):
        if len(block.ids):
            yield _count(block)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the same language and term, which follow each other, as one."""

    def merged(table: pa.RecordBatch) -> pa.RecordBatch:
        lang, term = (table.column(n).dictionary_encode() for n in ("lang", "term"))
        head = _firsts(*(x.indices.to_numpy() for x in (lang, term)))
        entries, sizes = _entries(table.column("vector"))
        run = np.repeat(np.arange(len(head)), np.diff(np.r_[head, len(table)]))
        owner = np.repeat(run, sizes)
        by = np.lexsort((entries["source"], owner))
        owner, entries = owner[by], entries[by]
        cell = _firsts(owner, entries["source"])
        out = entries[cell].copy()
        out["count"] = np.add.reduceat(entries["count"], cell)
        documents = np.add.reduceat(table.column("documents").to_numpy(), head)
        names = [table.column(n).take(pa.array(head)) for n in ("lang", "term")]
        return pa.RecordBatch.from_arrays([*names, pa.array(documents), _vectors(out, _firsts(owner[cell]))], names=table.schema.names)

    held: pa.RecordBatch | None = None
    for batch in batches:
        if not len(batch):
            continue
        own = merged(batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0])
        if len(own) > 1:
            yield own.slice(0, len(own) - 1)
        held = own.slice(len(own) - 1)
    if held is not None:
        yield held


def kept_terms(docs: DataFrame, least_documents: int) -> DataFrame:
    """lang, term and vector of each term in enough documents of its language. docs: lang, source (a hash) and text."""
    counted = map_batches(docs, _blocks, "lang string, term string, documents long, vector binary")
    near = counted.repartition("lang", "term").sortWithinPartitions("lang", "term")
    return map_batches(near, _merge, counted.schema).filter(F.col("documents") >= least_documents).drop("documents")


def _group_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of counts by language and source, and of terms by language (source null)."""
    for batch in batches:
        entries, sizes = _entries(batch.column("vector"))
        lang = batch.column("lang").dictionary_encode()
        codes, names = lang.indices.to_numpy(), lang.dictionary
        owner = np.repeat(codes, sizes)
        by = np.lexsort((entries["source"], owner))
        owner, entries = owner[by], entries[by]
        cell = _firsts(owner, entries["source"])
        if not len(cell):
            continue
        terms = np.bincount(codes, minlength=len(names))
        none = pa.nulls(len(names), pa.int64())
        own = [pa.concat_arrays([names.take(pa.array(owner[cell])), names])]
        own.append(pa.concat_arrays([pa.array(entries["source"][cell]), none]))
        own.append(pa.array(np.r_[np.add.reduceat(entries["count"], cell), terms]))
        yield pa.RecordBatch.from_arrays(own, names=["lang", "source", "count"])


class Groups:
    """The groups of each language: sources (hashes, sorted), what their shares are divided by, and that of the language.

    A result has a row for each ordered pair of a language's groups, so this table is far smaller than it.
    """

    def __init__(self, groups: list[tuple[str, int]], counts: list[tuple[str, int | None, int]]):
        terms = {lang: n for lang, source, n in counts if source is None}
        sums = {(lang, source): n for lang, source, n in counts if source is not None}
        self.sources: dict[str, np.ndarray] = {}
        self.below: dict[str, list[int]] = {}
        self.whole: dict[str, int] = {}
        by: dict[str, list[int]] = {}
        for lang, source in groups:
            by.setdefault(lang, []).append(source)
        for lang, sources in by.items():
            own = np.sort(np.array(sources, np.int64))
            self.sources[lang] = own
            self.below[lang] = [sums.get((lang, int(s)), 0) + terms.get(lang, 0) for s in own]
            self.whole[lang] = sum(self.below[lang]) - (len(own) - 1) * terms.get(lang, 0)


def shares(counts: np.ndarray, below: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (count + 1) / below), exact for any size."""
    if not counts.size or int(counts.max()) < (1 << 63) // UNIT - 2:
        return 1 + UNIT * (counts + 1) // below
    wide = UNIT * (counts.astype(object) + 1) // below.astype(object)
    return 1 + wide.astype(np.int64)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q) ** 2 / q); shares are at most UNIT + 1, so all fits 64 bits."""
    return (p - q) ** 2 // q


def _pairs(batches: Iterator[pa.RecordBatch], groups: Groups) -> Iterator[pa.RecordBatch]:
    """Partial sums of pairs of sources over distinct vectors: each vector is evaluated for each pair of its cell once."""
    sums: dict[tuple[str, int], np.ndarray] = {}

    def told() -> Iterator[pa.RecordBatch]:
        for (lang, cell), values in sums.items():
            own = groups.sources[lang]
            side = -(-len(own) // CELL)
            a, b = own[cell // side * CELL :][:CELL], own[cell % side * CELL :][:CELL]
            names = pa.array([lang] * values.size, pa.string())
            yield pa.RecordBatch.from_arrays([names, pa.array(np.repeat(a, len(b))), pa.array(np.tile(b, len(a))), pa.array(values.ravel())], names=["lang", "source", "other", "value"])
        sums.clear()

    for batch in batches:
        entries, sizes = _entries(batch.column("vector"))
        lang = batch.column("lang").dictionary_encode()
        codes, cells, times = lang.indices.to_numpy(), batch.column("cell").to_numpy(), batch.column("times").to_numpy()
        starts = np.r_[0, np.cumsum(sizes)]
        for code, name in enumerate(lang.dictionary.to_pylist()):
            own, below = groups.sources[name], np.array(groups.below[name], np.int64)
            side = -(-len(own) // CELL)
            for cell in np.unique(cells[codes == code]).tolist():
                mine = np.flatnonzero((codes == code) & (cells == cell))
                a, b = slice(cell // side * CELL, (cell // side + 1) * CELL), slice(cell % side * CELL, (cell % side + 1) * CELL)
                total = sums.setdefault((name, cell), np.zeros((len(own[a]), len(own[b])), np.int64))
                step = max(1, CUBE // max(total.size, len(own)))
                for at in range(0, len(mine), step):
                    rows = mine[at : at + step]
                    dense = np.zeros((len(rows), len(own)), np.int64)
                    where = np.repeat(np.arange(len(rows)), sizes[rows])
                    found = entries[np.concatenate([np.arange(starts[r], starts[r + 1]) for r in rows])]
                    dense[where, np.searchsorted(own, found["source"])] = found["count"]
                    p = shares(dense, below)
                    total += (divergence(p[:, a, None], p[:, None, b]) * times[rows, None, None]).sum(0)
        if len(sums) > 32:
            yield from told()
    yield from told()


def _terms(batches: Iterator[pa.RecordBatch], groups: Groups, ranks: int) -> Iterator[pa.RecordBatch]:
    """Terms that a group overuses, with their divergence; of a batch's terms of a group those that can get a rank."""
    for batch in batches:
        entries, sizes = _entries(batch.column("vector"))
        lang = batch.column("lang").dictionary_encode()
        codes = lang.indices.to_numpy()
        row = np.repeat(np.arange(len(batch)), sizes)
        totals = np.add.reduceat(entries["count"], np.r_[0, np.cumsum(sizes)[:-1]]) if len(entries) else np.zeros(0, np.int64)
        for code, name in enumerate(lang.dictionary.to_pylist()):
            mine = np.flatnonzero(codes[row] == code)
            own = groups.sources[name]
            place = np.searchsorted(own, entries["source"][mine])
            p = shares(entries["count"][mine], np.array(groups.below[name], np.int64)[place])
            q = shares(totals[row[mine]], np.full(len(mine), groups.whole[name], np.int64))
            value = divergence(p, q)
            keep = np.flatnonzero(p > q)
            order = keep[np.lexsort((-value[keep], place[keep]))]
            first = _firsts(place[order])
            size = np.diff(np.r_[first, len(order)])
            least = np.repeat(value[order[first + np.minimum(size, ranks) - 1]], size) if len(first) else np.zeros(0, np.int64)
            kept = order[value[order] >= least]
            if len(kept):
                columns = [pa.array([name] * len(kept), pa.string()), pa.array(own[place[kept]]), batch.column("term").take(pa.array(row[mine[kept]])), pa.array(value[kept])]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "item", "value"])


def hashed_sources(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs with its source as a 64-bit hash, and the groups: lang, name and source (its hash), no two names alike.

    The hashes are checked on the groups; should two names of one language meet, another seed is taken.
    """
    for seed in range(64):
        code = F.xxhash64(F.lit(seed), F.col("source"))
        groups = materialise(docs.select("lang", F.col("source").alias("name"), code.alias("source")).distinct(), "groups")
        if groups.groupBy("lang", "source").count().filter("count > 1").isEmpty():
            return docs.withColumn("source", code), groups
    raise RuntimeError("hashes of sources meet under every seed")


def source_divergence(documents: DataFrame, least_documents: int = 3, ranks: int = 200, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, part, item, value and rank: part `pair` compares sources, part `term` a group's words with its language's."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    docs = documents.select(plain(lang).alias("lang"), plain(source).alias("source"), F.col(text).alias("text"))
    docs, named = hashed_sources(docs)
    kept = materialise(kept_terms(docs, least_documents), "terms")
    counts = map_batches(kept, _group_counts, "lang string, source long, count long").groupBy("lang", "source").agg(F.sum("count").alias("count"))
    groups = Groups([(r.lang, r.source) for r in named.collect()], [tuple(r) for r in counts.collect()])

    side = {name: -(-len(own) // CELL) for name, own in groups.sources.items()}
    cells = documents.sparkSession.createDataFrame([(name, i) for name, n in side.items() for i in range(n * n)], "lang string, cell int")
    vectors = kept.groupBy("lang", "vector").agg(F.count(F.lit(1)).alias("times")).join(F.broadcast(cells), "lang")
    sums = map_batches(vectors.select("lang", "cell", "times", "vector"), lambda batches: _pairs(batches, groups), "lang string, source long, other long, value long")
    sums = sums.groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    other = named.select("lang", F.col("name").alias("item"), F.col("source").alias("other"))
    pairs = named.join(other, "lang").filter("source <> other").join(sums, ["lang", "source", "other"], "left")
    pairs = pairs.select("lang", F.col("name").alias("source"), F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))

    over = map_batches(kept, lambda batches: _terms(batches, groups, ranks), "lang string, source long, item string, value long")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    top = over.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= ranks)
    top = top.join(F.broadcast(named), ["lang", "source"]).select("lang", F.col("name").alias("source"), F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(top)
