"""Documents in blocks of some million words, each with a dictionary of its own: what meets other tables is a row for each
distinct string of a block, not for each occurrence.

A block holds whole rows of one input partition. A document longer than a block is a block by itself. Block numbers are
made of the partition's number and a counter, so that a task that runs again makes the same blocks.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext

#: Words of a block.
BLOCK_WORDS = 1 << 20
#: Row keys and block numbers have the partition above this many bits.
SHIFT = 33


@dataclass
class Block:
    """number; rows: the columns of its documents but the text; strings: distinct ones by their place; ids: the place of
    each occurrence, document after document; lengths: occurrences in each document; words: words in each document."""

    number: int
    rows: pa.RecordBatch
    strings: list[bytes]
    ids: np.ndarray
    lengths: np.ndarray
    words: np.ndarray

    def owners(self) -> np.ndarray:
        """The document, by its place, of each occurrence."""
        return np.repeat(np.arange(len(self.lengths)), self.lengths)


def splitter(is_word: Callable[[int], bool]) -> Callable[[bytes], list[bytes]]:
    """Words of UTF-8 bytes: runs of bytes from 0x80 on and of those that is_word takes, with A-Z in lower case."""
    table = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b >= 0x80 or is_word(b) else 0x20 for b in range(256))
    return lambda text: text.translate(table).split()


def runs(low: int, high: int) -> Callable[[list[bytes]], list[bytes]]:
    """All runs of low to high consecutive words, joined by one space."""
    if (low, high) == (1, 1):
        return lambda words: words
    return lambda words: [b" ".join(words[i : i + n]) for n in range(low, high + 1) for i in range(len(words) - n + 1)]


def blocks(batches: Iterator[pa.RecordBatch], text: str, words_of: Callable[[bytes], list[bytes]], strings_of: Callable[[list[bytes]], list[bytes]] = lambda words: words) -> Iterator[Block]:
    """Blocks of the rows of one partition. A null text has no words."""
    part, made = TaskContext.get().partitionId(), 0
    place: dict[bytes, int] = defaultdict()
    place.default_factory = place.__len__
    rows, ids, lengths, words, held = [], [], [], [], 0

    def closed() -> Block:
        table = pa.Table.from_batches(rows).combine_chunks()
        whole = table.to_batches()[0] if table.num_rows else rows[0]
        return Block((part << SHIFT) + made, whole, list(place), np.concatenate(ids), np.array(lengths, np.int64), np.array(words, np.int64))

    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(text)).cast(pa.binary())
        others = batch.select([n for n in batch.schema.names if n != text])
        began = 0
        for i, value in enumerate(texts):
            found = words_of(value.as_py() or b"")
            strings = strings_of(found)
            ids.append(np.fromiter(map(place.__getitem__, strings), np.int32, len(strings)))
            lengths.append(len(strings))
            words.append(len(found))
            held += len(strings)
            if held >= BLOCK_WORDS:
                rows.append(others.slice(began, i + 1 - began))
                yield closed()
                began, made, held = i + 1, made + 1, 0
                place.clear()
                rows, ids, lengths, words = [], [], [], []
        if began < len(batch):
            rows.append(others.slice(began))
    if lengths:
        yield closed()


def string_structs(block: Block, counts: np.ndarray, names: tuple[str, str]) -> pa.Array:
    """The block's strings with their counts, as one list of structs."""
    values = pa.StructArray.from_arrays([pa.array(block.strings, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())], names=list(names))
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def row_structs(block: Block) -> pa.Array:
    """The kept columns of the block's documents, as one list of structs."""
    values = block.rows.to_struct_array()
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def pack(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on, compressed byte plane by byte plane."""
    if not len(values):
        return b""
    width = max(1, (int(values.max()).bit_length() + 7) // 8)
    planes = values.astype("<u8").view(np.uint8).reshape(len(values), 8)[:, :width].T.tobytes()
    return bytes([width]) + len(values).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    """The numbers that `pack` took, as int64."""
    if not data:
        return np.zeros(0, np.int64)
    width, n = data[0], int.from_bytes(data[1:9], "little")
    planes = pa.decompress(pa.py_buffer(data)[9:], decompressed_size=n * width, codec="zstd")
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(planes, np.uint8).reshape(width, n).T
    return out.view("<i8").ravel()


def pack_all(arrays: list[np.ndarray]) -> bytes:
    """Several arrays by `pack`, one after another."""
    parts = [pack(x) for x in arrays]
    return b"".join([bytes([len(parts)]), *(len(x).to_bytes(8, "little") for x in parts), *parts])


def unpack_all(data: bytes) -> list[np.ndarray]:
    sizes = [int.from_bytes(data[1 + 8 * i : 9 + 8 * i], "little") for i in range(data[0])]
    stops = np.cumsum([1 + 8 * len(sizes), *sizes]).tolist()
    return [unpack(data[a:b]) for a, b in zip(stops, stops[1:], strict=False)]


def gathered(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each key together, from batches that are sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for at, stop in zip(cuts, cuts[1:], strict=False):
            if at == stop:
                continue
            if held and held[-1].column(key)[0].as_py() != keys[at]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(at, stop - at))
    if held:
        yield pa.Table.from_batches(held)
