"""Lines of markdown documents that tables and figures are made of: runs of pipe rows and images, with what is near them.

Like the scan of headings this reads each document once, in Arrow batches, and returns small structs: no line leaves
the row of its paper but those of tables, images and captions. Null and empty markdown has none. Offsets are bytes of
the UTF-8 text; a line's stop includes its newline.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

LINE = "place:int,line:string,start:int,stop:int"
#: A paper's tables: each an array of blocks, of which those after the first continue it; the first entry holds the
#: blocks that continue no table. above: the last LOOKBACK full lines before the block.
TABLES = f"array<array<struct<block:int,lines:array<struct<{LINE}>>,continuation:boolean,above:array<struct<{LINE}>>>>>"
#: A paper's images, with the lines one and two below, then one and two above, as far as there are any.
IMAGES = f"array<struct<{LINE},near:array<struct<{LINE}>>>>"

# White space, the word that marks a continuation, how many lines above a table are looked at, what an
# image looks like, and where its caption may stand.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
CONTINUED = re.compile("continued", re.I | re.A)
LOOKBACK = 3
IMAGE = re.compile(r"[\t\n\f\r ]*!\[[^\]]*\]\([^)]+\)")
PLACES = (1, 2, -1, -2)

Line = dict[str, int | str]


def document_lines(markdown: str) -> list[Line]:
    out, start = [], 0
    for place, line in enumerate(markdown.split("\n")):
        stop = start + len(line.encode("utf-8", "replace")) + 1
        out.append({"place": place, "line": line, "start": start, "stop": stop})
        start = stop
    out[-1]["stop"] -= 1
    return out


def is_pipe(line: str) -> bool:
    bare = line.strip(WHITE)
    return bare[:1] == "|" == bare[-1:] and len(bare.encode("utf-8", "replace")) > 2


def table_blocks(markdown: str | None) -> list[list[dict]]:
    """The blocks that continue no table, then those of each table."""
    tables: list[list[dict]] = [[]]
    if not markdown or "|" not in markdown:
        return tables
    above: list[Line] = []
    block = None
    for line in document_lines(markdown):
        if is_pipe(line["line"]):
            if block is None:
                before = above[-1]["line"] if above else ""
                continues = bool(CONTINUED.search(line["line"]) or CONTINUED.search(before) or is_pipe(before))
                number = sum(map(len, tables)) + 1
                block = {"block": number, "lines": [], "continuation": continues, "above": list(above)}
                if not continues:
                    tables.append([])
                tables[-1].append(block)
            block["lines"].append(line)
        else:
            block = None
        if line["line"].strip(WHITE):
            above = [*above, line][-LOOKBACK:]
    return tables


def images(markdown: str | None) -> list[dict]:
    if not markdown or "![" not in markdown:
        return []
    lines = document_lines(markdown)
    found = [line for line in lines if "![" in line["line"] and IMAGE.match(line["line"])]
    return [{**i, "near": [lines[i["place"] + d] for d in PLACES if 0 <= i["place"] + d < len(lines)]} for i in found]


#: How many texts, and about how many bytes of them, a scan answers at a time.
ANSWERED, ANSWERED_BYTES = 64, 1 << 20


def answers(batches: Iterator[pa.Array], scan: Callable[[str | None], list], kind: pa.DataType) -> Iterator[pa.Array]:
    """What scan finds in each text, in small arrays: Python holds objects of few texts, however many came in a batch."""
    for batch in batches:
        found, size = [], 0
        for text in batch:
            size += len(text.as_buffer()) if text.is_valid else 0
            found.append(scan(text.as_py()))
            if len(found) == ANSWERED or size >= ANSWERED_BYTES:
                yield pa.array(found, kind)
                found, size = [], 0
        if found or not len(batch):
            yield pa.array(found, kind)


def scanned(text: Column, scanner: Callable[[], Callable[[str | None], list]], kind: str) -> Column:
    """What a scan finds in each text, as an array of kind; a task makes its scan by scanner."""
    out = to_arrow_type(DataType.fromDDL(kind))

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from answers(batches, scanner(), out)

    return run(text)


def detect_table_blocks(markdown: Column) -> Column:
    return scanned(markdown, lambda: table_blocks, TABLES)


def detect_images(markdown: Column) -> Column:
    return scanned(markdown, lambda: images, IMAGES)
