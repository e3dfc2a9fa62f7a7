"""New columns from texts, a few hundred rows at a time: the other columns pass through as Arrow arrays, uncopied."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from scriptorium.session import map_batches

ROWS = 256


def with_text_columns(df: DataFrame, text: str, compute: Callable[[list[str | None]], Sequence], fields: Sequence[StructField], drop: Sequence[str] = ()) -> DataFrame:
    """df with the columns of fields, replacing those of the same name, in their place or at the end.

    compute: from the texts of some rows to a list of values for each field. drop: columns that are left out.
    """
    new = {f.name: f for f in fields}
    kept = [f for f in df.schema.fields if f.name not in drop]
    out = [new.get(f.name, f) for f in kept] + [f for f in fields if f.name not in {k.name for k in kept}]
    places, kinds = [f.name for f in fields], [to_arrow_type(f.dataType) for f in fields]
    names, source = [f.name for f in out], [df.columns.index(f.name) if f.name not in new else None for f in out]
    at_text = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), ROWS):
                part = whole.slice(at, ROWS)
                made = dict(zip(places, (pa.array(v, k) for v, k in zip(compute(part.column(at_text).to_pylist()), kinds, strict=True)), strict=True))
                yield pa.RecordBatch.from_arrays([made[n] if i is None else part.column(i) for n, i in zip(names, source, strict=True)], names=names)

    return map_batches(df, run, StructType(out))
