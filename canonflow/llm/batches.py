"""Columns computed from a text column, batch by batch in Arrow, beside all columns that a table has."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .words import shards

#: Text bytes of the parts in which a batch is handled, which bounds a worker's memory.
PART_BYTES = 4 << 20


def with_columns(df: DataFrame, text_column: str, added: T.StructType, compute: Callable[[pa.Array], list[pa.Array]]) -> DataFrame:
    """df with the columns `added`, which replace columns of those names. compute: from a batch's texts (strings, null kept), an array per added column."""
    df = df.drop(*[f.name for f in added.fields if f.name != text_column])
    fields = [f for f in df.schema.fields]
    at = df.columns.index(text_column)
    types = [f.type for f in to_arrow_schema(added)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first, end, _, _ in shards(whole.column(at).cast(pa.large_string()), PART_BYTES):
                batch = whole.slice(first, end - first)
                new = [x.cast(t) if x.type != t else x for x, t in zip(compute(batch.column(at).cast(pa.string())), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*[f.name for f in fields], *[f.name for f in added.fields]])

    return df.mapInArrow(run, T.StructType([*fields, *added.fields]))
