"""Arrow steps over frames: rows are handled a few at a time, and workers give memory back between tasks."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


#: Rows handled at once; Spark's own batches hold up to 10,000 texts.
ROWS = 2048


def give_back() -> None:
    """Returns freed memory to the system: Spark keeps workers for later tasks, beside the executor's heap."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


_rows = 0


def used(rows: int, most: int = 50_000) -> None:
    """Gives memory back once so many rows were handled: small groups needn't each pay for it."""
    global _rows
    _rows += rows
    if _rows >= most:
        _rows = 0
        give_back()


def stream(df: DataFrame, step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow with small batches."""

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                yield b.slice(lo, ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from step(small(batches))
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def add_columns(df: DataFrame, schema: T.StructType, make: Callable[[pa.RecordBatch], list]) -> DataFrame:
    """df with the columns of `schema`, made batch by batch; columns of these names that df has are replaced.

    make: gets a batch of df's rows, returns one Arrow array or list for each new column.
    """
    kept = [c for c in df.columns if c not in schema.names]
    types = [to_arrow_type(f.dataType) for f in schema]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(make(b), types, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in kept] + new, [*kept, *schema.names])

    out = T.StructType([f for f in df.schema if f.name in kept] + list(schema))
    return stream(df, step, out)


def expand(df: DataFrame, schema: T.StructType, make: Callable[[pa.RecordBatch], Iterator[dict | None]]) -> DataFrame:
    """Any number of rows for each batch of df: make yields dicts of arrays or lists by column name."""
    types = {f.name: to_arrow_type(f.dataType) for f in schema}

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in make(b):
                if part:
                    yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, types[n]) for n, x in ((n, part[n]) for n in types)], [*types])

    return stream(df, step, schema)


def blobs(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of each text."""
    wide = pa.types.is_large_string(column.type)
    return column.cast(pa.large_binary() if wide else pa.binary()).to_pylist()
