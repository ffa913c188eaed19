"""Run numpy kernels over the Arrow batches of a DataFrame, row by row in, row by row out.

``append`` keeps every input column (whatever its name) and adds the kernel's columns, without a
shuffle. Batches are cut into slices of bounded text size, so memory follows the slice, not the
partition; a text longer than the bound is a slice of its own.
"""

from __future__ import annotations

import ctypes
import gc
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

SLICE_BYTES = 1 << 20


def give_back() -> None:
    """Returns freed memory to the system: Python workers are reused, and keep what their largest task needed."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and the row offsets into them; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8).copy()
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    data = data[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def slices(column, limit: int = SLICE_BYTES):
    """Row ranges (first, last + 1) whose texts hold at most ``limit`` bytes, or one row."""
    _, offsets = text_buffers(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def append(df: DataFrame, fields: list[T.StructField], start, text: str = "text",
           keep: list[str] | None = None, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``df`` (or its columns ``keep``) plus ``fields``, computed from the column ``text``.

    ``start()`` runs once per task and returns the kernel: a function from (bytes, offsets, batch) of
    a slice to one Arrow-convertible sequence per field, one value per row.
    """
    kept = list(df.columns if keep is None else keep)
    clash = {f.name.lower() for f in fields} & {c.lower() for c in kept}
    if clash:
        raise ValueError(f"columns already there: {sorted(clash)}")
    source = df.select(*[f"`{c}`" for c in dict.fromkeys([*kept, text])])
    schema = T.StructType([source.schema[c] for c in kept] + fields)
    types = [f.type for f in to_arrow_schema(T.StructType(fields))]
    names = [f.name for f in fields]

    def run(batches):
        kernel = start()
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for i, j in slices(column, slice_bytes):
                part = batch.slice(i, j - i)
                data, offsets = text_buffers(part.column(part.schema.get_field_index(text)))
                new = [pa.array(v, type=t) if not isinstance(v, pa.Array) else v.cast(t)
                       for v, t in zip(kernel(data, offsets, part), types, strict=True)]
                old = [part.column(part.schema.get_field_index(c)) for c in kept]
                yield pa.RecordBatch.from_arrays(old + new, names=kept + names)
        del kernel
        give_back()

    return source.mapInArrow(run, schema)


def in_one_task(sample: DataFrame, function):
    """``function`` of a bounded sample as an Arrow table, run in a single Python worker (as Spark gives it one
    thread, numpy does not fight with other tasks for cores). Its result is pickled: plain arrays and tuples."""
    schema = to_arrow_schema(sample.schema)

    def run(batches):
        result = function(pa.Table.from_batches([b.cast(schema) for b in batches], schema))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(result)], pa.binary())], names=["result"])
        del result
        give_back()

    rows = sample.coalesce(1).mapInArrow(run, "result binary").collect()
    return pickle.loads(rows[0]["result"]) if rows else function(schema.empty_table())
