"""Arrow plumbing shared by the operators that run Python over whole texts."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Characters of text handled at once; longer single texts are handled alone.
SLICE_CHARS = 2_000_000


def slices(texts: list[str], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of a batch whose texts together stay below ``limit`` characters."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > limit:
            yield start, i
            start, size = i, 0
        size += len(t or "")
    if start < len(texts):
        yield start, len(texts)


def parts(b: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """``b`` in runs of rows whose texts in column ``at`` together stay below SLICE_CHARS bytes; longer single texts are alone."""
    start = size = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(b.column(at)), 0).to_pylist()):
        if size and size + n > SLICE_CHARS:
            yield b.slice(start, i - start)
            start, size = i, 0
        size += n
    yield b.slice(start)


def _tidy() -> None:
    """Give freed memory back to the system: a worker lives through many tasks, beside others in one executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``df.mapInArrow(run, schema)``, with the worker's memory tidied behind each task."""

    def tidied(batches):
        yield from run(batches)
        _tidy()

    return df.mapInArrow(tidied, schema)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has, in any case."""
    taken = {c.lower() for c in df.columns}
    end = "_"
    while any(f"{n}{end}".lower() in taken for n in names):
        end += "_"
    return [f"{n}{end}" for n in names]


def map_rows(df: DataFrame, schema: T.StructType | str, fn: Callable[..., dict[str, list]], by: str | None = None) -> DataFrame:
    """Apply ``fn(column lists...) -> {column: list}`` to batches of all columns of ``df``; to parts with SLICE_CHARS bytes of the text column ``by``, if given."""
    out = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(out)
    at = None if by is None else df.columns.index(by)

    def run(batches):
        for b in batches:
            for part in [b] if at is None else parts(b, at):
                if part.num_rows:
                    got = fn(*(c.to_pylist() for c in part.columns))
                    yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in arrow], schema=arrow)

    return map_batches(df, run, out)


def filter_rows(df: DataFrame, column: str, keep: Callable[[list], list]) -> DataFrame:
    """Rows of ``df`` for which ``keep(values of column)`` is true; all columns pass through unchanged."""
    at = df.columns.index(column)

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(keep(b.column(at).to_pylist()), pa.bool_()))

    return map_batches(df, run, df.schema)
