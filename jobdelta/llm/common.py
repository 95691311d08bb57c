"""What the operators of this folder share: row folds, texts in Arrow batches, per-worker tables, written tables."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobdelta.session import materialize

#: Characters of text that a Python step handles at once; bounds its lists, whatever the size of an Arrow batch.
SLICE_CHARS = 1 << 20


def fold(doc_id: Column | str, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % parts


def texts_of(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, null text as empty: further columns, whatever their names, play no part."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def written(df: DataFrame, name: str) -> DataFrame:
    """A table in the shared folder: computed once, and read again when an executor is lost."""
    return materialize(df, f"llm-{name}")


def once(key: str, make: Callable):
    """`make()`, kept for later tasks of the same Python worker.

    Functions may reach workers by value, so module globals do not outlive a task; the interpreter's `sys` does.
    """
    kept = sys.__dict__.setdefault("_jobdelta_llm", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def slices(texts: list[str], chars: int = SLICE_CHARS) -> Iterator[list[str]]:
    """Runs of texts of about `chars` characters; a text is never cut."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def sized(batch: pa.RecordBatch, column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows that hold about `limit` bytes of a string or binary column."""
    ends = np.cumsum(np.asarray(pa.compute.binary_length(batch.column(column)).fill_null(0)), dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def binaries(data: np.ndarray | bytes, lengths: np.ndarray) -> pa.Array:
    """An Arrow binary column from its values, one after the other."""
    ends = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=ends[1:])
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column in one array, and where each row ends (with a leading 0)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    ends = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def unused(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
