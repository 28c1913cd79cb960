"""Arrow text columns as bytes, cut into pieces and coded by a dictionary without a Python object for each piece."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are scanned at once; a longer text is scanned alone.
SCAN_BYTES = 8 << 20


def slices(batch: pa.RecordBatch, text: int, size: int = SCAN_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows of a batch in runs of at most ``size`` bytes of text, one row at least. Null texts become empty ones."""
    column = pc.fill_null(batch.column(text), "")
    batch = pa.RecordBatch.from_arrays([column if i == text else c for i, c in enumerate(batch.columns)], batch.schema.names)
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
        yield batch.slice(at, to - at)
        at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts one after the other, and where each begins, with the end of the last. ``column`` has no nulls."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    if data is None:
        return np.empty(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def coded(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Codes of the pieces of ``data`` that begin at ``starts`` (and reach to the next one), and the different pieces as binary values."""
    offsets = np.append(starts, len(data)).astype(np.int32)
    pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    found = pieces.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def gathered(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The stretches of ``values`` that begin at ``starts`` one after the other."""
    ends = np.cumsum(counts)
    return values[np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)]
