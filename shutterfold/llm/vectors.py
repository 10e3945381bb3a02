"""Embedding columns as matrices: which rows are usable, whole-number components, and their compact form."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scaled components must stay below this size, so that exact sums of squares fit in 64 bits.
LIMIT = 1 << 27


def finite(vector: str) -> Column:
    """True where the vector is there and none of its entries is null, NaN or infinite."""
    bad = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))
    return F.col(vector).isNotNull() & ~F.coalesce(F.exists(vector, bad), F.lit(True))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of one length as rows of doubles."""
    return np.asarray(column.flatten().cast(pa.float64())).reshape(len(column), width)


def scaled(rows: np.ndarray, scale: int = 1024) -> np.ndarray:
    """``floor(scale * x)`` as 64-bit whole numbers; larger ones than ``LIMIT`` are an error, never wrapped."""
    found = np.floor(rows * scale)
    if found.size and np.abs(found).max() >= LIMIT:
        raise OverflowError(f"a vector component times {scale} reaches {LIMIT}; exact 64-bit distances need smaller ones")
    return found.astype(np.int64)


def packed(rows: np.ndarray) -> pa.Array:
    """Each row's bytes as one binary value."""
    rows = np.ascontiguousarray(rows)
    size = rows.shape[1] * rows.itemsize
    at = np.arange(len(rows) + 1, dtype=np.int64) * size
    return pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(at), pa.py_buffer(rows)]).cast(pa.binary())


def unpacked(column: pa.Array, width: int, kind: type) -> np.ndarray:
    """The rows that ``packed`` stored."""
    if len(column) == 0:
        return np.empty((0, width), kind)
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].view(kind).reshape(len(column), width)
