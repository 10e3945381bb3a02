"""Counted 64-bit keys in few bytes of shuffle.

A task that holds many hashed keys sorts them and sends, for each range of
keys (a bucket: their top bits), one row with the whole list.  Sorted keys
travel as differences without their leading zero bytes, most counts as one
byte.  A bucket's
rows meet in one group of about ``KEYS_A_BUCKET`` keys, whatever the corpus.
A key that is frequent has at most one entry for each list.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

KEYS_A_BUCKET = 1 << 20
GATHER = 1 << 20  # keys that a task holds before it sends them on
LARGE = 255
SCHEMA = "bucket long, keys binary, n binary"


def bucket_bits(keys: int) -> int:
    """Top bits of a key that name its bucket, for about so many keys in all."""
    return min(32, (keys // KEYS_A_BUCKET).bit_length())


def pack(counts: np.ndarray) -> bytes:
    """One byte a count; those of ``LARGE`` or more follow in full."""
    large = counts[counts >= LARGE].astype(np.uint64)
    return np.minimum(counts, LARGE).astype(np.uint8).tobytes() + large.tobytes() + len(large).to_bytes(8, "little")


def unpack(data: bytes) -> np.ndarray:
    large = int.from_bytes(data[-8:], "little")
    out = np.frombuffer(data, np.uint8, len(data) - 8 * (large + 1)).astype(np.uint64)
    out[out == LARGE] = np.frombuffer(data, np.uint64, large, len(out))
    return out


def pack_keys(keys: np.ndarray) -> bytes:
    """The first key, then planes of the bytes that the differences need."""
    steps = np.diff(keys)
    width = max(1, (int(steps.max(initial=0)).bit_length() + 7) // 8)
    planes = steps.view(np.uint8).reshape(-1, 8)[:, :width].T
    return keys[:1].tobytes() + bytes([width]) + np.ascontiguousarray(planes).tobytes()


def unpack_keys(data: bytes) -> np.ndarray:
    width = data[8]
    planes = np.frombuffer(data, np.uint8, offset=9).reshape(width, -1)
    out = np.zeros((planes.shape[1] + 1, 8), np.uint8)
    out[1:, :width] = planes.T
    out = out.view(np.uint64).ravel()
    out[0] = int.from_bytes(data[:8], "little")
    return np.cumsum(out, dtype=np.uint64)


def rows(keys: np.ndarray, n: np.ndarray, bits: int) -> pa.RecordBatch:
    """One row for each bucket of the sorted, distinct ``keys``."""
    bucket = keys >> np.uint64(64 - bits) if bits else np.zeros(len(keys), np.uint64)
    first = np.searchsorted(bucket, np.unique(bucket))
    ends = [*zip(first, [*first[1:], len(keys)])]
    lists = [pack_keys(keys[a:b]) for a, b in ends]
    counts = [pack(n[a:b]) for a, b in ends]
    return pa.RecordBatch.from_arrays([pa.array(bucket[first].astype(np.int64)), pa.array(lists, pa.binary()), pa.array(counts, pa.binary())], ["bucket", "keys", "n"])


def gathered(parts: Iterator[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct keys, counts) of all parts."""
    held: list[tuple[np.ndarray, np.ndarray]] = [np.unique(x, return_counts=True) for x in parts]
    return merged([k for k, _ in held], [n for _, n in held])


def merged(keys: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct keys, sums of their counts) of several lists."""
    if len(keys) == 1:
        return keys[0], n[0]
    flat = np.concatenate([np.empty(0, np.uint64), *keys])
    order = np.argsort(flat, kind="stable")
    flat, sums = flat[order], np.concatenate([np.empty(0, np.int64), *n])[order]
    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.empty(0, np.int64)
    return flat[first], np.add.reduceat(sums, first) if len(first) else sums


def mapper(column: str, parts: Callable[[pa.Array], Iterator[np.ndarray]], bits: int):
    """For ``mapInArrow``: the keys of a whole task, sent on each time ``GATHER`` of them are held."""

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in parts(batch[column]):
                held.append(part)
                size += len(part)
                if size >= GATHER:
                    yield rows(*gathered(held), bits)
                    held, size = [], 0
        if size:
            yield rows(*gathered(held), bits)

    return sent
