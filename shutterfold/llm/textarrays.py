"""Whole-column text arithmetic for Arrow batches.

A batch of texts is one byte buffer plus offsets, so words, word hashes and
word n-gram hashes of all its documents come from a few numpy passes instead
of a Python loop over words.  Words are maximal runs of bytes outside
``\\x20\\x09-\\x0D``; ``A``-``Z`` hash like ``a``-``z``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_MULT = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_INV = pow(_MULT, -1, 1 << 64)

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _byte_values() -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULT))
    values[65:91] = values[97:123]
    return values


BYTE_VALUES = _byte_values()

#: Also splits at ASCII punctuation: words are then runs of ASCII letters, digits and non-ASCII bytes.
PUNCTUATION = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``_MULT**i`` and its inverse for i < n, modulo 2**64; grown by doubling and kept."""
    global _powers
    while len(_powers[0]) < n:
        up, down = _powers
        k = len(up)
        _powers = (
            np.concatenate([up, up * np.uint64(pow(_MULT, k, 1 << 64))]),
            np.concatenate([down, down * np.uint64(pow(_INV, k, 1 << 64))]),
        )
    return _powers


class Words:
    """The words of a run of documents.

    ``data`` bytes, ``offsets`` of the documents in it, ``start``/``end`` of
    each word in bytes, ``first``: index of the first word of each document
    (one more entry than documents).
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SEPARATOR):
        n = len(data)
        separator = separators[data]
        opens = np.zeros(n + 1, bool)
        opens[offsets] = True
        start = ~separator
        end = start.copy()
        if n:
            start[1:] &= separator[:-1] | opens[1:n]
            end[:-1] &= separator[1:] | opens[1:n]
        self.data, self.offsets = data, offsets
        self.start = np.flatnonzero(start)
        self.end = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.start, offsets)

    def hashes(self) -> np.ndarray:
        """One 64-bit hash per word, independent of where it stands."""
        up, down = _power_tables(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(BYTE_VALUES[self.data] * up[: len(self.data)], out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * down[self.start])


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of ``words[i:i+n]`` for every i where it fits."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    out = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        out = out * np.uint64(_MULT) + words[i : len(words) - n + 1 + i]
    return mix(out)


def chunks(texts: pa.Array | pa.ChunkedArray, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Splits a text column into runs of documents of about ``most`` bytes.

    Yields (from row, to row, bytes, offsets); nulls are empty; a longer text
    is a run of its own.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if len(texts) == 0:
        return
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        hi = min(hi, len(texts))
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def shingle_sets(words: Words, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct n-word shingle hashes of each document; a shorter word sequence is one shingle."""
    hashes = words.hashes()
    grams = ngram_hashes(hashes, n)
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        if b - a >= n:
            yield np.unique(grams[a : b - n + 1])
        elif b > a:
            yield ngram_hashes(hashes[a:b], int(b - a))
        else:
            yield np.empty(0, np.uint64)
