"""Byte-level BPE encoding and decoding.

Each pretoken is encoded by backtracking: take the longest vocabulary match,
keep it when the pair with the token before it is one that merging would leave
apart, else try the next shorter match, else step back.  A token sequence is
the merge result exactly when every adjacent pair is, and pair answers are
memoised, so long pretokens take linear time.  Bytes stand as Latin-1
characters, the form in which pyahocorasick finds all vocabulary matches.

Nulls and empty texts encode to no ids; null ids decode to no bytes; empty
tables give no rows, repeated rows equal ids; very long texts are encoded
whole.  Other columns pass through; an output name that the input has already
is replaced.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MEMO = 1 << 20  # entries of each memo, which hold keys of at most 64 bytes: two full ones take some 400 MB of a worker
NEVER = 1 << 60


class Memo(dict):
    """Computes what is missing; emptied at ``most`` entries; long keys aren't kept."""

    def __init__(self, compute, most: int):
        super().__init__()
        self.compute, self.most = compute, most

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class Codec:
    """Encoder and decoder over one rank table; memo sizes are bounded."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo: int = MEMO):
        self.memo = memo
        self.ranks = {k.decode("latin-1"): v for k, v in ranks.items()}
        self.by_id = {v: k for k, v in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton()
        for piece, rank in self.ranks.items():
            self.automaton.add_word(piece, (len(piece) - 1, piece))
        self.automaton.make_automaton()
        self.shorter = Memo(self._next_shorter, memo)
        self.apart: dict[tuple[str, str], bool] = {}
        self.words = Memo(self.pretoken, memo)

    def _merge(self, text: str) -> list[str]:
        """Plain merging, lowest rank first and leftmost among equals; only for two tokens at a time."""
        parts, rank = list(text), self.ranks.get
        ranks = [rank(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) != NEVER:
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1] + parts[i], NEVER)
            if i < len(ranks):
                ranks[i] = rank(parts[i] + parts[i + 1], NEVER)
        return parts

    def _stay_apart(self, left: str, right: str) -> bool:
        if len(self.apart) >= self.memo:
            self.apart.clear()
        found = self.apart[left, right] = self._merge(left + right) == [left, right]
        return found

    def _next_shorter(self, piece: str) -> str | None:
        return next((piece[:n] for n in range(len(piece) - 1, 0, -1) if piece[:n] in self.ranks), None)

    def _backtrack(self, text: str) -> list[str]:
        longest: list[str | None] = [None] * (len(text) + 1)
        for end, (back, piece) in self.automaton.iter(text):
            longest[end - back] = piece  # ends ascend, so the last one is the longest
        open_at = [True] * (len(text) + 1)
        out: list[str] = []
        at, piece, apart, shorter = 0, longest[0], self.apart, self.shorter
        while at < len(text):
            last = out[-1] if out else None
            while piece is not None:
                if open_at[at + len(piece)]:
                    fits = last is None or apart.get((last, piece))
                    if fits is None:
                        fits = self._stay_apart(last, piece)
                    if fits:
                        break
                piece = shorter[piece]
            if piece is not None:
                out.append(piece)
                at += len(piece)
                piece = longest[at]
            else:
                if last is None:
                    raise ValueError("the vocabulary lacks a single byte")
                open_at[at] = False
                at -= len(out.pop())
                piece = last
        return out

    def pretoken(self, word: str) -> bytes:
        """Ids of one pretoken as little-endian 32-bit integers."""
        text = word.encode("utf-8", "surrogatepass").decode("latin-1")
        whole = self.ranks.get(text)
        ids = [whole] if whole is not None else [self.ranks[x] for x in self._backtrack(text)]
        return np.array(ids, "<i4").tobytes()

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.split(text)))

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.by_id.__getitem__, ids.tolist()))


@lru_cache(maxsize=4)
def codec(path: str, pattern: str, memo: int = MEMO) -> Codec:
    """One codec for each worker process."""
    return Codec(read_ranks(path), pattern, memo)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids", memo: int = MEMO) -> DataFrame:
    """Adds ``out array<int>``: ids of the whole text, each pretoken by itself, no special tokens."""

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        one = codec(path, pattern, memo)
        parts = [one.encode(x or "") for x in texts.to_pylist()]
        ends = np.zeros(len(parts) + 1, np.int32)
        np.cumsum([len(x) // 4 for x in parts], out=ends[1:])
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), "<i4")))

    return df.withColumn(out, ids(F.col(text)))


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded", memo: int = MEMO) -> DataFrame:
    """Adds ``out binary``: the bytes of the ids, which need not be valid UTF-8."""

    @F.arrow_udf("binary")
    def joined(lists: pa.Array) -> pa.Array:
        one = codec(path, pattern, memo)
        ends, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        present = lists.is_valid().to_numpy(zero_copy_only=False)
        return pa.array([one.decode(values[a:b]) if ok else b"" for a, b, ok in zip(ends[:-1], ends[1:], present, strict=True)], pa.binary())

    return df.withColumn(out, joined(F.col(ids)))


def checked(df: DataFrame, path: str, pattern: str, text: str = "text", memo: int = MEMO) -> DataFrame:
    """Adds ``ids array<int>, n_tokens long, round_trip boolean`` in one pass.

    Every task makes its own codec and gives it back at its end: the worker
    processes of a pipeline go on to other stages, which need the memory.
    """
    added = ("ids", "n_tokens", "round_trip")
    base = df.select(*(c for c in df.columns if c not in added))
    schema = T.StructType(list(base.schema.fields)).add("ids", T.ArrayType(T.IntegerType())).add("n_tokens", T.LongType()).add("round_trip", T.BooleanType())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = Codec(read_ranks(path), pattern, memo)
        for batch in batches:
            texts = [x or "" for x in batch[text].to_pylist()]
            parts = [one.encode(x) for x in texts]
            n = np.array([len(x) // 4 for x in parts], np.int64)
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(np.frombuffer(b"".join(parts), "<i4")))
            same = [one.decode(np.frombuffer(p, "<i4")) == x.encode() for p, x in zip(parts, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, ids, pa.array(n), pa.array(same, pa.bool_())], names=[*batch.schema.names, *added])

    return base.mapInArrow(task, schema)
