"""Benchmark decontamination by spaced-seed hashing.

Fixed masks hash the words of a text at chosen offsets and ignore the others.
Training and test hashes join; every (document, item, diagonal) that a seed
hits is verified on the aligned words around its hits.  An overlap counts when
``WINDOW`` aligned words agree in at least ``SHARE`` of their places; ``MASKS``
hit every such window, wherever its substituted words stand.  Items of fewer
than ``WINDOW`` words count when all their words stand in a row, and are found
by ``SHORT_MASK``; items of fewer than ``SHORTEST`` words never count.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z folded;
null and empty texts have none, very long ones are read whole.  Ids must be
whole numbers (any integer type; others raise ``TypeError``) and come back as
longs.  One id with several texts is several documents; repeated rows are
judged once.  ``overlaps`` leaves out rows with a null id, ``clean`` judges
them.  Several passing diagonals of one pair give the one with most matches,
then the smallest.  Empty tables give empty results; other columns are not
read, and pass through ``clean``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.lineage import stored
from . import textarrays
from .keyfilter import KeyFilter

# Found by search; a test goes through all places of substituted words.
MASKS = ((0, 1, 4, 5, 6, 8, 9), (0, 1, 3, 5, 6, 7, 8), (0, 1, 2, 4, 5, 8, 10))
SHORT_MASK = (0, 1, 3, 4)
WINDOW = 13
SHARE = 0.8
SHORTEST = 5


def _tokens(texts) -> Iterator[tuple[int, textarrays.Words, np.ndarray]]:
    for lo, _, data, offsets in textarrays.chunks(texts):
        words = textarrays.Words(data, offsets, textarrays.PUNCTUATION)
        yield lo, words, words.hashes()


def _seeds(hashes: np.ndarray, mask: tuple[int, ...], salt: int) -> np.ndarray:
    n = len(hashes) - mask[-1]
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, salt + 1, np.uint64)
    for offset in mask:
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[offset : offset + n]
    return textarrays.mix(out)


def _keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    """``id, rid, text``: rid tells documents apart, also where an id repeats or is null."""
    if not isinstance(df.schema[key].dataType, T.IntegralType):
        raise TypeError(f"column {key} must hold whole numbers, not {df.schema[key].dataType.simpleString()}")
    return df.select(F.col(key).cast("long").alias("id"), F.xxhash64(F.col(key).cast("long"), F.col(text)).alias("rid"), F.col(text).alias("text"))


def seed_rows(keyed: DataFrame, keep: KeyFilter | None = None) -> DataFrame:
    """``rid, pos, seed, words`` for every mask and position of every text; only members of ``keep``, where given."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["rid"].to_numpy()
            for lo, words, hashes in _tokens(batch["text"]):
                for salt, mask in enumerate((*MASKS, SHORT_MASK)):
                    seeds = _seeds(hashes, mask, salt)
                    at = np.flatnonzero(keep(seeds)) if keep is not None else np.arange(len(seeds))
                    doc = np.searchsorted(words.first, at, "right") - 1
                    inside = at + mask[-1] < words.first[doc + 1] if len(at) else np.empty(0, bool)
                    at, doc = at[inside], doc[inside]
                    columns = ids[lo + doc], (at - words.first[doc]).astype(np.int32), seeds[at].view(np.int64), np.diff(words.first)[doc].astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns] + [pa.array(np.full(len(at), mask == SHORT_MASK))], ["rid", "pos", "seed", "words", "short"])

    return keyed.select("rid", "text").mapInArrow(rows, "rid long, pos int, seed long, words int, short boolean")


def token_rows(keyed: DataFrame, keep: KeyFilter | None = None) -> DataFrame:
    """``rid, id, tokens array<long>``, each document once; only those whose rid is in ``keep``, where given."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if keep is not None:
                batch = batch.filter(pa.array(keep(batch["rid"].to_numpy())))
            for lo, words, hashes in _tokens(batch["text"]):
                n = len(words.first) - 1
                tokens = pa.ListArray.from_arrays(pa.array(words.first.astype(np.int32)), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch["rid"].slice(lo, n), batch["id"].slice(lo, n), tokens], ["rid", "id", "tokens"])

    found = keyed.select("rid", "id", "text").mapInArrow(rows, "rid long, id long, tokens array<long>")
    return found.groupBy("rid").agg(F.first("id").alias("id"), F.first("tokens").alias("tokens"))


def verify(doc: np.ndarray, item: np.ndarray, item_words: int) -> tuple[int, int, int] | None:
    """(first word, end, matches) of the overlap of aligned words of an item of ``item_words``, or None when it is too weak."""
    width = min(WINDOW, item_words)
    need = math.ceil(SHARE * width - 1e-9) if item_words >= WINDOW else width
    if item_words < SHORTEST or len(doc) < width:
        return None
    sums = np.concatenate([[0], np.cumsum(doc == item)])
    good = np.flatnonzero(sums[width:] - sums[:-width] >= need)
    if not len(good):
        return None
    a, b = int(good[0]), int(good[-1]) + width
    return a, b, int(sums[b] - sums[a])


def _leaks(docs: DataFrame, items: DataFrame, doc_key: str, item_key: str, text: str) -> DataFrame:
    """``rid, doc_id, item_id, diagonal, item_start, item_end, matched``: every diagonal that passes, in words."""
    train_texts, test_texts = _keyed(docs, doc_key, text), _keyed(items, item_key, text)
    long_enough = (F.col("words") >= SHORTEST) & (F.col("short") == (F.col("words") < WINDOW))
    test = stored(seed_rows(test_texts).where(long_enough).selectExpr("rid AS item_rid", "pos AS item_pos", "seed"))
    train = seed_rows(train_texts, KeyFilter(test, "seed")).selectExpr("rid", "pos AS doc_pos", "seed")
    placed = train.join(test, "seed").select("rid", "item_rid", "item_pos", (F.col("doc_pos") - F.col("item_pos")).alias("diagonal"))
    hits = stored(placed.groupBy("rid", "item_rid", "diagonal").agg(F.min("item_pos").alias("lo"), F.max("item_pos").alias("hi")))  # read twice
    doc_tokens = token_rows(train_texts, KeyFilter(hits.select("rid").distinct(), "rid")).selectExpr("rid", "id AS doc_id", "tokens AS doc_tokens")
    item_tokens = token_rows(test_texts).selectExpr("rid AS item_rid", "id AS item_id", "tokens AS item_tokens")

    @F.arrow_udf("struct<start:int,end:int,matched:int>")
    def verified(doc: pa.Array, item: pa.Array, words: pa.Array) -> pa.Array:
        d, i = doc.values.to_numpy(), item.values.to_numpy()
        do, io = doc.offsets.to_numpy(), item.offsets.to_numpy()
        found = [verify(d[do[k] : do[k + 1]], i[io[k] : io[k + 1]], n) for k, n in enumerate(words.to_pylist())]
        return pa.array([dict(zip(("start", "end", "matched"), x, strict=True)) if x else None for x in found], pa.struct([("start", pa.int32()), ("end", pa.int32()), ("matched", pa.int32())]))

    # every window that passes holds a hit, so the words within a window's length of the hits decide
    first = F.greatest(F.col("lo") - (WINDOW - 1), F.lit(0), -F.col("diagonal"))
    last = F.least(F.col("hi") + WINDOW, F.size("item_tokens"), F.size("doc_tokens") - F.col("diagonal"))
    around = (
        hits.join(item_tokens, "item_rid").join(doc_tokens, "rid").withColumns({"first": first, "length": F.greatest(last - first, F.lit(0))})
        .select("rid", "doc_id", "item_id", "diagonal", "first", F.size("item_tokens").alias("n"),
                F.slice("doc_tokens", F.col("first") + F.col("diagonal") + 1, F.col("length")).alias("d"), F.slice("item_tokens", F.col("first") + 1, F.col("length")).alias("i"))
    )
    judged = around.withColumn("v", verified("d", "i", "n")).where("v is not null")
    return judged.selectExpr("rid", "doc_id", "item_id", "diagonal", "first + v.start AS item_start", "first + v.end AS item_end", "v.matched AS matched")


def overlaps(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """``doc_id, item_id, doc_start, doc_end, item_start, item_end, matched``: one row per leaking pair, in words."""
    best = F.min(F.struct((-F.col("matched")).alias("m"), "diagonal", "item_start", "item_end", "matched")).alias("b")
    pairs = _leaks(docs, items, doc_key, item_key, text).where("doc_id is not null and item_id is not null").groupBy("doc_id", "item_id").agg(best)
    return pairs.selectExpr(
        "doc_id", "item_id", "b.item_start + b.diagonal AS doc_start", "b.item_end + b.diagonal AS doc_end", "b.item_start AS item_start", "b.item_end AS item_end", "b.matched AS matched"
    )


def clean(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """The documents that no item leaks into; rows and columns as they were."""
    leaking = _leaks(docs, items, doc_key, item_key, text).select(F.col("rid").alias("__rid")).distinct()
    keyed = docs.withColumn("__rid", F.xxhash64(F.col(doc_key).cast("long"), F.col(text)))
    return keyed.join(leaking, "__rid", "left_anti").select(*docs.columns)
