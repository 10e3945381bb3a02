"""Cross-entropy difference between matched target and background bigram models.

Both models share one vocabulary -- every word of either corpus, the end of a
text and one unknown word -- and one smoothing; only their counts differ.  All
words and all bigrams count, however rare; no list is cut.

    p(w)     = (c(w) + 1) / (words + texts + vocabulary + 2)
    p(w | h) = (c(h w) + PRIOR * p(w)) / (c(h) + PRIOR)

``c(h)`` counts every ``h``: each is followed by a word or by the end, so the
probabilities of all words, the end and the unknown word sum to one after
every ``h``.  The first word of a text has ``p(w)``; ends are not scored.

Documents are written once as compressed blocks of about ``BLOCK_BYTES``, as
they come, so no key can make a block large.  A block sends the list of its
distinct grams with their counts, by ranges of the hashed gram; the range sums
them over both corpora and answers every block with the totals in the order of
its list.  The block then scores its documents.  Nothing is broadcast, and the
driver sees nine numbers.

Score of a document: mean over its words of target loss minus background loss
(nats); lower means closer to the target.  Null and empty texts have 0 words
and score 0.  Words are runs of non-blank characters, A-Z folded.  Repeated
rows score alike; an empty corpus counts nothing.  Very long texts are read
whole, each in one task.  Words and bigrams are told apart by 63-bit hashes.
Columns of ``docs`` other than the text pass through; one named ``out`` is
replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.lineage import stored
from . import packed, textarrays

PRIOR = 50.0
BLOCK_BYTES = 4 << 20
TARGET, BACKGROUND = -1, -2  # block numbers of lists that ask for no answer
LOSSES = "struct<n_words:bigint,target_loss:double,background_loss:double,score:double>"


def _documents(texts) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first word of each document, word keys, places with a word before them, keys of the pairs that end there), by runs of documents."""
    for _, _, data, offsets in textarrays.chunks(texts):
        words = textarrays.Words(data, offsets)
        hashes = words.hashes()
        later = np.ones(len(hashes), bool)
        later[words.first[words.first < len(hashes)]] = False
        inner = np.flatnonzero(later)
        pairs = textarrays.ngram_hashes(hashes, 2)[inner - 1] if len(inner) else np.empty(0, np.uint64)
        yield words.first, hashes & ~np.uint64(1), inner, pairs | np.uint64(1)


def _keys(texts) -> Iterator[np.ndarray]:
    for _, words, _, pairs in _documents(texts):
        yield np.concatenate([words, pairs])


def losses(c_word: np.ndarray, c_before: np.ndarray, c_pair: np.ndarray, inner: np.ndarray, total: np.ndarray) -> np.ndarray:
    """-log p of every word under both models, from counts of shape (2, words) and (2, pairs)."""
    p = (c_word + 1) / total
    p[:, inner] = (c_pair + PRIOR * p[:, inner]) / (c_before + PRIOR)
    return -np.log(p)


def _size(df: DataFrame, text: str) -> tuple[int, int]:
    """(bytes, texts that hold a word)."""
    worded = F.col(text).rlike(r"[^\x20\x09-\x0D]").cast("long")
    return tuple(df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)), F.coalesce(F.sum(worded), F.lit(0))).first())


def _packed_table(parts: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, parts[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        for part in parts:
            stream.write_batch(part)
    return sink.getvalue().to_pybytes()


def _table(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def blocks(docs: DataFrame, text: str, block_bytes: int) -> DataFrame:
    """``block, rows binary``: runs of whole documents with all their columns; a longer text is a block of its own."""

    def row(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.array([_packed_table(parts)], pa.binary())], ["block", "rows"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for lo, hi, data, _ in textarrays.chunks(batch[text], block_bytes):
                if held and size + len(data) > block_bytes:
                    yield row(held)
                    held, size = [], 0
                held.append(batch.slice(lo, hi - lo))
                size += len(data)
        if held:
            yield row(held)

    return stored(docs.mapInArrow(rows, "block long, rows binary"))  # stored: the numbers must stay


def _answers(own: bool):
    """Totals of a bucket of grams: one row of numbers, and the answer to each block's list."""

    def answered(table: pa.Table) -> pa.Table:
        blocks = table["block"].to_numpy()
        lists = [packed.unpack_keys(x.as_py()) for x in table["keys"]]
        keys, place = np.unique(np.concatenate(lists), return_inverse=True)
        ends = np.cumsum([len(x) for x in lists])
        n = np.concatenate([packed.unpack(x.as_py()) for x in table["n"]]).astype(float)
        of = np.repeat(blocks, np.diff(ends, prepend=0))
        counts = [np.bincount(place, weights=n * (of == TARGET), minlength=len(keys))]
        counts.append(np.bincount(place, weights=n * ((of == BACKGROUND) | (own & (of >= 0))), minlength=len(keys)))
        word = (keys & np.uint64(1)) == 0
        asks = np.flatnonzero(blocks >= 0)
        each = [[packed.pack(c[place[ends[i] - len(lists[i]) : ends[i]]].astype(np.int64)) for i in asks] for c in counts]
        rest = [None] * len(asks)
        return pa.table(
            {
                "block": pa.array([*blocks[asks], None], pa.int64()),
                "bucket": pa.array(np.full(len(asks) + 1, table["bucket"][0].as_py()), pa.int64()),
                "t": pa.array([*each[0], None], pa.binary()),
                "b": pa.array([*each[1], None], pa.binary()),
                "vocabulary": pa.array([*rest, int((word & (counts[0] + counts[1] > 0)).sum())], pa.int64()),
                "target_words": pa.array([*rest, int(counts[0][word].sum())], pa.int64()),
                "background_words": pa.array([*rest, int(counts[1][word].sum())], pa.int64()),
            }
        )

    return answered


def difference(docs: DataFrame, target: DataFrame, background: DataFrame | None = None, text: str = "text", out: str = "lm", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without ``text`` and with ``out`` (``LOSSES``); without ``background`` the documents themselves are the background."""
    size, texts = _size(docs, text)
    (target_size, target_texts), own = _size(target, text), background is None
    background_size, background_texts = (0, texts) if own else _size(background, text)
    bits = packed.bucket_bits((size + target_size + background_size) // 3)
    dealt = blocks(docs, text, block_bytes)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data in zip(batch["block"], batch["rows"], strict=True):
                found = packed.rows(*packed.gathered(_keys(_table(data.as_py())[text])), bits)
                yield found.append_column("block", pa.array(np.full(len(found), number.as_py(), np.int64)))

    lists = dealt.mapInArrow(counted, packed.SCHEMA + ", block long")
    for corpus, number in ((target, TARGET), (background, BACKGROUND)):
        if corpus is not None:
            lists = lists.unionByName(corpus.select(text).mapInArrow(packed.mapper(text, _keys, bits), packed.SCHEMA).withColumn("block", F.lit(number).cast("long")))
    summed = stored(lists.groupBy("bucket").applyInArrow(_answers(own), "block long, bucket long, t binary, b binary, vocabulary long, target_words long, background_words long"))
    words, t, b = summed.where("block is null").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("vocabulary", "target_words", "background_words"))).first()
    totals = np.array([[t + target_texts], [b + background_texts]], float) + words + 2
    answers = summed.where("block is not null").select("block", "bucket", "t", "b")

    def scored(block: pa.Table, answers: pa.Table) -> pa.Table:
        table = _table(block["rows"][0].as_py())
        keys, _ = packed.gathered(_keys(table[text]))
        order = np.argsort(answers["bucket"].to_numpy())  # buckets are ranges, so their lists in order are the sorted keys
        known = np.array([np.concatenate([np.empty(0, np.uint64), *(packed.unpack(answers[c][int(i)].as_py()) for i in order)]) for c in ("t", "b")], float)
        parts = []
        for first, words, inner, pairs in _documents(table[text]):
            each = known[:, np.searchsorted(keys, words)]
            loss = losses(each, each[:, inner - 1], known[:, np.searchsorted(keys, pairs)], inner, totals)
            n = np.diff(first)
            of = np.repeat(np.arange(len(n)), n)
            parts.append((n, *(np.bincount(of, weights=x, minlength=len(n)) / np.maximum(n, 1) for x in loss)))
        n, t, b = (np.concatenate(x) if x else np.empty(0) for x in (zip(*parts, strict=True) if parts else ((), (), ())))
        found = pa.StructArray.from_arrays([pa.array(n.astype(np.int64)), pa.array(t), pa.array(b), pa.array(t - b)], ["n_words", "target_loss", "background_loss", "score"])
        return table.drop_columns([text, *({out} & set(table.column_names))]).append_column(out, found)

    kept = [f for f in docs.schema.fields if f.name not in (text, out)]
    schema = T.StructType([*kept, T.StructField(out, T._parse_datatype_string(LOSSES))])
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(scored, schema)
