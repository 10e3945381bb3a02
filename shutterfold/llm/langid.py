"""Language identification: unigram pieces, summed over all segmentations.

A fixed public vocabulary of pieces is shared; every language has its own
piece probabilities.  A text becomes lower-case words (runs of letters and
marks; all else only separates), each with the word mark in front.  The
probability of a word is the sum over all ways to cut it into pieces of the
product of their probabilities, by the forward algorithm in logarithms; words
are independent, so a text's is the product of its words'.  The language with
the largest posterior wins; its share is the score.  A character that no piece
of its own spells is spelled by its bytes, whose pieces have probabilities too.

Learning is expectation maximisation over the same segmentations: from
uniform probabilities, ``EM_ROUNDS`` times, Spark counts every piece's expected
occurrences by forward and backward sums over the words of the training sample,
and the driver gets one number for each language and piece.  The sample
is the one limit: at most ``DOCS_A_LANGUAGE`` labelled rows of each language,
by a hash of id and text.  Priors are the shares of all labelled rows.  At most
``MAX_LANGUAGES`` languages are learned, as the model has a table for each;
more are an error.

Scoring reads every text whole.  Null texts and those without a letter get
``und`` with score 0, as does everything when nothing was learned; empty tables
give no rows; equal texts score alike; of equal posteriors the language first
in order wins.  Rows whose label is null aren't learned from.  Other columns
pass through, and existing ones named like the outputs are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shutterfold.operators.lineage import stored

from . import textarrays

MARK = "▁"
UNKNOWN = "und"
DOCS_A_LANGUAGE = 2000
EM_ROUNDS = 3
MAX_LANGUAGES = 256
#: Added to every piece's expected count.
SMOOTH = 0.1
MEMO = 1 << 18
LONGEST_KEPT = 64
#: Words of about so many characters are summed at once.
LATTICE_CHARS = 1 << 17
NOT_LETTERS = r"[^\p{L}\p{M}]+"
_MARK, _NOTHING = pa.scalar(MARK, pa.large_string()), pa.scalar("", pa.large_string())


class Vocabulary:
    """Pieces by number: those that can match a marked word, and a piece for every byte."""

    def __init__(self, pieces: dict[str, int], byte_pieces: list[int], size: int):
        self.size = size
        self.bytes = np.array(byte_pieces)
        self.length = np.zeros(size, np.int64)
        self.automaton = ahocorasick.Automaton()
        for piece, number in pieces.items():
            if MARK not in piece[1:]:  # others would cross words
                self.length[number] = len(piece)
                self.automaton.add_word(piece, number)
        if len(self.automaton):
            self.automaton.make_automaton()
        self.single = {p for p in pieces if len(p) == 1}


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """The ordinary and byte pieces of a model file; one object for each worker process."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    plain = {model.id_to_piece(i): i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}
    return Vocabulary(plain, [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], size)


class Lattice:
    """All pieces that match inside marked words, each word apart.

    Numbers of ``vocabulary.size`` and more are characters without a piece, in ``odd``.
    """

    def __init__(self, words: list[str], vocabulary: Vocabulary):
        text = "".join(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        self.first = np.cumsum(size + 1) - (size + 1)  # node of each word's start
        self.last = self.first + size
        self.nodes = int((size + 1).sum())
        found = vocabulary.automaton.iter(text) if len(vocabulary.automaton) and text else ()
        pairs = np.fromiter(chain.from_iterable(found), np.int64).reshape(-1, 2)
        at, piece, length = pairs[:, 0], pairs[:, 1], vocabulary.length[pairs[:, 1]]
        self.odd = sorted(set(text) - vocabulary.single)
        if self.odd:
            codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            known = np.array([ord(c) for c in self.odd], np.uint32)
            where = np.minimum(np.searchsorted(known, codes), len(known) - 1)
            odd = np.flatnonzero(known[where] == codes)
            at, piece = np.concatenate([at, odd]), np.concatenate([piece, vocabulary.size + where[odd]])
            length = np.concatenate([length, np.ones(len(odd), np.int64)])
        self.word = np.repeat(np.arange(len(words)), size)[at]
        self.end = at + 1 + self.word  # a word has one node more than characters
        self.piece, self.start = piece, self.end - length

    def _steps(self, distance: np.ndarray, node: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Matches by rising distance, with the places where a new ``node`` begins."""
        order = np.lexsort((node, distance))
        far = distance[order]
        cuts = np.flatnonzero(np.r_[True, far[1:] != far[:-1], True]) if len(far) else np.zeros(1, np.int64)
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            here = order[lo:hi]
            own = node[here]
            yield here, np.flatnonzero(np.r_[True, own[1:] != own[:-1]])

    def _sums(self, cost: np.ndarray, begin: np.ndarray, source: np.ndarray, target: np.ndarray, distance: np.ndarray) -> np.ndarray:
        """Log sum of all paths from ``begin`` to each node."""
        sums = np.full((self.nodes, cost.shape[1]), -np.inf)
        sums[begin] = 0.0
        for here, groups in self._steps(distance, target):
            sums[target[here[groups]]] = np.logaddexp.reduceat(sums[source[here]] + cost[here], groups, axis=0)
        return sums

    def forward(self, cost: np.ndarray) -> np.ndarray:
        """``cost`` has the log probability of every match, a column for each language."""
        return self._sums(cost, self.first, self.start, self.end, self.end - self.first[self.word])

    def backward(self, cost: np.ndarray) -> np.ndarray:
        return self._sums(cost, self.last, self.end, self.start, self.last[self.word] - self.start)


def costs(lattice: Lattice, log_p: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """Log probability of every match by language; ``log_p`` is pieces x languages."""
    odd = [log_p[vocabulary.bytes[list(c.encode())]].sum(axis=0) for c in lattice.odd]
    return (np.vstack([log_p, *odd]) if odd else log_p)[lattice.piece]


def _runs(words: list[str]) -> Iterator[slice]:
    """Slices of about ``LATTICE_CHARS`` characters, so that a long text with many new words takes bounded memory."""
    size = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    lo = 0
    while lo < len(words):
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + LATTICE_CHARS, "right")))
        yield slice(lo, hi)
        lo = hi


def word_scores(words: list[str], log_p: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """Log probability of each marked word (rows) in each language (columns)."""
    out = np.empty((len(words), log_p.shape[1]))
    for part in _runs(words):
        lattice = Lattice(words[part], vocabulary)
        out[part] = lattice.forward(costs(lattice, log_p, vocabulary))[lattice.last]
    return out


def expected(words: list[str], n: np.ndarray, log_p: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """Expected occurrences of every piece in words that stand ``n`` times, under one language's probabilities."""
    out = np.zeros(vocabulary.size)
    for part in _runs(words):
        lattice = Lattice(words[part], vocabulary)
        cost = costs(lattice, log_p[:, None], vocabulary)
        forward, backward = lattice.forward(cost)[:, 0], lattice.backward(cost)[:, 0]
        share = np.exp(forward[lattice.start] + cost[:, 0] + backward[lattice.end] - forward[lattice.last[lattice.word]]) * n[part][lattice.word]
        total = np.bincount(lattice.piece, weights=share, minlength=vocabulary.size + len(lattice.odd))
        for c, count in zip(lattice.odd, total[vocabulary.size :]):
            np.add.at(total, vocabulary.bytes[list(c.encode())], count)
        out += total[: vocabulary.size]
    return out


def marked_words(texts: pa.Array) -> pa.ListArray:
    """Lists of lower-case words with their marks; no empty ones."""
    lower = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    spaced = pc.utf8_trim_whitespace(pc.replace_substring_regex(lower, NOT_LETTERS, " "))
    lists = pc.split_pattern(spaced, " ")
    return pa.LargeListArray.from_arrays(pa.array(_offsets(lists, spaced)), pc.binary_join_element_wise(_MARK, _filled(lists), _NOTHING))


def _filled(lists: pa.Array) -> pa.Array:
    flat = lists.flatten()
    return flat.filter(pc.greater(pc.binary_length(flat), 0))


def _offsets(lists: pa.Array, spaced: pa.Array) -> np.ndarray:
    """A blank text splits into one empty word, which isn't one."""
    size = np.where(np.asarray(pc.equal(pc.binary_length(spaced), 0)), 0, np.asarray(pc.list_value_length(lists)))
    return np.concatenate([[0], np.cumsum(size)]).astype(np.int64)


@dataclass
class Model:
    """Languages in order, log priors, and log probabilities (pieces x languages)."""

    path: str
    languages: list[str]
    prior: np.ndarray
    log_p: np.ndarray


class Scorer:
    """Posteriors of texts; word scores are kept while there is room."""

    def __init__(self, model: Model):
        self.model, self.vocabulary = model, vocabulary(model.path)
        self.known: dict[str, int] = {}
        self.rows = np.empty((MEMO, len(model.languages)))

    def _words(self, words: list[str]) -> np.ndarray:
        out = np.empty((len(words), self.rows.shape[1]))
        at = np.fromiter((self.known.get(w, -1) for w in words), np.int64, len(words))
        out[at >= 0] = self.rows[at[at >= 0]]
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh = [words[i] for i in new]
            out[new] = word_scores(fresh, self.model.log_p, self.vocabulary)
            kept = [i for i, w in enumerate(fresh) if len(w) <= LONGEST_KEPT][:MEMO]
            if len(self.known) + len(kept) > MEMO:
                self.known.clear()
            base = len(self.known)
            self.known.update((fresh[i], base + j) for j, i in enumerate(kept))
            self.rows[base : base + len(kept)] = out[new[kept]]
        return out

    def logs(self, texts: pa.Array) -> np.ndarray:
        """Log probability of each text in each language, prior included; zero rows for texts without letters."""
        lists = marked_words(texts)
        coded = lists.values.dictionary_encode()
        scores = self._words(coded.dictionary.to_pylist())
        code = np.asarray(coded.indices)
        text = np.repeat(np.arange(len(texts)), np.diff(np.asarray(lists.offsets)))
        found = np.column_stack([np.bincount(text, weights=scores[code, i], minlength=len(texts)) for i in range(scores.shape[1])])
        return found + self.model.prior

    def posteriors(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of the likeliest language, and its posterior."""
        logs = self.logs(texts)
        best = logs.argmax(axis=1)
        return best, 1 / np.exp(logs - logs[np.arange(len(logs)), best][:, None]).sum(axis=1)


def _lettered(text: str):
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def _sampled(labelled: DataFrame, most: int) -> tuple[DataFrame, dict[str, int]]:
    """At most ``most`` rows of every language, and the number of rows of each."""
    found = labelled.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    rows = {r["lang"]: r["count"] for r in found}
    chance = F.pmod("h", F.lit(1 << 40)) / float(1 << 40)
    enough = F.lit(False)
    for language, n in rows.items():  # about twice as many as needed, so that ranking them sorts a bounded number
        enough = enough | ((F.col("lang") == language) & (chance * n < 2 * most))
    picked = labelled.withColumn("h", F.xxhash64("doc_id", "text")).where(enough)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    return picked.withColumn("place", place).where(F.col("place") <= most).select("lang", "text"), rows


def _counted(sample: DataFrame, languages: list[str]) -> DataFrame:
    """``language int, word string, n long``: the sample's words."""
    number = {x: i for i, x in enumerate(languages)}

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.array([number[x] for x in batch["lang"].to_pylist()], np.int64)
            for lo, hi, _, _ in textarrays.chunks(batch["text"]):
                lists = marked_words(batch["text"].slice(lo, hi - lo))
                coded = lists.values.dictionary_encode()
                language = np.repeat(own[lo:hi], np.diff(np.asarray(lists.offsets)))
                keys, n = np.unique(language * max(1, len(coded.dictionary)) + np.asarray(coded.indices), return_counts=True)
                word = coded.dictionary.take(pa.array(keys % max(1, len(coded.dictionary)))).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(keys // max(1, len(coded.dictionary)), pa.int32()), word, pa.array(n, pa.int64())], ["language", "word", "n"])

    return sample.mapInArrow(words, "language int, word string, n bigint").groupBy("language", "word").agg(F.sum("n").alias("n"))


def _expectations(words: DataFrame, path: str, log_p: np.ndarray) -> np.ndarray:
    """Expected piece counts (pieces x languages) under ``log_p``; a number a language and piece is collected."""
    shared = words.sparkSession.sparkContext.broadcast(log_p)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = vocabulary(path), np.zeros(shared.value.shape)
        for batch in batches:
            language, n = np.asarray(batch["language"]), np.asarray(batch["n"]).astype(float)
            for i in np.unique(language):
                at = np.flatnonzero(language == i)
                total[:, i] += expected(batch["word"].take(pa.array(at)).to_pylist(), n[at], shared.value[:, i], own)
        piece, i = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int32()), pa.array(i, pa.int32()), pa.array(total[piece, i])], ["piece", "language", "n"])

    found = words.mapInArrow(task, "piece int, language int, n double").groupBy("piece", "language").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(log_p.shape)
    out[np.asarray(found["piece"]), np.asarray(found["language"])] = np.asarray(found["n"])
    shared.destroy()
    return out


def fit(labelled: DataFrame, path: str, most: int = DOCS_A_LANGUAGE, rounds: int = EM_ROUNDS, smooth: float = SMOOTH) -> Model:
    """Learns from ``doc_id, text, lang`` rows with a language and a letter."""
    sample, rows = _sampled(labelled.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & _lettered("text")), most)
    languages = sorted(rows)
    size = vocabulary(path).size
    log_p = np.full((size, len(languages)), -np.log(size))
    if languages:
        words = stored(_counted(sample, languages))
        for _ in range(rounds):
            counts = _expectations(words, path, log_p) + smooth
            log_p = np.log(counts / counts.sum(axis=0))
    total = sum(rows.values())
    return Model(path, languages, np.log([rows[x] / total for x in languages]) if languages else np.empty(0), log_p)


def identify(df: DataFrame, model: Model, text: str = "text", language: str = "lang_pred", score: str = "score") -> DataFrame:
    """Adds ``language string`` and ``score double`` (the posterior) from the whole text and nothing else."""
    if not model.languages:
        return df.withColumns({language: F.lit(UNKNOWN), score: F.lit(0.0)})
    shared = df.sparkSession.sparkContext.broadcast(model)
    scorers: list[Scorer] = []  # one for each task, made where it is used

    @F.arrow_udf("struct<best:int,share:double>")
    def scored(texts: pa.Array) -> pa.Array:
        if not scorers:
            scorers.append(Scorer(shared.value))
        best, share = [np.empty(0, np.int64)], [np.empty(0)]
        for lo, hi, _, _ in textarrays.chunks(texts, 1 << 22):
            one, part = scorers[0].posteriors(texts.slice(lo, hi - lo))
            best.append(one)
            share.append(part)
        return pa.StructArray.from_arrays([pa.array(np.concatenate(best), pa.int32()), pa.array(np.concatenate(share))], ["best", "share"])

    names = F.array(*map(F.lit, model.languages))
    guess = df.withColumn("__guess", F.when(_lettered(text), scored(F.col(text))))
    return guess.withColumns(
        {language: F.coalesce(F.get(names, F.col("__guess.best")), F.lit(UNKNOWN)), score: F.coalesce(F.col("__guess.share"), F.lit(0.0))}
    ).drop("__guess")
