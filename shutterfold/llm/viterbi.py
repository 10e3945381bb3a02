"""Token counts of a unigram tokenizer without making its tokens.

Aho-Corasick enumerates the vocabulary matches of a segment; dynamic
programming over their ends carries the best score and the number of pieces of
the best path, nothing else.  Tie rule of the tokenizer: a later candidate
replaces an earlier one only when it scores strictly more and candidates come
by ascending start, so among equal scores the longest last piece stays.  A
character with no piece of its own costs the lowest score less 10 and counts
one piece for each of its UTF-8 bytes (byte fallback).

Spaces become the word mark, and one stands before every text that is not
empty.  No piece holds a word mark after another character, so the best path
of a text is that of its segments, and segments are memoised; with a
vocabulary that has such pieces the whole text is one segment.  Scores add up
in double precision, which is exact for whole-number scores; libraries that
add in single precision agree until their sums round.  Counts are those of the
unigram method over the table's pieces and scores, also where the table comes
from a merge tokenizer.

Null and empty texts count 0 pieces with score 0, empty tables give no rows,
repeated rows count alike, very long texts are read whole.  Other columns pass
through; an existing output name is replaced.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
UNKNOWN_PENALTY = 10.0
NEVER = -1e8
MEMO = 1 << 20


class Counter(dict):
    """Segment -> complex(pieces, score); complex numbers add up in C, both parts exactly."""

    def __init__(self, pieces: dict[str, float]):
        super().__init__()
        self.whole = any(MARK in x.lstrip(MARK) for x in pieces)  # such pieces cross words, so texts aren't cut
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {x for x in pieces if len(x) == 1}
        self.unknown = min(pieces.values()) - UNKNOWN_PENALTY
        used = set("".join(pieces))
        alone = "".join(c for c in "\t\n\v\f\r" if c not in used)  # no piece holds them, so paths break there
        self.segments = re.compile(f"[{alone}]|{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+" if alone else f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall

    def best(self, segment: str) -> complex:
        matches = [(end + 1, n, score, 1) for end, (n, score) in self.automaton.iter(segment)]
        if not self.single.issuperset(segment):
            matches += [(i + 1, 1, self.unknown, len(c.encode("utf-8", "surrogatepass"))) for i, c in enumerate(segment) if c not in self.single]
            matches.sort(key=lambda m: (m[0], -m[1]))
        scores: list[float] = [0.0] * (len(segment) + 1)
        counts = [0] * (len(segment) + 1)
        reached, longest = 0, 0
        for end, n, score, pieces in matches:
            score += scores[end - n]
            if end != reached or score > scores[end] or (score == scores[end] and n > longest):
                scores[end], counts[end], reached, longest = score, counts[end - n] + pieces, end, n
        return complex(counts[-1], scores[-1])

    def __missing__(self, segment: str) -> complex:
        found = self.best(segment)
        if len(segment) <= 64:
            if len(self) >= MEMO:
                self.clear()
            self[segment] = found
        return found

    def count(self, text: str) -> complex:
        if not text:
            return 0j
        if self.whole:
            return self.best(MARK + text.replace(" ", MARK))
        return sum(map(self.__getitem__, self.segments(MARK + text.replace(" ", MARK))), 0j)


def pieces_of(path: str) -> dict[str, float]:
    """Ordinary pieces and scores of a model file.

    Control, unknown and byte pieces never match text; a score of ``NEVER`` or
    less marks pieces that no path is meant to take.
    """
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    plain = (i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)))
    return {model.id_to_piece(i): score for i in plain if (score := model.get_score(i)) > NEVER}


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    """One counter for each worker process."""
    return Counter(pieces_of(path))


def count_tokens(df: DataFrame, path: str, text: str = "text", out: str = "counted") -> DataFrame:
    """Adds ``out struct<n_tokens:bigint,score:double>`` for the whole text."""

    @F.arrow_udf("struct<n_tokens:bigint,score:double>")
    def counted(texts: pa.Array) -> pa.Array:
        one = counter(path)
        found = np.array([one.count(x) for x in texts.to_pylist()], complex)
        return pa.StructArray.from_arrays([pa.array(found.real.astype(np.int64)), pa.array(found.imag)], ["n_tokens", "score"])

    return df.withColumn(out, counted(F.col(text)))
