"""Personal data with offset-preserving deobfuscation.

The base finds e-mail addresses, IPv4 addresses, card numbers and phone
numbers in the text as it stands.  Transducers then rewrite disguises --
look-alike characters to ASCII, spelled digits to digits, at/dot wordings
(also a bare "at" before a domain) to ``@`` and ``.``, invisible characters to
nothing -- while each output
character keeps the source range it came from.  What the same finders see
only after rewriting is mapped back and added.

An added span holds at least one rewritten character and differs from every
base span; base spans are never removed, and an added one may enclose a base
one.  Spans count code points, end exclusive.  Null and empty texts have no
spans, empty tables no rows; repeated rows get the same spans.  Other columns
pass through and an output name that exists is replaced.  Every finder is
linear in the length of the text, so very long texts are read whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
SPANS = "array<struct<kind:string,start:int,end:int,added:boolean>>"

# The four base patterns; possessive runs take the same matches as greedy ones here, without retries.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Letters of other scripts that look like Latin ones, and look-alikes of "@", "." and "-".
LOOKALIKES = {
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S",
    "Т": "T", "Х": "X", "У": "Y", "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o",
    "р": "p", "ѕ": "s", "х": "x", "у": "y", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ɡ": "g", "ⅼ": "l", "﹫": "@", "。": ".", "․": ".", "｡": ".", "﹒": ".", "‐": "-", "‑": "-", "–": "-", "−": "-",
    " ": " ", " ": " ", " ": " ",
}
INVISIBLE = "­​‌‍⁠﻿"
# Number words.
DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}


def _fold_table() -> dict[int, str]:
    table = {ord(k): v for k, v in LOOKALIKES.items()}
    table |= {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
    for c in range(0x80, 0x20000):
        if (d := unicodedata.decimal(chr(c), None)) is not None:
            table[c] = str(d)
    return table


FOLD = _fold_table()
_WORD = "|".join(DIGIT_WORDS)
_AT = r"(?:(?<!\s)\s+)?[\[({<]\s*(?:at|@)\s*[\])}>]\s*"
_DOT = r"\s*[\[({<]\s*(?:dot|punkt|point|punto|\.)\s*[\])}>]\s*|\s+(?:dot|DOT|Dot)\s+"
# Words after which a bare "at" names a place, and those that follow it then.
_BEFORE = ("me us him her it them you look looks looked see is are was were be here there now live meet shop order page site online available found more info hosted".split())
_AFTER = "the|a|an|this|that|my|your|his|her|its|our|their"
_BARE_AT = rf"(?<=[\w])(?=\s+at\s){''.join(rf'(?<!\b{w})' for w in _BEFORE)}\s+at\s+(?!(?:{_AFTER})\s)"
# each rule looks at its first character before anything else, which is what most places of a text fail at
_REWRITE = re.compile(
    rf"(?=[\s\[({{<])(?:(?P<at>{_AT}|{_BARE_AT}(?=[\w-]+(?:{_DOT})[\w-]|(?:[a-z0-9-]+\.)+[a-z]{{2,24}}\b(?!@)))|(?P<dot>(?<=[\w])(?:{_DOT})(?=[\w])))"
    rf"|(?P<plus>(?=p)\bplus\s+(?=[0-9]|(?:{_WORD})\b))|(?P<digit>(?=[zotfsen])\b(?:{_WORD})\b)|(?P<gap>[{INVISIBLE}])",
    re.IGNORECASE,
)


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> Iterable[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        end = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, (end := m.end())
            free = end
        else:
            free = max(free, start)
        at = text.find("@", end)


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the base patterns, sorted."""
    found = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(x := part.lstrip("0")) <= 3 and int(x or "0") <= 255 for part in m.groups()):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and _luhn(d):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


def rewritten(text: str) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """The normalised text with, for each of its characters, source start, source end and whether it was rewritten."""
    folded = text.translate(FOLD)
    pieces, lengths, at = [], [], 0
    for m in _REWRITE.finditer(folded):
        new = {"at": "@", "dot": ".", "plus": "+", "gap": ""}.get(m.lastgroup) if m.lastgroup != "digit" else DIGIT_WORDS[m["digit"].casefold().replace("\u0307", "")]
        pieces += [folded[at : m.start()], new]
        lengths.append((m.start() - at, len(new), m.start(), m.end()))
        at = m.end()
    out = "".join([*pieces, folded[at:]])
    starts = np.empty(len(out), np.int64)
    ends = np.empty(len(out), np.int64)
    changed = np.zeros(len(out), bool)
    here = source = 0
    for plain, new, a, b in [*lengths, (len(folded) - at, 0, len(folded), len(folded))]:
        starts[here : here + plain] = np.arange(source, source + plain)
        ends[here : here + plain] = np.arange(source + 1, source + plain + 1)
        here += plain
        starts[here : here + new], ends[here : here + new], changed[here : here + new] = a, b, True
        if not new and here:
            changed[here - 1] = True  # something invisible stood behind it
        here, source = here + new, b
    if folded != text:
        differs = np.frombuffer(folded.encode("utf-32-le", "surrogatepass"), np.uint32) != np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        changed |= differs[np.minimum(starts, len(text) - 1)] if len(starts) else False
    return out, starts, ends, changed


def spans(text: str) -> list[tuple[int, int, int, bool]]:
    """(start, kind index, end, added), sorted by start, kind, end."""
    base = find(text)
    out = [(a, k, b, False) for a, k, b in base]
    if _REWRITE.search(text) or (not text.isascii() and text.translate(FOLD) != text):  # else nothing is rewritten
        known = set(base)
        plain, starts, ends, changed = rewritten(text)
        for a, k, b in find(plain):
            if changed[a:b].any() and (at := (int(starts[a]), k, int(ends[b - 1]))) not in known:
                out.append((*at, True))
    return sorted(out)


def detect(df: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """Adds ``out``: all spans of the whole text, by start, then kind as in ``KINDS``, then end."""

    @F.arrow_udf(SPANS)
    def found(texts: pa.Array) -> pa.Array:
        each = [spans(x) if x else [] for x in texts.to_pylist()]
        flat = [s for x in each for s in x]
        ends = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int32)
        values = pa.StructArray.from_arrays(
            [
                pa.array([KINDS[s[1]] for s in flat], pa.string()),
                pa.array([s[0] for s in flat], pa.int32()),
                pa.array([s[2] for s in flat], pa.int32()),
                pa.array([s[3] for s in flat], pa.bool_()),
            ],
            ["kind", "start", "end", "added"],
        )
        return pa.ListArray.from_arrays(pa.array(ends), values)

    return df.withColumn(out, found(F.col(text)))
