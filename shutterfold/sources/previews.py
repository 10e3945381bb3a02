"""Embedded JPEG previews: candidates as rows of arrays, the choice as Column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tiff

CANDIDATE = "array<struct<offset:int,length:int,width:int,height:int,edge:int>>"
# Markers of frames that give sizes.
FRAME_MARKERS = frozenset({0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF})


def jpeg_at(data: bytes, start: int) -> tuple[int, int, int] | None:
    """(end, width, height) of the complete JPEG that starts here: segments are walked, entropy data is searched for its true end."""
    at, size = start + 2, (0, 0)
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            return (at + 2, *size) if size[0] else None
        if marker == 0x01 or 0xD0 <= marker <= 0xD7:
            at += 2
            continue
        length = int.from_bytes(data[at + 2 : at + 4])
        if length < 2:
            return None
        if marker in FRAME_MARKERS:
            size = int.from_bytes(data[at + 7 : at + 9]), int.from_bytes(data[at + 5 : at + 7])
        at += 2 + length
        if marker == 0xDA:
            while True:
                at = data.find(b"\xff", at)
                if at < 0 or at + 1 >= len(data):
                    return None
                if data[at + 1] and not 0xD0 <= data[at + 1] <= 0xD7:
                    break
                at += 2
    return None


def candidates(data: bytes) -> Iterator[tuple[int, int, int, int]]:
    """(offset, length, width, height) of complete JPEGs: those that directories name, then those that a scan finds."""
    seen = set()
    starts = []
    for _, tags in tiff.directories(data):
        if (at := tags.get(tiff.JPEG_AT)) and tags.get(tiff.JPEG_SIZE):
            starts.append(at[0])
    if data[-4:] and data[:4] == b"FOVb":
        starts += [at + 28 for at in _x3f_images(data)]
    for start in starts:
        if isinstance(start, int) and data[start : start + 2] == b"\xff\xd8" and start not in seen and (found := jpeg_at(data, start)):
            seen.add(start)
            yield start, found[0] - start, found[1], found[2]
    at = data.find(b"\xff\xd8\xff")
    while at >= 0:
        found = jpeg_at(data, at)
        if found and at not in seen:
            yield at, found[0] - at, found[1], found[2]
        at = data.find(b"\xff\xd8\xff", found[0] if found else at + 2)


def _x3f_images(data: bytes) -> Iterator[int]:
    """Offsets of JPEG image sections by the directory that the last four bytes point to."""
    at = int.from_bytes(data[-4:], "little")
    if data[at : at + 4] != b"SECd":
        return
    for i in range(min(int.from_bytes(data[at + 8 : at + 12], "little"), 256)):
        e = at + 12 + 12 * i
        place = int.from_bytes(data[e : e + 4], "little")
        if data[place : place + 4] == b"SECi" and int.from_bytes(data[place + 12 : place + 16], "little") == 18:
            yield place


def with_candidates(files: DataFrame, content: str = "content", out: str = "previews") -> DataFrame:
    @F.pandas_udf(CANDIDATE)
    def found(column: pd.Series) -> pd.Series:
        return pd.Series([[{"offset": o, "length": n, "width": w, "height": h, "edge": max(w, h)} for o, n, w, h in candidates(bytes(x))] if x is not None else None for x in column])

    return files.withColumn(out, found(F.col(content)))


def choose(previews: Column, min_edge: int | None) -> Column:
    """The smallest preview of at least ``min_edge``, else the largest; None asks for the largest."""
    by_edge = F.transform(previews, lambda p: F.struct(p["edge"].alias("edge"), p["length"].alias("size"), p.alias("p")))
    largest = F.array_max(by_edge)["p"]
    if min_edge is None:
        return largest
    enough = F.filter(by_edge, lambda x: x["edge"] >= min_edge)
    return F.when(F.size(enough) > 0, F.array_min(enough)["p"]).otherwise(largest)


def preview_bytes(content: Column, preview: Column) -> Column:
    return F.substring(content, preview["offset"] + 1, preview["length"])


def is_full_size(native: Column, original: Column, gate: int) -> Column:
    """Whether a preview stands for the original: at least ``gate`` and nine tenths of its edge, when that is known."""
    return (native >= gate) & (original.isNull() | (native * 10 >= original * 9))
