"""HEIF item index: which bytes of a file are which image, how they are turned, and how large they are.

Only the index is read; JPEG items can be taken out by their offsets, HEVC
items are not decoded.  Boxes that point outside the file are left out.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tiff import boxes

ITEM = "struct<id:bigint,kind:string,role:string,offset:bigint,length:bigint,width:int,height:int>"
INDEX = f"struct<primary:bigint,orientation:int,edge:int,items:array<{ITEM}>>"
# Screen coordinates (x right, y down): where a point of the stored image is shown, by EXIF orientation.
TURNS = {1: (1, 0, 0, 1), 2: (-1, 0, 0, 1), 3: (-1, 0, 0, -1), 4: (1, 0, 0, -1), 5: (0, 1, 1, 0), 6: (0, -1, 1, 0), 7: (0, -1, -1, 0), 8: (0, 1, -1, 0)}


def composed(steps: list[tuple[str, int]]) -> int:
    """EXIF orientation of turns (``("turn", quarter turns against the clock)``) and mirrors (``("mirror", 0 top-bottom | 1 left-right)``) in order."""
    a, b, c, d = TURNS[1]
    for kind, value in steps:
        for p, q, r, s in [TURNS[8]] * (value % 4) if kind == "turn" else [TURNS[4] if value == 0 else TURNS[2]]:
            a, b, c, d = p * a + q * c, p * b + q * d, r * a + s * c, r * b + s * d
    return next(o for o, m in TURNS.items() if m == (a, b, c, d))


def _extents(data: bytes, at: int, end: int, idat: int) -> dict[int, tuple[int, int]]:
    """First byte and length of each item; items of several pieces that don't follow one another are left out."""
    version = data[at]
    at += 4
    widths = [data[at] >> 4, data[at] & 15, data[at + 1] >> 4, data[at + 1] & 15 if version in (1, 2) else 0]
    at += 2
    number = lambda n: int.from_bytes(data[at : at + n], "big")
    wide = 2 if version < 2 else 4
    count, at = number(wide), at + wide
    out = {}
    for _ in range(count):
        if at >= end:
            break
        item, at = number(wide), at + wide
        method = 0
        if version in (1, 2):
            method, at = number(2) & 15, at + 2
        at += 2
        base, at = number(widths[2]), at + widths[2]
        pieces, at = number(2), at + 2
        spans = []
        for _ in range(pieces):
            at += widths[3]
            offset, at = number(widths[0]), at + widths[0]
            length, at = number(widths[1]), at + widths[1]
            spans.append((base + offset + (idat if method == 1 else 0), length))
        joined = bool(spans) and method in (0, 1) and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
        if joined and spans[0][0] + sum(n for _, n in spans) <= len(data):
            out[item] = (spans[0][0], sum(n for _, n in spans))
    return out


def index(data: bytes) -> dict | None:
    """The index of a file as in ``INDEX``; None where there is none."""
    meta = next(((a, b) for kind, a, b in boxes(data, 0, len(data)) if kind == b"meta"), None)
    if meta is None:
        return None
    parts = {kind: (a, b) for kind, a, b in boxes(data, meta[0] + 4, meta[1])}
    number = lambda at, n: int.from_bytes(data[at : at + n], "big")
    primary, kinds, thumbs, properties, owned = None, {}, set(), [], {}
    if b"pitm" in parts:
        a, _ = parts[b"pitm"]
        primary = number(a + 4, 2 if data[a] == 0 else 4)
    if b"iinf" in parts:
        a, b = parts[b"iinf"]
        for kind, x, _ in boxes(data, a + (6 if data[a] == 0 else 8), b):
            if kind == b"infe" and data[x] in (2, 3):
                wide = 2 if data[x] == 2 else 4
                kinds[number(x + 4, wide)] = data[x + 6 + wide : x + 10 + wide].decode("latin-1")
    if b"iref" in parts:
        a, b = parts[b"iref"]
        wide = 2 if data[a] == 0 else 4
        for kind, x, _ in boxes(data, a + 4, b):
            if kind == b"thmb":
                count = number(x + wide, 2)
                if primary in [number(x + wide + 2 + wide * i, wide) for i in range(count)]:
                    thumbs.add(number(x, wide))
    if b"iprp" in parts:
        a, b = parts[b"iprp"]
        for kind, x, y in boxes(data, a, b):
            if kind == b"ipco":
                for name, p, _ in boxes(data, x, y):
                    value = None
                    if name == b"ispe":
                        value = ("size", number(p + 4, 4), number(p + 8, 4))
                    elif name == b"irot":
                        value = ("turn", data[p] & 3)
                    elif name == b"imir":
                        value = ("mirror", data[p] & 1)
                    properties.append(value)
            elif kind == b"ipma":
                wide, long_index, at = (2 if data[x] == 0 else 4), data[x + 3] & 1, x + 8
                for _ in range(number(x + 4, 4)):
                    if at >= y:
                        break
                    item, at = number(at, wide), at + wide
                    n, at = data[at], at + 1
                    step = 2 if long_index else 1
                    owned[item] = [number(at + step * i, step) & (0x7FFF if long_index else 0x7F) for i in range(n)]
                    at += step * n
    places = _extents(data, *parts[b"iloc"], parts.get(b"idat", (0, 0))[0]) if b"iloc" in parts else {}
    of = lambda item: [properties[i - 1] for i in owned.get(item, []) if 0 < i <= len(properties) and properties[i - 1]]
    items = []
    for item, kind in sorted(kinds.items()):
        offset, length = places.get(item, (None, None))
        jpeg = kind == "jpeg" or (offset is not None and data[offset : offset + 3] == b"\xff\xd8\xff")
        width, height = next((p[1:] for p in of(item) if p[0] == "size"), (None, None))
        role = "primary" if item == primary else "thumb" if item in thumbs else "other"
        items.append({"id": item, "kind": "jpeg" if jpeg else kind, "role": role, "offset": offset, "length": length, "width": width, "height": height})
    sizes = [max(p[1:]) for p in properties if p and p[0] == "size"]
    return {"primary": primary, "orientation": composed([p for p in of(primary) if p[0] != "size"]), "edge": max(sizes, default=None), "items": items}


def with_index(files: DataFrame, content: str = "content", out: str = "heif") -> DataFrame:
    """Adds ``out`` (``INDEX``); null for other files and for broken ones."""

    @F.pandas_udf(INDEX)
    def found(column: pd.Series) -> pd.DataFrame:
        rows = []
        for data in column:
            try:
                rows.append(index(bytes(data)) if data is not None else None)
            except (IndexError, ValueError, StopIteration):
                rows.append(None)
        return pd.DataFrame([r or {"primary": None, "orientation": None, "edge": None, "items": None} for r in rows], columns=["primary", "orientation", "edge", "items"])

    return files.withColumn(out, found(F.col(content)))


def choose(items: Column, previews: Column, min_edge: int) -> Column:
    """``struct<offset,length,source>`` to decode: a JPEG primary, else the smallest JPEG item of three quarters of ``min_edge`` or more, else the largest JPEG found in the bytes."""
    span = lambda x, source: F.struct(x["offset"].alias("offset"), x["length"].alias("length"), F.lit(source).alias("source"))
    jpeg = F.filter(items, lambda x: (x["kind"] == "jpeg") & x["offset"].isNotNull())
    primary = F.get(F.filter(jpeg, lambda x: x["role"] == "primary"), F.lit(0))
    ranked = F.transform(jpeg, lambda x: F.struct(F.greatest(x["width"], x["height"]).alias("edge"), x["offset"].alias("offset"), x["length"].alias("length")))
    enough = F.array_min(F.filter(ranked, lambda x: x["edge"] * 4 >= 3 * min_edge))
    scanned = F.array_max(F.transform(previews, lambda p: F.struct(p["edge"].alias("edge"), p["offset"].alias("offset"), p["length"].alias("length"))))
    return F.when(primary.isNotNull(), span(primary, "primary")).when(enough.isNotNull(), span(enough, "item")).when(scanned.isNotNull(), span(scanned, "scan"))


def original_edge(raw: Column, previews: Column, width: Column, height: Column) -> Column:
    """Long edge of the original: the largest embedded image of a RAW file, the header's of an image."""
    return F.when(raw, F.array_max(F.transform(previews, lambda p: p["edge"]))).otherwise(F.greatest(width, height))
