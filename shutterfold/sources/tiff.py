"""Capture metadata from TIFF structures, wherever a file keeps them.

``fields`` walks IFDs with bounds on entries and depth; the containers only say
where a TIFF block starts.  Bad bytes give no fields, never an error.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tag numbers of the TIFF and EXIF specifications.
MAKE, MODEL, ORIENTATION, DATETIME, EXIF_IFD, GPS_IFD = 0x010F, 0x0110, 0x0112, 0x0132, 0x8769, 0x8825
EXPOSURE, FNUMBER, ISO, ORIGINAL, FOCAL, COLOUR, WIDTH, HEIGHT, LENS = 0x829A, 0x829D, 0x8827, 0x9003, 0x920A, 0xA001, 0xA002, 0xA003, 0xA434
IMAGE_WIDTH, IMAGE_HEIGHT, SUB_IFDS, JPEG_AT, JPEG_SIZE = 0x0100, 0x0101, 0x014A, 0x0201, 0x0202
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4}
FORMATS = {3: "H", 4: "I", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I"}
MOST_ENTRIES, MOST_IFDS = 512, 16

INFO = (
    "struct<make:string,model:string,lens:string,datetime:string,iso:string,aperture:string,shutter:string,focal:string,width:int,height:int,orientation:int,"
    "lat:double,lon:double,alt:double>"
)


def ifd(data: bytes, order: str, at: int) -> tuple[dict[int, list], int]:
    """Values by tag of one directory, and where the next one starts."""
    if at < 8 or at + 2 > len(data):
        return {}, 0
    count = struct.unpack_from(order + "H", data, at)[0]
    found: dict[int, list] = {}
    for i in range(min(count, MOST_ENTRIES)):
        e = at + 2 + 12 * i
        if e + 12 > len(data):
            return found, 0
        tag, kind, n = struct.unpack_from(order + "HHI", data, e)
        size = SIZES.get(kind, 0) * n
        place = e + 8 if size <= 4 else struct.unpack_from(order + "I", data, e + 8)[0]
        if not size or n > 65536 or place + size > len(data):
            continue
        raw = data[place : place + size]
        if kind in (5, 10):
            pairs = struct.unpack(order + ("i" if kind == 10 else "I") * 2 * n, raw)
            found[tag] = [(a, b) for a, b in zip(pairs[::2], pairs[1::2], strict=True)]
        elif kind in FORMATS:
            found[tag] = list(struct.unpack(order + FORMATS[kind] * n, raw))
        else:
            found[tag] = [raw]
    after = at + 2 + 12 * count
    return found, struct.unpack_from(order + "I", data, after)[0] if after + 4 <= len(data) else 0


def place(data: bytes, order: str, at: int, tag: int) -> int | None:
    """Where the value of a tag of one directory starts."""
    if at < 8 or at + 2 > len(data):
        return None
    for i in range(min(struct.unpack_from(order + "H", data, at)[0], MOST_ENTRIES)):
        e = at + 2 + 12 * i
        if e + 12 > len(data):
            return None
        found, kind, n = struct.unpack_from(order + "HHI", data, e)
        if found == tag:
            return e + 8 if SIZES.get(kind, 0) * n <= 4 else struct.unpack_from(order + "I", data, e + 8)[0]
    return None


def header(data: bytes) -> tuple[str, int] | None:
    """(byte order, first IFD); any version number passes, as some makers write their own."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    return (order, struct.unpack_from(order + "I", data, 4)[0]) if order and len(data) >= 8 else None


def directories(data: bytes) -> Iterator[tuple[str, dict[int, list]]]:
    """The chain of IFDs and their sub-IFDs, each once."""
    if not (head := header(data)):
        return
    order, first = head
    waiting, seen = [first], set()
    while waiting and len(seen) < MOST_IFDS:
        at = waiting.pop(0)
        if at in seen or not at:
            continue
        seen.add(at)
        tags, following = ifd(data, order, at)
        yield order, tags
        waiting += [x for x in tags.get(SUB_IFDS, []) if isinstance(x, int)] + [following]


def _text(tags: dict[int, list], tag: int) -> str | None:
    value = tags.get(tag, [b""])[0]
    if not isinstance(value, bytes):
        return str(value)
    return next((text for part in value.split(b"\0") if (text := part.decode("utf-8", "replace").strip())), None)


def _ratio(value) -> float | None:
    return (value[0] / value[1] if value[1] else None) if isinstance(value, tuple) else float(value)


def _number(x: float) -> str:
    return f"{x:.1f}".rstrip("0").rstrip(".")


def fields(data: bytes, blocks: list[bytes] | None = None) -> dict | None:
    """What INFO names, from a TIFF block (and, for containers that split it, further ones); null without any."""
    tags: dict[int, list] = {}
    gps: dict[int, list] = {}
    for block in [data, *(blocks or [])]:
        if not (head := header(block)):
            continue
        order, first = head
        main, _ = ifd(block, order, first)
        for key, value in main.items():
            tags.setdefault(key, value)
        if isinstance(at := main.get(EXIF_IFD, [0])[0], int):
            tags |= ifd(block, order, at)[0]
        if isinstance(at := main.get(GPS_IFD, [0])[0], int):
            gps |= ifd(block, order, at)[0]
        if block is not data and 2 in main and 4 in main:
            gps |= main
    if not tags and not gps:
        return None
    first = lambda *keys: next((tags[k][0] for k in keys if tags.get(k)), None)
    shutter, aperture, focal, speed = (_ratio(x) if (x := first(k)) is not None else None for k in (EXPOSURE, FNUMBER, FOCAL, ISO))
    turn = first(ORIENTATION)
    size = lambda *keys: int(x) if isinstance(x := first(*keys), (int, float)) and 0 < x < 1 << 31 else None
    out = {
        "make": _text(tags, MAKE), "model": _text(tags, MODEL) or _text(tags, MAKE), "lens": _text(tags, LENS), "datetime": _text(tags, ORIGINAL) or _text(tags, DATETIME),
        "iso": str(int(speed)) if speed else None, "aperture": f"f/{_number(aperture)}" if aperture else None,
        "shutter": (f"1/{round(1 / shutter)}" if shutter < 0.5 else _number(shutter)) if shutter else None, "focal": f"{_number(focal)} mm" if focal else None,
        "width": size(WIDTH, IMAGE_WIDTH), "height": size(HEIGHT, IMAGE_HEIGHT), "orientation": turn if turn in range(1, 9) else 1, "lat": None, "lon": None, "alt": None,
    }

    def degrees(tag: int, ref: int, limit: float) -> float | None:
        parts = [_ratio(x) for x in gps.get(tag, [])]
        if not parts or parts[0] is None:
            return None
        value = sum((x or 0) / 60**i for i, x in enumerate(parts[:3]))
        value = -value if gps.get(ref, [b""])[0][:1] in (b"S", b"W") else value
        return value if abs(value) <= limit else None

    lat, lon = degrees(2, 1, 90), degrees(4, 3, 180)
    if lat is not None and lon is not None and (lat or lon):
        height = _ratio(gps[6][0]) if gps.get(6) else None
        low = gps.get(5, [b"\0"])[0]
        out |= {"lat": lat, "lon": lon, "alt": -height if height is not None and low in (b"\1", 1) else height}
    return out


def boxes(data: bytes, start: int = 0, stop: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(type, body start, body end) of the ISO boxes in a range."""
    stop = len(data) if stop is None else min(stop, len(data))
    while start + 8 <= stop:
        size, kind, body = int.from_bytes(data[start : start + 4]), data[start + 4 : start + 8], start + 8
        if size == 1 and start + 16 <= stop:
            size, body = int.from_bytes(data[start + 8 : start + 16]), start + 16
        end = stop if size == 0 else start + size
        if end < body or end > stop:
            return
        yield kind, body, end
        start = end


def tiff_blocks(data: bytes) -> Iterator[list[bytes]]:
    """Where the metadata of a file may stand, best first: the file itself, the CMT boxes of a movie-style raw, then every EXIF part with a readable header in its first 2 MB."""
    if header(data):
        yield [data]
    if data[4:8] == b"ftyp":
        found = []
        for kind, a, b in boxes(data):
            if kind == b"moov":
                for inner, c, d in boxes(data, a, b):
                    if inner == b"uuid":
                        found += [data[e:f] for k, e, f in boxes(data, c + 16, d) if k in (b"CMT1", b"CMT2", b"CMT4")]
        if found:
            yield found
    at = data.find(b"Exif\0\0", 0, 2 << 20)
    while at >= 0:
        if header(data[at + 6 : at + 14]):
            yield [data[at + 6 :]]
        at = data.find(b"Exif\0\0", at + 6, 2 << 20)


def first_fields(data: bytes) -> dict | None:
    """The fields of the first place that has any."""
    for blocks in tiff_blocks(data):
        try:
            if found := fields(blocks[0], blocks[1:]):
                return found
        except (struct.error, ValueError, IndexError, TypeError):
            continue
    return None


def read_info(files: DataFrame, content: str = "content", out: str = "info") -> DataFrame:
    """Adds ``out``: the capture metadata of each file; null where none can be read."""

    @F.pandas_udf(INFO)
    def read(column: pd.Series) -> pd.DataFrame:
        rows = []
        for data in column:
            try:
                rows.append((first_fields(bytes(data)) if data is not None else None) or {})
            except (struct.error, ValueError, IndexError, TypeError):
                rows.append({})
        names = [x.split(":")[0] for x in INFO[7:-1].split(",")]
        return pd.DataFrame([[r.get(n) for n in names] for r in rows], columns=names).astype({n: "Int32" for n in ("width", "height", "orientation")})

    read_out = read(F.col(content))
    return files.withColumn(out, F.when(read_out["orientation"].isNotNull(), read_out))


def orientation(info: Column) -> Column:
    return F.coalesce(info["orientation"], F.lit(1))
