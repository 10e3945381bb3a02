"""Focus points and lens names from the notes that camera makers add to the capture metadata.

A note is one more IFD; makers differ in its signature, in what its offsets
count from, and in the tags.  Points are normalised boxes of the stored image.
Notes of other makers, and broken ones, give null.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tiff

POINT = "struct<cx:double,cy:double,w:double,h:double,in_focus:boolean,selected:boolean>"
NOTES = f"struct<source:string,lens:string,points:array<{POINT}>>"
# Tag numbers of the notes, and bounds on what is drawn.
NOTE = 0x927C
CANON_LENS, CANON_FOCUS, CANON_FOCUS_OLD = 0x0095, (0x003C, 0x0026), 0x0012
PANASONIC_PLACE, PANASONIC_SIZE, SONY_FOCUS = 0x004D, 0x00DE, 0x2027
OLYMPUS_EQUIPMENT, OLYMPUS_SETTINGS, OLYMPUS_LENS, OLYMPUS_AREAS, OLYMPUS_SELECTED = 0x2010, 0x2020, 0x0203, 0x0304, 0x0305
OLYMPUS_SPEC = {"wide": 0x0207, "tele": 0x0208, "wide_open": 0x0205, "tele_open": 0x0206}
NIKON_FOCUS, NIKON_BOX, NIKON_WIDEST = 0x00B7, (260, 286), 0.1
PENTAX_LENS = (0x0239, 0x023A)
MOST_POINTS, MOST_GRID = 256, 4096

Tags = dict[int, list]


def _point(cx: float, cy: float, w: float, h: float, in_focus: bool = True, selected: bool = True) -> dict:
    return {"cx": cx, "cy": cy, "w": w, "h": h, "in_focus": in_focus, "selected": selected}


def _unit(*values: float | None) -> bool:
    return all(v is not None and 0 <= v <= 1 for v in values)


def _ratios(values: list) -> list[float | None]:
    return [(a / b if b else None) for a, b in values] if values and isinstance(values[0], tuple) else []


def _signed(x: int) -> int:
    return x - (1 << 16) if x >> 15 else x


def _bits(words: list[int], n: int) -> list[bool]:
    return [bool(words[i // 16] >> i % 16 & 1) for i in range(n)]


def canon(tags: Tags, model: str) -> list[dict]:
    """Boxes from the newer table of widths, heights and places, else from the older one of places; heights count up but on compact cameras."""
    up = 1 if "PowerShot" in model else -1
    new = next((v for t in CANON_FOCUS if isinstance((v := tags.get(t, [b""]))[0], int)), None)
    if new and len(new) > 8 and 0 < (n := new[2]) <= MOST_GRID and new[6] and new[7]:
        words = -(-n // 16)
        if len(new) >= 8 + 4 * n + words:
            width, height, x, y = (new[8 + k * n : 8 + (k + 1) * n] for k in range(4))
            focus = _bits(new[8 + 4 * n :], n)
            rest = new[8 + 4 * n + words :]
            chosen = _bits(rest, n) if len(rest) >= words else [False] * n
            return [
                _point(0.5 + _signed(x[i]) / new[6], 0.5 + up * _signed(y[i]) / new[7], abs(_signed(width[i])) / new[6], abs(_signed(height[i])) / new[7], focus[i], chosen[i])
                for i in range(min(n, new[3], MOST_POINTS))
            ]
    old = tags.get(CANON_FOCUS_OLD, [b""])
    if isinstance(old[0], int) and len(old) > 8 and 0 < (n := old[0]) <= 128 and old[4] and old[5] and len(old) >= 8 + 2 * n + -(-n // 16):
        focus = _bits(old[8 + 2 * n :], n)
        return [_point(0.5 + _signed(old[8 + i]) / old[4], 0.5 + up * _signed(old[8 + n + i]) / old[5], old[6] / old[4], old[7] / old[5], focus[i], False) for i in range(min(n, old[1]))]
    return []


def panasonic(tags: Tags) -> list[dict]:
    place, size = _ratios(tags.get(PANASONIC_PLACE, [])), _ratios(tags.get(PANASONIC_SIZE, []))
    if len(place) < 2 or not _unit(*place[:2]):
        return []
    w, h = size[:2] if len(size) >= 2 and _unit(*size[:2]) else (0.0, 0.0)
    return [_point(place[0], place[1], w, h)]


def sony(tags: Tags) -> list[dict]:
    values = tags.get(SONY_FOCUS, [])
    if len(values) < 4 or not values[0] or not values[1] or values[2] > values[0] or values[3] > values[1]:
        return []
    return [_point(values[2] / values[0], values[3] / values[1], 0.0, 0.0)]


def _box(x0: float, y0: float, x1: float, y1: float) -> dict:
    return _point((x0 + x1) / 2, (y0 + y1) / 2, abs(x1 - x0), abs(y1 - y0))


def olympus(settings: Tags) -> list[dict]:
    """The selected box of newer bodies, else the areas of older ones, four bytes each."""
    chosen = _ratios(settings.get(OLYMPUS_SELECTED, []))
    if len(chosen) >= 5:
        return [_box(*chosen[1:5])] if _unit(*chosen[1:5]) else []
    areas = settings.get(OLYMPUS_AREAS, [])
    return [_box(*(b / 255 for b in struct.pack(">I", v))) for v in areas if isinstance(v, int) and v]


def olympus_lens(equipment: Tags) -> str | None:
    """The lens's own text, else one from its focal lengths and widest apertures (powers of two in steps of 1/512)."""
    if text := tiff._text(equipment, OLYMPUS_LENS):
        return text
    value = {k: v if isinstance(v := equipment.get(t, [None])[0], int) and v > 0 else None for k, t in OLYMPUS_SPEC.items()}
    if not value["wide"] or not value["tele"]:
        return None
    focal = f"{value['wide']}mm" if value["wide"] == value["tele"] else f"{value['wide']}-{value['tele']}mm"
    if not value["wide_open"] or not value["tele_open"]:
        return focal
    a, b = (2 ** (value[k] / 512) for k in ("wide_open", "tele_open"))
    return f"{focal} F{a:.1f}" if abs(a - b) < 0.05 else f"{focal} F{a:.1f}-{b:.1f}"


def nikon(table: bytes, order: str) -> list[dict]:
    """The one point of mirrorless bodies, in pixels of the image; tables without places (bit masks of a grid) give none."""
    if len(table) < 0x46 or not table.startswith(b"04") or table[7] != 1:
        return []
    width, height, x, y = struct.unpack_from(order + "4H", table, 0x3E)
    if not width or not height or x > width or y > height:
        return []
    return [_point(x / width, y / height, *(min(box / side, NIKON_WIDEST) for box, side in zip(NIKON_BOX, (width, height), strict=True)))]


def pentax_lens(tags: Tags) -> str | None:
    """A lens text where the note has one; numbers of lens types stay unnamed."""
    texts = (tiff._text(tags, t) for t in PENTAX_LENS if isinstance(tags.get(t, [0])[0], bytes))
    return next((t for t in texts if t and t.isascii() and t.isprintable()), None)


def _sub(data: bytes, order: str, tags: Tags, tag: int) -> Tags:
    at = tags.get(tag, [0])[0]
    return tiff.ifd(data, order, at)[0] if isinstance(at, int) else {}


def notes(block: bytes) -> dict | None:
    """What NOTES names, from a TIFF block; None where no note that is understood is reached."""
    if not (head := tiff.header(block)):
        return None
    order, first = head
    main, _ = tiff.ifd(block, order, first)
    at = main.get(tiff.EXIF_IFD, [0])[0]
    exif = tiff.ifd(block, order, at)[0] if isinstance(at, int) else {}
    lens = tiff._text(exif, tiff.LENS) if tiff.LENS in exif else None
    make, model = tiff._text(main, tiff.MAKE) or "", tiff._text(main, tiff.MODEL) or ""
    place = tiff.place(block, order, at, NOTE) if isinstance(at, int) else None
    if place is None:
        return {"source": None, "lens": lens, "points": []} if lens else None
    sign = block[place : place + 12]
    read: Callable[[int], Tags] = lambda offset: tiff.ifd(block, order, offset)[0]
    if sign.startswith(b"Panasonic\0") or make.startswith("Panasonic"):
        return {"source": "panasonic", "lens": lens, "points": panasonic(read(place + 12))}
    if sign.startswith((b"SONY DSC", b"SONY CAM", b"SONY MOBILE")):
        return {"source": "sony", "lens": lens, "points": sony(read(place + 12))}
    if sign.startswith((b"OM SYSTEM\0", b"OLYMPUS\0")):
        own = block[place:]
        order = {b"II": "<", b"MM": ">"}.get(own[(at := 8 if sign.startswith(b"OLYMPUS\0") else 12) : at + 2], order)
        tags, _ = tiff.ifd(own, order, at + 4)
        return {"source": "olympus", "lens": lens or olympus_lens(_sub(own, order, tags, OLYMPUS_EQUIPMENT)), "points": olympus(_sub(own, order, tags, OLYMPUS_SETTINGS))}
    if sign.startswith(b"OLYMP\0"):
        tags = read(place + 8)
        return {"source": "olympus", "lens": lens or olympus_lens(_sub(block, order, tags, OLYMPUS_EQUIPMENT)), "points": olympus(_sub(block, order, tags, OLYMPUS_SETTINGS))}
    if sign.startswith(b"Nikon\0"):
        own = block[place + 10 :]  # a TIFF block of its own
        inner = tiff.header(own)
        table = tiff.ifd(own, *inner)[0].get(NIKON_FOCUS, [b""])[0] if inner else b""
        return {"source": "nikon", "lens": lens, "points": nikon(table, inner[0]) if isinstance(table, bytes) and inner else []}
    if sign.startswith(b"PENTAX \0"):
        own = block[place:]
        tags = tiff.ifd(own, {b"II": "<", b"MM": ">"}.get(own[8:10], order), 10)[0]
        return {"source": "pentax", "lens": lens or pentax_lens(tags), "points": []}
    if make.startswith("Canon"):
        tags = read(place)
        return {"source": "canon", "lens": lens or (tiff._text(tags, CANON_LENS) if CANON_LENS in tags else None), "points": canon(tags, model)}
    if make.upper().startswith("SONY"):
        return {"source": "sony", "lens": lens, "points": sony(read(place))}
    return {"source": None, "lens": lens, "points": []} if lens else None


def with_notes(files: DataFrame, content: str = "content", out: str = "notes") -> DataFrame:
    """Adds ``out`` (NOTES): of the first place in each file where a note is found."""

    @F.pandas_udf(NOTES)
    def read(column: pd.Series) -> pd.DataFrame:
        rows = []
        for data in column:
            found = None
            try:
                for blocks in tiff.tiff_blocks(bytes(data)) if data is not None else ():
                    if found := notes(blocks[0]):
                        break
            except (struct.error, ValueError, IndexError, TypeError, ZeroDivisionError):
                found = None
            rows.append([found["source"], found["lens"], found["points"]] if found else [None, None, None])
        return pd.DataFrame(rows, columns=["source", "lens", "points"], dtype=object)

    added = files.withColumn(out, read(F.col(content)))
    return added.withColumn(out, F.when(F.col(f"{out}.points").isNotNull(), F.col(out)))


def lens(info: Column, found: Column) -> Column:
    """The lens of the standard metadata, else of the maker's note."""
    return F.coalesce(info["lens"], found["lens"])
