"""Maker notes from bytes that the tests build themselves."""

import struct

import pytest
from pyspark.sql import functions as F

from shutterfold.functions import geo
from shutterfold.sources import makernotes, tiff


def directory(entries, at):
    """An IFD that stands at ``at`` (offsets count from 0 there), with its long values behind it."""
    body, extra, base = b"", b"", at + 2 + 12 * len(entries) + 4
    for tag, kind, count, raw in sorted(entries):
        if len(raw) <= 4:
            raw = raw.ljust(4, b"\0")
        else:
            extra, raw = extra + raw, struct.pack("<I", base + len(extra))
        body += struct.pack("<HHI", tag, kind, count) + raw
    return struct.pack("<H", len(entries)) + body + b"\0" * 4 + extra


def photo(make, note, model=b"Body\0"):
    """A TIFF block whose EXIF directory ends with the note; ``note`` gets the place where it will stand."""
    main = lambda exif_at: directory([(tiff.MAKE, 2, len(make), make), (tiff.MODEL, 2, len(model), model), (tiff.EXIF_IFD, 4, 1, struct.pack("<I", exif_at))], 8)
    exif_at = 8 + len(main(0))
    head = 2 + 12 + 4
    raw = note(exif_at + head)
    return b"II*\0\x08\0\0\0" + main(exif_at) + directory([(makernotes.NOTE, 7, len(raw), raw)], exif_at)


shorts = lambda *v: struct.pack(f"<{len(v)}H", *(x & 0xFFFF for x in v))
ratio = lambda *v: b"".join(struct.pack("<ii", *x) for x in v)


def canon_note(at):
    table = shorts(0, 0, 3, 2, 0, 0, 1000, 500, 100, 100, 100, 50, 50, 50, -250, 0, 250, 125, 0, -125, 0b101, 0b010)
    return directory([(makernotes.CANON_FOCUS[1], 3, len(table) // 2, table), (makernotes.CANON_LENS, 2, 9, b"Kinlux 9\0")], at)


def test_canon_boxes_and_lens():
    found = makernotes.notes(photo(b"Canon\0", canon_note))
    assert found["lens"] == "Kinlux 9" and [(p["cx"], p["cy"], p["w"], p["h"], p["in_focus"], p["selected"]) for p in found["points"]] == [(0.25, 0.25, 0.1, 0.1, True, False), (0.5, 0.5, 0.1, 0.1, False, True)]
    compact = makernotes.notes(photo(b"Canon\0", canon_note, b"PowerShot 1\0"))
    assert compact["points"][0]["cy"] == 0.75
    old = shorts(2, 2, 0, 0, 100, 100, 10, 20, -25, 25, 0, 50, 0b10)
    found = makernotes.notes(photo(b"Canon\0", lambda at: directory([(makernotes.CANON_FOCUS_OLD, 3, len(old) // 2, old)], at)))
    assert [(p["cx"], p["cy"], p["w"], p["h"], p["in_focus"]) for p in found["points"]] == [(0.25, 0.5, 0.1, 0.2, False), (0.75, 0.0, 0.1, 0.2, True)]
    short = shorts(0, 0, 3, 3, 0, 0, 10, 10, 1)
    assert makernotes.notes(photo(b"Canon\0", lambda at: directory([(makernotes.CANON_FOCUS[1], 3, len(short) // 2, short)], at)))["points"] == []


@pytest.mark.parametrize("place,size,want", [(((1, 4), (1, 2)), ((1, 10), (1, 5)), (0.25, 0.5, 0.1, 0.2)), (((1, 4), (1, 2)), ((1 << 22, 1), (1, 5)), (0.25, 0.5, 0, 0)), (((1 << 24, 1), (1 << 24, 1)), ((0, 1), (0, 1)), None)])
def test_panasonic_point(place, size, want):
    note = lambda at: b"Panasonic\0\0\0" + directory([(makernotes.PANASONIC_PLACE, 5, 2, ratio(*place)), (makernotes.PANASONIC_SIZE, 5, 2, ratio(*size))], at + 12)
    points = makernotes.notes(photo(b"Panasonic\0", note))["points"]
    assert [(p["cx"], p["cy"], p["w"], p["h"]) for p in points] == ([want] if want else [])


def test_sony_point():
    note = lambda sign: lambda at: sign + directory([(makernotes.SONY_FOCUS, 3, 4, shorts(400, 200, 100, 150))], at + len(sign))
    for sign in (b"SONY DSC \0\0\0", b""):
        assert [(p["cx"], p["cy"]) for p in makernotes.notes(photo(b"SONY\0", note(sign)))["points"]] == [(0.25, 0.75)]


def olympus_note(equipment, settings, sign=b"OM SYSTEM\0\0\0II\x04\0"):
    def note(at):
        start = len(sign)
        size = 2 + 24 + 4
        first, base = start + size, 0 if sign.startswith((b"OM", b"OLYMPUS")) else at
        one = directory(equipment, base + first)
        two = directory(settings, base + first + len(one))
        tags = [(makernotes.OLYMPUS_EQUIPMENT, 4, 1, struct.pack("<I", base + first)), (makernotes.OLYMPUS_SETTINGS, 4, 1, struct.pack("<I", base + first + len(one)))]
        return sign + directory(tags, base + start) + one + two

    return note


def test_olympus_boxes_and_lens_texts():
    box = (makernotes.OLYMPUS_SELECTED, 10, 5, ratio((0, 0), (1, 4), (1, 4), (1, 2), (3, 4)))
    spec = lambda *v: [(t, 3, 1, shorts(x)) for t, x in zip(makernotes.OLYMPUS_SPEC.values(), v)]
    found = makernotes.notes(photo(b"OM\0", olympus_note(spec(14, 45, 925, 1271), [box])))
    assert found["lens"] == "14-45mm F3.5-5.6" and [(p["cx"], p["cy"], p["w"], p["h"]) for p in found["points"]] == [(0.375, 0.5, 0.25, 0.5)]
    assert makernotes.notes(photo(b"OM\0", olympus_note(spec(25, 25, 512, 512), [box], b"OLYMPUS\0II\x03\0")))["lens"] == "25mm F2.0"
    named = [(makernotes.OLYMPUS_LENS, 2, 6, b"Kin 8\0")]
    areas = (makernotes.OLYMPUS_AREAS, 4, 3, struct.pack("<III", 0x00336699, 0, 0xFFFFFFFF))
    old = makernotes.notes(photo(b"OM\0", olympus_note(named, [areas], b"OLYMP\0\x01\0")))
    assert old["lens"] == "Kin 8" and [round(p["cx"], 3) for p in old["points"]] == [0.2, 1.0]


def nikon_note(version=b"0400", flag=1, place=(8000, 5000, 2000, 1000), size=0x46):
    table = (version + b"\0\0\0" + bytes([flag])).ljust(0x3E, b"\0") + shorts(*place)
    return lambda at: b"Nikon\0\x02\x11\0\0" + b"II*\0\x08\0\0\0" + directory([(makernotes.NIKON_FOCUS, 7, size, table[:size])], 8)


def test_nikon_point():
    points = lambda **k: makernotes.notes(photo(b"NIKON\0", nikon_note(**k)))["points"]
    assert [(p["cx"], p["cy"], p["w"], p["h"], p["in_focus"]) for p in points()] == [(0.25, 0.2, 260 / 8000, 286 / 5000, True)]
    assert points(place=(100, 100, 100, 0))[0]["w"] == 0.1
    assert points(version=b"0101") == points(flag=0) == points(place=(10, 10, 11, 1)) == points(place=(0, 10, 0, 1)) == points(size=0x44) == []


def test_pentax_lens():
    def note(tag, text, sign=b"PENTAX \0II"):
        return lambda at: sign + directory([(tag, 2, len(text), text)], len(sign))

    lens = lambda *a: makernotes.notes(photo(b"RICOH\0", note(*a)))["lens"]
    assert lens(makernotes.PENTAX_LENS[0], b"Kin 35 mm\0") == lens(makernotes.PENTAX_LENS[1], b"Kin 35 mm\0") == "Kin 35 mm"
    assert lens(0x003F, b"\x08\x3e\0\0\0\0") is None and lens(makernotes.PENTAX_LENS[1], b"\x01\x80\xff\x02\x03\0") is None


def test_notes_of_files(spark):
    rows = [(0, bytearray(photo(b"Canon\0", canon_note))), (1, bytearray(b"\xff\xd8\xff\xe1\0\x10Exif\0\0" + photo(b"Canon\0", canon_note))), (2, bytearray(b"junk")), (3, None), (4, bytearray(photo(b"Other\0", lambda at: b"x" * 20)))]
    df = makernotes.with_notes(tiff.read_info(spark.createDataFrame(rows, "i int, content binary")))
    got = df.select("i", makernotes.lens(F.col("info"), F.col("notes")).alias("lens"), F.size(geo.focus_regions(F.col("notes.points"), F.lit(1))).alias("n")).orderBy("i").collect()
    assert [(r.lens, r.n) for r in got] == [("Kinlux 9", 1), ("Kinlux 9", 1), (None, 0), (None, 0), (None, 0)]
