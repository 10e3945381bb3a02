"""Names, pairing, sessions, transfers, caches and sources on hand-made cases."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from shutterfold.functions import exif, geo, names, pixels
from shutterfold.operators import cache, pairing, ranking, selection, sessions, transfer
from shutterfold.sources import files, lut, previews, tiff


def one(spark, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}")


def values(spark, rows, make, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r.v for r in df.select("i", make(F.col("x")).alias("v")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "paths,count",
    [
        (["web/heron.jpg", "orig/heron.orf"], 1), (["orig/moth.arw", "web/moth.jpeg", "phone/moth.heic"], 1), (["orig/reed.raf", "web/reed.png", "web/reed.tif"], 1),
        (["mon/orig/gate.dng", "mon/web/gate.jpg", "tue/orig/gate.dng", "tue/web/gate.jpg"], 4), (["web/kite.jpg", "print/kite.jpg", "orig/kite.pef"], 3), (["one/dune.jpg", "two/dune.jpeg", "orig/dune.orf"], 3),
        (["both/pier.orf", "both/pier.jpg", "web/pier.jpg"], 2), (["card1/fern.arw", "card2/fern.arw", "web/fern.jpg"], 3), (["orig/q7.Arw", "web/Q7.jpg"], 1), (["lark.srw", "deep/lark.srw"], 2),
        (["orig/oak.dng", "orig/elm.dng", "web/oak.jpg", "web/elm.jpg", "print/elm.jpg"], 4), (["web/_ice..jpg", "orig/_ice..raf"], 1),
    ],
)
def test_pairing_rules(spark, paths, count):
    assert pairing.pair(spark.createDataFrame([(p,) for p in paths], "path string")).count() == count


def test_system_folders_are_left_out(spark):
    paths = ["/root/$Recycle.bin/a.jpg", "/root/x/.Trashes/b.jpg", "/root/._c.jpg", "/root/ok/d.JPG", "/root/e.txt"]
    got = pairing.supported_files(spark.createDataFrame([(p,) for p in paths], "path string"), "path", "/root").collect()
    assert [r.path for r in got] == ["/root/ok/d.JPG"]
    inside = spark.createDataFrame([("/x/$RECYCLE.BIN/y/d.jpg",)], "path string")
    assert pairing.supported_files(inside, "path", "/x/$RECYCLE.BIN").count() == 1


def test_natural_order(spark):
    want = ["dock3", "dock03", "dock4", "dock20", "dock20x", "DOCK31", "e", "roll-7", "Roll-64", "s900017", "S900210"]
    df = spark.createDataFrame([(x,) for x in reversed(want)], "x string").orderBy(names.natural_key(F.col("x")))
    assert [r.x for r in df.collect()] == want


def test_capture_order(spark):
    rows = [(77, "roll12"), (None, "wharf3"), (12, "roll4"), (40, "roll8"), (40, "roll2"), (None, "quay11")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t int, name string")
    got = ranking.numbered(df, [F.col("t").isNull(), F.col("t"), names.natural_key(F.col("name"))], "p").orderBy("p").collect()
    assert [r.i for r in got] == [2, 4, 3, 0, 5, 1]


def test_capture_text(spark):
    assert values(spark, ["6400", "ISO 100", "none", None], exif.iso) == [6400, 100, None, None]
    assert values(spark, ["f/2.8", "2.0", "x"], exif.aperture) == pytest.approx([2.799999952316284, 2.0, None])
    assert values(spark, ["85 mm", "24.0 mm", "mm"], exif.focal) == [85, 24, None]
    assert values(spark, ["1/250", "1/250 s", "0.5 s", "1/0", "x"], exif.shutter) == pytest.approx([np.float32(0.004), np.float32(0.004), 0.5, None, None])
    t = values(spark, ["2024:01:01 23:59:59", "2024-01-02 00:00:00", "2024:02:31 00:00", "2024:13:01 00:00:00", "x"], exif.epoch_seconds)
    assert t[1] - t[0] == 1 and t[2] is not None and t[3:] == [None, None] and t[0] == 1704153599
    assert values(spark, ["35 mm", " 16 mm ", "200mm", "10.5 mm", "34.9 mm", "", "x", "0 mm", "."], names.focal_folder) == ["35mm", "16mm", "200mm", "11mm", "35mm"] + ["unknown-focal"] * 4


def test_small_text_functions(spark):
    v = values(spark, ["v1.2", "v0.6.0-rc1", "nope"], names.version)
    assert [tuple(x) if x else None for x in v] == [(1, 2, 0), (0, 6, 0), None]
    assert values(spark, [5, 1, 0], names.grade, "int") == ["A", "E", ""]
    assert values(spark, [3 << 30, 5 << 20, 2048, 7], names.size_text, "long") == ["3.00 GB", "5.0 MB", "2 KB", "7 B"]
    assert [tuple(x) if x else None for x in values(spark, ["#0a0bFF", "red"], names.hex_colour)] == [(10, 11, 255), None]
    assert values(spark, ["한글", "각", "é"], names.compose_hangul) == ["한글", "각", "é"]
    row = one(spark, "x").select(names.caption(F.lit("Cam"), F.lit(" "), F.lit("f/2"), F.lit("1/60"), F.lit("200"), F.lit(None).cast("string"), F.lit("2024:01:02 03:04")).alias("c")).first()
    assert row.c == ["Cam", "f/2  1/60s  ISO 200", "2024.01.02 03:04"]
    t = names.templated("{orig}-{seq:03}{zz}{", {"orig": F.lit("a:b"), "seq": F.lit(7)}, F.lit("o"))
    assert one(spark, "x").select(t.alias("t")).first().t == "a_b-007{"
    assert one(spark, "x").select(names.templated("{zz}", {}, F.lit("o")).alias("t")).first().t == "o"


def test_focus_boxes_and_guides(spark):
    def turned(o):
        return [round(x, 6) for x in one(spark, "x").select(geo.oriented_box(F.lit(0.25), F.lit(0.1), F.lit(0.2), F.lit(0.4), F.lit(o)).alias("b")).first().b]

    assert turned(2) == [0.75, 0.1, 0.2, 0.4] and turned(6) == [0.9, 0.25, 0.4, 0.2] and turned(8) == [0.1, 0.75, 0.4, 0.2]
    assert one(spark, [0.5, float("nan"), 2.0, None], "array<double>").select(geo.guide_lines("custom", custom=F.col("x")).alias("g")).first().g == [0.5, 1.0]
    assert one(spark, [0.5], "array<double>").select(geo.largest_gap_middle(F.col("x")).alias("m")).first().m == 0.25


def test_terms(spark):
    assert selection.search_terms("A, B\tC\n;a") == ["A", "B", "C"]
    df = spark.createDataFrame([("IMG_A1",), ("x",)], "stem string")
    assert df.where(selection.matches_terms(F.col("stem"), ["a1"])).count() == 1 and df.where(selection.matches_terms(F.col("stem"), ["a1"], exact=True)).count() == 0


def test_relabel_and_undo(spark):
    df = spark.createDataFrame([(1, "pick"), (2, "unrated")], "item_id int, label string")
    edited = selection.relabel(df, F.lit(True), "pick", toggle=True)
    assert {(r.item_id, r.label) for r in edited.collect()} == {(1, "unrated"), (2, "pick")}
    assert {(r.item_id, r.label) for r in selection.undo(edited.select("item_id", "label"), edited).collect()} == {(1, "pick"), (2, "unrated")}


def test_sessions_round_trip(spark):
    text = '{"version":1,"items":{"A":{"label":"pick","stars":9,"members":["Sub\\\\A.NEF"]},"b":{"tag":"red"},"old":{"stars":2}}}'
    saved = sessions.records(one(spark, text).withColumnRenamed("x", "text"))
    items = spark.createDataFrame([("i1", "hold", 1, None), ("i2", "hold", 1, None), ("i3", "unrated", 0, None), ("i4", "hold", 3, "blue")], "item string, label string, stars int, tag string")
    wanted = spark.createDataFrame([("i1", 0, "sub/a.nef"), ("i1", 1, "B"), ("i2", 0, "b"), ("i3", 0, "zz"), ("i4", 0, "zz")], "item string, prio int, key string")
    legacy = spark.createDataFrame([("i3", "OLD"), ("i1", "old")], "item string, key string")
    got = {r.item: (r.label, r.stars, r.tag, r.has_record) for r in sessions.restore(items, wanted, saved, legacy).collect()}
    assert got == {"i1": ("pick", 5, "red", True), "i2": ("unrated", 0, "red", True), "i3": ("unrated", 2, None, True), "i4": ("hold", 3, "blue", False)}
    assert sessions.records(one(spark, "not json").withColumnRenamed("x", "text")).count() == 0


def test_collisions_move_whole_groups(spark):
    rows = [("d", 0, 1, "X.JPG"), ("d", 0, 1, "X.NEF"), ("d", 1, 2, "x.jpg"), ("d", 1, 2, "X.NEF"), ("e", 0, 3, "X.JPG")]
    planned = spark.createDataFrame(rows, "folder string, pos int, item_id int, name string")
    none = spark.createDataFrame([], "folder string, name string")
    got = lambda skip: sorted(((r.folder, r.item_id, r.name, r.final_name) for r in transfer.resolve_collisions(planned, none, skip).collect()), key=str)
    assert got(False) == sorted([("d", 1, "X.JPG", "X.JPG"), ("d", 1, "X.NEF", "X.NEF"), ("d", 2, "x.jpg", "x_001.jpg"), ("d", 2, "X.NEF", "X_001.NEF"), ("e", 3, "X.JPG", "X.JPG")], key=str)
    assert [r[3] for r in got(True) if r[1] == 2] == [None, None]


def test_collisions_beyond_a_hundred_thousand_and_across_families(spark):
    there = spark.range(100_005).select(F.lit("d").alias("folder"), F.when(F.col("id") == 0, "X.JPG").otherwise(F.concat(F.lit("x_"), F.lpad(F.col("id").cast("string"), 6, "0"), F.lit(".jpg"))).alias("name"))
    there = there.withColumn("name", F.regexp_replace("name", "_0{1,3}([0-9]{3,})", "_$1"))
    rows = [("d", i, i, "x.jpg") for i in range(3)] + [("d", 5, 5, "x_100005.jpg"), ("d", 6, 6, "other.jpg"), ("d", 7, 7, "y.nef"), ("d", 7, 7, "x.jpg"), ("d", 8, 8, "y.nef"), ("d", 9, 9, "z.nef")]
    planned = spark.createDataFrame(rows, "folder string, pos int, item_id int, name string")
    got = sorted((r.item_id, r.final_name) for r in transfer.resolve_collisions(planned, there).collect())
    assert got == [(0, "x_100005.jpg"), (1, "x_100006.jpg"), (2, "x_100007.jpg"), (5, "x_100005_001.jpg"), (6, "other.jpg"), (7, "x_100008.jpg"), (7, "y_100008.nef"), (8, "y.nef"), (9, "z.nef")]


def test_transfer_never_overwrites(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "out").mkdir()
    for n in ("a.jpg", "b.jpg"):
        (tmp_path / "in" / n).write_text(n)
    (tmp_path / "out" / "b.jpg").write_text("old")
    rows = [(str(tmp_path / "in/a.jpg"), str(tmp_path / "out"), "a.jpg"), (str(tmp_path / "in/b.jpg"), str(tmp_path / "out"), "b.jpg"), (str(tmp_path / "in/b.jpg"), str(tmp_path / "in"), "b.jpg"), (str(tmp_path / "in/b.jpg"), "x", None), (str(tmp_path / "in/zz.jpg"), str(tmp_path / "out"), "z.jpg")]
    done = transfer.execute(spark.createDataFrame(rows, "path string, folder string, final_name string")).collect()
    assert [r.status for r in done] == ["sent", "failed", "in_place", "skipped", "failed"]
    assert (tmp_path / "out/b.jpg").read_text() == "old" and not (tmp_path / "out/z.jpg").exists()
    totals = transfer.report(spark.createDataFrame(done)).first()
    assert (totals.transferred, totals.failures, totals.in_place, totals.skipped, totals.bytes) == (1, 2, 1, 1, 5)


def test_cache_eviction(spark):
    df = spark.createDataFrame([(str(i), i, 10) for i in range(6)], "path string, mtime int, size int")
    assert [r.path for r in cache.evict(df, 35).where("evicted").orderBy("path").collect()] == ["0", "1", "2"]
    assert cache.evict(df, 0).where("evicted").count() == 0


def test_pixel_measures(spark):
    flat = np.full((64, 64, 3), 128, np.uint8)
    checker = np.where((np.indices((64, 64)).sum(axis=0) % 2)[..., None] > 0, 255, 0).astype(np.uint8).repeat(3, axis=2)
    assert pixels.sharpness(pixels.gray(flat)) == 0 and pixels.sharpness(pixels.gray(checker)) > 0.9
    assert pixels.exposure_of(pixels.gray(flat))["score"] > 0.9 and pixels.exposure_of(pixels.gray(np.full((9, 9, 3), 255, np.uint8)))["score"] == 0
    y, x = np.mgrid[0:200, 0:200]
    for degrees in (0, 6):
        edge = np.clip(128 + 20 * (y * np.cos(np.radians(degrees)) + x * np.sin(np.radians(degrees)) - 100), 0, 255).astype(np.uint8)  # a soft edge, as in photographs
        found, confidence = pixels.tilt(edge)
        assert abs(abs(found) - degrees) < 1.5 and confidence > 0.2
    gradient = ((x ^ y) % 256).astype(np.uint8)[..., None].repeat(3, axis=2)
    assert pixels.dhash(gradient) == pixels.dhash(gradient.copy()) and bin((pixels.dhash(gradient) ^ pixels.dhash(flat)) & (1 << 64) - 1).count("1") > 10
    assert pixels.dhash(np.empty((0, 0, 3), np.uint8)) == 0 and sum(pixels.rgb_histogram(flat)) == 3 * 64 * 64
    assert pixels.oriented(np.arange(6).reshape(2, 3, 1), 6).shape == (3, 2, 1) and pixels.shrunk(flat, 16).shape == (16, 16, 3)
    rows = spark.createDataFrame([((64, 64, 3, bytearray(checker[..., ::-1].tobytes())),), ((9, 9, 3, bytearray(b"x")),)], "image struct<height:int,width:int,nChannels:int,data:binary>")
    got = pixels.score_images(rows).collect()
    assert got[0].report.sharpness > 0.9 and got[1].report is None


def tiff_bytes(entries, order="<", more=b""):
    """One IFD after the header, values that don't fit behind it."""
    body, extra = b"", b""
    base = 8 + 2 + 12 * len(entries) + 4
    for tag, kind, count, raw in entries:
        if len(raw) <= 4:
            raw = raw.ljust(4, b"\0")
        else:
            extra, raw = extra + raw, struct.pack(order + "I", base + len(extra))
        body += struct.pack(order + "HHI", tag, kind, count) + raw
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8) + struct.pack(order + "H", len(entries)) + body + b"\0" * 4 + extra + more


def test_capture_metadata_from_bytes(spark):
    p = lambda a, b: struct.pack("<II", a, b)
    block = tiff_bytes([
        (tiff.MAKE, 2, 5, b"Make\0"), (tiff.ORIENTATION, 3, 1, struct.pack("<H", 6)), (tiff.DATETIME, 2, 20, b"2024:01:02 03:04:05\0"), (tiff.EXPOSURE, 5, 1, p(1, 250)),
        (tiff.FNUMBER, 5, 1, p(28, 10)), (tiff.ISO, 3, 1, struct.pack("<H", 400)), (tiff.FOCAL, 5, 1, p(85, 1)), (tiff.WIDTH, 4, 1, struct.pack("<I", 6000)),
    ])
    info = tiff.fields(block)
    assert (info["model"], info["orientation"], info["shutter"], info["aperture"], info["iso"], info["focal"], info["width"]) == ("Make", 6, "1/250", "f/2.8", "400", "85 mm", 6000)
    box = lambda kind, body: struct.pack(">I", 8 + len(body)) + kind + body
    movie = box(b"ftyp", b"crx ") + box(b"moov", box(b"uuid", b"u" * 16 + box(b"CMT1", block)))
    jpeg = b"\xff\xd8\xff\xe1\x00\x10Exif\0\0" + block
    rows = [(0, bytearray(block)), (1, bytearray(movie)), (2, bytearray(jpeg)), (3, bytearray(b"II*\0\xff\xff\xff\xff")), (4, bytearray(b"junk")), (5, None)]
    got = tiff.read_info(spark.createDataFrame(rows, "i int, content binary")).orderBy("i").collect()
    assert [r.info.iso if r.info else None for r in got] == ["400", "400", "400", None, None, None]
    assert list(tiff.boxes(struct.pack(">I", 4) + b"free")) == []


def jpeg_bytes(w, h):
    return b"\xff\xd8\xff\xc0\x00\x11\x08" + struct.pack(">HH", h, w) + b"\x03" + b"\1\x11\0" * 3 + b"\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00" + b"data\xff\x00more" + b"\xff\xd9"


def test_embedded_previews(spark):
    small, big = jpeg_bytes(160, 120), jpeg_bytes(1600, 1200)
    data = b"head" + small + b"gap" + big + b"\xff\xd8\xff\xe0broken"
    df = previews.with_candidates(spark.createDataFrame([(bytearray(data),)], "content binary"))
    row = df.select("previews", previews.choose(F.col("previews"), 100).alias("a"), previews.choose(F.col("previews"), 800).alias("b"), previews.choose(F.col("previews"), 9000).alias("c"), previews.choose(F.col("previews"), None).alias("d"), previews.preview_bytes(F.col("content"), previews.choose(F.col("previews"), 100)).alias("bytes")).first()
    assert [p.edge for p in row.previews] == [160, 1600] and [x.edge for x in (row.a, row.b, row.c, row.d)] == [160, 1600, 1600, 1600] and bytes(row.bytes) == small


def test_colour_tables(spark, tmp_path):
    good = "LUT_3D_SIZE 2\n# note\n" + "\n".join("0 0.5 1" for _ in range(8))
    assert lut.parse(good)["size"] == 2
    for bad in ("LUT_3D_SIZE 65\n", "LUT_1D_SIZE 4\n", "LUT_3D_SIZE 2\n0 0 0", good + "\nDOMAIN_MAX 0 1 1", good.replace("0.5", "nan", 1)):
        with pytest.raises(ValueError):
            lut.parse(bad)
    (tmp_path / "B.cube").write_text(good)
    (tmp_path / "a.cube").write_text("LUT_3D_SIZE 2\n")
    assert [(r.name, r.ok) for r in lut.listing(spark, str(tmp_path)).collect()] == [("a.cube", False), ("B.cube", True)]


def test_scan_of_a_folder(spark, tmp_path):
    for p in ("raw/A.NEF", "jpg/A.JPG", "note.txt", "._B.jpg"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_bytes(b"x")
    got = files.items(spark, str(tmp_path)).collect()
    assert [(len(r.members), os.path.basename(r.display)) for r in got] == [(2, "A.JPG")]
