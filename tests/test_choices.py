"""Settings, metadata cases, scans, HEIF, model scores, looks and caches on own cases."""

import json
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from shutterfold.functions import choices, exif, looks, names, pixels
from shutterfold.operators import cache, scoring, selection, sessions, similar, transfer
from shutterfold.sources import files, heif, settings, tiff
from tests.test_collection import one, tiff_bytes, values


def test_names_with_dots_and_folders(spark):
    assert values(spark, ["a..jpg", "_DSC1.NEF", ".jpg", "x.", "y", "p/q.r/z"], names.extension) == ["jpg", "nef", None, None, None, None]
    assert values(spark, ["1.2.3 mm", "20. mm", "7mm"], names.focal_folder) == ["unknown-focal", "20mm", "7mm"]
    none = F.lit(None).cast("timestamp")
    assert values(spark, ["2031:04:05 x", "2031-04-05 1", " 2031:4:5", "31:04:05"], lambda c: names.date_folder(c, none)) == ["2031-04-05", "unknown-date", "2031-4-5", "unknown-date"]
    split = lambda by: values(spark, [0, 3, 7], lambda c: names.split_folder(F.lit("unrated"), c, F.lit(None).cast("string"), by), "int")
    assert split("stars") == split("label") == ["unrated", "3star", "5star"] and split("tag") == ["@untagged"] * 3
    assert values(spark, ["ko-KR", "JA", "en_US", "fr", None], names.language) == ["ko", "ja", "en", None, None]
    assert values(spark, ["..", " Kin/Q7 ", None, ". "], lambda c: names.named_folder(c, "unknown-lens")) == ["unknown-lens", "Kin_Q7", "unknown-lens", "unknown-lens"]
    assert one(spark, 1.5, "double").select(names.map_url("m:{lat},{lon}/{zoom}", F.col("x"), F.lit(-2.0), F.lit(9)).alias("u")).first().u == "m:1.500000,-2.000000/9"


def test_dates_are_whole(spark):
    rows = ["2031:04:05 06:07:08", "2031:04:05T06:07:08", "2031:04:05 06:07:08.5", "2031:04:05 06:07:08 z", "2031:04:05  06:07", "2031:04:05 06:07 ", "x 2031:04:05 06:07"]
    got = values(spark, rows, exif.epoch_seconds)
    assert got[1:5] == [None] * 4 and got[6] is None and got[0] - got[5] == 8
    assert values(spark, [0, 90, 180, 270, 45], exif.rotation_orientation, "int") == [1, 6, 3, 8, 1]


def test_decisions(spark):
    assert values(spark, ["all", "unrated", "x"], choices.next_filter) == ["pick", "all", None]
    assert values(spark, [4, 5], choices.dead_decode, "int") == [False, True]
    assert values(spark, ["/a/./b/../c/", "a//b", "", "C:\\x\\.."], choices.plain_folder) == ["/a/c", "a/b", None, "C:"]
    row = one(spark, "/a/b/").select(
        choices.same_folder(F.col("x"), F.lit("/a/c/../b")).alias("same"), choices.same_folder(F.lit(""), F.lit("")).alias("none"), choices.same_folder(F.col("x"), F.lit("/A/B"), True).alias("folded"),
        choices.hits_open_folder(F.col("x"), F.lit("/a/b"), F.lit("none")).alias("hit"), choices.hits_open_folder(F.col("x"), F.lit("/a/b"), F.lit("tag")).alias("free"),
        choices.output_key(F.lit("k"), F.lit(0).cast("long")).alias("k0"), choices.output_key(F.lit("k"), F.lit(255).cast("long")).alias("k1"),
        (choices.signature(edge=F.lit(640), focus=F.lit(True)) == choices.signature(focus=F.lit(True), edge=F.lit(640))).alias("steady"),
        (choices.signature(edge=F.lit(640)) == choices.signature(edge=F.lit(512))).alias("blind"),
    ).first()
    assert (row.same, row.none, row.folded, row.hit, row.free, row.k0, row.k1, row.steady, row.blind) == (True, False, True, True, False, "k", "k-00000000000000ff", True, False)
    shown = lambda v, m, d, below: tuple(one(spark, "x").select(choices.compared_numbers(F.lit(v).cast("float"), F.lit(m).cast("float"), d, below).alias("t")).first().t)
    assert shown(0.3, 0.6, 1, True) == ("0.3", "0.6") and shown(0.4496, 0.45, 2, True) == ("0.4496", "0.4500") and shown(2.00001, 2.0, 1, False) == ("2.0001", "2.0000")
    assert shown(0.125, 0.5, 2, True) == ("0.12", "0.50")  # a tie goes to the even digit


def test_settings_and_sessions_on_disk(spark, tmp_path):
    path, defaults = tmp_path / "set.json", {"recursive": True, "columns": 4, "ratio": 0.5, "last": None, "names": {"a": "x"}}
    assert settings.load(path, defaults) == defaults
    settings.save(path, {"columns": 7, "recursive": 3, "ratio": 2, "names": {"a": "y", "zz": 1}, "old": 1})
    assert settings.load(path, defaults) == {"recursive": True, "columns": 7, "ratio": 2.0, "last": None, "names": {"a": "y"}}
    path.write_bytes(b"\xff{")
    assert settings.load(path, defaults) == defaults and not path.exists() and (tmp_path / "set.json.corrupt").exists()
    rows = spark.createDataFrame([("a", "pick", 3, None, ["a.orf"])], "key string, label string, stars int, tag string, members array<string>")
    saved = tmp_path / "s" / "session.json"
    for label in ("hold", "pick"):
        settings.save_session(rows.withColumn("label", F.lit(label)), saved, "/photos", "2031-01-01")
    assert settings.load_session(spark, saved).first().label == "pick" and json.loads((tmp_path / "s" / "session.json.bak").read_text())["items"]["a"]["label"] == "hold"
    saved.write_text("{broken")
    assert settings.load_session(spark, saved).first().label == "hold" and (tmp_path / "s" / "session.json.corrupt").exists()
    assert settings.load_session(spark, saved).count() == 1 and settings.load_session(spark, tmp_path / "none.json").count() == 0


def test_later_of_two_folding_keys_wins(spark):
    saved = spark.createDataFrame([("Bay", "hold", 1, None, []), ("bay", "pick", 0, None, ["x\\Bay.orf"]), ("sub/c", "pick", 0, None, [])], "key string, label string, stars int, tag string, members array<string>")
    items = spark.createDataFrame([("i", "unrated", 0, None)], "item string, label string, stars int, tag string")
    wanted = spark.createDataFrame([("i", 0, "BAY"), ("i", 1, "X/bay.ORF"), ("i", 2, "none")], "item string, prio int, key string")
    assert [(r.label, r.stars) for r in sessions.restore(items, wanted, saved).collect()] == [("pick", 0)]
    assert [r.key for r in sessions.claimed(wanted, saved).collect()] == ["bay"]


def test_scan_hides_nothing(spark, tmp_path):
    for p in ("_ICE1.NEF", "deep/er/_ICE2.jpg", "two..jpg", "note.txt", "$RECYCLE.BIN/x.jpg", "._two.jpg"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(p.encode())
    names_of = lambda df: sorted(os.path.relpath(r.path, tmp_path) for r in df.collect())
    assert names_of(files.scan(spark, str(tmp_path))) == ["_ICE1.NEF", "deep/er/_ICE2.jpg", "two..jpg"]
    assert names_of(files.scan(spark, str(tmp_path), recursive=False)) == ["_ICE1.NEF", "two..jpg"]
    got = files.scan(spark, str(tmp_path), content=True).where("path like '%ICE1%'").first()
    assert bytes(got.content) == b"_ICE1.NEF" and got.size == 9 and got.modified is not None
    rows = spark.createDataFrame([("/b/x10.jpg", 5), ("/a/x9.jpg", 5), ("/a/x1.jpg", 9)], "display string, modified int")
    assert [r.display for r in rows.orderBy(*files.scan_order("name")).collect()] == ["/a/x1.jpg", "/a/x9.jpg", "/b/x10.jpg"]
    assert [r.display for r in rows.orderBy(*files.scan_order("modified")).collect()] == ["/a/x1.jpg", "/a/x9.jpg", "/b/x10.jpg"]


def test_metadata_cascade():
    block = tiff_bytes([(tiff.MAKE, 2, 9, b"\0\0Kinlux\0\0"), (tiff.ISO, 3, 1, struct.pack("<H", 320))])
    data = b"junk Exif\0\0not a header" + b"Exif\0\0" + tiff_bytes([]) + b"Exif\0\0" + block
    found = tiff.first_fields(data)
    assert found["iso"] == "320" and found["make"] == "Kinlux"


def box(kind, body, version=None):
    body = (struct.pack(">I", version << 24) if version is not None else b"") + body
    return struct.pack(">I", 8 + len(body)) + kind + body


def heif_bytes(turn, mirror, kind=b"hvc1"):
    picture, thumb = b"P" * 40, b"\xff\xd8\xff" + b"T" * 20
    infe = lambda i, k: box(b"infe", struct.pack(">HH", i, 0) + k, 2)

    def meta(base):
        iloc = struct.pack(">BBH", 0x44, 0, 2) + b"".join(struct.pack(">HHHII", i, 0, 1, base + at, n) for i, at, n in ((1, 0, 40), (2, 40, 23)))
        props = box(b"ispe", struct.pack(">II", 4000, 3000), 0) + box(b"irot", bytes([turn])) + box(b"imir", bytes([mirror])) + box(b"ispe", struct.pack(">II", 320, 240), 0)
        ipma = struct.pack(">I", 2) + struct.pack(">HB", 1, 3) + bytes([1, 2, 3]) + struct.pack(">HB", 2, 1) + bytes([4])
        parts = box(b"pitm", struct.pack(">H", 1), 0) + box(b"iinf", struct.pack(">H", 2) + infe(1, kind) + infe(2, b"jpeg"), 0) + box(b"iref", box(b"thmb", struct.pack(">HHH", 2, 1, 1)), 0)
        return box(b"meta", parts + box(b"iprp", box(b"ipco", props) + box(b"ipma", ipma, 0)) + box(b"iloc", iloc, 0), 0)

    head = box(b"ftyp", b"heic\0\0\0\0")
    size = len(head) + len(meta(0)) + 8
    return head + meta(size) + box(b"mdat", picture + thumb)


def test_heif_index(spark):
    data = heif_bytes(1, 1)
    found = heif.index(data)
    assert found["primary"] == 1 and found["edge"] == 4000
    one_, two = found["items"]
    assert data[one_["offset"] : one_["offset"] + one_["length"]] == b"P" * 40 and one_["role"] == "primary" and (two["role"], two["kind"], two["width"]) == ("thumb", "jpeg", 320)
    rows = [(0, bytearray(data)), (1, bytearray(data[:100])), (2, None), (3, bytearray(heif_bytes(0, 0, b"jpeg")))]
    df = heif.with_index(spark.createDataFrame(rows, "i int, content binary"))
    none = F.array().cast("array<struct<offset:int,length:int,width:int,height:int,edge:int>>")
    got = df.select("i", heif.choose(F.col("heif.items"), none, 400).alias("a"), heif.choose(F.col("heif.items"), none, 4000).alias("b")).orderBy("i").collect()
    assert got[0].a.source == "item" and got[0].b is None and got[1].a is None and got[2].a is None and got[3].b.source == "primary"


def test_heif_turns_equal_turned_pixels():
    x = np.arange(6).reshape(2, 3, 1)
    for turn in range(4):
        for mirror in (None, 0, 1):
            want = np.rot90(x, turn)
            want = want if mirror is None else want[::-1] if mirror == 0 else want[:, ::-1]
            steps = [("turn", turn)] + ([("mirror", mirror)] if mirror is not None else [])
            assert np.array_equal(pixels.oriented(x, heif.composed(steps)), want), steps


def test_model_scores_cost_one_row(spark):
    def load():
        def model(batch):
            if (batch > 200).any():
                raise RuntimeError("model failed")
            return np.stack([1 - batch.mean(axis=(1, 2, 3)), batch.mean(axis=(1, 2, 3))], axis=1)

        return model

    raw = lambda x: x.astype(np.float32)
    image = lambda v, n=4: ((n, n, 3, bytearray([v] * (n * n * 3))),)
    rows = [image(0), image(1), image(250), ((4, 4, 3, bytearray(b"short")),), image(3)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, image struct<height:int,width:int,nChannels:int,data:binary>").coalesce(1)
    got = [r.s for r in scoring.score(df, load, raw, scoring.aesthetic_score, "s", "double", batch=4).orderBy("i").collect()]
    assert got == [0.0, 1.0, None, None, 1.0]
    short = scoring.score(df, lambda: lambda batch: np.zeros((0, 1)), raw, scoring.aesthetic_score, "s", "double")
    assert [r.s for r in short.collect()] == [None] * 5
    assert scoring.axes_scores(np.array([0.1, 0.2, 0.3, 0.4]))["sharp"] == pytest.approx(0.3)
    assert scoring.face_score([np.array([0.5, 0.9])] * 3 + [np.array([1.0, 0.5])] * 3) == pytest.approx(0.5)
    rgb = np.full((10, 20, 3), (255, 0, 0), np.uint8)
    assert scoring.clip_input(rgb).shape == (3, 224, 224) and scoring.face_input(rgb)[2, 0, 0] == 255 and scoring.object_input(rgb)[0, 0, 0] == 1


def test_detected_classes(spark):
    found = [(0.9, 2.4), (0.2, 7.0), (0.3, 2.0), (0.5, 79.6), (0.5, -0.4), (0.8, 17.5)]
    assert scoring.detections(np.array([[0, 0, 0, 0, c, k] for c, k in found], np.float32)) == [2, 0, 18]
    df = spark.createDataFrame([(found,)], "d array<struct<conf:float,cls:float>>")
    assert df.select(scoring.sure_classes(F.col("d")).alias("c")).first().c == [2, 0, 18]
    kinds = ["sports ball", "ball", "dog"]
    assert values(spark, ["Ball", " ball game", "zebra", "", "DO"], lambda c: scoring.class_number(c, kinds)) == [1, 1, None, None, 2]


def test_reports_of_chosen_signals_and_regions(spark):
    half = np.full((64, 128, 3), 128, np.uint8)
    half[:, 64:] = np.where((np.indices((64, 64)).sum(axis=0) % 2)[..., None] > 0, 255, 0)
    off = pixels.report(half, signals=("exposure",))
    assert off["sharpness"] == off["tilt"] == 0 and off["mean"] > 0 and off["good"]
    assert pixels.report(half, ("focus",), [(0.2, 0.5, 0.1, 0.1)])["sharpness"] == 0 and pixels.report(half, ("focus",), [(0.8, 0.5, 0.1, 0.1)])["in_focus"]
    assert pixels.report(half, ("focus",), [(0.2, 0.5, 0.1, 0.1)], {"focus": 0.2})["good"] is False
    assert pixels.tilt(np.tile(np.arange(7) * 30, (7, 1))) == (0.0, 0.0)
    ramp = np.tile(np.linspace(0, 255, 512), (16, 1)).astype(np.uint8)
    assert np.abs(np.diff(pixels.shrunk(ramp, 64)[0].astype(int))).max() <= 6 and pixels.shrunk(half, 32).shape == (16, 32, 3)
    rows = spark.createDataFrame([((64, 128, 3, bytearray(half.tobytes())), [(0.8, 0.5, 0.1, 0.1)]), ((1, 1, 3, None), None)], "image struct<height:int,width:int,nChannels:int,data:binary>, at array<struct<cx:double,cy:double,w:double,h:double>>")
    got = pixels.score_images(rows, signals=("focus",), regions="at").collect()
    assert got[0].report.in_focus and got[1].report is None


def test_looks(spark):
    rgba = bytes(range(200))
    assert looks.applied(rgba, None) == looks.applied(rgba, looks.baked("dusk"), compare=True) == rgba
    for name in looks.LOOKS:
        table = looks.baked(name)
        assert table.shape == (17**3, 3) and table.min() >= 0 and table.max() <= 1
        out = looks.applied(rgba, table)
        assert out[3::4] == rgba[3::4] and len(out) == len(rgba)
    identity = np.stack(np.meshgrid(*[np.linspace(0, 1, 5)] * 3, indexing="ij")[::-1], axis=-1).reshape(-1, 3)
    assert looks.applied(rgba, identity) == rgba
    df = spark.createDataFrame([(bytearray(rgba),), (None,)], "rgba binary")
    assert [bytes(r.rgba) if r.rgba else None for r in looks.with_look(df, "slate").collect()] == [looks.applied(rgba, looks.baked("slate")), None]


def test_cache_rows_and_histograms(spark, tmp_path):
    text = '[{"path":"a","mtime":1,"signature":2,"extra":0},{"path":"a","mtime":3},{"mtime":9},{"path":"b","aesthetic":0.5}]'
    got = {r.path: (r.mtime, r.aesthetic) for r in cache.entries(spark.createDataFrame([(text,), ("no list",), (None,)], "text string")).collect()}
    assert got == {"a": (3, None), "b": (None, 0.5)}
    bins = list(range(192))
    df = spark.createDataFrame([("k", bytearray(b"j"), bins), ("l", bytearray(b"j"), [1])], "key string, jpeg binary, histogram array<int>")
    cache.store(df, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t")).select("key", cache.unpacked_histogram("histogram").alias("h"), cache.histogram_top(cache.unpacked_histogram("histogram")).alias("top")).orderBy("key").collect()
    assert (back[0].h, back[0].top, back[1].h, back[1].top) == (bins, 191, None, 1)
    cache.clear(spark, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 0
    key = lambda **k: one(spark, "p").select(cache.cache_key(1, F.col("x"), *(F.lit(k.get(n, 5)) for n in ("size", "mtime", "edge")), F.lit(k.get("heic", False))).alias("k")).first().k
    assert len({key(), key(size=6), key(mtime=6), key(edge=6), key(heic=True)}) == 5 and len(key()) == 16
    assert cache.newest(spark.createDataFrame([("a", 1), ("b", 2)], "path string, mtime int"), 1).first().path == "b"
    assert cache.totals(spark.createDataFrame([(3,), (None,)], "size int")).first().bytes == 3


def test_history_moves_both_ways(spark):
    items = spark.createDataFrame([(1, "x"), (2, "unrated")], "item_id long, label string")
    log = spark.createDataFrame([(1, 1, "unrated", "pick"), (2, 1, "pick", "hold"), (3, 2, "unrated", "reject")], "step long, item_id long, old_label string, label string")
    state = lambda n: {r.item_id: r.label for r in selection.at_step(items, log, n).collect()}
    assert [state(n) for n in (0, 1, 2, 3)] == [{1: "unrated", 2: "unrated"}, {1: "pick", 2: "unrated"}, {1: "hold", 2: "unrated"}, {1: "hold", 2: "reject"}]
    edit = spark.createDataFrame([(2, "unrated", "pick")], "item_id long, old_label string, label string")
    assert sorted((r.step, r.label) for r in selection.edited(log, edit, 1).collect()) == [(1, "pick"), (2, "pick")]


def test_near_pairs_find_all(spark):
    rng = np.random.default_rng(2)
    hashes = [int(x) for x in rng.integers(-(1 << 63), 1 << 63, 60)]
    for h in hashes[:20]:
        flips = rng.choice(64, rng.integers(1, 9), replace=False)
        v = (h & (1 << 64) - 1) ^ sum(1 << int(b) for b in flips)
        hashes.append(v - (1 << 64) if v >> 63 else v)
    near = {(min(a, b), max(a, b)) for i, a in enumerate(hashes) for b in hashes[i + 1 :] if a != b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 6}
    got = similar.near_pairs(spark.createDataFrame([(h,) for h in [*hashes, None]], "h long"), 6)
    assert {(r.a, r.b) for r in got.collect()} == near and len(near) >= 8


def test_near_pairs_do_not_pass_the_driver(spark):
    rng = np.random.default_rng(3)
    hashes = spark.createDataFrame([(int(x),) for x in rng.integers(-(1 << 63), 1 << 63, 500)], "h long")
    pairs = similar.near_pairs(hashes, 6)
    pairs.collect()
    plan = pairs._jdf.queryExecution().executedPlan().toString()  # the rows that a self-join under every mask would broadcast are 84 times the hashes
    assert "isFinalPlan=true" in plan and "SortMergeJoin" in plan and "Broadcast" not in plan


def test_cluster_queries_do_not_pass_the_driver(spark, monkeypatch):
    from shutterfold.plans.registry import QUERIES

    asked = []
    monkeypatch.setattr(similar, "connected_components", lambda edges, *ends: asked.append(edges) or edges.selectExpr("a AS node", "a AS component"))
    for name in ("dedup_best", "near_dup_clusters"):
        QUERIES[name](spark, "/root/testdata/sf0.001")
    for edges in asked:
        edges.collect()
        assert "Broadcast" not in edges._jdf.queryExecution().executedPlan().toString()
    assert len(asked) == 2


def test_transfer_targets_read_their_items_once(spark):
    from shutterfold.plans.registry import QUERIES

    found = QUERIES["transfer_targets"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() > 0 and "l_linenumber" not in plan and plan.count("Generate explode") + plan.count("Generate posexplode") == 1


def test_parts_of_odd_paths(spark):
    paths = ["", "a", "/", "/a", "a/", "//", "a//b", "/a/./b", "a/..", "/../a", ".", "..", "...", "/.a/b..", "x\\y/z", "a/b\n", "a/\n", "\u00e9/\u00fc\u00df/n", None]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    for r in df.select("p", names.file_name(F.col("p")).alias("name"), names.parent(F.col("p")).alias("parent"), choices.plain_folder(F.col("p")).alias("plain")).collect():
        if r.p is None:
            assert (r.name, r.parent, r.plain) == (None, None, None)
            continue
        parent, _, name = r.p.replace("\\", "/").rpartition("/")
        kept: list[str] = []
        for x in r.p.replace("\\", "/").split("/"):
            kept = kept[:-1] if x == ".." else kept + [x] * (x not in ("", "."))
        plain = "/" * r.p.startswith(("/", "\\")) + "/".join(kept)
        assert (r.name, r.parent, r.plain) == (name, parent, plain or None), r.p


def test_dates_match_once(spark):
    df = spark.createDataFrame([("2024:01:02 03:04:05",), ("2024-02-31 1:2",), ("2024:13:01 00:00:00",), ("99999999999999999999:1:1 0:0",), ("2024:1:1 0:0:-7:x",), ("x",), (None,)], "t string")
    found = df.select(exif.epoch_seconds(F.concat("t", F.lit(""))).alias("s"))
    assert [r.s for r in found.collect()] == [1704164645, 1709341320, None, None, 1704067193, None, None]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_") + plan.count("RLIKE") <= 3  # the numbers of a date have 30 uses, each of which searched the text again


def test_organised_files_resolve_and_move(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = []
    for i, (name, camera) in enumerate((("_a.orf", "Kin 7"), ("b..jpg", None), ("_A.orf", "Kin 7"))):
        folder = tmp_path / "in" / str(i)
        folder.mkdir()
        (folder / name).write_text(name)
        rows.append((i, i, str(folder / name), "2031:04:05 1", camera, None, None))
    df = spark.createDataFrame(rows, "item_id int, pos int, path string, exif_date string, camera string, lens string, focal string").withColumn("modified", F.lit(None).cast("timestamp"))
    planned = transfer.organise(df, f"{tmp_path}/out", "camera")
    solved = transfer.resolve_collisions(planned, spark.createDataFrame([], "folder string, name string"))
    assert {r.status for r in transfer.execute(solved, move=True).collect()} == {"sent"}
    assert sorted(str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*.*") if p.is_file()) == ["Kin 7/_A_001.orf", "Kin 7/_a.orf", "unknown-camera/b..jpg"]


def jpeg_of(spark, shade, w=24, h=16):
    """A JPEG of one shade, by the Java runtime that Spark runs on."""
    jvm = spark._jvm
    image = jvm.java.awt.image.BufferedImage(w, h, 1)
    for x in range(w):
        for y in range(h):
            image.setRGB(x, y, shade << 16 | shade << 8 | shade)
    out = jvm.java.io.ByteArrayOutputStream()
    jvm.javax.imageio.ImageIO.write(image, "jpg", out)
    return bytes(out.toByteArray())


def test_every_kind_of_file_comes_to_pixels(spark, tmp_path):
    small, large = jpeg_of(spark, 40), jpeg_of(spark, 200, 80, 40)
    turned = b"\xff\xd8\xff\xe1" + struct.pack(">H", 8 + len(block := tiff_bytes([(tiff.ORIENTATION, 3, 1, struct.pack("<H", 6))]))) + b"Exif\0\0" + block + small[2:]
    rows = [("/p/a.jpg", turned), ("/p/b.nef", b"raw" * 5 + small + b"gap" + large + b"end"), ("/p/c.heic", heif_bytes(3, 1)), ("/p/d.arw", b"nothing"), ("/p/e.jpg", b"broken")]
    (tmp_path / "out").mkdir()
    df = spark.createDataFrame([(p, bytearray(b)) for p, b in rows], "path string, content binary")
    got = {r.path[-5:-4] if r.path.endswith("heic") else r.path[3]: r for r in files_decoded(df, str(tmp_path / "out"))}
    assert (got["a"].image.width, got["a"].orientation, got["a"].bytes_from) == (24, 6, "file") and abs(got["a"].image.data[0] - 40) < 4
    assert (got["b"].image.width, got["b"].bytes_from, got["b"].original_edge) == (80, "preview", 80)
    by_path = {r.path: r for r in got.values()}
    assert by_path["/p/c.heic"].image is None and by_path["/p/c.heic"].original_edge == 4000 and by_path["/p/c.heic"].orientation == heif.composed([("turn", 3), ("mirror", 1)])
    assert by_path["/p/d.arw"].bytes_from is None and by_path["/p/d.arw"].image is None and by_path["/p/e.jpg"].image is None


def files_decoded(df, folder):
    from shutterfold.sources import decode

    return decode.decoded(df, folder, 50).collect()
