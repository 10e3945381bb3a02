"""Whole runs: culling tables against a plain model, and folders from the scan to sent files."""

import json
import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from shutterfold.operators import cache, runs, transfer
from shutterfold.operators.culling import Criteria, MetaFilter
from shutterfold.sources import collection, tiff
from tests.test_choices import jpeg_of
from tests.test_collection import tiff_bytes

ITEMS = "key long, pos long, label string, stars int, tag string"
REPORTS = "key long, sharpness float, exposure float, tilt float, tilt_confidence float, aesthetic float, face boolean, sharp_ai float, object_match boolean, dhash long"
SHOTS = "key long, shot_time long, iso int"


def tables(spark, n, seed):
    rng = random.Random(seed)
    maybe = lambda p, x: x if rng.random() < p else None
    items = [(i, n - i, rng.choice(["unrated", "hold"]), rng.randint(0, 5), maybe(0.3, "teal")) for i in range(n)]
    reports = [
        (i, rng.choice([0.1, 0.5, 0.9]), rng.choice([0.1, 0.6]), rng.choice([0.0, 9.0]), rng.choice([0.1, 0.9]), maybe(0.8, rng.choice([0.2, 0.5, rng.random()])), maybe(0.8, rng.random() < 0.8),
         maybe(0.8, rng.random()), maybe(0.8, rng.random() < 0.9), maybe(0.9, rng.choice([0, 1, 255, 1 << 40]))) for i in range(n) if i % 11
    ]
    shots = [(i, maybe(0.9, rng.randint(0, 2 * n)), maybe(0.9, rng.choice([100, 6400]))) for i in range(n) if i % 7]
    return items, reports, shots, (spark.createDataFrame(items, ITEMS), spark.createDataFrame(reports, REPORTS), spark.createDataFrame(shots, SHOTS))


def f32(x):
    return struct.unpack("f", struct.pack("f", x))[0]


def plain(items, reports, shots, s):
    """Outcome of every item by loops over a list, as one machine would do it."""
    pos = {i[0]: i[1] for i in items}
    time = {k: (t, iso) for k, t, iso in shots}
    rows = []
    for r in reports:
        key, sharp, light, tilt, sure, score, face, ai, thing, dhash = r
        t, iso = time.get(key, (None, None))
        bad = [sharp < f32(s.criteria.focus), sure >= f32(0.2) and abs(tilt) > s.criteria.tilt]
        if not s.criteria.top_n and s.criteria.aesthetic is not None:
            bad.append(score is not None and f32(score) < f32(s.criteria.aesthetic))
        hard = (s.face and face is False) or (s.genre == "landscape" and face is True) or (s.sharp_min is not None and ai is not None and f32(ai) < f32(s.sharp_min)) or (s.thing and thing is False)
        rows.append({"key": key, "order": (t is None, t or 0, pos[key]), "t": t, "score": score, "sharp": sharp, "hash": dhash, "good": not any(bad), "hard": hard, "in": iso is None or s.meta is None or iso <= s.meta.iso_max})
    rows.sort(key=lambda r: r["order"])
    if s.criteria.top_n:
        best = sorted((r for r in rows if r["score"] is not None), key=lambda r: -f32(r["score"]))[: s.criteria.top_n]
        for r in rows:
            r["good"] = r in best
    for r in rows:
        r["good"] = r["good"] and not r["hard"] and r["in"]

    def keep_best(group, keep):
        able = [r for r in group if r["good"]]
        if len(able) >= 2:
            able.sort(key=lambda r: (r["score"] is None, -f32(r["score"] or 0), -r["sharp"]))
            for r in able[keep:]:
                r["good"] = False

    inside = [r for r in rows if r["in"]]
    groups, last = [], None
    for r in inside:
        if last is None or last["t"] is None or r["t"] is None or abs(r["t"] - last["t"]) > s.burst_gap:
            groups.append([])
        groups[-1].append(r)
        last = r
    for g in groups:
        keep_best(g, s.burst_keep)
    root = list(range(len(inside)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i, a in enumerate(inside):
        for j in range(i):
            if a["hash"] is not None and inside[j]["hash"] is not None and bin((a["hash"] ^ inside[j]["hash"]) & (1 << 64) - 1).count("1") <= s.hamming:
                root[find(i)] = find(j)
    for c in {find(i) for i, r in enumerate(inside) if r["hash"] is not None}:
        keep_best([r for i, r in enumerate(inside) if r["hash"] is not None and find(i) == c], s.dedup_keep)
    return {r["key"]: "excluded" if not r["in"] else "good" if r["good"] else "bad" for r in rows}


@pytest.mark.parametrize("seed,top_n", [(1, 0), (2, 40)])
def test_a_run_equals_a_plain_model(spark, seed, top_n):
    items, reports, shots, frames = tables(spark, 160, seed)
    s = runs.Settings(Criteria(0.3, None, 5.0, 0.3, top_n), MetaFilter(iso_max=3200), face=True, sharp_min=0.2, thing=True, burst_gap=3, burst_keep=2, hamming=2, dedup_keep=9)
    after = runs.cull(frames[0], frames[1], s, frames[2])
    got = {r["key"]: r for r in after.collect()}
    want = plain(items, reports, shots, s)
    assert {k: r["outcome"] for k, r in got.items()} == {i[0]: want.get(i[0]) for i in items} and {"good", "bad", "excluded"} == set(want.values())
    for key, _, label, stars, tag in items:
        r = got[key]
        assert (r["stars"], r["tag"]) == (stars, tag) and r["label"] == {"good": "pick", "bad": "reject"}.get(r["outcome"], label)
        assert (r["outcome"] == "bad") == bool(r["primary"] or []) and (r["outcome"] in ("good", "bad") or not r["secondary"])
    back = runs.undone(after.select("key", "pos", "label", "stars", "tag"), runs.edits(after))
    assert sorted(map(str, back.select("key", "pos", "label", "stars", "tag").collect())) == sorted(map(str, frames[0].collect()))


def test_axes_and_refusals(spark):
    _, _, _, (items, reports, _) = tables(spark, 30, 3)
    got = runs.cull(items, reports, runs.Settings(Criteria(focus=0.3), axis="stars", good=5, bad=1)).where("outcome is not null")
    assert {(r.outcome, r.stars) for r in got.collect()} == {("good", 5), ("bad", 1)} and got.where("label <> old_label or stars = old_stars and old_stars not in (1, 5)").count() == 0
    with pytest.raises(ValueError):
        runs.cull(items, reports.withColumn("aesthetic", F.lit(math.nan).cast("float")), runs.Settings(Criteria(top_n=3)))
    assert runs.cull(items.limit(0), reports, runs.Settings(Criteria(top_n=3))).count() == 0 == runs.cull(items, reports.limit(0), runs.Settings(Criteria(focus=1.0))).where("outcome is not null").count()


def test_the_cache_spares_what_it_holds(spark):
    wanted = spark.createDataFrame([(i, f"/p/{i}", 10 + i % 2, 7) for i in range(12)], "key long, path string, mtime long, signature long")
    cached = spark.createDataFrame([(f"/p/{i}", 10, 7 if i < 8 else 8, 0.9 if i != 4 else 0.1, None if i < 6 else 0.5) for i in range(10)], "path string, mtime long, signature long, sharpness float, aesthetic float")
    asked, scored = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def counting(total, column, value):
        return lambda rows: (rows.foreach(lambda _: total.add(1)), rows.withColumn(column, value))[1]

    measure = counting(asked, "sharpness", F.when(F.col("key") != 3, F.col("key") / 10).cast("float"))
    score = counting(scored, "aesthetic", F.when(F.col("key") == 7, F.lit(math.nan)).otherwise(0.8))
    plain = runs.Settings(Criteria(focus=0.5))
    reports, after = runs.measured(wanted, cached, measure, plain)
    assert asked.value == 8 and reports.where("from_cache").count() == 4  # 0, 2, 4 and 6 fit by time and signature
    assert after.count() == 12 and after.where("signature = 8").count() == 0
    rated = runs.Settings(Criteria(focus=0.5, aesthetic=0.4))
    reports, after = runs.measured(wanted, cached, measure, rated, score)
    got = {r["key"]: r for r in reports.collect()}
    assert [k for k, r in got.items() if r.from_cache] == [6] or {k for k, r in got.items() if r.from_cache} == {4, 6}  # 4 fails its checks and needs no score
    assert scored.value == sum(r["sharpness"] is None or r["sharpness"] >= 0.5 for r in got.values() if not r.from_cache)
    assert got[7].aesthetic is None and after.where("path = '/p/7' and mtime = 11").count() == 0
    assert runs.totals(runs.cull(wanted.withColumns({"pos": F.col("key"), "label": F.lit("unrated"), "stars": F.lit(0), "tag": F.lit(None).cast("string")}), reports, rated), reports).first().cached == 2
    assert cache.newest(after, 3, "mtime").count() == 3


def photo(spark, shade, taken, camera=b"Kin 7\0", w=48, h=32):
    """A JPEG with a capture date and a camera."""
    date = taken.encode() + b"\0"
    small = jpeg_of(spark, shade, w, h)
    block = tiff_bytes([(tiff.MODEL, 2, len(camera), camera), (tiff.DATETIME, 2, len(date), date)])
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", 8 + len(block)) + b"Exif\0\0" + block + small[2:]


@pytest.fixture
def folder(spark, tmp_path):
    root = tmp_path / "card"
    (root / "sub").mkdir(parents=True)
    dates = {"IMG_10.jpg": "2031:04:05 06:07:08", "IMG_2.jpg": "2031:04:05 06:07:09", "sub/B_1.JPG": "2031:04:06 01:00:00"}
    for (name, taken), shade in zip(dates.items(), (128, 130, 2)):
        (root / name).write_bytes(photo(spark, shade, taken))
    (root / "IMG_2.ORF").write_bytes(b"raw")
    (root / "broken.jpg").write_bytes(b"no image")
    (root / "notes.txt").write_text("x")
    return root


def test_open_cull_save_and_open_again(spark, folder, tmp_path):
    session, pixels = tmp_path / "session.json", tmp_path / "pixels"
    session.write_text(json.dumps({"version": 1, "items": {"img_10": {"label": "hold", "stars": 9, "members": []}, "old": {"label": "pick", "members": ["sub\\b_1.jpg"]}}}))
    items = collection.open_folder(spark, str(folder), True, "capture", str(session)).orderBy("pos").collect()
    assert [(r.stem, r.pos, r.label, r.stars, len(r.members)) for r in items] == [("IMG_10", 1, "hold", 5, 1), ("IMG_2", 2, "unrated", 0, 2), ("B_1", 3, "pick", 0, 1), ("broken", 4, "unrated", 0, 1)]
    by_name = collection.open_folder(spark, str(folder)).orderBy("pos")
    assert [r.stem for r in by_name.collect()] == ["B_1", "broken", "IMG_2", "IMG_10"]
    assert [r.stem for r in collection.open_folder(spark, str(folder), recursive=False).orderBy("pos").collect()] == ["broken", "IMG_2", "IMG_10"]

    s = runs.Settings(Criteria(exposure=0.2), burst_gap=5, hamming=8)
    none = spark.createDataFrame([], "path string, mtime long, signature long")
    after, reports, cached = collection.cull_folder(by_name, none, str(pixels), s)
    found = {r.stem: r for r in after.collect()}
    assert {k: r.outcome for k, r in found.items()} == {"IMG_10": "good", "IMG_2": "bad", "B_1": "bad", "broken": None}
    assert [f.kind for f in found["IMG_2"].primary] == ["burst"] and found["B_1"].primary[0].kind == "exposure" and found["broken"].label == "unrated"
    again, reports, _ = collection.cull_folder(by_name, cached, str(tmp_path / "pixels2"), s)
    assert reports.where("from_cache").count() == 3 and len(list((tmp_path / "pixels2").iterdir())) == 1 and {r.stem: r.outcome for r in again.collect()} == {k: r.outcome for k, r in found.items()}

    collection.save_folder(after, str(folder), str(session), "2031-04-07T00:00:00Z")
    saved = json.loads(session.read_text())["items"]
    assert {k: v["label"] for k, v in saved.items()} == {"IMG_10": "pick", "IMG_2": "reject", "sub/B_1": "reject"} and saved["IMG_2"]["members"] == ["IMG_2.ORF", "IMG_2.jpg"]
    assert {r.stem: r.label for r in collection.open_folder(spark, str(folder), True, "name", str(session)).collect()} == {"IMG_10": "pick", "IMG_2": "reject", "B_1": "reject", "broken": "unrated"}


def test_send_and_organise(spark, folder, tmp_path):
    items = collection.open_folder(spark, str(folder)).withColumns({"label": F.when(F.col("stem") != "broken", "pick").otherwise("unrated"), "stars": F.when(F.col("stem") == "IMG_2", 5).otherwise(0)})
    out = tmp_path / "out"
    out.mkdir()
    (out / "1_pick.jpg").write_text("old")
    t = collection.Transfer(str(out), ("pick",), template="{seq}_{label}")
    assert [tuple(r) for r in collection.preview(items, t, 2).collect()] == [("B_1.JPG", "1_pick.JPG"), ("IMG_2.ORF", "2_pick.ORF")]
    done = collection.send(items, t, str(folder)).collect()
    assert sorted(r.final_name for r in done) == ["1_pick_001.JPG", "2_pick.ORF", "2_pick.jpg", "3_pick.jpg"] and {r.status for r in done} == {"sent"}
    assert (out / "1_pick.jpg").read_text() == "old" and (folder / "IMG_2.ORF").exists()
    with pytest.raises(ValueError):
        collection.send(items, collection.Transfer(f"{folder}/", ("pick",)), str(folder))
    graded = collection.preview(items, collection.Transfer(str(out), ("pick",), template="{gradeseq:02}-{seq}-{stars:3}-{x}{orig}", by_grade=True), 9).collect()
    assert [tuple(r) for r in graded] == [("B_1.JPG", "B_1.JPG"), ("IMG_2.ORF", "A01-1-5-IMG_2.ORF"), ("IMG_2.jpg", "A01-1-5-IMG_2.jpg"), ("IMG_10.jpg", "IMG_10.jpg")]

    split = collection.Transfer(str(folder), split="label", move=True)
    moved = transfer.report(collection.send(items, split, str(folder))).first()
    assert (moved.transferred, moved.in_place, moved.raw, moved.remove_failed) == (5, 0, 1, 0) and (folder / "pick" / "IMG_2.ORF").exists() and not (folder / "IMG_2.ORF").exists()
    items = collection.open_folder(spark, str(folder))
    stay = transfer.report(collection.send(items.withColumn("label", F.when(F.col("stem") != "broken", "pick").otherwise("unrated")), split, str(folder))).first()
    assert (stay.transferred, stay.in_place, stay.renames) == (0, 5, 0)

    by_date = collection.organise(items, str(tmp_path / "days"), "date", move=False).collect()
    assert {r.folder[len(str(tmp_path)) :] for r in by_date if "broken" not in r.path} == {"/days/2031-04-05", "/days/2031-04-06"} and {r.status for r in by_date} == {"sent"}
    by_ext = collection.organise(items, str(tmp_path / "kinds"), "extension", move=False).collect()
    assert {r.folder.rpartition("/")[2] for r in by_ext} == {"JPG", "ORF"}
    camera = collection.organise(collection.open_folder(spark, str(tmp_path / "days")), str(tmp_path / "days"), "camera").collect()
    assert {r.folder.rpartition("/")[2] for r in camera} == {"Kin 7", "unknown-camera"}
