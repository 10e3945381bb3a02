"""Folders from end to end: opening one as classified items in order, culling it, saving its session, sending and organising its files.

Files are read and written by tasks, on a file system that all workers mount;
what stands between those steps are the table operators.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import choices, exif, geo, pixels
from ..functions import names as N
from ..operators import pairing, runs, sessions, transfer
from ..operators.lineage import stored
from ..operators.ranking import numbered
from . import decode, files, makernotes, settings, tiff

DEFAULTS = {"label": "unrated", "stars": 0, "tag": None}


def _content(df: DataFrame, path: str = "path") -> DataFrame:
    """Adds ``content``; null for a file that can't be read."""

    @F.udf("binary", useArrow=True)
    def read(name: str) -> bytes | None:
        try:
            with open(name, "rb") as file:
                return file.read()
        except OSError:
            return None

    return df.withColumn("content", read(path))


def shots(of: DataFrame, path: str = "path") -> DataFrame:
    """``key, SHOT, orientation, points`` of the capture metadata in the files of ``of(key, path)``; the lens of the maker's note where the standard one is missing."""
    found = makernotes.with_notes(tiff.read_info(_content(of, path)))
    info = {n: F.col(f"info.{n}") for n in ("iso", "aperture", "shutter", "focal", "datetime", "width", "height", "orientation")}
    info |= {"camera": F.coalesce("info.model", "info.make"), "lens": makernotes.lens(F.col("info"), F.col("notes"))}
    meta = found.select("key", exif.photo_meta(info).alias("m"), F.coalesce("info.orientation", F.lit(1)).alias("orientation"), F.col("notes.points").alias("points"))
    return meta.select("key", F.col("m.taken").alias("shot_time"), *(f"m.{n}" for n in runs.SHOT if n != "shot_time"), "orientation", "points")


def candidates(items: DataFrame, root: str) -> DataFrame:
    """``item, prio, key`` under which an item's records may stand: its own key, then for each member its key and its path."""
    own = items.select("item", F.lit(0).alias("prio"), N.item_key(F.col("item"), root).alias("key"))
    each = items.select("item", F.posexplode("members").alias("at", "path"))
    by_key = each.select("item", (F.col("at") * 2 + 1).alias("prio"), N.item_key(F.col("path"), root).alias("key"))
    return own.unionByName(by_key).unionByName(each.select("item", (F.col("at") * 2 + 2).alias("prio"), relative(F.col("path"), root).alias("key")))


def relative(path: Column, root: str) -> Column:
    """The path below the root with forward slashes, else the file's name."""
    p, base = F.translate(path, "\\", "/"), root.rstrip("/") + "/"
    return F.when(p.startswith(base), F.substring(p, len(base) + 1, 1 << 30)).otherwise(N.file_name(p))


def restored(items: DataFrame, saved: DataFrame, root: str) -> DataFrame:
    """Items with the saved classification; a record under a bare stem counts where nothing else is found and one item only has the stem."""
    stem = N.ascii_lower(F.col("stem"))
    alone = items.groupBy(stem.alias("key")).agg(F.min("item").alias("item"), F.count("*").alias("n")).where("n = 1").select("item", "key")
    return sessions.restore(items, candidates(items, root), saved, alone)


def open_folder(spark: SparkSession, root: str, recursive: bool = True, by: str = "name", saved: DataFrame | str | None = None) -> DataFrame:
    """``item, stem, members, display, has_raw, has_image, modified, label, stars, tag, has_record, pos``: the items of a folder in order.

    ``by`` is ``name``, ``modified`` (newest first) or ``capture`` (unknown
    times last).  ``saved`` has the session's records, or is its file.
    """
    root = root.rstrip("/") or "/"
    listed = stored(files.scan(spark, root, recursive))  # the folder is listed once
    items = pairing.pair(listed.select("path")).join(listed.select(F.col("path").alias("display"), "modified"), "display", "left")
    items = items.withColumns({"label": F.lit(DEFAULTS["label"]), "stars": F.lit(DEFAULTS["stars"]), "tag": F.lit(DEFAULTS["tag"]).cast("string")})
    if isinstance(saved, str):
        saved = settings.load_session(spark, saved)
    items = restored(items, saved, root) if saved is not None else items.withColumn("has_record", F.lit(False))
    order = files.scan_order(by)
    if by == "capture":
        times = shots(items.select(F.col("item").alias("key"), F.col("display").alias("path"))).select(F.col("key").alias("item"), "shot_time")
        items = items.join(times, "item", "left")
        order = [F.col("shot_time").asc_nulls_last(), *order]
    return numbered(items, [*order, F.col("item")], "pos").drop("shot_time")


def measure(folder: str, s: runs.Settings, by_focus_points: bool = False) -> Callable[[DataFrame], DataFrame]:
    """A measuring step for ``runs.measured``: files to pixels (written to ``folder`` on the way) to the signals that are on.

    With ``by_focus_points`` focus is measured where the camera says it focused,
    over the whole frame where it says nothing.
    """
    c = s.criteria
    signals = tuple(n for n, limit in (("exposure", c.exposure), ("focus", c.focus), ("tilt", c.tilt)) if limit is not None)
    edge = choices.EDGES["focus" if c.focus is not None else "detector" if s.face or s.genre or s.thing or s.sharp_min is not None else "tilt" if c.tilt is not None else "other"]

    def run(misses: DataFrame) -> DataFrame:
        shown = decode.decoded(_content(misses.select("path").distinct()), folder, edge).where("image is not null")
        if by_focus_points and c.focus is not None:
            at = shots(misses.select(F.col("path").alias("key"), "path"))
            regions = geo.focus_regions(F.coalesce("points", F.array().cast(f"array<{makernotes.POINT}>")), F.col("orientation"))
            shown = shown.join(at.select(F.col("key").alias("path"), regions.alias("regions")), "path", "left").withColumn("regions", F.when(F.size("regions") > 0, F.col("regions")))
        scored = pixels.score_images(shown, signals=signals, regions="regions" if "regions" in shown.columns else None)
        hashed = F.col("report.dhash") if s.hamming is not None else F.lit(None).cast("bigint")
        report = scored.where("report is not null").select("path", "report.sharpness", "report.exposure", "report.tilt", "report.tilt_confidence", hashed.alias("dhash"), "image")
        return misses.join(report, "path")

    return run


def cull_folder(items: DataFrame, cached: DataFrame, folder: str, s: runs.Settings, by_focus_points: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items after the run, its reports, the cache after it) for the items of ``open_folder``; models come in through ``runs.measured``."""
    signals = {"focus": s.criteria.focus, "exposure": s.criteria.exposure, "tilt": s.criteria.tilt, "hash": s.hamming}
    mark = choices.signature(**{k: F.lit(v is not None) for k, v in signals.items()}, points=F.lit(by_focus_points))
    keyed = items.withColumn("key", F.col("item"))
    wanted = keyed.select("key", F.col("display").alias("path"), F.unix_micros(F.col("modified").cast("timestamp")).alias("mtime"), mark.alias("signature"))
    reports, after = runs.measured(wanted, cached, measure(folder, s, by_focus_points), s)
    needs_meta = s.meta is not None or s.burst_gap is not None
    known = shots(wanted.select("key", "path")).drop("orientation", "points") if needs_meta else None
    return runs.cull(keyed, reports, s, known).drop("key"), reports, after


def records(items: DataFrame, root: str) -> DataFrame:
    """``key, label, stars, tag, members`` that a session saves of the items."""
    return items.select(
        N.item_key(F.col("item"), root).alias("key"), "label", "stars", "tag", F.transform("members", lambda m: relative(m, root)).alias("members")
    )


def save_folder(items: DataFrame, root: str, path: str, updated_at: str, recursive: bool = True) -> None:
    """Writes the session of a folder; a flat save keeps what was saved of sub-folders and no item reads now."""
    root = root.rstrip("/") or "/"
    old = settings.load_session(items.sparkSession, path)
    kept = stored(sessions.save(records(items, root), old, sessions.claimed(candidates(items, root), old), recursive))
    settings.save_session(kept, path, root, updated_at)


@dataclass(frozen=True)
class Transfer:
    """What to send where: items of any chosen label, star count or tag; with ``split`` (label, stars or tag) all items, each to its sub-folder."""

    target: str
    labels: tuple[str, ...] = ()
    stars: tuple[int, ...] = ()
    tags: tuple[str, ...] = ()
    which: str = "both"
    split: str | None = None
    template: str | None = None
    by_grade: bool = False
    skip: bool = False
    move: bool = False


def listed(folders: DataFrame) -> DataFrame:
    """``folder, name`` of what stands in the given folders; none for one that isn't there."""

    def names(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(folder, name) for folder in frame["folder"] if os.path.isdir(folder) for name in os.listdir(folder)]
            yield pd.DataFrame(rows, columns=["folder", "name"])

    return folders.select("folder").distinct().mapInPandas(names, "folder string, name string")


def planned(items: DataFrame, t: Transfer) -> DataFrame:
    """``item_id, pos, slot, path, folder, name``: every file to send, with its target before collisions are resolved."""
    chosen = transfer.selected(t.labels, t.stars, t.tags, t.split is not None)
    rows = transfer.renamed(transfer.plan(items.withColumn("item_id", F.col("item")), chosen, t.which), t.template, t.by_grade)
    target = F.lit(t.target.rstrip("/"))
    folder = F.concat_ws("/", target, N.split_folder(F.col("label"), F.col("stars"), F.col("tag"), t.split)) if t.split else target
    return rows.select("item_id", "pos", "slot", "path", folder.alias("folder"), F.col("new_name").alias("name"))


def preview(items: DataFrame, t: Transfer, n: int) -> DataFrame:
    """The first ``n`` old and new names, whatever stands in the target."""
    return planned(items, t).orderBy("pos", "item_id", "slot").limit(n).select(N.file_name(F.col("path")).alias("name"), F.col("name").alias("new_name"))


def _sent(rows: DataFrame, there: Column, skip: bool, move: bool) -> DataFrame:
    """Sends what isn't in place yet: collisions with the targets' files are resolved and stored, for names that are resolved after some were sent would differ."""
    rows = stored(rows.withColumn("there", F.coalesce(there, F.lit(False))))
    todo = rows.where("not there").drop("there", "slot")
    solved = stored(transfer.resolve_collisions(todo, listed(todo), skip))
    done = transfer.send(solved, move)
    still = rows.where("there").select("path", "folder", N.file_name(F.col("path")).alias("final_name"), F.lit("in_place").alias("status"), F.lit(0).cast("long").alias("size"), F.lit(False).alias("left"))
    return done.unionByName(still)


def send(items: DataFrame, t: Transfer, opened: str) -> DataFrame:
    """``path, folder, final_name, status, size, left`` of every file of a transfer out of the folder ``opened``."""
    if t.split is None and os.path.realpath(t.target) == os.path.realpath(opened):
        raise ValueError("a transfer into one folder can't go to the folder that is open")
    rows = planned(items, t)
    return _sent(rows, transfer.in_place(), t.skip, t.move)


def organise(items: DataFrame, target: str, by: str, skip: bool = False, move: bool = True) -> DataFrame:
    """The same for organising all items into folders by ``date``, ``camera``, ``lens``, ``focal`` (one for all files of an item) or ``extension``."""
    if by == "extension":
        known = items.select("item", *(F.lit(None).cast("string").alias(c) for c in ("exif_date", "camera", "lens", "focal")))
    else:
        info = tiff.read_info(_content(items.select("item", F.col("display").alias("path"))))
        info = makernotes.with_notes(info)
        known = info.select("item", F.col("info.datetime").alias("exif_date"), F.coalesce("info.model", "info.make").alias("camera"), makernotes.lens(F.col("info"), F.col("notes")).alias("lens"), F.col("info.focal").alias("focal"))
    each = items.join(known, "item").select(F.col("item").alias("item_id"), "pos", F.posexplode("members").alias("slot", "path"), "exif_date", "modified", "camera", "lens", "focal")
    rows = transfer.organise(each, target, by).withColumn("slot", F.lit(0))
    return _sent(rows, transfer.in_place(by_folder=True), skip, move)
