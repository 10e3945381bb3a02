"""A whole run of culling over tables: reports from the cache or freshly measured, every decision in order, and what was changed.

``measured`` gives the reports, ``cull`` decides and writes one axis, and
``edits``, ``undone`` and ``totals`` tell and take back what a run did.  All
are joins and windows over keyed tables; no step gathers a collection in one
task, however large its largest folder, burst or cluster is.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import choices
from . import cache, culling, similar
from .culling import Criteria, MetaFilter, f32, finite
from .lineage import cut, stored
from .ranking import numbered

# What a report holds, by column; what was not measured is null.
MEASURES = {
    "sharpness": "float", "exposure": "float", "tilt": "float", "tilt_confidence": "float", "aesthetic": "float", "face": "boolean", "sharp_ai": "float", "object_match": "boolean",
    "dhash": "bigint",
}
# What is known of a shot without looking at its pixels.
SHOT = {
    "shot_time": "bigint", "iso": "int", "aperture": "float", "shutter": "float", "focal": "float", "width": "int", "height": "int", "camera": "string", "lens": "string",
}
AXES = ("label", "stars", "tag")


@dataclass(frozen=True)
class Settings:
    """What a run checks; what is None or False is off.

    ``genre`` is ``portrait`` (a face is needed) or ``landscape`` (none may be
    there).  ``good`` and ``bad`` are written to ``axis``.
    """

    criteria: Criteria = field(default_factory=Criteria)
    meta: MetaFilter | None = None
    face: bool = False
    genre: str | None = None
    sharp_min: float | None = None
    thing: bool = False
    burst_gap: float | None = None
    burst_keep: int = 1
    hamming: int | None = None
    dedup_keep: int = 1
    axis: str = "label"
    good: str | int | None = "pick"
    bad: str | int | None = "reject"

    def hard(self) -> list[tuple[str, Column, float | None, Column, Column]]:
        """Facts of the hard filters: kind, value, limit, whether it is told, whether it rejects.  Absent results do neither."""
        face, none, yes = F.col("face"), F.lit(None).cast("float"), F.lit(True)
        out = []
        if self.face or self.genre == "portrait":
            out.append(("face_missing", none, None, ~face, yes))
        if self.genre == "landscape":
            out.append(("face_in_landscape", none, None, face, yes))
        if self.sharp_min is not None:
            score = finite(F.col("sharp_ai"))
            out.append(("sharp_ai", score, self.sharp_min, score.isNotNull(), score < f32(self.sharp_min)))
        if self.thing:
            out.append(("object_missing", none, None, ~F.col("object_match"), yes))
        return out

    def rejects(self) -> Column:
        return culling.hard_reject(*(told & rejects for _, _, _, told, rejects in self.hard()))


def _completed(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Missing columns as nulls, all of their own types."""
    return df.withColumns({c: (F.col(c) if c in df.columns else F.lit(None)).cast(t) for c, t in columns.items()})


def _needs_score(s: Settings, rows: DataFrame) -> Column:
    """Whether this run needs the row's aesthetic score: a ranking needs all, a threshold those that pass the other checks."""
    others = Criteria(s.criteria.focus, s.criteria.exposure, s.criteria.tilt)
    use = s.criteria.aesthetic is not None or s.criteria.top_n > 0
    return choices.needs_aesthetic(F.lit(use), F.lit(s.criteria.top_n), culling.cv_good(culling.checks(others)))


def measured(
    wanted: DataFrame, cached: DataFrame, measure: Callable[[DataFrame], DataFrame], s: Settings, score: Callable[[DataFrame], DataFrame] | None = None, cap: int = 50_000
) -> tuple[DataFrame, DataFrame]:
    """(reports, the cache after the run).

    ``wanted(key, path, mtime, signature)``; the cache has ``path, mtime,
    signature`` and MEASURES.  Rows of the same path, time and signature that
    hold all this run needs are used again.  ``measure`` takes the others and
    adds MEASURES; rows that it leaves out couldn't be measured and have no
    report.  ``score`` adds ``aesthetic`` to those of them that need one, and to
    no others.  The cache then has one row a path, the new one where it was
    measured now, without rows whose needed score is missing, newest ``cap``.
    """
    own = ["key", "path", "mtime", "signature"]
    cached = _completed(cached, MEASURES).select("path", "mtime", "signature", *MEASURES)
    ok = cache.usable(s.hamming is not None, _needs_score(s, cached))
    hits, misses = cache.lookup(wanted.select(*own), cached, ok=ok)
    fresh = stored(_completed(measure(misses), MEASURES).select(*own, *MEASURES))  # pixels are read once
    if score is not None:
        needs = _needs_score(s, fresh)
        scored = _completed(score(fresh.where(needs)), MEASURES).withColumn("aesthetic", finite(F.col("aesthetic"))).select(*own, *MEASURES)
        fresh = stored(scored.unionByName(fresh.where(~needs)))
    keep = fresh.where(F.col("mtime").isNotNull() & (F.col("aesthetic").isNotNull() | ~_needs_score(s, fresh))).drop("key").dropDuplicates(["path"])
    after = cached.join(keep.select("path"), "path", "left_anti").unionByName(keep)
    reports = hits.select(*own, *MEASURES, F.lit(True).alias("from_cache")).unionByName(fresh.withColumn("from_cache", F.lit(False)))
    return reports, cache.newest(after, cap)


def cull(items: DataFrame, reports: DataFrame, s: Settings, shots: DataFrame | None = None) -> DataFrame:
    """``items(key, pos, label, stars, tag, ...)`` after a run, with ``outcome``, ``primary``, ``secondary`` and the ranks.

    Order of decisions: checks, score rank or threshold, hard filters, metadata
    exclusion, burst, near-duplicate cluster.  Items compete in order of capture
    time (unknown last), then of ``pos``.  ``shots(key, SHOT)`` has what is
    known without pixels.  Excluded items and those without a report keep their
    classification; the latter have no outcome.  A score ranking over items
    none of which has a finite score is an error, as it would reject all.
    """
    known = _completed(reports, MEASURES).select("key", *MEASURES)
    if shots is not None:
        known = known.join(_completed(shots, SHOT).select("key", *SHOT), "key", "left")
    rows = items.select("key", "pos").join(_completed(known, SHOT), "key")
    if s.criteria.top_n and rows.where(finite(F.col("aesthetic")).isNotNull()).isEmpty() and not rows.isEmpty():
        raise ValueError("a ranking by aesthetic score needs scores; none of the items has one")
    rows = numbered(rows, [F.col("shot_time").isNull(), F.col("shot_time"), F.col("pos"), F.col("key")], "idx")
    judged = culling.verdicts(rows, s.criteria, "idx")
    judged = judged.withColumns({"good": F.col("good") & ~s.rejects(), "rank": f32(0.0), "sharp": F.coalesce("sharpness", f32(0.0))})
    cluster = None
    if s.hamming is not None:
        hashed = judged.where((s.meta.passes() if s.meta else F.lit(True)) & F.col("dhash").isNotNull()).select("idx", "dhash")
        judged = judged.join(similar.clusters(hashed, s.hamming, "dhash", "idx").select("idx", "cluster"), "idx", "left")
        cluster = "cluster"
    judged = culling.decide(cut(judged), [], s.meta, s.burst_gap, s.burst_keep, cluster, s.dedup_keep)
    told = culling.explain(judged, s.burst_keep, s.dedup_keep, s.criteria.top_n, s.hard())
    ranks = [c for c in ("score_rank", "burst_rank", "burst_size", "dedup_rank", "dedup_size") if c in told.columns]
    out = items.join(told.select("key", F.col("idx").alias("place"), "outcome", "primary", "secondary", *ranks), "key", "left")
    return culling.write_axis(out.withColumns({f"old_{a}": F.col(a) for a in AXES}), s.axis, s.good, s.bad)


def edits(after: DataFrame) -> DataFrame:
    """What a run wrote: old and new values of every item it judged, as one step to undo."""
    return after.where(F.col("outcome").isin("good", "bad")).select("key", *(f"old_{a}" for a in AXES), *AXES)


def undone(items: DataFrame, log: DataFrame) -> DataFrame:
    """The items with a run's edits taken back; other items stay."""
    old = log.select("key", *(F.col(f"old_{a}").alias(f"__{a}") for a in AXES), F.lit(True).alias("__edited"))
    back = {a: F.when(F.col("__edited"), F.col(f"__{a}")).otherwise(F.col(a)) for a in AXES}
    return items.join(old, "key", "left").withColumns(back).drop("__edited", *(f"__{a}" for a in AXES))


def totals(after: DataFrame, reports: DataFrame) -> DataFrame:
    """One row: good, bad, skipped (excluded) and unmeasured items, reports from the cache, and the range of scores."""
    of = lambda kind: F.count_if(F.col("outcome") == kind)
    run = after.agg(of("good").alias("good"), of("bad").alias("bad"), of("excluded").alias("skipped"), F.count_if(F.col("outcome").isNull()).alias("unmeasured"))
    score = finite(F.col("aesthetic"))
    return run.crossJoin(F.broadcast(reports.agg(F.count_if("from_cache").alias("cached"), F.min(score).alias("low"), F.max(score).alias("high"))))  # one row by one row
