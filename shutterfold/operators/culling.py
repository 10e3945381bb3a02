"""Deciding which items of a collection to keep, with a reason for every decision.

Order of decisions for one item: criterion checks, then a threshold or global
top-N verdict, hard filters, metadata exclusion, best-N of a time-gap burst,
best-N of a near-duplicate cluster.  Everything is a projection or a window
over a group key; scores and limits are single-precision floats, so that a
value equal to its limit compares equal.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import before, largest, numbered, numbered_within, placed

TILT_CONFIDENCE = 0.2
#: A group of more rows isn't a window, which is one task, but is cut into ranges; both ways give the same rows.
GROUP_ROWS = 1_000_000


def f32(x: float | Column) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("float")


def finite(x: Column) -> Column:
    """The value, or null when it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def sort_score(x: Column) -> Column:
    """Descending sort key: what is not finite comes after every number, and -0 equals 0."""
    return F.coalesce(finite(x) + f32(0.0), f32(float("-inf")))


@dataclass(frozen=True)
class Criteria:
    """Limits of the checks; None leaves a check out."""

    focus: float | None = None
    exposure: float | None = None
    tilt: float | None = None
    aesthetic: float | None = None
    top_n: int = 0


@dataclass(frozen=True)
class MetaFilter:
    """Optional inclusive bounds; an unknown value passes."""

    portrait: bool | None = None
    iso_min: int | None = None
    iso_max: int | None = None
    aperture_min: float | None = None
    aperture_max: float | None = None
    shutter_min: float | None = None
    shutter_max: float | None = None
    focal_min: float | None = None
    focal_max: float | None = None
    camera: str | None = None
    lens: str | None = None

    @staticmethod
    def from_switches(flags: dict[str, bool], values: dict[str, float | int | str]) -> MetaFilter:
        """Builds the filter from per-bound switches; "at least 1/N" becomes an upper bound on seconds and blank names mean no bound."""
        on = lambda k: values[k] if flags.get(k) and k in values else None
        text = lambda k: v.strip() or None if isinstance(v := on(k), str) else None
        denominator = on("shutter_at_least")
        return MetaFilter(
            portrait=on("portrait"), iso_min=on("iso_min"), iso_max=on("iso_max"), aperture_min=on("aperture_min"), aperture_max=on("aperture_max"),
            shutter_max=1 / denominator if denominator else None, focal_min=on("focal_min"), focal_max=on("focal_max"), camera=text("camera"), lens=text("lens"),
        )

    def passes(self) -> Column:
        ok = F.lit(True)
        for name in ("iso", "aperture", "shutter", "focal"):
            limit = (lambda x: F.lit(x)) if name == "iso" else f32
            if (low := getattr(self, f"{name}_min")) is not None:
                ok &= F.coalesce(F.col(name) >= limit(low), F.lit(True))
            if (high := getattr(self, f"{name}_max")) is not None:
                ok &= F.coalesce(F.col(name) <= limit(high), F.lit(True))
        if self.portrait is not None:
            ok &= F.coalesce(is_portrait(F.col("width"), F.col("height")) == F.lit(self.portrait), F.lit(True))
        for name in ("camera", "lens"):
            if (part := getattr(self, name)) is not None:
                ok &= F.coalesce(F.contains(F.lower(name), F.lit(part.lower())), F.lit(True))
        return ok


def is_portrait(width: Column, height: Column) -> Column:
    """Null for squares and unknown sizes."""
    return F.when(width != height, height > width)


def checks(c: Criteria) -> Column:
    """``array<struct<kind,value,limit,fail>>`` of the checks that apply to the row."""

    def one(kind: str, value: Column, limit: float, fail: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.cast("float").alias("value"), f32(limit).alias("limit"), F.coalesce(fail, F.lit(False)).alias("fail"))

    out = []
    if c.focus is not None:
        out.append(one("focus", F.col("sharpness"), c.focus, F.col("sharpness") < f32(c.focus)))
    if c.exposure is not None:
        out.append(one("exposure", F.col("exposure"), c.exposure, F.col("exposure") < f32(c.exposure)))
    if c.tilt is not None:
        out.append(F.when(F.col("tilt_confidence") >= f32(TILT_CONFIDENCE), one("tilt", F.col("tilt"), c.tilt, F.abs("tilt") > f32(c.tilt))))
    if c.aesthetic is not None and not c.top_n:
        score = finite(F.col("aesthetic"))
        out.append(F.when(score.isNotNull(), one("aesthetic", score, c.aesthetic, score < f32(c.aesthetic))))
    if not out:
        return F.expr("cast(array() as array<struct<kind:string,value:float,limit:float,fail:boolean>>)")
    return F.array_compact(F.array(*out))


def cv_good(checked: Column) -> Column:
    return ~F.exists(checked, lambda x: x["fail"])


def verdicts(df: DataFrame, c: Criteria, order: str = "idx") -> DataFrame:
    """Adds ``checks``, ``cv_good``, ``score_rank`` and ``good``.

    Threshold mode: Good unless a check fails.  Top-N mode: Good exactly for
    the N best finite scores of the table, whatever the checks say.
    """
    checked = df.withColumn("checks", checks(c)).withColumn("cv_good", cv_good(F.col("checks")))
    if not c.top_n:
        return checked.withColumns({"score_rank": F.lit(None).cast("long"), "good": F.col("cv_good")})
    scored = finite(F.col("aesthetic"))
    best = numbered(checked.where(scored.isNotNull()), [sort_score(F.col("aesthetic")).desc(), F.col(order)], "score_rank")
    rest = checked.where(scored.isNull()).withColumn("score_rank", F.lit(None).cast("long"))
    return best.unionByName(rest).withColumn("good", F.coalesce(F.col("score_rank") <= c.top_n, F.lit(False)))


def hard_reject(*signals: Column) -> Column:
    """True when any signal says so; an absent signal never rejects."""
    out = F.lit(False)
    for s in signals:
        out |= F.coalesce(s, F.lit(False))
    return out


def burst_ids(df: DataFrame, part: list[str], order: list[Column], gap: float, time: str = "shot_time", out: str = "burst") -> DataFrame:
    """Adds ``out``: a number for each burst of a partition, from 1.

    Rows in order belong together while neighbouring times differ by at most
    ``gap``; an unknown time is a burst of its own and breaks the chain.
    """
    if largest(df, part) > GROUP_ROWS:
        return _burst_ids_by_range(df, part, order, gap, time, out)
    by = Window.partitionBy(*part).orderBy(*order)
    last, here = F.lag(time).over(by), F.col(time)
    opened = df.withColumn("__opens", _opens(last, here, gap))
    return opened.withColumn(out, F.sum("__opens").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("long")).drop("__opens")


def _opens(last: Column, here: Column, gap: float) -> Column:
    return F.when(last.isNull() | here.isNull() | (F.abs(here - last) > gap), 1).otherwise(0)


def _burst_ids_by_range(df: DataFrame, part: list[str], order: list[Column], gap: float, time: str, out: str) -> DataFrame:
    """The same without a task for each partition: ranges of the whole order, and two rows a range that tell how it continues the one before."""
    group = F.struct(F.lit(0).alias("one"), *part)
    rows = placed(df.withColumns({"__g": group, "__t": F.col(time)}), [*(F.col(c) for c in part), *order])
    by = Window.partitionBy("__part").orderBy("__in_part")
    ends = rows.groupBy("__part").agg(F.max_by(F.struct("__g", "__t"), "__in_part").alias("end"))
    rows = rows.join(before(ends, __end=F.last("end")), "__part")
    last = F.when(F.col("__in_part") == 0, F.col("__end")).otherwise(F.lag(F.struct("__g", "__t")).over(by))
    rows = rows.withColumn("__last", last).withColumn("__first", ~F.coalesce(F.col("__last.__g") == F.col("__g"), F.lit(False)))
    rows = rows.withColumn("__opens", F.when(F.col("__first"), 1).otherwise(_opens(F.col("__last.__t"), F.col("__t"), gap)))
    upto = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("__upto", F.sum("__opens").over(upto))
    rows = rows.withColumn("__base", F.last(F.when(F.col("__first"), F.col("__upto") - 1), ignorenulls=True).over(upto))
    ranges = rows.groupBy("__part").agg(F.sum("__opens").alias("n"), F.max_by("__base", "__in_part").alias("base"))
    ranges = ranges.withColumn("base", F.col("base") + F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.join(before(ranges, __n=F.sum("n"), __open=F.last("base", ignorenulls=True)), "__part")
    n = F.coalesce("__n", F.lit(0))
    number = F.col("__upto") + n - F.coalesce(F.col("__base") + n, F.col("__open"))
    return rows.withColumn(out, number.cast("long")).select(*df.columns, out)


def group_keys(rich: Column) -> list[Column]:
    """Three values, each best when largest, that order the competitors of a group.

    A ``rich`` group, where any competitor has an aesthetic or sharpness value,
    orders by finite aesthetic first, then sharpness (a missing one is 0);
    other groups order by rank.
    """
    score = finite(F.col("aesthetic"))
    return [
        F.when(rich, score.isNotNull().cast("int")).otherwise(0),
        F.when(rich, F.coalesce(score, f32(0.0)) + f32(0.0)).otherwise(f32(0.0)),
        F.when(rich, sort_score(F.coalesce(F.col("sharp"), f32(0.0)))).otherwise(sort_score(F.col("rank"))),
    ]


def best_n(df: DataFrame, group: list[str], keep: int, competes: Column, prefix: str, tie: str = "idx") -> DataFrame:
    """Adds ``<prefix>_rank``, ``<prefix>_size`` (null below two competitors) and ``<prefix>_out``: beaten by ``keep`` others."""
    keep = max(keep, 1)
    flagged = df.withColumn("__competes", F.coalesce(competes, F.lit(False)))
    large = largest(df, group) > GROUP_ROWS
    if large:
        flagged = _with_group_totals(flagged, group)
    else:
        whole = Window.partitionBy(*group)
        flagged = flagged.withColumns({"__rich": F.max(_rich()).over(whole) == 1, "__size": F.sum(F.col("__competes").cast("int")).over(whole)})
    size = F.col("__size")
    keys = {f"__k{i}": k for i, k in enumerate(group_keys(F.col("__rich")))}
    shown = F.col("__competes") & (size >= 2)
    out, by = flagged.withColumns(keys), [*(F.col(k).desc() for k in keys), F.col(tie)]
    if large:
        out = numbered_within(out, [*group, "__competes"], by, "__place")
    else:
        out = out.withColumn("__place", F.row_number().over(Window.partitionBy(*group, "__competes").orderBy(*by)))
    out = out.withColumns({f"{prefix}_rank": F.when(shown, F.col("__place").cast("int")), f"{prefix}_size": F.when(shown, size.cast("int"))})
    out = out.withColumn(f"{prefix}_out", F.coalesce(F.col(f"{prefix}_rank") > keep, F.lit(False)))
    return out.drop("__competes", "__place", "__rich", "__size", *keys)


def _rich() -> Column:
    """1 for a competitor with an aesthetic or sharpness value."""
    return (F.col("__competes") & (F.col("aesthetic").isNotNull() | F.col("sharp").isNotNull())).cast("int")


def _with_group_totals(flagged: DataFrame, group: list[str]) -> DataFrame:
    """Adds what a group's order needs by a join, which splits a hot group, instead of a window over it."""
    found = flagged.groupBy(*group).agg((F.max(_rich()) == 1).alias("__rich"), F.sum(F.col("__competes").cast("int")).alias("__size"))
    found = found.select(*(F.col(c).alias(f"__of_{c}") for c in group), "__rich", "__size")
    same = F.lit(True)
    for c in group:
        same &= F.col(c).eqNullSafe(F.col(f"__of_{c}"))
    return flagged.join(found, same).drop(*(f"__of_{c}" for c in group))


def decide(
    df: DataFrame, part: list[str], meta: MetaFilter | None = None, burst_gap: float | None = None, burst_keep: int = 1, cluster: str | None = None, dedup_keep: int = 1
) -> DataFrame:
    """Adds ``included``, ``decided`` and the burst and dedup ranks.

    ``df`` has idx, good, rank, aesthetic, sharp, shot_time and the metadata
    columns.  Excluded rows take part in nothing; rows that are not good form
    bursts and clusters but take no place in them.
    """
    out = df.withColumn("included", meta.passes() if meta else F.lit(True)).withColumn("decided", F.col("good") & F.col("included"))
    if burst_gap is not None:
        order = [F.col("shot_time").isNull(), F.col("shot_time"), F.col("idx")]
        out = burst_ids(out, [*part, "included"], order, burst_gap)
        out = best_n(out, [*part, "included", "burst"], burst_keep, F.col("decided"), "burst").withColumn("decided", F.col("decided") & ~F.col("burst_out"))
    if cluster is not None:
        out = out.withColumn("__cluster", F.when(F.col("included"), F.col(cluster)))
        alone = out.where("__cluster is null").withColumns({"dedup_rank": F.lit(None).cast("int"), "dedup_size": F.lit(None).cast("int"), "dedup_out": F.lit(False)})
        grouped = best_n(out.where("__cluster is not null"), [*part, "__cluster"], dedup_keep, F.col("decided"), "dedup")
        out = grouped.unionByName(alone).withColumn("decided", F.col("decided") & ~F.col("dedup_out")).drop("__cluster")
    return out


def explain(df: DataFrame, burst_keep: int = 1, dedup_keep: int = 1, top_n: int = 0, hard: list[tuple[str, Column, float | None, Column, Column]] | None = None) -> DataFrame:
    """Adds ``outcome`` and ``primary``/``secondary`` arrays of facts (kind, value, limit, rank, size, keep).

    Facts come in the order of the decisions: score rank, checks, burst,
    cluster, hard filters (``hard``: kind, value, limit, whether it is told,
    whether it rejects).  What made an item Bad is primary; everything else
    known about it is secondary, and the facts of a Good item all are.  In
    top-N mode the score rank decides and checks are secondary.  An excluded
    item has no facts.
    """

    def fact(told: Column, weighs: Column, kind, value=None, limit=None, rank=None, size=None, keep=None) -> Column:
        null = lambda x, t: (F.lit(None) if x is None else x if isinstance(x, Column) else F.lit(x)).cast(t)
        body = F.struct(
            null(kind, "string").alias("kind"), null(value, "float").alias("value"), null(limit, "float").alias("limit"),
            null(rank, "int").alias("rank"), null(size, "int").alias("size"), null(keep, "int").alias("keep"),
        )
        return F.when(told, F.struct(F.coalesce(weighs, F.lit(False)).alias("weighs"), body.alias("fact")))

    known, top = F.lit(True), F.lit(bool(top_n))
    first = [fact(known, F.coalesce(F.col("score_rank") > top_n, known), "top_n", F.col("aesthetic"), rank=F.col("score_rank"), keep=top_n)] if top_n else []
    checked = F.transform("checks", lambda x: fact(known, x["fail"] & ~top, x["kind"], x["value"], x["limit"]))
    groups = [(p, k) for p, k in (("burst", burst_keep), ("dedup", dedup_keep)) if f"{p}_rank" in df.columns]
    rest = [fact(F.col(f"{p}_rank").isNotNull(), F.col(f"{p}_out"), p, rank=F.col(f"{p}_rank"), size=F.col(f"{p}_size"), keep=k) for p, k in groups]
    rest += [fact(F.coalesce(told, F.lit(False)), rejects, kind, value, limit) for kind, value, limit, told, rejects in hard or []]
    told = F.concat(*([F.array(*first)] if first else []), checked, *([F.array_compact(F.array(*rest))] if rest else []))
    good = F.col("decided")
    out = df.withColumn("outcome", F.when(~F.col("included"), "excluded").when(good, "good").otherwise("bad"))
    out = out.withColumn("__told", F.when(F.col("included"), told).otherwise(F.slice(told, 1, 0)))
    side = lambda weighs: F.transform(F.filter("__told", lambda x: x["weighs"] == weighs), lambda x: x["fact"])
    out = out.withColumns({"primary": side(True), "secondary": side(False)})
    return out.withColumns({"secondary": F.when(good, F.concat("primary", "secondary")).otherwise(F.col("secondary")), "primary": F.when(good, F.slice("primary", 1, 0)).otherwise(F.col("primary"))}).drop("__told")


def write_axis(df: DataFrame, axis: str, good_value, bad_value) -> DataFrame:
    """Puts Good/Bad on exactly one of label, stars and tag; excluded rows keep what they have."""
    value = F.when(F.col("outcome") == "good", F.lit(good_value)).when(F.col("outcome") == "bad", F.lit(bad_value)).otherwise(F.col(axis))
    return df.withColumn(axis, value)
