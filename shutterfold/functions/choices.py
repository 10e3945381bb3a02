"""Decisions from settings, as Column expressions: what runs, at which size, with which output, and why it can't."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The order in which a label filter cycles, and the edges at which images are decoded for checks.
FILTER_CYCLE = ("all", "pick", "hold", "reject", "unrated")
EDGES = {"focus": 1024, "detector": 640, "tilt": 512, "other": 256}
MODEL_MEMORY, MOST_WORKERS = 2_000_000_000, 12
DEAD_AFTER = 5
OUTCOME_DIGITS = 4


def any_of(switches: Iterable[Column]) -> Column:
    """Whether any switch is on; none is off."""
    out = F.lit(False)
    for s in switches:
        out |= F.coalesce(s, F.lit(False))
    return out


def filter_active(label: Column, stars: Column, tag: Column) -> Column:
    """Whether any filter axis is away from its default (``all``, ``any``, ``any``)."""
    return (label != "all") | (stars != "any") | (tag != "any")


def next_filter(label: Column) -> Column:
    out = F.lit(None).cast("string")
    for here, there in zip(FILTER_CYCLE, FILTER_CYCLE[1:] + FILTER_CYCLE[:1]):
        out = F.when(label == here, there).otherwise(out)
    return out


def needs_aesthetic(use: Column, top_n: Column, good: Column) -> Column:
    """A ranking needs every score; a threshold only those of items that pass the other checks."""
    return use & ((top_n > 0) | good)


def blockers(enabled: Column, count: Column, needs: dict[str, Column], present: dict[str, Column], class_known: Column, use_object: Column) -> Column:
    """Why a run can't start: an array of ``no check``, ``no items``, ``<model> missing`` and ``unknown class``; empty when it can."""
    missing = [F.when(needs[m] & ~present[m], F.lit(f"{m} missing")) for m in needs]
    return F.array_compact(F.array(F.when(~enabled, F.lit("no check")), F.when(count <= 0, F.lit("no items")), *missing, F.when(use_object & ~class_known, F.lit("unknown class"))))


def dead_decode(failures: Column) -> Column:
    """Whether so many decodes in a row failed that the source counts as gone."""
    return failures >= DEAD_AFTER


def decode_edge(focus: Column, tilt: Column, face: Column, sharp: Column, thing: Column) -> Column:
    """Long edge to decode at: that of the enabled check that needs most detail."""
    return F.when(focus, EDGES["focus"]).when(face | sharp | thing, EDGES["detector"]).when(tilt, EDGES["tilt"]).otherwise(EDGES["other"])


def signature(**signals: Column) -> Column:
    """One number for all that changes a report: enabled checks, edge, model and versions, but no threshold."""
    return F.xxhash64(*(F.concat(F.lit(f"{k}="), F.coalesce(v.cast("string"), F.lit("none"))) for k, v in sorted(signals.items())))


def worker_count(cores: Column, model_bytes: Column) -> Column:
    """Cores, as far as that many copies of the model fit in memory; 1 to 12."""
    fitting = F.when(model_bytes > 0, F.greatest(F.floor(F.lit(MODEL_MEMORY) / model_bytes), F.lit(1))).otherwise(cores)
    return F.greatest(F.lit(1), F.least(cores, fitting, F.lit(MOST_WORKERS))).cast("int")


def split_mode(split: Column, by_label: Column, by_tag: Column) -> Column:
    """The new setting where it isn't ``none``, else what the old flags say."""
    return F.when(F.coalesce(split, F.lit("none")) != "none", split).when(by_label, "label").when(by_tag, "tag").otherwise("none")


def output_colour(wide: Column, system: Column, layer_ok: Column, profile_bytes: Column, managed: Column) -> Column:
    """``srgb``, ``display_p3`` or ``icc`` (the monitor's): where a wide gamut is asked for and the system can show it."""
    return (
        F.when(~wide, "srgb").when((system == "macos") & layer_ok, "display_p3")
        .when((system == "windows") & ~managed & (F.coalesce(profile_bytes, F.lit(0)) > 0), "icc").otherwise("srgb")
    )


def output_kind(wide: Column, system: Column, layer_ok: Column, profile_bytes: Column, managed: Column) -> Column:
    """As ``output_colour``, but ``srgb_fallback`` where a wide gamut was asked for in vain."""
    found = output_colour(wide, system, layer_ok, profile_bytes, managed)
    return F.when(wide & (found == "srgb"), "srgb_fallback").otherwise(found)


def output_key(key: Column, tag: Column) -> Column:
    """A cache key with the output's tag; tag 0 leaves it as it is."""
    return F.when(tag == 0, key).otherwise(F.concat(key, F.lit("-"), F.lpad(F.lower(F.hex(tag)), 16, "0")))


def guide_style(weight: Column, opacity: Column) -> Column:
    """``struct<weight,opacity>`` within 1..4 and 0.2..1; what is not finite is 1 and 0.8."""

    def inside(x: Column, low: float, high: float, default: float) -> Column:
        ok = ~F.isnan(x) & (F.abs(x) < float("inf"))
        return F.greatest(F.lit(low), F.least(F.lit(high), F.when(ok, x).otherwise(default)))

    return F.struct(inside(weight, 1.0, 4.0, 1.0).alias("weight"), inside(opacity, 0.2, 1.0, 0.8).alias("opacity"))


def plain_folder(path: Column, fold_case: bool = False) -> Column:
    """A path without ``.``, ``..``, doubled and closing slashes; null for an empty one."""
    p = F.translate(path, "\\", "/")
    kept = F.aggregate(
        F.filter(F.split(p, "/"), lambda x: (x != "") & (x != ".")), F.array().cast("array<string>"),
        lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x))),
    )
    out = F.concat(F.when(p.startswith("/"), "/").otherwise(""), F.array_join(kept, "/"))
    out = F.when(p.rlike(r"/\.{0,2}(/|$)|^\.{0,2}$|^\.{1,2}/"), F.get(F.filter(F.array(out), lambda x: x != ""), F.lit(0))).otherwise(p)  # each built once; most paths are plain
    return F.lower(out) if fold_case else out


def same_folder(a: Column, b: Column, fold_case: bool = False) -> Column:
    """Whether two paths name one folder; an empty path names none."""
    return F.coalesce(plain_folder(a, fold_case) == plain_folder(b, fold_case), F.lit(False))


def hits_open_folder(target: Column, opened: Column, split: Column) -> Column:
    """A transfer without sub-folders may not go to the folder that is open."""
    return (split == "none") & same_folder(target, opened)


def compared_numbers(value: Column, limit: Column, digits: int, below: bool) -> Column:
    """``struct<value,limit>`` texts that show the strict order of the two: as few decimals as do, from ``digits`` to 4.

    Where 4 don't, the value is cut towards its side of the limit, and the limit to the other.
    """
    out = None
    scale = 10.0**OUTCOME_DIGITS
    down, up = (lambda x: F.floor(x * scale) / scale), (lambda x: F.ceil(x * scale) / scale)
    text = lambda x, d: F.bround(x.cast("decimal(30,18)"), d).cast("string")  # noqa: E731 - exact ties go to the even digit
    v, m = value.cast("double"), limit.cast("double")
    out = F.struct(text(down(v) if below else up(v), OUTCOME_DIGITS).alias("value"), text(up(m) if below else down(m), OUTCOME_DIGITS).alias("limit"))
    for d in range(OUTCOME_DIGITS, digits - 1, -1):
        a, b = text(v, d), text(m, d)
        shows = a.cast("double") < b.cast("double") if below else a.cast("double") > b.cast("double")
        out = F.when(shows, F.struct(a.alias("value"), b.alias("limit"))).otherwise(out)
    return out
