"""Map tiles, focus-point coordinates, guide lines and gaps, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def tile(lat: Column, lon: Column, zoom: int) -> Column:
    """Fractional Web-Mercator tile ``struct<x,y>``."""
    n = float(1 << zoom)
    r = F.radians(lat)
    return F.struct(((lon + 180.0) / 360.0 * n).alias("x"), ((1.0 - F.ln(F.tan(r) + 1.0 / F.cos(r)) / math.pi) / 2.0 * n).alias("y"))


def tile_window(x: Column, y: Column, zoom: int, width: int, height: int, edge: int = 256) -> Column:
    """``array<struct<x,y>>`` of the tiles that a view centred on (x, y) covers; x wraps, y is clipped."""
    n = 1 << zoom
    x0, x1 = F.floor(x - width / 2 / edge), F.floor(x + width / 2 / edge)
    y0 = F.greatest(F.floor(y - height / 2 / edge), F.lit(0))
    y1 = F.least(F.floor(y + height / 2 / edge), F.lit(n - 1))
    rows = F.transform(F.sequence(x0, x1), lambda a: F.transform(F.sequence(y0, y1), lambda b: F.struct(F.pmod(a, F.lit(n)).alias("x"), b.alias("y"))))
    return F.when(y0 <= y1, F.flatten(rows)).otherwise(F.slice(F.flatten(rows), 1, 0))


def oriented_box(cx: Column, cy: Column, w: Column, h: Column, orientation: Column) -> Column:
    """A normalised sensor box in display coordinates; orientations 5 to 8 swap the sides."""
    o = F.coalesce(orientation, F.lit(1))
    x = F.when(o == 2, 1 - cx).when(o == 3, 1 - cx).when(o == 4, cx).when(o == 5, cy).when(o == 6, 1 - cy).when(o == 7, 1 - cy).when(o == 8, cy).otherwise(cx)
    y = F.when(o == 2, cy).when(o == 3, 1 - cy).when(o == 4, 1 - cy).when(o == 5, cx).when(o == 6, cx).when(o == 7, 1 - cx).when(o == 8, 1 - cx).otherwise(cy)
    turned = o.between(5, 8)
    return F.struct(x.alias("cx"), y.alias("cy"), F.when(turned, h).otherwise(w).alias("w"), F.when(turned, w).otherwise(h).alias("h"))


def focus_centre(points: Column) -> Column:
    """Mean centre of the in-focus points, else of the selected ones, else of all; null without points."""

    def mean(chosen: Column) -> Column:
        total = lambda k: F.aggregate(chosen, F.lit(0.0), lambda s, p: s + p[k])
        return F.when(F.size(chosen) > 0, F.struct((total("cx") / F.size(chosen)).alias("cx"), (total("cy") / F.size(chosen)).alias("cy")))

    return F.coalesce(mean(F.filter(points, lambda p: p["in_focus"])), mean(F.filter(points, lambda p: p["selected"])), mean(points))


def guide_lines(style: str, width: Column | None = None, height: Column | None = None, custom: Column | None = None) -> Column:
    """Relative positions of guide lines: thirds, cross, the sides of the centred square, or up to 8 finite own ones."""
    if style == "thirds":
        return F.array(F.lit(1 / 3), F.lit(2 / 3))
    if style == "cross":
        return F.array(F.lit(0.5))
    if style == "square":
        share = F.least(width, height) / width
        return F.when(share < 1, F.array((1 - share) / 2, (1 + share) / 2)).otherwise(F.array().cast("array<double>"))
    usable = F.filter(custom, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.transform(F.slice(usable, 1, 8), lambda x: F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0)))


def largest_gap_middle(points: Column, epsilon: float = 1e-4) -> Column:
    """Middle of the widest gap between 0, the clamped points and 1; the first of gaps that differ by epsilon at most."""
    clamped = F.transform(points, lambda x: F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0)))
    stops = F.array_sort(F.concat(F.array(F.lit(0.0), F.lit(1.0)), clamped))
    gaps = F.zip_with(F.slice(stops, F.lit(1), F.size(stops) - 1), F.slice(stops, F.lit(2), F.size(stops) - 1), lambda a, b: F.struct((b - a).alias("w"), ((a + b) / 2).alias("m")))
    first = F.struct(F.lit(-1.0).alias("w"), F.lit(0.5).alias("m"))
    return F.aggregate(gaps, first, lambda best, g: F.when(g["w"] > best["w"] + epsilon, g).otherwise(best))["m"]


def lut_sample(table: Column, size: int, r: Column, g: Column, b: Column) -> Column:
    """Trilinear value of a 3-D table (array of ``size**3`` structs or numbers, red fastest) at 0..1 coordinates."""
    top = float(size - 1)

    def at(c: Column) -> tuple[Column, Column, Column]:
        p = F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0)) * top
        lo = F.floor(p)
        return lo, F.least(lo + 1, F.lit(size - 1)), p - lo

    (r0, r1, fr), (g0, g1, fg), (b0, b1, fb) = at(r), at(g), at(b)
    cell = lambda x, y, z: F.element_at(table, (x + y * size + z * size * size + 1).cast("int"))
    mixed = lambda a, c, f: a + (c - a) * f
    plane = lambda z: mixed(mixed(cell(r0, g0, z), cell(r1, g0, z), fr), mixed(cell(r0, g1, z), cell(r1, g1, z), fr), fg)
    return mixed(plane(b0), plane(b1), fb)


def focus_regions(points: Column, orientation: Column) -> Column:
    """Display boxes of the points in focus; empty where none is, and then the whole frame counts."""
    chosen = F.filter(F.coalesce(points, F.array().cast("array<struct<cx:double,cy:double,w:double,h:double,in_focus:boolean,selected:boolean>>")), lambda p: p["in_focus"])
    return F.transform(chosen, lambda p: oriented_box(p["cx"], p["cy"], p["w"], p["h"], orientation))
