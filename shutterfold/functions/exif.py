"""Capture metadata text to numbers, as Column expressions.

Bad text gives null.  Dates are checked for month 1-12 and day 1-31 only:
impossible days and any hour, minute and second count through, as plain
arithmetic on the proleptic Gregorian calendar.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso(text: Column) -> Column:
    """All digits together, when above 0."""
    value = F.regexp_replace(text, "[^0-9]", "").try_cast("long")
    return F.when(value.between(1, 4294967295), value)


def aperture(text: Column) -> Column:
    token = F.regexp_extract(F.regexp_replace(F.trim(text), "^[fF/]+", ""), r"^\s*([^\s]+)", 1)
    return F.when(token.rlike(r"^[0-9]*\.?[0-9]+$|^[0-9]+\.$"), token.try_cast("float"))


def focal(text: Column) -> Column:
    return F.regexp_extract(F.trim(text), r"^([0-9.]+)", 1).try_cast("float")


def shutter(text: Column) -> Column:
    """Seconds from ``1/250``, ``1/250 s`` or ``0.5``; a zero denominator is null."""
    bare = F.trim(F.regexp_replace(F.trim(text), r"[s\s]+$", ""))
    top, bottom = F.substring_index(bare, "/", 1), F.substring_index(F.substring_index(bare, "/", 2), "/", -1)
    ratio = F.trim(top).try_cast("float") / F.when(F.trim(bottom).try_cast("float") != 0, F.trim(bottom).try_cast("float"))
    return F.when(F.contains(bare, F.lit("/")), ratio.cast("float")).otherwise(bare.try_cast("float"))


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01; months count from March, so that the leap day comes last."""
    year = y - F.when(m <= 2, 1).otherwise(0)
    era = F.floor(year / 400)
    yoe = year - era * 400
    doy = F.floor((153 * (m + F.when(m > 2, -3).otherwise(9)) + 2) / 5) + d - 1
    return (era * 146097 + yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy - 719468).cast("long")


def epoch_seconds(text: Column) -> Column:
    """``YYYY:MM:DD HH:MM[:SS]`` (dashes work too) to seconds, without a zone; whole numbers, one blank, nothing behind but further parts."""
    pattern = r"^\s*([+]?[0-9]+)[:-]([+]?[0-9]+)[:-]([+]?[0-9]+)(?:[:-][^ ]*)? ([+-]?[0-9]+):([+-]?[0-9]+)(?::([+-]?[0-9]+)(?::.*)?)?\s*$"
    parts = F.when(text.rlike(pattern), F.split(F.regexp_replace(text, pattern, "$1 $2 $3 $4 $5 $6 "), " "))

    def seconds(n: Column) -> Column:
        y, mo, d, h, mi, s = (F.get(n, F.lit(i)) for i in range(6))
        return F.when(mo.between(1, 12) & d.between(1, 31), days_from_civil(y, mo, d) * 86400 + h * 3600 + mi * 60 + F.coalesce(s, F.lit(0)))

    # An empty part is no number without asking try_cast, which raises and catches an error for it.  In a lambda the text is matched once, not for each of the numbers' many uses; nor does the sum then swell the stage's
    # one generated method beyond what the JVM compiles (8,000 bytes), which slowed every other column of the row.
    return F.get(F.transform(F.array(F.transform(parts, lambda x: F.when(x != "", x.try_cast("long")))), seconds), F.lit(0))


def photo_meta(exif: dict[str, Column]) -> Column:
    """``struct<iso,aperture,shutter,focal,taken,width,height,camera,lens>`` from metadata texts and sensor sizes; width and height as displayed."""
    size = display_size(exif["width"], exif["height"], exif["orientation"])
    named = {
        "iso": iso(exif["iso"]), "aperture": aperture(exif["aperture"]), "shutter": shutter(exif["shutter"]), "focal": focal(exif["focal"]), "taken": epoch_seconds(exif["datetime"]),
        "width": size["w"], "height": size["h"], "camera": exif["camera"], "lens": exif["lens"],
    }
    return F.struct(*(value.alias(name) for name, value in named.items()))


def is_empty(exif: dict[str, Column]) -> Column:
    """None of the eight fields that a caption or a map could show."""
    out = F.lit(True)
    for name in ("camera", "lens", "aperture", "shutter", "iso", "datetime", "width", "gps"):
        out &= exif[name].isNull()
    return out


def input_colour(icc: Column, colour_space: Column, interop: Column) -> Column:
    """``icc`` where a profile is embedded, ``adobe_rgb`` for an uncalibrated space with index R03, else ``srgb``."""
    index = F.upper(F.trim(F.trim(F.regexp_replace(interop, r"^[\x00 ]+|[\x00 ]+$", ""))))
    return F.when(F.coalesce(F.length(icc), F.lit(0)) > 0, "icc").when((colour_space == 0xFFFF) & (index == "R03"), "adobe_rgb").otherwise("srgb")


def rotation_orientation(rotation: Column) -> Column:
    """Orientation 1 to 8 of a header rotation in degrees."""
    return F.when(rotation == 90, 6).when(rotation == 180, 3).when(rotation == 270, 8).otherwise(1)


def display_size(width: Column, height: Column, orientation: Column) -> Column:
    """``struct<w,h>`` with the sides swapped for orientations 5 to 8."""
    turned = F.coalesce(orientation, F.lit(1)).between(5, 8)
    return F.struct(F.when(turned, height).otherwise(width).alias("w"), F.when(turned, width).otherwise(height).alias("h"))


def gps_decimal(degrees: Column, minutes: Column, seconds: Column, ref: Column, limit: float) -> Column:
    """Decimal degrees; missing minutes and seconds are 0; S and W negate; out of range is null."""
    value = degrees + F.coalesce(minutes, F.lit(0.0)) / 60 + F.coalesce(seconds, F.lit(0.0)) / 3600
    signed = F.when(F.upper(F.trim(ref)).isin("S", "W"), -value).otherwise(value)
    return F.when(F.abs(signed) <= limit, signed)


def gps(lat: Column, lon: Column, altitude: Column, below_sea: Column) -> Column:
    """``struct<lat,lon,alt>``; null when a coordinate is missing or both are 0."""
    alt = F.when(F.coalesce(below_sea, F.lit(0)) == 1, -altitude).otherwise(altitude)
    return F.when(lat.isNotNull() & lon.isNotNull() & ~((lat == 0) & (lon == 0)), F.struct(lat.alias("lat"), lon.alias("lon"), alt.alias("alt")))
