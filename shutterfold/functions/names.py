"""File names, item keys, natural order, templates and folder names as Column expressions."""

from __future__ import annotations

import re

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Supported extensions, the image families, and the order in which an image is preferred for display.
RAW_EXTENSIONS = ("arw", "cr2", "cr3", "nef", "orf", "rw2", "raf", "dng", "pef", "srw", "raw", "x3f")
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "webp", "heic", "heif", "tif", "tiff")
FAMILIES = {"jpeg": "jpg", "heif": "heic", "tiff": "tif"}
DISPLAY_ORDER = ("jpg", "jpeg", "heic", "heif", "png", "tif", "tiff", "webp")
FORBIDDEN = '\\/:*?"<>|'
COLOUR_TAGS = ("orange", "pink", "teal", "blue", "purple")


def ascii_lower(s: Column) -> Column:
    """Folds A-Z only; other letters keep their case."""
    return F.translate(s, UPPER, LOWER)


def file_name(path: Column) -> Column:
    return F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)


def parent(path: Column) -> Column:
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.substring(p, F.lit(1), F.length(p) - F.length(F.substring_index(p, "/", -1)) - 1)


def extension(path: Column) -> Column:
    """Lower-case text after the last dot of the file name, when something stands before that dot; else null."""
    found = F.regexp_extract(file_name(path), r"^.+\.([^.]+)$", 1)
    return F.when(found != "", ascii_lower(found))


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def kind(ext: Column) -> Column:
    return F.when(ext.isin(*RAW_EXTENSIONS), "raw").when(ext.isin(*IMAGE_EXTENSIONS), "image")


def family(ext: Column) -> Column:
    out = ext
    for k, v in FAMILIES.items():
        out = F.when(ext == k, v).otherwise(out)
    return out


def display_rank(ext: Column) -> Column:
    """Preferred images first, then other images, then RAW."""
    out = F.when(kind(ext) == "raw", 98).otherwise(99)
    for i, e in reversed(list(enumerate(DISPLAY_ORDER))):
        out = F.when(ext == e, i).otherwise(out)
    return out


def item_key(path: Column, root: str = "") -> Column:
    """Path below the root with forward slashes and without extension."""
    p = F.translate(path, "\\", "/")
    rel = F.when(p.startswith(root.rstrip("/") + "/"), F.substring(p, len(root.rstrip("/")) + 2, 1 << 30)).otherwise(file_name(path)) if root else p
    return F.regexp_replace(rel, r"(?<=[^/])\.[^./]*$", "")


def normal_key(key: Column) -> Column:
    return ascii_lower(F.translate(key, "\\", "/"))


def natural_key(s: Column) -> Column:
    """A string whose plain order is the natural order of ``s``.

    Digit runs order by value whatever their length, then by fewer leading
    zeros; other characters by code point with A-Z folded; a prefix comes first.
    """
    tokens = F.regexp_extract_all(s, F.lit(r"([0-9]+|[^0-9])"), F.lit(1))

    def token(t: Column) -> Column:
        value = F.regexp_replace(t, "^0+", "")
        digits = F.concat(F.lit("0"), F.lpad(F.length(value).cast("string"), 10, "0"), value, F.lpad(F.length(t).cast("string"), 10, "0"))
        return F.when(t.rlike("^[0-9]"), digits).otherwise(ascii_lower(t))

    return F.array_join(F.transform(tokens, token), "")


def sanitized(s: Column, empty: Column) -> Column:
    """A safe file or folder name: forbidden characters become ``_``; outer blanks and dots go; ``empty`` stands for nothing left."""
    clean = F.trim(F.translate(s, FORBIDDEN, "_" * len(FORBIDDEN)))
    clean = F.trim(F.regexp_replace(clean, r"^\.+|\.+$", ""))
    return F.when(F.coalesce(clean, F.lit("")) == "", empty).otherwise(clean)


#: Tokens of a file name template that are numbers.
NUMBERS = ("seq", "order", "gradeseq")


def grade(stars: Column) -> Column:
    """5 is A, 1 is E; other values have no letter."""
    return F.when(stars.between(1, 5), F.substring(F.lit("EDCBA"), stars, F.lit(1))).otherwise("")


def templated(template: str, values: dict[str, Column], original: Column, prefix: dict[str, Column] | None = None) -> Column:
    """A file name from ``{token}`` and ``{token:0N}`` parts.

    Only tokens in ``NUMBERS`` take a width; ``prefix`` stands before a token's
    padded number.  Unknown tokens are empty, a brace without an end is literal
    text; the result is sanitised, and the original stem stands in for an empty
    one.
    """
    parts: list[Column] = []
    for literal, token, rest in re.findall(r"(?s)([^{]+)|\{([^}]*)\}|(\{.*)", template):
        if literal or rest:
            parts.append(F.lit(literal or rest))
            continue
        name, _, width = token.partition(":")
        if name in values:
            value = values[name].cast("string")
            n = int(width.strip()) if name in NUMBERS and width.strip().isdecimal() else 0
            value = F.when(F.length(value) < n, F.lpad(value, n, "0")).otherwise(value) if n else value
            parts.append(F.concat(prefix[name], value) if prefix and name in prefix else value)
    built = F.concat(*[F.coalesce(p, F.lit("")) for p in parts]) if parts else F.lit("")
    return sanitized(built, original)


def split_folder(label: Column, stars: Column, tag: Column, by: str) -> Column:
    """Target sub-folder when splitting by label, stars or tag; a label split sends star-only items to their star folder."""
    star = F.when(stars >= 1, F.concat(F.least(stars, F.lit(5)).cast("string"), F.lit("star"))).otherwise("unrated")
    if by == "stars":
        return star
    if by == "tag":
        return F.concat(F.lit("@"), F.coalesce(tag, F.lit("untagged")))
    return F.when(label != "unrated", label).otherwise(star)


def date_folder(exif_date: Column, modified: Column) -> Column:
    """``YYYY-MM-DD`` of the capture date (colons between its parts), else of the file time, else ``unknown-date``."""
    date = F.regexp_extract(exif_date, r"^\s*([^\s]*)", 1)
    capture = F.when(date.rlike(r"^[0-9]{4}:[0-9]*:[0-9]*$"), F.translate(date, ":", "-"))
    return F.coalesce(capture, F.date_format(modified, "yyyy-MM-dd"), F.lit("unknown-date"))


def focal_folder(text: Column) -> Column:
    """Leading number rounded half away from zero, as ``35mm``; ``unknown-focal`` for none or not above 0."""
    value = F.regexp_extract(F.trim(text), r"^([0-9.]*)", 1).try_cast("double")
    return F.when(value > 0, F.concat(F.floor(value + 0.5).cast("string"), F.lit("mm"))).otherwise("unknown-focal")


def named_folder(text: Column, unknown: str) -> Column:
    """A camera's or lens's folder; ``unknown`` where no name is left."""
    clean = sanitized(text, F.lit("unknown"))
    return F.when(clean != "unknown", clean).otherwise(unknown)


def extension_folder(path: Column) -> Column:
    return F.coalesce(F.upper(extension(path)), F.lit("unknown-ext"))


def organise_folder(by: str, path: Column, exif_date: Column, modified: Column, camera: Column, lens: Column, focal: Column) -> Column:
    """Target folder by date, camera, lens, focal length or extension; all but the last are the same for all members of an item."""
    return {
        "date": lambda: date_folder(exif_date, modified), "camera": lambda: named_folder(camera, "unknown-camera"), "lens": lambda: named_folder(lens, "unknown-lens"),
        "focal": lambda: focal_folder(focal), "extension": lambda: extension_folder(path),
    }[by]()


def language(locale: Column) -> Column:
    """``ko``, ``ja`` or ``en`` by the prefix of a locale code; null for others."""
    code = F.substring(ascii_lower(F.trim(locale)), 1, 2)
    return F.when(code.isin("ko", "ja", "en"), code)


def map_url(template: str, lat: Column, lon: Column, zoom: Column) -> Column:
    """A map link from ``{lat}``, ``{lon}`` and ``{zoom}``; null where a coordinate is."""
    out = F.lit(template)
    for name, value in {"lat": F.format_string("%.6f", lat), "lon": F.format_string("%.6f", lon), "zoom": zoom.cast("string")}.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return F.when(lat.isNotNull() & lon.isNotNull(), out)


def size_text(n: Column) -> Column:
    """GB with 2 decimals, MB with 1, KB with none, else bytes."""
    gb, mb, kb = 1 << 30, 1 << 20, 1 << 10
    return (
        F.when(n >= gb, F.format_string("%.2f GB", n / gb))
        .when(n >= mb, F.format_string("%.1f MB", n / mb))
        .when(n >= kb, F.format_string("%.0f KB", n / kb))
        .otherwise(F.format_string("%d B", n.cast("long")))
    )


def version(text: Column) -> Column:
    """``struct<major,minor,patch>`` of ``v1.2.3-rc1``-like text: pre-release dropped, missing parts 0; null when no number."""
    base = F.split(F.regexp_replace(F.trim(text), "^[vV]", ""), "[-+]").getItem(0)
    part = lambda i: F.when(F.size(F.split(base, r"\.")) > i, F.get(F.split(base, r"\."), F.lit(i)).try_cast("int")).otherwise(0)
    return F.when(base.rlike(r"^[0-9]+(\.[0-9]+)*$"), F.struct(part(0).alias("major"), part(1).alias("minor"), part(2).alias("patch")))


def hex_colour(text: Column) -> Column:
    """``struct<r,g,b>`` of ``#rrggbb``; null otherwise."""
    at = lambda i: F.conv(F.substring(text, i, 2), 16, 10).cast("int")
    return F.when(text.rlike("^#[0-9A-Fa-f]{6}$"), F.struct(at(2).alias("r"), at(4).alias("g"), at(6).alias("b")))


def colour_text(r: Column, g: Column, b: Column) -> Column:
    return F.when(r.isNotNull() & g.isNotNull() & b.isNotNull(), F.format_string("#%02X%02X%02X", r, g, b))


def compose_hangul(text: Column) -> Column:
    """Composes conjoining Hangul jamo; other characters keep their form."""

    @F.udf("string", useArrow=True)
    def composed(s: str | None) -> str | None:
        import unicodedata

        return None if s is None else re.sub("[ᄀ-ᄒ][ᅡ-ᅵ][ᆨ-ᇂ]?|[가-힣][ᆨ-ᇂ]", lambda m: unicodedata.normalize("NFC", m[0]), s)

    return composed(text)


@F.arrow_udf(T.StringType())
def composed(texts: pa.Array) -> pa.Array:
    """Texts with all characters in their composed form (NFC), in which two spellings of a path are equal."""
    return pa.array([unicodedata.normalize("NFC", x) if x is not None else None for x in texts.to_pylist()], pa.string())


def caption(model: Column, lens: Column, aperture: Column, shutter: Column, iso: Column, focal: Column, date: Column) -> Column:
    """Caption lines: camera; lens; exposure values; date with dots. Missing parts drop out."""
    blank = lambda c: F.when(F.trim(c) != "", F.trim(c))
    exposure = F.array_compact(F.array(blank(aperture), F.concat(blank(shutter), F.lit("s")), F.concat(F.lit("ISO "), blank(iso)), blank(focal)))
    when = F.concat(F.replace(F.substring_index(date, " ", 1), F.lit(":"), F.lit(".")), F.regexp_extract(date, "( .*)$", 1))
    return F.array_compact(F.array(blank(model), blank(lens), F.when(F.size(exposure) > 0, F.array_join(exposure, "  ")), blank(when)))
