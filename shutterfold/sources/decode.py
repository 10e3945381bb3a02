"""From any supported file to pixels: the image itself, a HEIF's JPEG item, or a RAW file's embedded preview.

The bytes that can be decoded are written to a folder that all workers mount,
one file for each row, and come back through Spark's image source; rows
without such bytes, and images that don't decode, keep a null image.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from . import files as F_
from . import heif, previews, tiff

HEIF = ("heic", "heif")


def displayable(files: DataFrame, min_edge: int | None = None) -> DataFrame:
    """Adds ``bytes``, ``bytes_from``, ``orientation`` and ``original_edge`` to rows of ``path, content``.

    ``min_edge`` asks for the smallest preview that is large enough.  A HEIF is
    turned as its index says, every other file as its capture metadata says.
    """
    found = heif.with_index(previews.with_candidates(tiff.read_info(files)))
    ext = N.extension(F.col("path"))
    raw = N.kind(ext) == "raw"
    preview = previews.choose(F.col("previews"), min_edge)
    item = heif.choose(F.col("heif.items"), F.col("previews"), min_edge or 1 << 20)
    piece = lambda p: F.substring(F.col("content"), (p["offset"] + 1).cast("int"), p["length"].cast("int"))
    chosen = F.when(raw, piece(preview)).when(ext.isin(*HEIF), piece(item)).otherwise(F.col("content"))
    source = F.when(raw, F.when(preview.isNotNull(), "preview")).when(ext.isin(*HEIF), item["source"]).otherwise("file")
    turned = F.when(ext.isin(*HEIF), F.coalesce("heif.orientation", F.lit(1))).otherwise(tiff.orientation(F.col("info")))
    edge = heif.original_edge(raw, F.col("previews"), F.coalesce("heif.edge", "info.width"), F.col("info.height"))
    return found.select(*files.columns, chosen.alias("bytes"), source.alias("bytes_from"), turned.alias("orientation"), edge.cast("int").alias("original_edge"))


def decoded(files: DataFrame, folder: str, min_edge: int | None = None) -> DataFrame:
    """Rows of ``path, bytes_from, orientation, original_edge`` with ``image`` as in Spark's image source."""
    shown = displayable(files, min_edge).withColumn("__name", F.concat(F.lower(F.hex(F.xxhash64("path"))), F.lit(".img")))
    kept = ["path", "bytes_from", "orientation", "original_edge", "__name"]

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        for frame in frames:
            for name, data in zip(frame["__name"], frame["bytes"], strict=True):
                if data is not None:
                    with open(os.path.join(folder, name), "wb") as out:
                        out.write(data)
            yield frame[kept]

    written = shown.select(*kept, "bytes").mapInPandas(write, shown.select(*kept).schema)
    written = F_.stored(written)  # the files must be there before they are read
    images = F_.images(files.sparkSession, folder).select(F.regexp_extract("image.origin", r"[^/]*$", 0).alias("__name"), "image")
    return written.join(images, "__name", "left").drop("__name")
