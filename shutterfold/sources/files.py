"""Media files as tables: the scan, display names and capture-ready items."""

from __future__ import annotations

import os
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..operators.lineage import stored
from ..operators.pairing import SYSTEM_FOLDERS, pair, supported_files

LISTING = "path string, folder boolean, modified timestamp, size long"


def _entries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What stands directly in each folder; one that can't be read is empty."""
    for frame in frames:
        rows = []
        for path in frame["path"]:
            try:
                with os.scandir(path) as found:
                    for e in found:
                        if e.is_dir(follow_symlinks=False) or e.is_file():
                            is_folder, stat = e.is_dir(follow_symlinks=False), e.stat()
                            rows.append((e.path, is_folder, datetime.fromtimestamp(stat.st_mtime, timezone.utc).replace(tzinfo=None), stat.st_size))
            except OSError:
                continue
        yield pd.DataFrame(rows, columns=["path", "folder", "modified", "size"])


def _listing(spark: SparkSession, root: str, recursive: bool) -> DataFrame:
    """All files, level by level, by a file system that all workers mount; names with a leading ``_`` or ``.`` too, which Spark's own sources hide."""
    folders = spark.createDataFrame([(root,)], "path string")
    levels = []
    while True:
        level = stored(folders.mapInPandas(_entries, LISTING))
        levels.append(level.where("not folder").drop("folder"))
        name = F.lower(N.file_name(F.col("path")))
        folders = level.where(F.col("folder") & ~name.isin(*SYSTEM_FOLDERS)).select("path")
        if not recursive or folders.isEmpty():
            break
        folders = folders.repartition(spark.sparkContext.defaultParallelism)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def scan(spark: SparkSession, root: str, recursive: bool = True, content: bool = False) -> DataFrame:
    """``path, modified, size`` (and ``content``) of the supported files in ``root``, or also below it."""
    found = supported_files(_listing(spark, root.rstrip("/") or "/", recursive), "path", root)

    @F.udf("binary", useArrow=True)
    def read(path: str) -> bytes | None:
        try:
            with open(path, "rb") as file:
                return file.read()
        except OSError:
            return None

    return found.withColumn("content", read("path")) if content else found


def items(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """The logical items of a folder."""
    return pair(scan(spark, root, recursive).select("path"))


def scan_order(by: str, display: str = "display", modified: str = "modified") -> list:
    """Sort columns of items: ``name`` in natural order of the display file's name, ``modified`` newest first, then by name."""
    name = [N.natural_key(N.file_name(F.col(display))), F.col(display)]
    return [F.col(modified).desc_nulls_last(), *name] if by == "modified" else name


def images(spark: SparkSession, root: str) -> DataFrame:
    """Decoded pixels of the images that the runtime can decode (JPEG, PNG, BMP, GIF, TIFF); others drop out."""
    return spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(root)
