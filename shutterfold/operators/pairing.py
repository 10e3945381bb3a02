"""Files to logical items: RAW and image files of one shot belong together.

Files of one folder pair by ASCII-folded stem.  Sets of one stem in several
folders merge when that is unambiguous: exactly one set has RAW files only, at
least one has images only, none is mixed, and every image family occurs in one
set only.  Otherwise they stay apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names as N

# Folders of operating systems whose contents are never part of a collection.
SYSTEM_FOLDERS = ("$recycle.bin", ".trashes", "system volume information")


def supported_files(paths: DataFrame, path: str = "path", root: str = "") -> DataFrame:
    """Keeps supported media files that lie outside system folders (below the root) and aren't ``._`` companions."""
    p = F.translate(F.col(path), "\\", "/")
    below = F.when(p.startswith(root.rstrip("/") + "/"), F.substring(p, len(root.rstrip("/")) + 2, 1 << 30)).otherwise(p) if root else p
    folders = F.slice(F.split(below, "/"), F.lit(1), F.size(F.split(below, "/")) - 1)
    system = F.exists(folders, lambda x: F.lower(x).isin(*SYSTEM_FOLDERS))
    return paths.where(N.kind(N.extension(F.col(path))).isNotNull() & ~system & ~N.file_name(F.col(path)).startswith("._"))


def pair(paths: DataFrame, path: str = "path") -> DataFrame:
    """``item, stem, members, display, has_raw, has_image``: one row per logical item; its id is the smallest member path."""
    ext = N.extension(F.col(path))
    files = paths.select(
        F.col(path).alias("path"), N.parent(F.col(path)).alias("folder"), N.ascii_lower(N.stem(F.col(path))).alias("key"),
        (N.kind(ext) == "raw").alias("raw"), F.when(N.kind(ext) == "image", N.family(ext)).alias("family"), N.display_rank(ext).alias("rank"),
    )
    bit = F.lit(None).cast("int")
    for i, f in enumerate(sorted({N.FAMILIES.get(e, e) for e in N.IMAGE_EXTENSIONS})):
        bit = F.when(F.col("family") == f, 1 << i).otherwise(bit)
    files = files.withColumn("family_bit", bit)
    sets = files.groupBy("key", "folder").agg(
        F.max("raw").alias("any_raw"), F.max(F.col("family").isNotNull()).alias("any_image"), F.coalesce(F.bit_or("family_bit"), F.lit(0)).alias("families"),
        F.collect_list(F.struct("path", "raw", "rank")).alias("files"),
    )
    per_stem = sets.groupBy("key").agg(
        F.count("*").alias("sets"), F.count_if(F.col("any_raw") & ~F.col("any_image")).alias("raw_only"), F.count_if(~F.col("any_raw") & F.col("any_image")).alias("image_only"),
        F.count_if(F.col("any_raw") & F.col("any_image")).alias("mixed"), F.sum(F.bit_count("families")).alias("family_sets"), F.bit_count(F.bit_or("families")).alias("families_all"),
    )
    merged = (F.col("sets") > 1) & (F.col("raw_only") == 1) & (F.col("image_only") >= 1) & (F.col("mixed") == 0) & (F.col("family_sets") == F.col("families_all"))
    placed = sets.join(per_stem.where(merged).select("key", F.lit(True).alias("merge")), "key", "left")
    grouped = placed.groupBy("key", F.when(F.col("merge"), F.lit("")).otherwise(F.concat(F.lit("/"), "folder")).alias("place")).agg(F.flatten(F.collect_list("files")).alias("files"))
    members = F.array_sort(F.transform("files", lambda f: f["path"]))
    shown = F.array_min(F.transform("files", lambda f: F.struct(f["rank"].alias("rank"), f["path"].alias("path"))))["path"]
    return grouped.select(
        members.getItem(0).alias("item"), N.stem(members.getItem(0)).alias("stem"), members.alias("members"), shown.alias("display"),
        F.exists("files", lambda f: f["raw"]).alias("has_raw"), F.exists("files", lambda f: ~f["raw"]).alias("has_image"),
    )
