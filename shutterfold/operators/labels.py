"""Display names of labels and tags, and real paths of names that are spelled otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import composed


def named(items: DataFrame, names: DataFrame, lang: str, column: str = "label", custom: DataFrame | None = None, out: str = "name") -> DataFrame:
    """Adds ``out``: the user's own name (``custom(value, own)``), else that of ``names(lang, value, name)``, else the value itself."""
    known = names.where(F.col("lang") == lang).groupBy("value").agg(F.min("name").alias("__name"))
    joined = items.join(known.withColumnRenamed("value", "__value"), F.col(column) == F.col("__value"), "left").drop("__value")
    own = F.lit(None).cast("string")
    if custom is not None:
        mine = custom.groupBy("value").agg(F.min("own").alias("__own")).withColumnRenamed("value", "__value")
        joined = joined.join(mine, F.col(column) == F.col("__value"), "left").drop("__value")
        own = F.when(F.trim("__own") != "", F.col("__own"))
    return joined.withColumn(out, F.coalesce(own, F.col("__name"), F.col(column))).drop("__name", "__own")


def real_paths(wanted: DataFrame, there: DataFrame, path: str = "path", out: str = "real") -> DataFrame:
    """Adds ``out``: the path of ``there`` that is spelled the same, else the first that is when all characters are composed; null for none."""
    by_form = there.select(path).distinct().withColumn("__k", composed(path)).groupBy("__k").agg(F.min(path).alias("__first"), F.collect_set(path).alias("__all"))
    joined = wanted.withColumn("__k", composed(path)).join(by_form, "__k", "left")
    return joined.withColumn(out, F.when(F.array_contains("__all", F.col(path)), F.col(path)).otherwise(F.col("__first"))).drop("__k", "__first", "__all")
