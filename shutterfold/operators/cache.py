"""Keyed result caches: usable entries, misses, size-bounded eviction and newest-first trimming."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranking import numbered


def usable(needs_hash: bool, needs_aesthetic: Column | bool) -> Column:
    """Whether a cached row holds all that this run needs."""
    ok = F.col("dhash").isNotNull() if needs_hash else F.lit(True)
    need = needs_aesthetic if isinstance(needs_aesthetic, Column) else F.lit(needs_aesthetic)
    return ok & (F.col("aesthetic").isNotNull() | ~need)


def lookup(wanted: DataFrame, cache: DataFrame, keys: tuple[str, ...] = ("path", "mtime", "signature"), ok: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(hits with the cached columns, misses): a hit needs the same path, time and signature, and all that ``ok`` asks for."""
    good = cache.where(ok) if ok is not None else cache
    return wanted.join(good, list(keys)), wanted.join(good.select(*keys), list(keys), "left_anti")


def evict(files: DataFrame, limit: int, size: str = "size", age: str = "mtime", key: str = "path") -> DataFrame:
    """Adds ``evicted``: oldest rows go until the total is at most ``limit``; 0 keeps all."""
    if limit == 0:
        return files.withColumn("evicted", F.lit(False))
    total = files.agg(F.coalesce(F.sum(size), F.lit(0)).alias("__total"))
    summed = numbered(files, [F.col(age), F.col(key)], "__row", size, "__upto")
    older = F.col("__upto") - F.coalesce(F.col(size), F.lit(0))
    return summed.crossJoin(F.broadcast(total)).withColumn("evicted", F.col("__total") - older > limit).drop("__row", "__upto", "__total")  # one row


def newest(files: DataFrame, cap: int = 50_000, age: str = "mtime", key: str = "path") -> DataFrame:
    return files.orderBy(F.col(age).desc(), key).limit(cap)


def totals(files: DataFrame, size: str = "size") -> DataFrame:
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))


ENTRIES = "array<struct<path:string, mtime:bigint, signature:bigint, dhash:bigint, aesthetic:double>>"


def entries(documents: DataFrame, text: str = "text") -> DataFrame:
    """Rows of saved cache lists; missing fields are null, the last entry of a path wins, text that is no list has none."""
    found = documents.select(F.posexplode(F.from_json(text, ENTRIES, {"mode": "PERMISSIVE"})).alias("__at", "e")).where("e.path is not null")
    return found.groupBy("e.path").agg(F.max_by("e", "__at").alias("e")).select("e.*")


def cache_key(version: int, path: Column, size: Column, mtime: Column, edge: Column, heic: Column) -> Column:
    """16 hex digits of all that makes a thumbnail; HEIC files have their own salt."""
    hashed = F.xxhash64(F.lit(version), path, size.cast("long"), mtime.cast("long"), edge.cast("int"), F.when(heic, F.lit("heic")).otherwise(""))
    return F.lpad(F.lower(F.hex(hashed)), 16, "0")


BINS = 64


@F.arrow_udf(T.BinaryType())
def packed_histogram(bins: pa.Array) -> pa.Array:
    """3 x 64 counts (red, green, blue) as little-endian 32-bit numbers; null for another number of counts."""
    return pa.array([np.array(x, "<u4").tobytes() if x is not None and len(x) == 3 * BINS else None for x in bins.to_pylist()], pa.binary())


@F.arrow_udf(T.ArrayType(T.LongType()))
def unpacked_histogram(data: pa.Array) -> pa.Array:
    """The counts of ``packed_histogram``; null for another length."""
    return pa.array([np.frombuffer(x, "<u4").tolist() if x is not None and len(x) == 12 * BINS else None for x in data.to_pylist()], pa.list_(pa.int64()))


def histogram_top(bins: Column) -> Column:
    """Height of a histogram's display: the largest count, at least 1."""
    return F.greatest(F.coalesce(F.array_max(bins), F.lit(0)), F.lit(1))


def store(thumbs: DataFrame, path: str) -> None:
    """Adds thumbnails (``key, jpeg, histogram``) to a stored table; a commit is whole or not there."""
    thumbs.select("key", "jpeg", packed_histogram("histogram").alias("histogram")).write.mode("append").parquet(path)


def clear(spark: SparkSession, path: str) -> None:
    """An empty table in place of the stored one."""
    spark.createDataFrame([], "key string, jpeg binary, histogram binary").write.mode("overwrite").parquet(path)
