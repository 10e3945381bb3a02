"""Saved classifications: restoring them onto items, saving them back, and the readable summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import normal_key
from .ranking import numbered_within

RECORDS = "version int, folder string, updated_at string, items map<string, struct<label:string, stars:int, tag:string, members:array<string>>>"


def parse(text: Column) -> Column:
    """A session document with missing fields defaulted; null for text that isn't one."""
    return F.from_json(text, RECORDS, {"mode": "PERMISSIVE"})


def records(sessions: DataFrame, text: str = "text") -> DataFrame:
    """``key, label, stars, tag, members`` of session documents."""
    items = sessions.select(F.explode(parse(F.col(text))["items"]).alias("key", "r"))
    return items.select("key", F.coalesce("r.label", F.lit("unrated")).alias("label"), F.least(F.coalesce("r.stars", F.lit(0)), F.lit(5)).alias("stars"), F.col("r.tag").alias("tag"), F.coalesce("r.members", F.array().cast("array<string>")).alias("members"))


def matches(candidates: DataFrame, saved: DataFrame) -> DataFrame:
    """``item, prio, record`` (a folded key): ``candidates(item, prio, key)`` meet records by own key or by a saved member path."""
    by_key = saved.select(normal_key(F.col("key")).alias("k"), normal_key(F.col("key")).alias("record"))
    by_member = saved.select(F.explode("members").alias("m"), normal_key(F.col("key")).alias("record")).select(normal_key(F.col("m")).alias("k"), "record")
    keys = by_key.unionByName(by_member).distinct()
    found = candidates.select("item", "prio", normal_key(F.col("key")).alias("k")).join(keys, "k")
    return found.groupBy("item", "record").agg(F.min("prio").alias("prio"))


def claimed(candidates: DataFrame, saved: DataFrame) -> DataFrame:
    """``key``: the folded keys of all records that current items read."""
    return matches(candidates, saved).select(F.col("record").alias("key")).distinct()


def folded(saved: DataFrame) -> DataFrame:
    """One record for each folded key, as ``record``: the one whose own key comes last."""
    rows = saved.groupBy(normal_key(F.col("key")).alias("record")).agg(F.max_by(F.struct("label", "stars", "tag"), "key").alias("r"))
    return rows.select("record", "r.*")


def restore(items: DataFrame, candidates: DataFrame, saved: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """``items`` with label, stars, tag and ``has_record`` from the saved records.

    Per field the first non-default value in candidate order wins.  A matched
    record resets fields that it leaves at their default; an item without any
    record keeps what it has.  ``fallback(item, key)`` names legacy records,
    used only where nothing else matched.
    """
    found = matches(candidates, saved)
    if fallback is not None:
        legacy = fallback.select("item", normal_key(F.col("key")).alias("k")).join(folded(saved).select(F.col("record").alias("k"), "record"), "k")
        legacy = legacy.join(found.select("item").distinct(), "item", "left_anti")
        found = found.unionByName(legacy.select("item", "record", F.lit(1 << 20).alias("prio")))
    rows = found.join(folded(saved), "record")
    order = F.struct("prio", "record")
    merged = rows.groupBy("item").agg(
        F.min_by(F.when(F.col("label") != "unrated", F.col("label")), F.when(F.col("label") != "unrated", order)).alias("__label"),
        F.min_by(F.when(F.col("stars") > 0, F.col("stars")), F.when(F.col("stars") > 0, order)).alias("__stars"),
        F.min_by("tag", F.when(F.col("tag").isNotNull(), order)).alias("__tag"),
        F.lit(True).alias("__has"),
    )
    has = F.coalesce("__has", F.lit(False))
    return items.join(merged, "item", "left").select(
        *(F.col(c) for c in items.columns if c not in ("label", "stars", "tag")),
        F.when(has, F.coalesce("__label", F.lit("unrated"))).otherwise(F.col("label")).alias("label"),
        F.when(has, F.least(F.coalesce("__stars", F.lit(0)), F.lit(5))).otherwise(F.col("stars")).alias("stars"),
        F.when(has, F.col("__tag")).otherwise(F.col("tag")).alias("tag"),
        has.alias("has_record"),
    )


def save(items: DataFrame, saved: DataFrame, claimed: DataFrame, recursive: bool) -> DataFrame:
    """The records to write: classified items, and on a flat save old sub-folder records that no item claims."""
    new = items.where((F.col("label") != "unrated") | (F.col("stars") > 0) | F.col("tag").isNotNull()).select("key", "label", "stars", "tag", "members")
    if recursive:
        return new
    own = claimed.select(normal_key(F.col("key")).alias("__k")).distinct()
    keep = saved.withColumn("__k", normal_key(F.col("key"))).where(F.contains("__k", F.lit("/"))).join(own, "__k", "left_anti").join(new.select("key"), "key", "left_anti")
    return keep.select("key", "label", "stars", "tag", "members").unionByName(new)


def summary(items: DataFrame) -> DataFrame:
    """``section, n, place, key``: a row for every key of a section, ascending, and one without key for an empty pick, hold or reject.

    Stars 5 to 1 and tags appear only where used.  Rows are ranked over the
    whole table, so a section of any size is no single row or task.
    """
    parts = F.array(
        F.when(F.col("label").isin("pick", "hold", "reject"), F.col("label")),
        F.when(F.col("stars").between(1, 5), F.concat(F.col("stars").cast("string"), F.lit("star"))),
        F.when(F.col("tag").isNotNull(), F.concat(F.lit("@"), F.col("tag"))),
    )
    listed = items.select(F.explode(F.array_compact(parts)).alias("section"), "key")
    sizes = listed.groupBy("section").agg(F.count("*").alias("n"))
    used = numbered_within(listed, ["section"], [F.col("key")], "place").join(sizes, "section").select("section", "n", "place", "key")
    fixed = items.sparkSession.createDataFrame([("pick",), ("hold",), ("reject",)], "section string")
    empty = fixed.join(sizes, "section", "left_anti").select("section", F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("place"), F.lit(None).cast("string").alias("key"))
    return used.unionByName(empty)
