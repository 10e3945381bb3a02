"""Filters, counts, search and bulk edits over classified items (label, stars, tag)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import ascii_lower
from .ranking import numbered

LABELS = ("unrated", "pick", "hold", "reject")


def item_filter(label: str | None = None, stars: int | None = None, tag: str | None = None, untagged: bool = False) -> Column:
    """All given axes must fit; ``stars=0`` means unrated ones only."""
    ok = F.lit(True)
    if label is not None:
        ok &= F.col("label") == label
    if stars is not None:
        ok &= F.col("stars") == stars
    if untagged:
        ok &= F.col("tag").isNull()
    elif tag is not None:
        ok &= F.col("tag") == tag
    return ok


def axis_counts(items: DataFrame) -> DataFrame:
    """``axis, value, n`` of labels, stars (capped at 5) and colour tags (untagged left out) in one pass."""
    axes = F.array(
        F.struct(F.lit("label").alias("axis"), F.col("label").alias("value")),
        F.struct(F.lit("stars").alias("axis"), F.least("stars", F.lit(5)).cast("string").alias("value")),
        F.struct(F.lit("tag").alias("axis"), F.col("tag").alias("value")),
    )
    return items.select(F.inline(axes)).where("value is not null").groupBy("axis", "value").agg(F.count("*").alias("n"))


def search_terms(text: str) -> list[str]:
    """Terms split at ``, ; tab CR LF``, trimmed, distinct without regard to ASCII case; first spelling and order stay."""
    import re

    seen: dict[str, str] = {}
    for term in (t.strip() for t in re.split(r"[,;\t\r\n]", text)):
        if term:
            seen.setdefault("".join(c.lower() if "A" <= c <= "Z" else c for c in term), term)
    return list(seen.values())


def distinct_terms(df: DataFrame, text: str, key: str) -> DataFrame:
    """The same for a column: ``key, place, term``."""
    parts = df.select(key, F.posexplode(F.split(text, r"[,;\t\r\n]")).alias("at", "term")).withColumn("term", F.trim("term")).where("term <> ''")
    first = parts.groupBy(key, ascii_lower(F.col("term")).alias("folded")).agg(F.min(F.struct("at", "term")).alias("f"))
    return first.select(key, F.row_number().over(Window.partitionBy(key).orderBy("f.at")).cast("long").alias("place"), F.col("f.term").alias("term"))


def matches_terms(stem: Column, terms: list[str], exact: bool = False) -> Column:
    """Whether the folded stem equals or contains any term."""
    low, out = ascii_lower(stem), F.lit(False)
    for t in terms:
        folded = F.lit("".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        out |= (low == folded) if exact else F.contains(low, folded)
    return out


def relabel(items: DataFrame, chosen: Column, label: str, toggle: bool = False) -> DataFrame:
    """Bulk edit with its change log: adds ``old_label`` and ``changed``; ``toggle`` takes an equal label off."""
    target = F.when(F.col("label") == label, F.lit("unrated")).otherwise(label) if toggle else F.lit(label)
    new = F.when(chosen, target).otherwise(F.col("label"))
    return items.withColumns({"old_label": F.col("label"), "label": new, "changed": new != F.col("label")})


def undo(items: DataFrame, log: DataFrame, key: str = "item_id") -> DataFrame:
    """Puts the old labels of a change log back."""
    old = log.where("changed").select(key, F.col("old_label").alias("__old"))
    return items.join(old, key, "left").withColumn("label", F.coalesce("__old", "label")).drop("__old")


def distinct_names(df: DataFrame, column: str) -> DataFrame:
    """Trimmed, non-empty distinct values."""
    return df.select(F.trim(column).alias(column)).where(F.col(column) != "").distinct()


def recent(df: DataFrame, key: str, seq: str, cap: int) -> DataFrame:
    """Most recently used keys, newest first: ``key, place`` up to ``cap``."""
    last = df.groupBy(key).agg(F.max(seq).alias("__last")).orderBy(F.col("__last").desc(), key).limit(cap)
    return last.select(key, F.row_number().over(Window.orderBy(F.col("__last").desc(), key)).cast("long").alias("place"))  # at most cap rows


def lane_latest(df: DataFrame, lane: str, seq: str, cap: int) -> DataFrame:
    """Bounded latest-first queues: the ``cap`` newest requests of each lane with their serving order."""
    placed = df.withColumn("place", F.row_number().over(Window.partitionBy(lane).orderBy(F.col(seq).desc())).cast("long"))
    return placed.where(F.col("place") <= cap)


def position_window(df: DataFrame, order: list[Column], current: int, back: int, ahead: int) -> DataFrame:
    """Rows around the ``current``-th (1-based) of the ordered table."""
    return numbered(df, order, "pos").where(F.col("pos").between(current - back, current + ahead))


def jump_to_number(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return numbered(df, order, "pos").where(F.col("pos") == n)


def jump_to_name(df: DataFrame, order: list[Column], stem: str, term: str) -> DataFrame:
    """First match in order, with the number of all matches."""
    found = df.where(matches_terms(F.col(stem), [term]))
    return found.orderBy(*order).limit(1).crossJoin(F.broadcast(found.agg(F.count("*").alias("matches"))))  # one row by one row


def visible(chosen: DataFrame, shown: DataFrame, key: str = "item_id") -> DataFrame:
    """The chosen items that the filter shows."""
    return chosen.join(shown.select(key).distinct(), key, "left_semi")


def place_after_filter(shown: DataFrame, order: list[Column], keep: object, key: str = "item_id") -> DataFrame:
    """``place`` (from 0) of the item that was open; 0 where the new filter leaves it out."""
    found = numbered(shown, order, "__row").where(F.col(key).eqNullSafe(F.lit(keep)))
    return found.agg(F.coalesce(F.min("__row") - 1, F.lit(0)).alias("place"))


def place_after_rating(place: Column, still_shown: Column, shown: Column) -> Column:
    """One further while the item stays, else the same place, which the next one takes; never beyond the end, null for an empty list."""
    return F.when(shown > 0, F.least(F.when(still_shown, place + 1).otherwise(place), shown - 1))


HISTORY = 300


def at_step(items: DataFrame, log: DataFrame, step: int, key: str = "item_id") -> DataFrame:
    """Labels after ``step`` edits of a log ``(step, key, old_label, label)``: going back undoes, going forward redoes."""
    done = F.col("step") <= step
    last = log.groupBy(key).agg(F.max_by("label", F.when(done, F.col("step"))).alias("__new"), F.min_by("old_label", "step").alias("__old"), F.max(done).alias("__done"))
    label = F.when(F.col("__done"), F.col("__new")).otherwise(F.coalesce("__old", "label"))
    return items.join(last, key, "left").withColumn("label", label).drop("__new", "__old", "__done")


def edited(log: DataFrame, edit: DataFrame, step: int) -> DataFrame:
    """The log with an edit made after ``step``: later steps can't be redone any more, and only ``HISTORY`` steps stay."""
    return log.where(F.col("step") <= step).unionByName(edit.withColumn("step", F.lit(step + 1).cast("long"))).where(F.col("step") > step + 1 - HISTORY)


def of_generation(results: DataFrame, current: int | Column) -> DataFrame:
    """Results asked for by the folder and order that are open now."""
    return results.where(F.col("generation") == current)


def last_touches(touches: DataFrame, key: str, seq: str) -> DataFrame:
    """Only the newest touch of each key."""
    return touches.groupBy(key).agg(F.max(seq).alias(seq))
