"""Row numbers and running sums over a whole table without gathering it in one task.

The table is range-partitioned and sorted once; each partition numbers its own
rows, and the totals of the partitions before it are added.  Only one number a
partition is broadcast, so the plan holds for any number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def placed(df: DataFrame, order: list[Column]) -> DataFrame:
    """Rows dealt to ranges of ``order`` (a total order), with ``__part``, the range, and ``__in_part``, the place in it from 0."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__part", F.monotonically_increasing_id())
    rows = rows.withColumns({"__part": F.shiftright("__part", 33).cast("int"), "__in_part": F.col("__part").bitwiseAND(F.lit((1 << 33) - 1))})
    return cut(rows)


def before(parts: DataFrame, **columns: Column) -> DataFrame:
    """``columns`` computed over the partitions before each one; ``parts`` has one row a partition."""
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(parts.select("__part", *(c.over(earlier).alias(n) for n, c in columns.items())))


def numbered(df: DataFrame, order: list[Column], name: str = "row", running: str | None = None, total: str = "running") -> DataFrame:
    """Adds 1-based ``name`` by ``order`` (which must be a total order) and, for a ``running`` column, its inclusive sum."""
    rows = placed(df, order)
    value = F.coalesce(F.col(running), F.lit(0)) if running else F.lit(0)
    sums = rows.groupBy("__part").agg(F.count("*").alias("n"), F.sum(value).alias("v"))
    out = rows.join(before(sums, __n=F.sum("n"), __v=F.sum("v")), "__part").withColumn(name, F.col("__in_part") + 1 + F.coalesce("__n", F.lit(0)))
    if running:
        own = Window.partitionBy("__part").orderBy("__in_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = out.withColumn(total, F.sum(value).over(own) + F.coalesce("__v", F.lit(0)))
    return out.drop("__part", "__in_part", "__n", "__v")


def largest(df: DataFrame, group: list[str]) -> int:
    """Rows of the largest group."""
    return df.groupBy(*group).count().agg(F.max("count")).first()[0] or 0


def numbered_within(df: DataFrame, group: list[str], order: list[Column], name: str = "row") -> DataFrame:
    """Adds 1-based ``name`` by ``order`` inside each group, however large one is: global numbers less those of the groups before."""
    placed = numbered(df, [*(F.col(c) for c in group), *order], name)
    first = placed.groupBy(*group).agg(F.min(name).alias("__first"))
    same = F.lit(True)
    for c in group:
        same &= F.col(c).eqNullSafe(F.col(f"__g_{c}"))
    starts = first.select(*(F.col(c).alias(f"__g_{c}") for c in group), "__first")
    return placed.join(starts, same, "left").withColumn(name, F.col(name) - F.col("__first") + 1).drop("__first", *(f"__g_{c}" for c in group))
