"""Connected components of an edge table of any size.

Rounds of hooking and contraction: every node takes the smallest node next to
it as its parent, parents are shortened by pointer jumping, and the edges are
rewritten between parents.  Edges inside a merged group vanish, so the table
shrinks round by round; the parent maps are composed backwards at the end, the
small ones first.  Minima and duplicates combine before each shuffle, so a hub
with a third of all edges costs no more than its edges; nothing is collected
but whether edges are left, and no table is broadcast.

The edges of a round are a Parquet table.  A checkpoint keeps the size that the
planner guessed, a product of the sizes of all that was joined; with checkpoints
alone its digits grow fivefold a round, until the driver has no memory for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut, stored

JUMPS = 2


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``node, component`` for every node in an edge; component = its smallest node.

    Edges with a null end and self-loops only add the node they name.  An empty
    table gives an empty result.
    """
    ends = edges.select(F.col(src).alias("x"), F.col(dst).alias("y"))
    pairs = ends.select(F.coalesce("x", "y").alias("x"), F.coalesce("y", "x").alias("y")).where("x is not null")
    links = stored(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    maps: list[DataFrame] = []
    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("parent"))
        for _ in range(JUMPS):
            up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
            parents = cut(parents.join(up.hint("merge"), "parent").select("node", F.col("grand").alias("parent")))
        maps.append(parents)
        low = parents.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        high = parents.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        moved = links.where("a <> b").join(low.hint("merge"), "a").join(high.hint("merge"), "b").where("pa <> pb")
        links = stored(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
        if links.isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = maps.pop()
    while maps:
        roots = found.select(F.col("node").alias("parent"), F.col("parent").alias("root"))
        found = maps.pop().join(roots.hint("merge"), "parent", "left").select("node", F.coalesce("root", "parent").alias("parent"))
    return found.withColumnRenamed("parent", "component")
