"""Near-duplicate clusters of 64-bit perceptual hashes.

The 64 bits are cut into k + ``SPARE`` blocks.  Two hashes within distance k
differ in at most k of them, so they agree in ``SPARE`` blocks, and pairs meet
in equi-joins on the values of every choice of ``SPARE`` blocks.  Equal hashes
are one node, so copies cost nothing; what remains under a key are different
hashes that share all its bits, more than a third of the 64 at distance 6.
"""

from __future__ import annotations

from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components

SPARE = 3


@F.arrow_udf(T.LongType())
def text_hash(texts: pa.Array) -> pa.Array:
    """64 bits of a text: 65 characters at even steps, a bit set where one is below the next, lowest bit first."""
    found = []
    for text in texts.to_pylist():  # places of characters are found at once in a Python string; a UTF-8 column would be scanned for each
        if text is None:
            found.append(None)
            continue
        at = [ord(text[i * len(text) // 65]) if text else 0 for i in range(65)]
        bits = sum(1 << i for i in range(64) if at[i] < at[i + 1])
        found.append(bits - (1 << 64) if bits >> 63 else bits)
    return pa.array(found, pa.int64())


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def masks(k: int, spare: int = SPARE) -> list[int]:
    """Bit masks: hashes within distance k agree under one of them at least."""
    n = min(k + spare, 64)
    edges = [round(i * 64 / n) for i in range(n + 1)]
    blocks = [((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(blocks, max(1, n - k))]


def near_pairs(hashes: DataFrame, k: int, hash_column: str = "h") -> DataFrame:
    """``a, b`` with a < b: all pairs of distinct hashes within distance k."""
    distinct = hashes.select(hash_column).where(F.col(hash_column).isNotNull()).distinct()
    signed = F.array(*(F.lit(m - (1 << 64) if m >> 63 else m) for m in masks(k)))
    rows = distinct.select(F.col(hash_column).alias("h"), F.posexplode(signed).alias("mask", "bits")).select("h", "mask", F.col("h").bitwiseAND(F.col("bits")).alias("value"))
    left, right = rows.withColumnRenamed("h", "a"), rows.withColumnRenamed("h", "b")
    # Spark takes the size of the exploded rows for that of the hashes, and would send all of them through the driver as a broadcast
    near = left.join(right.hint("merge"), ["mask", "value"]).where((F.col("a") < F.col("b")) & (distance(F.col("a"), F.col("b")) <= k))
    return near.select("a", "b").distinct()


def clusters(df: DataFrame, k: int, hash_column: str, key: str, out: str = "cluster") -> DataFrame:
    """Adds ``out``: the smallest key of the row's cluster; null where the hash is."""
    groups = connected_components(near_pairs(df, k, hash_column), "a", "b")
    labelled = df.join(groups.select(F.col("node").alias(hash_column), F.col("component").alias("__root")).hint("merge"), hash_column, "left")
    rooted = labelled.withColumn("__root", F.when(F.col(hash_column).isNotNull(), F.coalesce("__root", hash_column)))
    least = rooted.where("__root is not null").groupBy("__root").agg(F.min(key).alias(out))
    return rooted.join(least.hint("merge"), "__root", "left").drop("__root")
