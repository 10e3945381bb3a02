"""A membership filter of bounded size, so that map stages can skip rows that no join will keep.

It has ``SPARE`` bits or more for each key up to ``MOST_BITS`` in all (16 MB),
whatever the data; building it collects at most 2**MOST_BITS / 64 numbers.
Beyond that it fills up and lets more rows through; it never loses a member,
and the join that follows decides.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPARE = 16
LEAST_BITS, MOST_BITS = 16, 27


class KeyFilter:
    def __init__(self, keys: DataFrame, column: str):
        """``column`` must be a long whose high bits are evenly spread, as of a hash; ``keys`` is read twice."""
        keys = keys.where(F.col(column).isNotNull())
        bits = min(MOST_BITS, max(LEAST_BITS, (SPARE * keys.count()).bit_length()))
        self.shift = 64 - bits
        words = (
            keys.select(F.shiftrightunsigned(F.col(column), self.shift).alias("place"))
            .selectExpr("shiftright(place, 6) AS word", "shiftleft(1L, cast(place % 64 AS int)) AS bit")
            .groupBy("word")
            .agg(F.bit_or("bit").alias("mask"))
            .toArrow()
        )
        table = np.zeros(1 << (bits - 6), np.uint64)
        table[words["word"].to_numpy()] = words["mask"].to_numpy().view(np.uint64)
        self.bytes = table.view(np.uint8)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        place = hashes.view(np.uint64) >> np.uint64(self.shift)
        return (self.bytes[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0
