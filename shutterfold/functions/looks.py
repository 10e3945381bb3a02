"""Colour looks: tables baked from closed formulas, and applying a table to pixels."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIDE = 17


def _curve(x: np.ndarray, strength: float) -> np.ndarray:
    """A soft S around one half that keeps 0, 1/2 and 1."""
    return x + strength * np.sin(2 * np.pi * x) / (-2 * np.pi)


def _grey(rgb: np.ndarray) -> np.ndarray:
    return (rgb @ np.array([0.2126, 0.7152, 0.0722]))[..., None]


#: Looks of this library, by name: each maps (n, 3) colours in 0..1 to colours.
LOOKS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "dusk": lambda c: np.clip(c * [1.06, 1.0, 0.9] + [0.0, 0.0, 0.02], 0, 1),
    "harbour": lambda c: np.clip(_curve(c, 0.5) * [0.95, 1.0, 1.05], 0, 1),
    "slate": lambda c: np.clip(np.repeat(_curve(_grey(c), 0.6), 3, axis=-1), 0, 1),
    "linen": lambda c: np.clip(0.06 + 0.9 * (0.75 * c + 0.25 * _grey(c)), 0, 1),
}


def baked(name: str) -> np.ndarray:
    """Table of ``SIDE**3`` colours, red fastest."""
    axis = np.linspace(0, 1, SIDE)
    b, g, r = np.meshgrid(axis, axis, axis, indexing="ij")
    return LOOKS[name](np.stack([r.ravel(), g.ravel(), b.ravel()], axis=1))


def sampled(table: np.ndarray, rgb: np.ndarray) -> np.ndarray:
    """Trilinear values of a table (red fastest) at colours in 0..1."""
    side = round(len(table) ** (1 / 3))
    grid = table.reshape(side, side, side, 3)
    p = np.clip(rgb, 0, 1) * (side - 1)
    lo = np.minimum(np.floor(p).astype(int), side - 1)
    hi, f = np.minimum(lo + 1, side - 1), p - lo
    out = np.zeros_like(p)
    for corner in range(8):
        at = [np.where(corner >> k & 1, hi[:, k], lo[:, k]) for k in range(3)]
        weight = np.prod([f[:, k] if corner >> k & 1 else 1 - f[:, k] for k in range(3)], axis=0)
        out += weight[:, None] * grid[at[2], at[1], at[0]]
    return out


def applied(rgba: bytes, table: np.ndarray | None, compare: bool = False) -> bytes:
    """Pixels through a table; without one, or while comparing, the same bytes.  Alpha stays."""
    if table is None or compare:
        return bytes(rgba)
    out = np.frombuffer(rgba, np.uint8).copy()
    whole = out[: len(out) // 4 * 4].reshape(-1, 4)
    whole[:, :3] = np.clip(np.floor(sampled(table, whole[:, :3] / 255) * 255 + 0.5), 0, 255)
    return out.tobytes()


def with_look(images: DataFrame, name: str | None, pixels: str = "rgba", compare: bool = False) -> DataFrame:
    """Puts ``pixels`` (RGBA bytes) through a named look."""
    table = baked(name) if name else None

    @F.pandas_udf("binary")
    def looked(column: pd.Series) -> pd.Series:
        return column.map(lambda x: applied(x, table, compare) if x is not None else None)

    return images.withColumn(pixels, looked(F.col(pixels))) if table is not None and not compare else images
