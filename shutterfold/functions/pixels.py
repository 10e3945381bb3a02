"""Pixel measures: relational forms over histograms, and numpy kernels for decoded images.

Kernels take (height, width, 3) uint8 arrays in RGB order.  A corrupt or empty
image gives null, never a failed job.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HIGH_CLIP, LOW_CLIP = 250, 5
LOW_Q, HIGH_Q = 0.005, 0.995
LEAST_BOX, IN_FOCUS = 0.06, 0.45


def luma(r: Column, g: Column, b: Column) -> Column:
    """The quality measures' brightness, 0..255."""
    return F.shiftright((54 * r + 183 * g + 19 * b).cast("int"), 8)


def hash_luma(r: Column, g: Column, b: Column) -> Column:
    return F.floor((30 * r + 59 * g + 11 * b) / 100).cast("int")


def percentile_bins(hist: DataFrame, key: str, value: str, count: str, quantiles: dict[str, float]) -> DataFrame:
    """First bin whose cumulative count reaches ``floor(total * q)``, which is bin 0 when that is 0; one row a key.

    ``hist`` has one row per key and bin that occurs.
    """
    by = Window.partitionBy(key)
    cum = F.sum(count).over(by.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = hist.withColumns({"__cum": cum, "__total": F.sum(count).over(by)})

    def bin_of(q: float) -> Column:
        need = F.floor(F.col("__total") * q)
        return F.coalesce(F.min(F.when(need == 0, 0).when(F.col("__cum") >= need, F.col(value))), F.lit(0))

    return rows.groupBy(key).agg(*(bin_of(q).cast("int").alias(name) for name, q in quantiles.items()))


def exposure(hist: DataFrame, key: str, value: str = "v", count: str = "n") -> DataFrame:
    """Exposure report of each key from its 256-bin brightness histogram."""
    c, v = F.col(count), F.col(value)
    sums = hist.groupBy(key).agg(
        F.sum(c).alias("n"), (F.sum(c * v) / F.sum(c) / 255).alias("mean"), (F.sum(F.when(v >= HIGH_CLIP, c).otherwise(0)) / F.sum(c)).alias("high"), (F.sum(F.when(v <= LOW_CLIP, c).otherwise(0)) / F.sum(c)).alias("low")
    )
    bins = percentile_bins(hist, key, value, count, {"lo_bin": LOW_Q, "hi_bin": HIGH_Q})
    both = sums.join(bins, key).withColumn("range", (F.col("hi_bin") - F.col("lo_bin")) / 255)
    penalty = F.when(F.col("mean") < 0.25, (0.25 - F.col("mean")) / 0.25).when(F.col("mean") > 0.75, (F.col("mean") - 0.75) / 0.25).otherwise(0.0)
    raw = (1 - F.least(6 * F.col("high") + 4 * F.col("low"), F.lit(1.0))) * (1 - penalty)
    return both.withColumn("score", F.greatest(F.least(raw, F.lit(1.0)), F.lit(0.0)))


def gray(rgb: np.ndarray) -> np.ndarray:
    x = rgb.astype(np.int32)
    return (54 * x[..., 0] + 183 * x[..., 1] + 19 * x[..., 2]) >> 8


def _edge_energy(g: np.ndarray) -> np.ndarray:
    """4c-l-r-u-d of the pixels that have all four neighbours, in the place of those pixels; zero on the border."""
    g = g.astype(np.float64)
    out = np.zeros(g.shape)
    out[1:-1, 1:-1] = 4 * g[1:-1, 1:-1] - g[1:-1, :-2] - g[1:-1, 2:] - g[:-2, 1:-1] - g[2:, 1:-1]
    return out


def acutance(g: np.ndarray, regions: list[tuple[float, float, float, float]] | None = None) -> float:
    """Root mean square of the edge energy over the frame, or over all pixels of boxes (cx, cy, w, h) at least 0.06 wide."""
    h, w = g.shape
    if min(h, w) < 3:
        return 0.0
    e = _edge_energy(g)
    total = n = 0.0
    for cx, cy, bw, bh in regions or []:
        bw, bh = max(bw, LEAST_BOX), max(bh, LEAST_BOX)
        x0, x1 = (int(min(max((cx + s * bw / 2) * w, 0), w)) for s in (-1, 1))
        y0, y1 = (int(min(max((cy + s * bh / 2) * h, 0), h)) for s in (-1, 1))
        box = e[max(y0, 1) : min(y1, h - 1), max(x0, 1) : min(x1, w - 1)]
        total, n = total + float((box * box).sum()), n + box.size
    if not n:
        box = e[1:-1, 1:-1]
        total, n = float((box * box).sum()), box.size
    return float(np.sqrt(total / n))


def sharpness(g: np.ndarray, regions: list[tuple[float, float, float, float]] | None = None) -> float:
    """a / (a + 8) of the acutance."""
    a = acutance(g, regions)
    return a / (a + 8)


def tilt(g: np.ndarray) -> tuple[float, float]:
    """(degrees, confidence) from a weighted histogram of Sobel edge angles within 12 degrees of level or plumb."""
    g = g.astype(np.float64)
    if min(g.shape) < 8:
        return 0.0, 0.0
    gx = (g[:-2, 2:] + 2 * g[1:-1, 2:] + g[2:, 2:]) - (g[:-2, :-2] + 2 * g[1:-1, :-2] + g[2:, :-2])
    gy = (g[2:, :-2] + 2 * g[2:, 1:-1] + g[2:, 2:]) - (g[:-2, :-2] + 2 * g[:-2, 1:-1] + g[:-2, 2:])
    size = np.hypot(gx, gy)
    strong = size >= 60
    if not strong.any():
        return 0.0, 0.0
    angle = np.degrees(np.arctan2(gy[strong], gx[strong]))
    off = (angle + 45) % 90 - 45  # from the nearest axis
    mass = size[strong]
    near = np.abs(off) <= 12
    place = np.clip(np.round((off[near] + 12) * 5).astype(int), 0, 120)
    hist = np.bincount(place, weights=mass[near], minlength=121)
    smooth = np.convolve(hist, [0.25, 0.5, 0.25], "same")
    top = int(np.argmax(smooth))
    at = np.arange(max(0, top - 3), min(121, top + 4))
    window = hist[at].sum()
    if window <= 0:
        return 0.0, 0.0
    return float((hist[at] * (at / 5 - 12)).sum() / window), float(window / mass.sum())


def dhash(rgb: np.ndarray) -> int:
    """64-bit difference hash: 9x8 nearest samples, a bit set where the left one is darker, lowest bit first; 0 for no image."""
    h, w = rgb.shape[:2]
    if not h or not w:
        return 0
    y, x = np.arange(8) * h // 8, np.arange(9) * w // 9
    s = rgb[y][:, x].astype(np.int32)
    v = (30 * s[..., 0] + 59 * s[..., 1] + 11 * s[..., 2]) // 100
    bits = (v[:, :-1] < v[:, 1:]).ravel()
    return int(np.uint64((bits.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum()).view(np.int64))


def rgb_histogram(rgb: np.ndarray, samples: int = 200_000) -> list[int]:
    """3 x 64 bins over every max(1, pixels / samples)-th pixel."""
    flat = rgb.reshape(-1, 3)[:: max(1, rgb.shape[0] * rgb.shape[1] // samples)] >> 2
    return np.concatenate([np.bincount(flat[:, c], minlength=64) for c in range(3)]).tolist()


def exposure_of(g: np.ndarray) -> dict[str, float]:
    hist = np.bincount(np.clip(g, 0, 255).ravel(), minlength=256)
    n = hist.sum()
    if not n:
        return {"mean": 0.0, "high": 0.0, "low": 0.0, "range": 0.0, "score": 0.0}
    cum = np.cumsum(hist)
    at = [int(np.searchsorted(cum, need)) if (need := int(n * q)) else 0 for q in (LOW_Q, HIGH_Q)]
    mean, high, low = float((hist * np.arange(256)).sum() / n / 255), float(hist[HIGH_CLIP:].sum() / n), float(hist[: LOW_CLIP + 1].sum() / n)
    penalty = (0.25 - mean) / 0.25 if mean < 0.25 else (mean - 0.75) / 0.25 if mean > 0.75 else 0.0
    return {"mean": mean, "high": high, "low": low, "range": (at[1] - at[0]) / 255, "score": min(1.0, max(0.0, (1 - min(6 * high + 4 * low, 1)) * (1 - penalty)))}


def oriented(rgb: np.ndarray, orientation: int) -> np.ndarray:
    """The image as displayed, for the 8 orientations."""
    turns = {2: lambda a: a[:, ::-1], 3: lambda a: a[::-1, ::-1], 4: lambda a: a[::-1], 5: lambda a: a.transpose(1, 0, 2), 6: lambda a: np.rot90(a, -1), 7: lambda a: np.rot90(a, 2).transpose(1, 0, 2), 8: lambda a: np.rot90(a)}
    return turns.get(orientation, lambda a: a)(rgb)


def _triangle(size: int, out: int) -> np.ndarray:
    """(out, size) weights of a triangle filter as wide as the reduction."""
    scale = size / out
    reach = max(scale, 1.0)
    centre = (np.arange(out) + 0.5) * scale
    weights = np.maximum(0, 1 - np.abs(np.arange(size)[None, :] + 0.5 - centre[:, None]) / reach)
    return weights / weights.sum(axis=1, keepdims=True)


def shrunk(image: np.ndarray, edge: int) -> np.ndarray:
    """Longest side at most ``edge`` by a triangle filter; smaller images stay."""
    h, w = image.shape[:2]
    if max(h, w) <= edge:
        return image
    nh, nw = max(1, round(h * edge / max(h, w))), max(1, round(w * edge / max(h, w)))
    tall = np.tensordot(_triangle(h, nh), image.astype(np.float64), axes=(1, 0))
    both = np.moveaxis(np.tensordot(_triangle(w, nw), tall, axes=(1, 1)), 0, 1)
    return np.clip(np.floor(both + 0.5), 0, 255).astype(image.dtype)


REPORT = "struct<exposure:float,mean:float,sharpness:float,in_focus:boolean,tilt:float,tilt_confidence:float,dhash:bigint,histogram:array<int>,good:boolean>"
SIGNALS = ("exposure", "focus", "tilt")


def report(image: np.ndarray, signals: tuple[str, ...] = SIGNALS, regions: list[tuple[float, float, float, float]] | None = None, limits: dict[str, float] | None = None) -> dict:
    """Measures of an image; signals that are off stay at zero.

    With ``regions`` focus is measured there, else over the whole frame.
    ``good`` is the verdict of ``limits`` (least exposure and focus, most tilt)
    over the signals that are on; a tilt of little confidence doesn't count.
    """
    g = gray(image)
    degrees, confidence = tilt(shrunk(g, 512)) if "tilt" in signals else (0.0, 0.0)
    e = exposure_of(g) if "exposure" in signals else {"score": 0.0, "mean": 0.0}
    focus = sharpness(shrunk(g, 1024), regions) if "focus" in signals else 0.0
    limits = limits or {}
    bad = [
        "exposure" in signals and e["score"] < limits.get("exposure", 0.0), "focus" in signals and focus < limits.get("focus", 0.0),
        "tilt" in signals and confidence >= 0.2 and abs(degrees) > limits.get("tilt", 180.0),
    ]
    return {
        "exposure": e["score"], "mean": e["mean"], "sharpness": focus, "in_focus": focus >= IN_FOCUS, "tilt": degrees, "tilt_confidence": confidence,
        "dhash": dhash(image), "histogram": rgb_histogram(image), "good": not any(bad),
    }


def score_images(images: DataFrame, image: str = "image", out: str = "report", signals: tuple[str, ...] = SIGNALS, regions: str | None = None, limits: dict[str, float] | None = None) -> DataFrame:
    """Adds ``out`` to rows of Spark's image source (BGR or BGRA bytes); null where an image can't be measured, whatever is wrong with it.

    ``regions`` names a column ``array<struct<cx,cy,w,h>>`` of display boxes in focus.
    """
    parts = [F.col(f"{image}.{k}") for k in ("height", "width", "nChannels", "data")]
    boxes = F.col(regions) if regions else F.array().cast("array<struct<cx:double,cy:double,w:double,h:double>>")

    @F.pandas_udf(REPORT)
    def scored(rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        for h, w, c, data, where in zip(rows["height"], rows["width"], rows["nChannels"], rows["data"], rows["boxes"], strict=True):
            try:
                pixels = np.frombuffer(data, np.uint8).reshape(int(h), int(w), int(c))  # floats where the batch has a null image
                where = [(b["cx"], b["cy"], b["w"], b["h"]) for b in where] if where is not None else None
                found.append({} if not pixels.size else report(np.repeat(pixels, 3, axis=2) if c == 1 else pixels[..., 2::-1], signals, where, limits))
            except Exception:  # noqa: BLE001 - one broken image costs one row
                found.append({})
        names = [f.split(":")[0] for f in REPORT[7:-1].split(",")]
        return pd.DataFrame([[r.get(n) for n in names] for r in found], columns=names, dtype=object)

    scored = scored.asNondeterministic()  # a filter on the report would measure each image twice otherwise
    return images.withColumn(out, scored(F.struct(*parts, boxes.alias("boxes")))).withColumn(out, F.when(F.col(f"{out}.sharpness").isNotNull(), F.col(out)))
