"""Model scores of images as a table operation: one model for each worker process, batches, and failures that cost one row.

A model is any function from a batch of input arrays to arrays of outputs, one
row for each input; ``onnx_model`` makes one from a file where the runtime is
there.  The readers turn outputs into the columns that culling uses.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Model = Callable[[np.ndarray], "np.ndarray | list[np.ndarray]"]

# Fixed values of the models: input sides, normalisation, strides of the face detector, least confidences.
CLIP_SIDE, DETECTOR_SIDE = 224, 640
CLIP_MEAN, CLIP_STD = (0.48145466, 0.4578275, 0.40821073), (0.26862954, 0.26130258, 0.27577711)
STRIDES = (8, 16, 32)
FACE_LEAST, OBJECT_LEAST, CLASSES = 0.5, 0.30, 80
AXES = ("quality", "genre_portrait", "sharp", "compose")


def resized(rgb: np.ndarray, side: int) -> np.ndarray:
    """Nearest samples of a square of ``side``; enough for models, which see the whole frame."""
    h, w = rgb.shape[:2]
    return rgb[np.arange(side) * h // side][:, np.arange(side) * w // side]


def clip_input(rgb: np.ndarray) -> np.ndarray:
    x = (resized(rgb, CLIP_SIDE).astype(np.float32) / 255 - np.float32(CLIP_MEAN)) / np.float32(CLIP_STD)
    return x.transpose(2, 0, 1)


def face_input(rgb: np.ndarray) -> np.ndarray:
    return resized(rgb, DETECTOR_SIDE)[..., ::-1].astype(np.float32).transpose(2, 0, 1)


def object_input(rgb: np.ndarray) -> np.ndarray:
    return (resized(rgb, DETECTOR_SIDE).astype(np.float32) / 255).transpose(2, 0, 1)


def aesthetic_score(row: np.ndarray) -> float:
    """The last output, between 0 and 1; what is not finite is an error."""
    value = float(np.ravel(row)[-1])
    if not np.isfinite(value):
        raise ValueError("a score that is not finite")
    return min(1.0, max(0.0, value))


def axes_scores(row: np.ndarray) -> dict[str, float]:
    return dict(zip(AXES, map(float, np.ravel(row)), strict=True))


def face_score(row: list[np.ndarray]) -> float:
    """The best class score times object score over the outputs of all strides (``cls, obj`` for each)."""
    return max((float(np.max(np.ravel(c) * np.ravel(o))) for c, o in zip(row[: len(STRIDES)], row[len(STRIDES) : 2 * len(STRIDES)], strict=True)), default=0.0)


def detections(row: np.ndarray) -> list[int]:
    """Class ids of detections ``x1, y1, x2, y2, confidence, class`` that are sure enough, in order of first sight."""
    seen: dict[int, None] = {}
    for *_, sure, kind in np.reshape(row, (-1, 6)):
        if sure >= OBJECT_LEAST and 0 <= (c := np.floor(kind + 0.5)) < CLASSES:
            seen.setdefault(int(c))
    return list(seen)


def sure_classes(found: Column) -> Column:
    """The same for a column ``array<struct<conf,cls>>``."""
    kinds = F.transform(F.filter(found, lambda d: d["conf"] >= F.lit(OBJECT_LEAST).cast("float")), lambda d: F.floor(d["cls"] + 0.5).cast("int"))
    return F.array_distinct(F.filter(kinds, lambda c: c.between(0, CLASSES - 1)))


def class_number(text: Column, names: list[str]) -> Column:
    """Place (from 0) of a class: its exact name, else the first that holds the text or is held by it; null for none and for blank text."""
    low = F.lower(F.trim(text))
    known = F.array(*map(F.lit, names))
    near = F.array_min(F.filter(F.transform(known, lambda n, i: F.when(F.contains(n, low) | F.contains(low, n), i)), lambda i: i.isNotNull()))
    return F.when(low != "", F.when(F.array_contains(known, low), F.array_position(known, low).cast("int") - 1).otherwise(near))


def onnx_model(path: str) -> Callable[[], Model]:
    """Loads a model file on the worker's CPU, with one thread for each process."""

    def load() -> Model:
        import onnxruntime

        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = 1
        session = onnxruntime.InferenceSession(path, options, providers=["CPUExecutionProvider"])
        name = session.get_inputs()[0].name
        return lambda batch: session.run(None, {name: batch})

    return load


def _rows(outputs: np.ndarray | list[np.ndarray], n: int) -> list:
    """One output, or list of outputs, for each input; fewer outputs than inputs are an error."""
    several = isinstance(outputs, list) and len(outputs) > 1
    first = outputs[0] if isinstance(outputs, list) else outputs
    if len(first) < n:
        raise ValueError("the model gave fewer outputs than inputs")
    return [[o[i] for o in outputs] if several else first[i] for i in range(n)]


def score(images: DataFrame, load: Callable[[], Model], prepare: Callable[[np.ndarray], np.ndarray], read: Callable, out: str, out_type: str, batch: int = 8, image: str = "image") -> DataFrame:
    """Adds ``out`` to rows of Spark's image source; null where an image or the model fails on it."""
    column = F.struct(*(F.col(f"{image}.{k}") for k in ("height", "width", "nChannels", "data")))

    @F.pandas_udf(out_type)
    def scored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        model = load()

        def pixels(row) -> np.ndarray:
            x = np.frombuffer(row.data, np.uint8).reshape(int(row.height), int(row.width), int(row.nChannels))  # floats where the batch has a null image
            return np.repeat(x, 3, axis=2) if row.nChannels == 1 else x[..., 2::-1]

        def alone(x: np.ndarray):
            try:
                return read(_rows(model(x[None]), 1)[0])
            except Exception:  # noqa: BLE001 - a model may raise anything; it costs this row only
                return None

        for frame in frames:
            found: list = [None] * len(frame)
            ready = []
            for i, row in enumerate(frame.itertuples(index=False)):
                try:
                    ready.append((i, prepare(pixels(row))))
                except (ValueError, TypeError, ZeroDivisionError, IndexError):
                    continue
                if len(ready) == batch:
                    _fill(found, ready, model, read, alone)
                    ready = []
            _fill(found, ready, model, read, alone)
            yield pd.Series(found, dtype=object)

    return images.withColumn(out, scored.asNondeterministic()(column))  # run once, whatever filters follow


def _fill(found: list, ready: list, model: Model, read: Callable, alone: Callable) -> None:
    """Scores a batch; where it fails as a whole, its rows one by one."""
    if not ready:
        return
    try:
        values = [read(r) for r in _rows(model(np.stack([x for _, x in ready])), len(ready))]
    except Exception:  # noqa: BLE001
        values = [alone(x) for _, x in ready]
    for (i, _), v in zip(ready, values, strict=True):
        found[i] = v
