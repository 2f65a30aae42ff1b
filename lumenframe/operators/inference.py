"""Model scoring in batches, one session for each Python worker and model."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import geometry, pixels

RAW = "path string, frame int, model int, det_no int, x1 double, y1 double, x2 double, y2 double, class_id int, conf double, ratio double, dw double, dh double"


@lru_cache(maxsize=4)
def session(path: str):
    """A session on the processor; graphics cards are taken where the library offers them.

    ``py:module:class`` makes another session with the same methods.
    """
    if path.startswith("py:"):
        import importlib

        _, module, name = path.split(":")
        return getattr(importlib.import_module(module), name)()
    import onnxruntime

    wanted = [p for p in ("CUDAExecutionProvider", "CPUExecutionProvider") if p in onnxruntime.get_available_providers()]
    return onnxruntime.InferenceSession(path, providers=wanted)


def run_model(path: str, tensor: np.ndarray) -> np.ndarray:
    """The first output for the first input."""
    s = session(path)
    return s.run([s.get_outputs()[0].name], {s.get_inputs()[0].name: tensor})[0]


def batch_size(path: str, most: int) -> int:
    """Images that a model takes at once: the number that it fixes, or ``most`` where it leaves that open; one where it doesn't say."""
    shape = getattr(session(path).get_inputs()[0], "shape", None)
    if not shape:
        return 1
    return shape[0] if isinstance(shape[0], int) and shape[0] > 0 else most


def run_batches(path: str, tensors: np.ndarray, most: int = 8) -> Iterator[tuple[int, np.ndarray]]:
    """The rows (x1, y1, x2, y2, class, confidence) found in each of ``tensors``, with its place; the last batch of a fixed size is filled up with zeros."""
    size = batch_size(path, most)
    for at in range(0, len(tensors), size):
        part = tensors[at : at + size]
        given = part
        if 1 < size != len(part) and batch_size(path, 0):
            given = np.concatenate([part, np.zeros((size - len(part), *part.shape[1:]), part.dtype)])
        found = np.asarray(run_model(path, given), float).reshape(-1, 7)
        of = found[:, 0].astype(int) if size > 1 else np.zeros(len(found), int)
        for k in range(len(part)):
            yield at + k, found[of == k, 1:]


def detect(frames: DataFrame, models: list[str], size: int = 640, most: int = 8) -> DataFrame:
    """Detections of each model on each frame, boxes in the letterboxed image; models give rows (batch, x1, y1, x2, y2, class, confidence).

    Models that take several images get up to ``most`` at once.
    """
    columns = [c.split()[0] for c in RAW.split(", ")]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), most):
                rows = list(whole.iloc[at : at + most].itertuples(index=False))
                shaped, tensors = [], []
                for r in rows:
                    image = pixels.drop_alpha(pixels.to_array(r.data, r.height, r.width, r.channels))
                    boxed, ratio, (dw, dh) = pixels.letterbox(image, (size, size), auto=False)
                    shaped.append((ratio, dw, dh))
                    tensors.append(pixels.to_tensor(pixels.swap_channels(boxed))[1])
                for k, model in enumerate(models, 1):
                    out = [(rows[p].path, rows[p].frame, k, n, *map(float, d[:4]), int(d[4]), float(d[5]), *shaped[p]) for p, found in run_batches(model, np.concatenate(tensors), most) for n, d in enumerate(found, 1)]
                    yield pd.DataFrame(out, columns=columns)

    return frames.select("path", "frame", "height", "width", "channels", "data").mapInPandas(work, RAW)


def in_pixels(detections: DataFrame) -> DataFrame:
    """Detections with boxes in whole pixels of the original image."""
    box = geometry.unletterbox(("x1", "y1", "x2", "y2"), "ratio", "dw", "dh")
    return detections.withColumns(dict(zip(("x1", "y1", "x2", "y2"), box, strict=True))).drop("ratio", "dw", "dh")


def score_vectors(rows: DataFrame, model: str, key: str, column: str, width: int, batch: int) -> DataFrame:
    """A model's first output for fixed batches of vectors' first ``width`` values: (key, output); the last batch is filled up with zeros."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                x = np.zeros((batch, width), np.float32)
                x[: len(part)] = np.stack([np.asarray(v[:width], np.float32) for v in part[column]])
                y = np.asarray(run_model(model, x)).reshape(batch, -1)[: len(part)]
                yield pd.DataFrame({key: part[key].to_numpy(), "output": [list(map(float, v)) for v in y]})

    return rows.select(key, column).mapInPandas(work, f"{key} long, output array<double>")


def label_lines(detections: DataFrame, with_conf: bool = False) -> DataFrame:
    """Lines of detection files, from boxes already normalised as xc, yc, w, h: class and six-digit numbers."""
    from lumenframe.functions.formats import general

    fields = [F.col("class_id").cast("double"), *(F.col(c) for c in ("xc", "yc", "w", "h")), *([F.col("conf")] if with_conf else [])]
    return detections.withColumn("line", F.concat_ws(" ", *(general(f) for f in fields)))
