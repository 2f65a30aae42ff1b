"""Random augmentation of images together with their boxes or polygons.

What is drawn depends on the path, the version and the seed alone, so a task
that runs again gives the same pixels.  Pixels and annotations of a version
share one draw.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import pixels
from lumenframe.sources.labels import Hyperparameters


def generator(path: str, version: int, seed: int = 0) -> np.random.Generator:
    import xxhash

    return np.random.default_rng(xxhash.xxh64_intdigest(f"{path}\x00{version}", seed))


def draw(rng: np.random.Generator, hyp: Hyperparameters, width: int, height: int) -> list[tuple[str, object]]:
    """The steps of one version, in random order: flips, an affine matrix about the centre, and colour factors half of the time."""
    steps: list[tuple[str, object]] = []
    if rng.random() < hyp.fliplr:
        steps.append(("affine", np.array([[-1.0, 0, width], [0, 1, 0]])))
    if rng.random() < hyp.flipud:
        steps.append(("affine", np.array([[1.0, 0, 0], [0, -1, height]])))
    scale = rng.uniform(1 - hyp.scale, 1 + hyp.scale)
    move = rng.uniform(-hyp.translate, hyp.translate, 2) * (width, height)
    turn, lean = np.deg2rad(rng.uniform(-hyp.degrees, hyp.degrees)), np.deg2rad(rng.uniform(-hyp.shear, hyp.shear))
    rotate = np.array([[np.cos(turn), -np.sin(turn)], [np.sin(turn), np.cos(turn)]])
    linear = scale * rotate @ np.array([[1, np.tan(lean)], [0, 1]])
    centre = np.array([width / 2, height / 2])
    steps.append(("affine", np.column_stack([linear, centre + move - linear @ centre])))
    if rng.random() < 0.5:
        steps.append(("colour", tuple(rng.uniform(1 - x, 1 + x) for x in (hyp.hsv_h, hyp.hsv_s, hyp.hsv_v))))
    return [steps[k] for k in rng.permutation(len(steps))]


def matrix_of(steps: list[tuple[str, object]]) -> np.ndarray:
    """All affine steps as one matrix, so pixels are resampled once."""
    whole = np.eye(3)
    for kind, step in steps:
        if kind == "affine":
            whole = np.vstack([step, [0, 0, 1]]) @ whole
    return whole[:2]


def augmented_pixels(image: np.ndarray, steps: list[tuple[str, object]]) -> np.ndarray:
    # Pixel centres are half a pixel into the plane in which points are moved.
    m = matrix_of(steps)
    half = np.array([0.5, 0.5])
    out = pixels.warp(image, np.column_stack([m[:, :2], m[:, 2] + m[:, :2] @ half - half]))
    for kind, step in steps:
        if kind == "colour":
            hsv = pixels.to_hsv(out).astype(np.float64)
            hsv[..., 0] = hsv[..., 0] * step[0] % 180
            hsv[..., 1:] = np.clip(hsv[..., 1:] * step[1:], 0, 255)
            out = pixels.from_hsv(hsv.astype(np.uint8))
    return out


def moved_points(points: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    return points @ matrix[:, :2].T + matrix[:, 2]


def moved_boxes(boxes: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Boxes (x1, y1, x2, y2) around their moved corners."""
    corners = boxes[:, [0, 1, 2, 1, 2, 3, 0, 3]].reshape(-1, 4, 2)
    moved = moved_points(corners.reshape(-1, 2), matrix).reshape(-1, 4, 2)
    return np.concatenate([moved.min(1), moved.max(1)], 1)


IMAGE_RESULT = "path string, version int, height int, width int, channels int, data binary, polygons array<struct<class_id: int, points: array<struct<x: double, y: double>>>>, boxes array<struct<class_id: int, x1: double, y1: double, x2: double, y2: double>>"


def _moved(r, m: np.ndarray) -> tuple[list[dict], list[dict]]:
    """Polygons and boxes of a row, moved."""
    polygons = [{"class_id": p["class_id"], "points": [{"x": float(x), "y": float(y)} for x, y in moved_points(np.array([[q["x"], q["y"]] for q in p["points"]]).reshape(-1, 2), m)]} for p in (r.polygons if r.polygons is not None else [])]
    given = list(r.boxes) if r.boxes is not None else []
    moved = moved_boxes(np.array([[b["x1"], b["y1"], b["x2"], b["y2"]] for b in given], float).reshape(-1, 4), m)
    return polygons, [{"class_id": b["class_id"], **dict(zip(("x1", "y1", "x2", "y2"), map(float, box), strict=True))} for b, box in zip(given, moved, strict=True)]


ANNOTATION_RESULT = "path string, version int, height int, width int, polygons array<struct<class_id: int, points: array<struct<x: double, y: double>>>>, boxes array<struct<class_id: int, x1: double, y1: double, x2: double, y2: double>>"


def augment_annotations(rows: DataFrame, hyp: Hyperparameters, seed: int = 0) -> DataFrame:
    """What ``augment_images`` gives for the annotations of versions (path, version, height, width, polygons, boxes), by the same draw, without reading pixels."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(r.path, r.version, r.height, r.width, *_moved(r, matrix_of(draw(generator(r.path, r.version, seed), hyp, r.width, r.height)))) for r in batch.itertuples(index=False)]
            yield pd.DataFrame(out, columns=["path", "version", "height", "width", "polygons", "boxes"])

    return rows.select("path", "version", "height", "width", "polygons", "boxes").mapInPandas(work, ANNOTATION_RESULT)


def augment_images(images: DataFrame, hyp: Hyperparameters, seed: int = 0) -> DataFrame:
    """Versions of images (path, version, height, width, channels, data) with arrays ``polygons`` (points in pixels) and ``boxes`` (corners in pixels); either may be null."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                image = pixels.drop_alpha(pixels.to_array(r.data, r.height, r.width, r.channels))
                steps = draw(generator(r.path, r.version, seed), hyp, r.width, r.height)
                out = augmented_pixels(image, steps)
                yield pd.DataFrame([(r.path, r.version, *out.shape, out.tobytes(), *_moved(r, matrix_of(steps)))], columns=["path", "version", "height", "width", "channels", "data", "polygons", "boxes"])

    columns = ("path", "version", "height", "width", "channels", "data", "polygons", "boxes")
    return images.select(*columns).mapInPandas(work, IMAGE_RESULT)


def uniform(*key: Column) -> Column:
    """A number from 0 to 1 by hash of the key, the same in any engine with MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(k.cast("string") for k in key))), 1, 8), 16, 10).cast("double") / 4294967296.0


def augmented_boxes(boxes: DataFrame, hyp: Hyperparameters, key: str, width: str, height: str) -> DataFrame:
    """Boxes (x1, y1, x2, y2) of (key, version) flipped, scaled about the centre and moved, as columns: for labels without pixels."""
    u = lambda name: uniform(F.col(key), F.col("version"), F.lit(name))
    w, h = F.col(width).cast("double"), F.col(height).cast("double")
    scale = 1.0 - hyp.scale + u("scale") * (2 * hyp.scale)
    dx, dy = (u("x") * 2.0 - 1.0) * hyp.translate * w, (u("y") * 2.0 - 1.0) * hyp.translate * h
    lr, ud = u("lr") < hyp.fliplr, u("ud") < hyp.flipud

    def moved(low: str, high: str, size: Column, flip: Column, d: Column) -> tuple[Column, Column]:
        a = F.when(flip, size - F.col(high)).otherwise(F.col(low))
        b = F.when(flip, size - F.col(low)).otherwise(F.col(high))
        return (a - size / 2) * scale + size / 2 + d, (b - size / 2) * scale + size / 2 + d

    x1, x2 = moved("x1", "x2", w, lr, dx)
    y1, y2 = moved("y1", "y2", h, ud, dy)
    return boxes.withColumns({"x1": x1, "y1": y1, "x2": x2, "y2": y2})


COLOUR_RESULT = "path string, tag string, height int, width int, channels int, data binary"


def _variants(images: DataFrame, make) -> DataFrame:
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                image = pixels.to_array(r.data, r.height, r.width, r.channels)
                made = make(r.path, image)
                yield pd.DataFrame([(r.path, tag, *x.shape, np.ascontiguousarray(x).tobytes()) for tag, x in made.items()], columns=["path", "tag", "height", "width", "channels", "data"])

    return images.select("path", "height", "width", "channels", "data").mapInPandas(work, COLOUR_RESULT)


def colour_variants(images: DataFrame, seed: int = 0) -> DataFrame:
    """Four variants of each image: brightness, saturation, contrast, inverted."""

    def make(path: str, image: np.ndarray) -> dict[str, np.ndarray]:
        rng = generator(path, 0, seed)
        image = pixels.drop_alpha(image)
        return {"_brt": pixels.brightness(image, int(rng.choice(pixels.SHIFTS))), "_sat": pixels.saturation(image, int(rng.choice(pixels.SHIFTS))), "_cot": pixels.contrast(image, int(rng.integers(pixels.CONTRASTS[0], pixels.CONTRASTS[1] + 1))), "_ivt": pixels.invert(image)}

    return _variants(images, make)


def flip_variants(images: DataFrame) -> DataFrame:
    """Three variants of each image; labels aren't flipped."""
    return _variants(images, lambda _, image: pixels.flips(image))


def resized(images: DataFrame, width: int = 640, height: int = 640) -> DataFrame:
    return _variants(images, lambda _, image: {"": pixels.resize(image, width, height)}).drop("tag")


def drawn(images: DataFrame, colours: list[tuple[int, int, int]]) -> DataFrame:
    """Images (with ``boxes``: class_id, x1, y1, x2, y2 in whole pixels) with their boxes drawn; those without a box are left out."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                image = pixels.to_array(r.data, r.height, r.width, r.channels)
                for b in r.boxes:
                    image = pixels.draw_box(image, b["x1"], b["y1"], b["x2"], b["y2"], colours[b["class_id"] % len(colours)])
                yield pd.DataFrame([(r.path, *image.shape, image.tobytes())], columns=["path", "height", "width", "channels", "data"])

    columns = ("path", "height", "width", "channels", "data")
    return images.where(F.size("boxes") > 0).select(*columns, "boxes").mapInPandas(work, "path string, height int, width int, channels int, data binary")


def crops(images: DataFrame) -> DataFrame:
    """A row for each box of each image: path, number, and the pixels inside; a box of no area gives no pixels."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                image = pixels.to_array(r.data, r.height, r.width, r.channels)
                cut = [pixels.crop(image, b["x1"], b["y1"], b["x2"], b["y2"]) for b in r.boxes]
                if cut:
                    yield pd.DataFrame([(r.path, k, *x.shape, np.ascontiguousarray(x).tobytes()) for k, x in enumerate(cut, 1)], columns=["path", "number", "height", "width", "channels", "data"])

    columns = ("path", "height", "width", "channels", "data")
    return images.select(*columns, "boxes").mapInPandas(work, "path string, number int, height int, width int, channels int, data binary")
