"""Pixel kernels on NumPy arrays (height, width, channels), blue-green-red, 8 bits."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The shifts of brightness and saturation, and the range of contrast.
SHIFTS = (-50, -40, -30, 30, 40, 50)
CONTRASTS = (40, 100)
BORDER = 114


def to_array(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(height, width, channels)


def drop_alpha(image: np.ndarray) -> np.ndarray:
    return image[..., :3] if image.shape[-1] == 4 else image


def swap_channels(image: np.ndarray) -> np.ndarray:
    """Blue-green-red to red-green-blue, or back."""
    return image[..., ::-1]


def to_hsv(image: np.ndarray) -> np.ndarray:
    """Hue in half degrees (0 to 179), saturation and value, 8 bits each."""
    b, g, r = (image[..., k].astype(np.float64) for k in range(3))
    v = np.maximum(np.maximum(b, g), r)
    spread = v - np.minimum(np.minimum(b, g), r)
    s = np.divide(255 * spread, v, out=np.zeros_like(v), where=v > 0)
    safe = np.where(spread > 0, spread, 1)
    hue = np.select([spread == 0, v == r, v == g], [0.0, 60 * (g - b) / safe, 120 + 60 * (b - r) / safe], 240 + 60 * (r - g) / safe)
    h = np.rint((hue % 360) / 2) % 180
    return np.stack([h, np.rint(s), v], -1).astype(np.uint8)


def from_hsv(hsv: np.ndarray) -> np.ndarray:
    h, s, v = hsv[..., 0] * 2.0, hsv[..., 1] / 255.0, hsv[..., 2].astype(np.float64)

    def channel(n: int) -> np.ndarray:
        k = (n + h / 60) % 6
        return v - v * s * np.clip(np.minimum(k, 4 - k), 0, 1)

    return np.rint(np.stack([channel(1), channel(3), channel(5)], -1)).astype(np.uint8)


def shift(image: np.ndarray, by: int, channel: int) -> np.ndarray:
    """Add to saturation (channel 1) or value (2), held between 0 and 255."""
    hsv = to_hsv(image).astype(np.int16)
    hsv[..., channel] = np.clip(hsv[..., channel] + by, 0, 255)
    return from_hsv(hsv.astype(np.uint8))


def brightness(image: np.ndarray, by: int) -> np.ndarray:
    return shift(image, by, 2)


def saturation(image: np.ndarray, by: int) -> np.ndarray:
    return shift(image, by, 1)


def contrast(image: np.ndarray, by: int, add: int = 10) -> np.ndarray:
    return np.clip(image.astype(np.int16) * (by / 127 + 1) - by + add, 0, 255).astype(np.uint8)


def invert(image: np.ndarray) -> np.ndarray:
    return 255 - image


def flips(image: np.ndarray) -> dict[str, np.ndarray]:
    """Upside down, left to right, and both."""
    return {"_flipped_ud": image[::-1], "_flipped_lr": image[:, ::-1], "_flipped_ud_lf": image[::-1, ::-1]}


def crop(image: np.ndarray, x1: int, y1: int, x2: int, y2: int) -> np.ndarray:
    return image[y1:y2, x1:x2]


def resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Stretch by bilinear interpolation between pixel centres."""
    h, w = image.shape[:2]
    ys = np.clip((np.arange(height) + 0.5) * h / height - 0.5, 0, h - 1)
    xs = np.clip((np.arange(width) + 0.5) * w / width - 0.5, 0, w - 1)
    y0, x0 = np.floor(ys).astype(int), np.floor(xs).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (ys - y0)[:, None, None], (xs - x0)[None, :, None]
    a = image.astype(np.float64)
    top = a[y0][:, x0] * (1 - fx) + a[y0][:, x1] * fx
    low = a[y1][:, x0] * (1 - fx) + a[y1][:, x1] * fx
    return np.rint(top * (1 - fy) + low * fy).astype(np.uint8)


def letterbox(image: np.ndarray, new: tuple[int, int] = (640, 640), auto: bool = True, scaleup: bool = True, stride: int = 32) -> tuple[np.ndarray, float, tuple[float, float]]:
    """The image fitted into ``new`` (height, width) with grey borders; its ratio and half paddings (width, height)."""
    h, w = image.shape[:2]
    ratio = min(new[0] / h, new[1] / w)
    ratio = ratio if scaleup else min(ratio, 1.0)
    inner_w, inner_h = round(w * ratio), round(h * ratio)
    dw, dh = new[1] - inner_w, new[0] - inner_h
    if auto:
        dw, dh = dw % stride, dh % stride
    dw, dh = dw / 2, dh / 2
    inner = image if (inner_w, inner_h) == (w, h) else resize(image, inner_w, inner_h)
    sides = ((round(dh - 0.1), round(dh + 0.1)), (round(dw - 0.1), round(dw + 0.1)), (0, 0))
    return np.pad(inner, sides, constant_values=BORDER), ratio, (dw, dh)


def to_tensor(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One image as a batch of channels: 8 bits, and 32-bit floats from 0 to 1."""
    whole = np.ascontiguousarray(image.transpose(2, 0, 1)[None])
    return whole, (whole / 255.0).astype(np.float32)


def warp(image: np.ndarray, matrix: np.ndarray, border: int = BORDER) -> np.ndarray:
    """The image moved by an affine ``matrix`` (2 x 3, from old to new places), bilinear."""
    h, w = image.shape[:2]
    back = np.linalg.inv(np.vstack([matrix, [0, 0, 1]]))
    ys, xs = np.mgrid[0:h, 0:w]
    x = back[0, 0] * xs + back[0, 1] * ys + back[0, 2]
    y = back[1, 0] * xs + back[1, 1] * ys + back[1, 2]
    padded = np.pad(image, ((1, 1), (1, 1), (0, 0)), constant_values=border).astype(np.float64)
    x, y = np.clip(x + 1, 0, w + 1), np.clip(y + 1, 0, h + 1)
    x0, y0 = np.minimum(np.floor(x).astype(int), w), np.minimum(np.floor(y).astype(int), h)
    fx, fy = (x - x0)[..., None], (y - y0)[..., None]
    top = padded[y0, x0] * (1 - fx) + padded[y0, x0 + 1] * fx
    low = padded[y0 + 1, x0] * (1 - fx) + padded[y0 + 1, x0 + 1] * fx
    return np.rint(top * (1 - fy) + low * fy).astype(np.uint8)


def draw_box(image: np.ndarray, x1: int, y1: int, x2: int, y2: int, colour: tuple[int, int, int], thickness: int | None = None) -> np.ndarray:
    """A copy with a rectangle's outline; captions need a font, so they go to the annotation table."""
    h, w = image.shape[:2]
    t = thickness or round(0.002 * (h + w) / 2) + 1
    out = image.copy()
    low, high = t // 2, t - t // 2
    for ya, yb, xa, xb in ((y1 - low, y1 + high, x1 - low, x2 + high), (y2 - low, y2 + high, x1 - low, x2 + high), (y1 - low, y2 + high, x1 - low, x1 + high), (y1 - low, y2 + high, x2 - low, x2 + high)):
        out[max(ya, 0) : max(yb, 0), max(xa, 0) : max(xb, 0)] = colour
    return out


def class_colours(n: int, seed: int | None = 42) -> list[tuple[int, int, int]]:
    rng = np.random.default_rng(seed)
    return [tuple(int(x) for x in rng.integers(0, 256, 3)) for _ in range(n)]


def png(image: np.ndarray) -> bytes:
    """A PNG file of a blue-green-red or grey image."""
    h, w, c = image.shape
    ordered = image if c == 1 else image[..., [2, 1, 0, *range(3, c)]]
    rows = np.zeros((h, 1 + w * c), np.uint8)
    rows[:, 1:] = ordered.reshape(h, -1)
    part = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(rows.tobytes(), 6)) + part(b"IEND", b"")


# The same on arrays of values, as columns.


def invert_values(values: Column) -> Column:
    return F.transform(values, lambda v: F.lit(255) - v)


def contrast_values(values: Column, by: Column, add: int = 10) -> Column:
    return F.transform(values, lambda v: F.least(F.greatest(v * (by / 127 + 1) - by + add, F.lit(0.0)), F.lit(255.0)).cast("int"))


def shift_values(values: Column, by: Column) -> Column:
    return F.transform(values, lambda v: F.least(F.greatest(v + by, F.lit(0)), F.lit(255)))


def flip_rows(values: Column, row: int, n: int) -> Column:
    """Rows of ``row`` values, ``n`` of them, each reversed: left to right."""
    return F.flatten(F.array(*(F.reverse(F.slice(values, 1 + k * row, row)) for k in range(n))))
