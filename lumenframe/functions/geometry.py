"""Box and polygon geometry as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def _c(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def xywh_to_xyxy(xc, yc, w, h) -> Box:
    """Centre and size to corners."""
    xc, yc, w, h = map(_c, (xc, yc, w, h))
    return xc - w / 2, yc - h / 2, xc + w / 2, yc + h / 2


def xywhn_to_xyxy(xc, yc, w, h, width=640, height=640, pad_x=0, pad_y=0) -> Box:
    """Normalised centre and size to corners in pixels, moved by the padding."""
    x1, y1, x2, y2 = xywh_to_xyxy(xc, yc, w, h)
    width, height, pad_x, pad_y = map(_c, (width, height, pad_x, pad_y))
    return width * x1 + pad_x, height * y1 + pad_y, width * x2 + pad_x, height * y2 + pad_y


def xyxy_to_xywh(x1, y1, x2, y2) -> Box:
    """Corners to centre and size."""
    x1, y1, x2, y2 = map(_c, (x1, y1, x2, y2))
    return (x1 + x2) / 2, (y1 + y2) / 2, x2 - x1, y2 - y1


def normalise(box, width, height) -> Box:
    """Divide a box by the image's size."""
    a, b, c, d = map(_c, box)
    width, height = _c(width), _c(height)
    return a / width, b / height, c / width, d / height


def pixel_corners(xc, yc, w, h, width, height) -> Box:
    """Corners in whole pixels, half to even, of a normalised box; scaled before halving."""
    xc, yc, w, h, width, height = map(_c, (xc, yc, w, h, width, height))
    x, y, bw, bh = xc * width, yc * height, w * width, h * height
    return tuple(F.rint(v).cast("int") for v in (x - bw / 2, y - bh / 2, x + bw / 2, y + bh / 2))


def truncated_corners(xc, yc, w, h, width, height, single: bool = False) -> Box:
    """Corners in pixels, truncated toward zero; ``single`` keeps the fields in 32 bits first, as label files are read."""
    fields = [_c(v).cast("float") if single else _c(v) for v in (xc, yc, w, h)]
    x1, y1, x2, y2 = xywh_to_xyxy(*fields)
    width, height = (_c(v).cast("float") if single else _c(v) for v in (width, height))
    return (x1 * width).cast("int"), (y1 * height).cast("int"), (x2 * width).cast("int"), (y2 * height).cast("int")


def voc_to_yolo(xmin, ymin, xmax, ymax, width, height) -> Box:
    xmin, ymin, xmax, ymax, width, height = map(_c, (xmin, ymin, xmax, ymax, width, height))
    return (xmin + xmax) / (2 * width), (ymin + ymax) / (2 * height), (xmax - xmin) / width, (ymax - ymin) / height


@dataclass(frozen=True)
class Letterbox:
    """What a letterbox does to an image: its ratio, inner size, half padding and borders."""

    ratio: Column
    inner_w: Column
    inner_h: Column
    dw: Column
    dh: Column
    top: Column
    bottom: Column
    left: Column
    right: Column


def letterbox(width, height, new_w: int = 640, new_h: int = 640, auto: bool = True, scaleup: bool = True, stride: int = 32) -> Letterbox:
    width, height = _c(width), _c(height)
    ratio = F.least(F.lit(float(new_h)) / height, F.lit(float(new_w)) / width)
    if not scaleup:
        ratio = F.least(ratio, F.lit(1.0))
    inner_w, inner_h = F.rint(width * ratio).cast("int"), F.rint(height * ratio).cast("int")
    dw, dh = F.lit(new_w) - inner_w, F.lit(new_h) - inner_h
    if auto:
        dw, dh = F.pmod(dw, F.lit(stride)), F.pmod(dh, F.lit(stride))
    dw, dh = dw / 2, dh / 2
    border = lambda v: F.rint(v).cast("int")
    return Letterbox(ratio, inner_w, inner_h, dw, dh, border(dh - 0.1), border(dh + 0.1), border(dw - 0.1), border(dw + 0.1))


def unletterbox(box, ratio, dw, dh) -> Box:
    """A box in the letterboxed image in the original's whole pixels."""
    x1, y1, x2, y2 = map(_c, box)
    ratio, dw, dh = map(_c, (ratio, dw, dh))
    return tuple(F.rint((v - d) / ratio).cast("int") for v, d in ((x1, dw), (y1, dh), (x2, dw), (y2, dh)))


def centre_inside(xc, yc, width, height) -> Column:
    xc, yc, width, height = map(_c, (xc, yc, width, height))
    return (xc > 0) & (xc < width) & (yc > 0) & (yc < height)


def clip(box, width, height) -> Box:
    x1, y1, x2, y2 = map(_c, box)
    width, height = _c(width).cast("double"), _c(height).cast("double")
    zero = F.lit(0.0)
    return F.least(F.greatest(x1, zero), width), F.least(F.greatest(y1, zero), height), F.least(F.greatest(x2, zero), width), F.least(F.greatest(y2, zero), height)


def box_candidates(before, after, wh_thr: float = 2, ar_thr: float = 20, area_thr: float = 0.1, eps: float = 1e-16) -> Column:
    """Whether an augmented box is still large enough, similar in area, and not too thin."""
    a1, b1, c1, d1 = map(_c, before)
    a2, b2, c2, d2 = map(_c, after)
    w1, h1, w2, h2 = c1 - a1, d1 - b1, c2 - a2, d2 - b2
    eps = F.lit(float(eps))
    aspect = F.greatest(w2 / (h2 + eps), h2 / (w2 + eps))
    return (w2 > wh_thr) & (h2 > wh_thr) & (w2 * h2 / (w1 * h1 + eps) > float(area_thr)) & (aspect < ar_thr)


def point_outside(x, y, width, height) -> Column:
    x, y, width, height = map(_c, (x, y, width, height))
    return ~((x >= 0) & (x <= width - 1) & (y >= 0) & (y <= height - 1))


def segment_to_box(points: Column | str, width=640, height=640) -> Column:
    """Extrema of a polygon's points inside the image, zeros if none of these has an x other than 0."""
    points, width, height = map(_c, (points, width, height))
    inside = F.filter(points, lambda p: (p["x"] >= 0) & (p["y"] >= 0) & (p["x"] <= width) & (p["y"] <= height))
    xs, ys = F.transform(inside, lambda p: p["x"]), F.transform(inside, lambda p: p["y"])
    box = lambda *v: F.struct(*(x.alias(n) for x, n in zip(v, ("x1", "y1", "x2", "y2"), strict=True)))
    zero = F.lit(0.0)
    return F.when(F.exists(xs, lambda x: x != 0), box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))).otherwise(box(zero, zero, zero, zero))


def resample_polygon(points: Column | str, n: int = 1000) -> Column:
    """``n`` points by linear interpolation along the index of the closed polygon."""
    points = _c(points)
    closed = F.concat(points, F.slice(points, 1, 1))
    step = F.size(points) / F.lit(float(n - 1)) if n > 1 else F.lit(0.0)

    def at(k: Column) -> Column:
        # The last point is the first one, whatever the step's rounding.
        where = F.least(k * step, F.size(points).cast("double"))
        low = F.least(F.floor(where).cast("int"), F.size(points) - 1)
        part = where - low
        a, b = F.get(closed, low), F.get(closed, low + 1)
        return F.struct((a["x"] + (b["x"] - a["x"]) * part).alias("x"), (a["y"] + (b["y"] - a["y"]) * part).alias("y"))

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at)


def to_boundary(cx, cy, x, y, width, height) -> Column:
    """Where the ray from the centre through a point leaves the image: the nearest hit of an edge; edges in order left, right, top, bottom on ties."""
    cx, cy, x, y, width, height = map(_c, (cx, cy, x, y, width, height))
    dx, dy = x - cx, y - cy
    right, bottom = width - 1.0, height - 1.0

    def hit(order: int, ok: Column, t: Column, px: Column, py: Column, along: Column, most: Column) -> Column:
        far = (px - cx) * (px - cx) + (py - cy) * (py - cy)
        return F.when(ok & (t >= 0) & (along >= 0) & (along <= most), F.struct(far.alias("far"), F.lit(order).alias("order"), px.alias("x"), py.alias("y")))

    safe = lambda d: F.when(d != 0, d)
    left_t, right_t = -cx / safe(dx), (right - cx) / safe(dx)
    top_t, bottom_t = -cy / safe(dy), (bottom - cy) / safe(dy)
    zero = F.lit(0.0)
    hits = F.array(
        hit(0, dx != 0, left_t, zero, cy + left_t * dy, cy + left_t * dy, bottom),
        hit(1, dx != 0, right_t, right, cy + right_t * dy, cy + right_t * dy, bottom),
        hit(2, dy != 0, top_t, cx + top_t * dx, zero, cx + top_t * dx, right),
        hit(3, dy != 0, bottom_t, cx + bottom_t * dx, bottom, cx + bottom_t * dx, right),
    )
    best = F.array_min(F.filter(hits, lambda h: h.isNotNull()))
    return F.struct(F.coalesce(best["x"], cx).alias("x"), F.coalesce(best["y"], cy).alias("y"))


def correct_polygon(points: Column | str, width, height) -> Column:
    """Normalised points of a polygon with those outside the image moved to its border."""
    points, width, height = _c(points), _c(width).cast("double"), _c(height).cast("double")

    def one(p: Column) -> Column:
        x, y = p["x"] * width, p["y"] * height
        moved = to_boundary(width / 2.0, height / 2.0, x, y, width, height)
        out = point_outside(x, y, width, height)
        return F.struct((F.when(out, moved["x"]).otherwise(x) / width).alias("x"), (F.when(out, moved["y"]).otherwise(y) / height).alias("y"))

    return F.transform(points, one)


def scale_polygon(points: Column | str, sx, sy) -> Column:
    points, sx, sy = map(_c, (points, sx, sy))
    return F.transform(points, lambda p: F.struct((p["x"] * sx).alias("x"), (p["y"] * sy).alias("y")))


def line_thickness(width, height) -> Column:
    """Half to even, as all rounding here."""
    return (F.rint(F.lit(0.002) * (_c(height) + _c(width)) / 2) + 1).cast("int")


def playback_delay(fps) -> Column:
    """Milliseconds between frames; 33 without a frame rate."""
    fps = _c(fps)
    return F.when(fps > 0, (F.lit(1000.0) / F.when(fps > 0, fps)).cast("int")).otherwise(F.lit(33))


def frame_rate(seconds) -> Column:
    """Whole frames a second at so many seconds a frame; null without time."""
    seconds = _c(seconds)
    return (F.lit(1.0) / F.when(seconds > 0, seconds)).cast("int")
