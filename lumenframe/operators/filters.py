"""Filters and class remaps over label lines, annotations and detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import geometry

#: Vehicle classes by their old and new ids; others are dropped.
VEHICLES = {"0": "0", "1": "0", "2": "0", "3": "1", "4": "1", "5": "2"}
#: The change of leading digits, made at once; others stay.
DIGITS = {"3": "0", "4": "1", "5": "2", "2": "3"}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _literal_map(mapping: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair))


def remap_classes(lines: DataFrame, line: str = "line", mapping: dict[str, str] | None = None) -> DataFrame:
    """Replace the class before the first blank; lines of other classes go, the rest of a line stays byte for byte."""
    text = F.col(line)
    token = F.substring_index(text, " ", 1)
    new = F.try_element_at(_literal_map(mapping or VEHICLES), token)
    return lines.withColumn(line, F.concat(new, F.substring(text, F.length(token) + 1, F.length(text)))).where(F.col(line).isNotNull())


def remap_leading(line: Column | str, mapping: dict[str, str] | None = None, strict: bool = False) -> Column:
    """Replace a line's first character (its whole first token if ``strict``)."""
    text = _c(line)
    head = F.regexp_extract(text, r"^\S*", 0) if strict else F.substring(text, 1, 1)
    new = F.coalesce(F.try_element_at(_literal_map(mapping or DIGITS), head), head)
    return F.concat(new, F.substring(text, F.length(head) + 1, F.length(text)))


def confident(detections: DataFrame, threshold: float | dict[int, float] = 0.5) -> DataFrame:
    """Detections above their model's threshold, not at it."""
    if isinstance(threshold, dict):
        limit = F.element_at(F.create_map(*(F.lit(x) for p in threshold.items() for x in p)), F.col("model"))
        return detections.where(F.col("conf") > limit)
    return detections.where(F.col("conf") > threshold)


def centred(boxes: DataFrame, corners: tuple[str, ...] = ("x1", "y1", "x2", "y2"), size: tuple[str, str] = ("width", "height")) -> DataFrame:
    """Boxes whose centre is inside the image, clipped to it."""
    x1, y1, x2, y2 = map(F.col, corners)
    kept = boxes.where(geometry.centre_inside((x1 + x2) / 2, (y1 + y2) / 2, *size))
    return kept.withColumns(dict(zip(corners, geometry.clip(corners, *size), strict=True)))


def starts_with_class(line: Column | str, classes: str = "01", exact: bool = False) -> Column:
    """Whether a line starts with one of the digits, so that 10 to 19 count as 1; with ``exact``, whether its class is one of them."""
    return F.regexp_replace(_c(line), r"^\s+", "").rlike(rf"^[{classes}]" + (r"(\s|$)" if exact else ""))


def first_images(images: DataFrame, n: int, path: str = "path") -> DataFrame:
    """The first ``n`` images by path; all if ``n`` is none or less."""
    ordered = images.orderBy(F.split(path, "/"))
    return ordered.limit(n) if n > 0 else ordered


def readable(pairs: DataFrame) -> DataFrame:
    """Pairs with an image that could be decoded and a label."""
    return pairs.where(F.col("height").isNotNull() & F.col("width").isNotNull() & F.col("label").isNotNull())
