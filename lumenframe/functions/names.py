"""Path and string scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that a clean name has "_" for.
SPECIAL = "|@#!¡·$€%&()=?¿^*;:,¨´><+"
#: Suffixes of the scans.
IMAGE_SUFFIXES = ("jpeg", "jpg", "JPG", "png", "PNG", "bmp", "BMP")
FLIP_SUFFIXES = ("png", "jpg", "jpeg", "bmp", "gif")
RESIZE_SUFFIXES = ("png", "jpg", "jpeg", "bmp", "PNG", "JPG", "JPEG")
SEGMENT_SUFFIXES = ("jpg", "jpeg", "png")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean(name: Column | str) -> Column:
    return F.translate(_c(name), SPECIAL, "_" * len(SPECIAL))


def file_name(path: Column | str) -> Column:
    return F.substring_index(_c(path), "/", -1)


def parent(path: Column | str) -> Column:
    """All before the last slash, "" without one."""
    return F.regexp_extract(_c(path), r"^(.*)/[^/]*$", 1)


def suffix(path: Column | str) -> Column:
    """The last suffix without its dot; a leading dot is no suffix."""
    return F.regexp_extract(file_name(path), r"^.+\.([^.]+)$", 1)


def stem(path: Column | str) -> Column:
    name = file_name(path)
    return F.when(suffix(path) == "", name).otherwise(F.regexp_extract(name, r"^(.+)\.[^.]+$", 1))


def without_suffix(path: Column | str) -> Column:
    up = parent(path)
    return F.when(up == "", stem(path)).otherwise(F.concat_ws("/", up, stem(path)))


def with_suffix(path: Column | str, new: str) -> Column:
    """The path with its last suffix replaced by ``new`` (with its dot)."""
    return F.concat(without_suffix(path), F.lit(new))


def tagged(path: Column | str, tag: str) -> Column:
    """The path with ``tag`` before its suffix."""
    end = suffix(path)
    return F.concat(without_suffix(path), F.lit(tag), F.when(end == "", "").otherwise(F.concat(F.lit("."), end)))


def augmented_name(path: Column | str, version: Column, new_suffix: str) -> Column:
    return F.concat(stem(path), F.lit("_aug_"), version.cast("string"), F.lit(new_suffix))


def frame_name(path: Column | str, frame: Column) -> Column:
    return F.concat(stem(path), F.format_string("_frame%05d.jpg", frame))


def detection_text_name(path: Column | str, frame: Column, video: Column) -> Column:
    return F.concat(stem(path), F.when(video, F.concat(F.lit("_"), frame.cast("string"))).otherwise(""), F.lit(".txt"))


def crop_name(path: Column | str, model: Column, number: Column) -> Column:
    """The model is in the name, so a second model's crops don't replace the first's."""
    return F.concat(stem(path), F.lit("_m"), model.cast("string"), F.lit("_box_"), number.cast("string"), F.lit(".jpg"))


def _parts(path: Column | str) -> Column:
    return F.split(parent(path), "/")


def split_path(path: Column | str, dest: Column | str) -> Column:
    """Where a split puts an image: its folders below the first one, under ``dest``."""
    below = F.array_join(F.slice(_parts(path), F.lit(2), F.greatest(F.size(_parts(path)) - 1, F.lit(0))), "/")
    return F.concat_ws("/", _c(dest), F.when(below != "", below), file_name(path))


def split_label_path(path: Column | str, dest: Column | str, compat: bool = False) -> Column:
    """Where a split puts the label of an image: under ``labels`` in place of ``images``.

    ``compat`` puts ``labels`` before the last folder instead, which loses the
    split's name if there is a folder below it.
    """
    name = F.concat(stem(path), F.lit(".txt"))
    if not compat:
        return F.concat_ws("/", parent(split_path(path, F.regexp_replace(_c(dest), r"images/([^/]*)$", "labels/$1"))), name)
    folders = F.split(parent(split_path(path, dest)), "/")
    n = F.size(folders)
    return F.concat_ws("/", F.array_join(F.slice(folders, F.lit(1), F.greatest(n - 2, F.lit(0))), "/"), F.lit("labels"), F.element_at(folders, -1), name)


def tweak_path(path: Column | str, out: str) -> Column:
    """A label's place below ``out``: the first folder goes."""
    return split_path(path, F.lit(out))


def counted_name(n: Column, name: Column | str) -> Column:
    """A part of a summary, such as "2 cars, "."""
    return F.concat(n.cast("string"), F.lit(" "), _c(name), F.when(n > 1, "s").otherwise(""), F.lit(", "))


def path_order(path: Column | str) -> Column:
    """Sorts as paths do, by part."""
    return F.split(_c(path), "/")
