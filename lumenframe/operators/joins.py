"""Pairings of images, labels, classes and models.

Sides keyed by path are large and shuffle on their key, or not at all where
they are bucketed by it.  Class lists and thresholds are small, and Spark sends
them out where their measured size allows; no hint overrides that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions import names


def keyed(files: DataFrame) -> DataFrame:
    """Files with their path without its suffix as ``key``."""
    return files.withColumn("key", names.without_suffix("path"))


def images_without_labels(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Keys of images that no label has, once each."""
    return keyed(images).join(keyed(labels).select("key"), "key", "left_anti").select("key").distinct()


def matched_pairs(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Images and labels side by side (key, image, label), null where there is none."""
    left = keyed(images).select("key", F.col("path").alias("image"))
    right = keyed(labels).select("key", F.col("path").alias("label"))
    return left.join(right, "key", "full")


def strict_pairs(images: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs; a row without a partner raises, and so do two images or labels of one key.

    The check is a condition of the rows, so it stays whichever columns are read.
    """
    pairs = matched_pairs(images, labels)
    broken = F.col("image").isNull() | F.col("label").isNull() | (F.count("*").over(Window.partitionBy("key")) > 1)
    checked = pairs.withColumn("_broken", broken)
    said = F.raise_error(F.concat(F.lit("image and label don't match, no partner: "), F.coalesce("image", "label"))).cast("boolean")
    return checked.where(F.when(F.col("_broken"), said).otherwise(F.lit(True))).drop("_broken")


def optional_labels(images: DataFrame, labels: DataFrame, required: bool = False) -> DataFrame:
    """Images with their label or null; with ``required``, without those that have none."""
    right = keyed(labels).select("key", F.col("path").alias("label"))
    return keyed(images).join(right, "key", "inner" if required else "left")


def class_names(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows with the name of their class_id; an unknown id raises."""
    joined = rows.join(classes.select("class_id", "name"), "class_id", "left")
    return joined.withColumn("name", F.when(F.col("name").isNull(), F.raise_error(F.concat(F.lit("no class "), F.col("class_id").cast("string")))).otherwise(F.col("name")))


def class_ids(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows with the first class_id of their name; an unknown name raises."""
    first = classes.groupBy("name").agg(F.min("class_id").alias("class_id"))
    joined = rows.join(first, "name", "left")
    return joined.withColumn("class_id", F.when(F.col("class_id").isNull(), F.raise_error(F.concat(F.lit("no class "), F.col("name")))).otherwise(F.col("class_id")))


def label_images(labels: DataFrame, images: DataFrame) -> DataFrame:
    """Labels with the png of their name, else the jpg, else null."""
    by = lambda end: keyed(images.where(F.col("suffix") == end)).select("key", F.col("path").alias(end))
    return keyed(labels).join(by("png"), "key", "left").join(by("jpg"), "key", "left").withColumn("image", F.coalesce("png", "jpg")).drop("png", "jpg")


def files_with(files: DataFrame, lines: DataFrame, condition) -> DataFrame:
    """Files with a line that fulfils the condition."""
    return files.join(lines.where(condition).select("path"), "path", "left_semi")


def frames_by_models(frames: DataFrame, thresholds: list[float]) -> DataFrame:
    """Each frame once for each model, with the model's number from 1 and its threshold."""
    models = F.array(*(F.struct(F.lit(k).alias("model"), F.lit(float(t)).alias("threshold")) for k, t in enumerate(thresholds, 1)))
    return frames.select("*", F.inline(models))


def with_shapes(annotations: DataFrame, images: DataFrame) -> DataFrame:
    """Annotations with their image's width and height; pixels aren't read."""
    return annotations.join(images.select("path", "width", "height"), "path")
