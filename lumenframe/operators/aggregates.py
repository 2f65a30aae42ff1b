"""Counts and histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import names
from lumenframe.operators.joins import matched_pairs


def count_objects(lines: DataFrame) -> DataFrame:
    """All lines of label files, blank ones and those of class lists too."""
    return lines.agg(F.count("*").alias("n_objects"))


def class_histogram(images: DataFrame, annotations: DataFrame, classes: DataFrame, key: str = "path") -> DataFrame:
    """Objects of each class in each image, zeros included; classes of one name count together.

    Counts are folded into one row for each image before the join; the class
    list, a file's lines, is laid out from a literal after it.
    """
    named: dict[str, list[int]] = {}
    for r in classes.select("class_id", "name").orderBy("class_id").collect():
        named.setdefault(r["name"], []).append(r["class_id"])
    listed = F.array(*(F.struct(F.lit(n).alias("name"), F.array(*map(F.lit, ids)).alias("ids")) for n, ids in named.items()))
    counted = annotations.groupBy(key, F.col("class_id").cast("int").alias("class_id")).agg(F.count("*").alias("n")).where("class_id IS NOT NULL")
    folded = counted.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("class_id", "n"))).alias("counts"))
    none = F.lit(0).cast("long")
    total = lambda ids: F.aggregate(ids, none, lambda a, i: a + F.coalesce(F.try_element_at("counts", i), none))
    laid_out = F.transform(listed, lambda c: F.struct(c["name"].alias("name"), total(c["ids"]).alias("n_objects")))
    return images.select(key).distinct().join(folded, key, "left").select(key, F.inline(laid_out))


def detections_by_class(detections: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Detections above the threshold by path, frame, model and class; none gives no row."""
    return detections.where(F.col("conf") > threshold).groupBy("path", "frame", "model", "class_id").agg(F.count("*").alias("n"))


def boxes_per_image(images: DataFrame, annotations: DataFrame, key: str = "path") -> DataFrame:
    counted = annotations.groupBy(key).agg(F.count("*").alias("n"))
    return images.select(key).join(counted, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n_boxes"))


def media_counts(files: DataFrame) -> DataFrame:
    return files.agg(F.count_if(F.col("kind") == "image").alias("images"), F.count_if(F.col("kind") == "video").alias("videos"))


def total_frames(files: DataFrame) -> DataFrame:
    """Frames of all files if there is a video, images with one each; else the number of files."""
    some = F.count_if(F.col("kind") == "video") > 0
    return files.agg(F.when(some, F.coalesce(F.sum("frames"), F.lit(0))).otherwise(F.count("*")).cast("long").alias("frames"))


def mismatches(images: DataFrame, labels: DataFrame) -> DataFrame:
    """How many images and labels have no partner."""
    pairs = matched_pairs(images, labels)
    return pairs.agg(F.count_if(F.col("label").isNull()).alias("images_alone"), F.count_if(F.col("image").isNull()).alias("labels_alone"))


def summaries(counts: DataFrame, classes: DataFrame) -> DataFrame:
    """One text for each path, frame and model, such as "2 cars, 1 bus, ", by class."""
    said = counts.join(classes.select("class_id", "name"), "class_id").withColumn("part", names.counted_name(F.col("n"), "name"))
    listed = F.array_sort(F.collect_list(F.struct("class_id", "part")))
    return said.groupBy("path", "frame", "model").agg(F.array_join(F.transform(listed, lambda x: x["part"]), "").alias("summary"))


def split_sizes(n: int, tenths: tuple[int, ...]) -> list[int]:
    """Sizes of parts of so many tenths each, cut to whole numbers in double arithmetic."""
    return [int(n * float(t / 10)) for t in tenths]
