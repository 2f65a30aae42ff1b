"""Random splits, replication and unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions import names

#: Tags of the variants that are made of an image.
COLOUR_TAGS = ("_brt", "_sat", "_cot", "_ivt")
FLIP_TAGS = ("_flipped_ud", "_flipped_lr", "_flipped_ud_lf")


def ranked(df: DataFrame, key: str, buckets: int = 4096) -> DataFrame:
    """Rows with ``place`` from 1 in the order of the key's MD5, over all rows.

    Places come from counts of ranges of the hash and places inside a range,
    so no task holds more than a range.
    """
    hashed = df.withColumn("_h", F.md5(F.col(key).cast("string"))).withColumn("_r", F.floor(F.conv(F.substring("_h", 1, 6), 16, 10).cast("long") * buckets / 2**24))
    counts = hashed.groupBy("_r").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_r", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_r").orderBy("_h", key))
    return hashed.withColumn("_i", inside).join(offsets, "_r").withColumn("place", F.col("_i") + F.col("_before")).drop("_h", "_r", "_i", "_before")


def random_split(df: DataFrame, key: str, tenths: tuple[int, int, int]) -> DataFrame:
    """Rows with ``split`` train, val, test, or null for those that no part takes; the same on each run."""
    if sum(tenths) > 10 or min(tenths) < 0:
        raise ValueError("parts are tenths, ten in all at most")
    total = df.agg(F.count("*").alias("_total"))
    cuts = [F.floor(F.col("_total") * F.lit(t / 10)) for t in tenths]
    place = F.col("place")
    split = F.when(place <= cuts[0], "train").when(place <= cuts[0] + cuts[1], "val").when(place <= cuts[0] + cuts[1] + cuts[2], "test")
    return ranked(df, key).crossJoin(total).withColumn("split", split).drop("_total", "place")


def replicate(df: DataFrame, n: int) -> DataFrame:
    """Each row with ``version`` 1 to ``n``."""
    return df.withColumn("version", F.explode(F.sequence(F.lit(1), F.lit(n)))) if n > 0 else df.withColumn("version", F.lit(1)).limit(0)


def variants(df: DataFrame, tags: tuple[str, ...], path: str = "path") -> DataFrame:
    """Each row once for each tag, with the variant's path as ``out``."""
    each = df.withColumn("tag", F.explode(F.array(*map(F.lit, tags))))
    end = names.suffix(path)
    return each.withColumn("out", F.concat(names.without_suffix(path), F.col("tag"), F.when(end == "", "").otherwise(F.concat(F.lit("."), end))))


def nearest_first(df: DataFrame, group: str, far: str, order: str) -> DataFrame:
    """The nearest row of each group; of equals, the first in order."""
    return df.groupBy(group).agg(F.min_by(F.struct(*[c for c in df.columns if c != group]), F.struct(far, order)).alias("best")).select(group, "best.*")


def collected(parts: list[DataFrame]) -> DataFrame:
    """The models' predictions together, with the number of the model."""
    return reduce(DataFrame.unionByName, [p.withColumn("model", F.lit(k)) for k, p in enumerate(parts, 1)])


def unique_classes(detections: DataFrame) -> DataFrame:
    return detections.select("class_id").distinct().orderBy("class_id")
