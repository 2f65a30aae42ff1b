"""File inventories.

Spark's file sources drop empty files and names that start with "_" or ".",
and empty label files mean something here.  So inventories come from a listing
by the file system itself: the driver lists the first level alone, and each
folder in it is listed by an executor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe import schema
from lumenframe.functions import names

#: Suffixes of media, in lower case.
MEDIA_IMAGES = ("bmp", "jpg", "jpeg", "png", "tif", "tiff", "dng", "webp", "mpo")
MEDIA_VIDEOS = ("mov", "avi", "mp4", "mpg", "mpeg", "m4v", "wmv", "mkv")
CAPTURE_VIDEOS = MEDIA_VIDEOS


LISTING = "path string, length long"


def _first_level(spark: SparkSession, root: str) -> tuple[list[tuple[str, int]], list[str]]:
    """Files (name, length) and folders right below ``root``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    here = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    found = [(s.getPath().getName(), s.getLen(), s.isDirectory()) for s in here]
    return [(name, n) for name, n, folder in found if not folder], [name for name, _, folder in found if folder]


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """All files below ``root``: path relative to it, dir, stem, suffix, length.  A missing root raises.

    What is found is held, so files written later don't show in it.
    """
    near, folders = _first_level(spark, root)

    def below(batches):
        import pandas as pd
        from pyarrow.fs import FileSelector, FileSystem, FileType

        fs, base = FileSystem.from_uri(root if "://" in root else f"file://{root}")
        base = base.rstrip("/")
        for batch in batches:
            for folder in batch["folder"]:
                found = fs.get_file_info(FileSelector(f"{base}/{folder}", recursive=True))
                rows = [(x.path[len(base) + 1 :], x.size) for x in found if x.type == FileType.File and not (x.base_name.startswith(".") and x.base_name.endswith(".crc"))]
                yield pd.DataFrame(rows, columns=["path", "length"]).astype({"path": "object", "length": "int64"})

    listed = spark.createDataFrame(near, LISTING)
    if folders:
        parts = spark.createDataFrame([(f,) for f in folders], "folder string").repartition(min(len(folders), 4 * spark.sparkContext.defaultParallelism))
        listed = listed.unionByName(parts.mapInPandas(below, LISTING))
    listed = listed.persist()
    listed.count()
    return with_parts(listed)


def with_parts(paths: DataFrame) -> DataFrame:
    return paths.select("path", names.parent("path").alias("dir"), names.stem("path").alias("stem"), names.suffix("path").alias("suffix"), F.col("length"))


def _sorted(df: DataFrame) -> DataFrame:
    return df.orderBy(names.path_order("path"))


def scan_images(files: DataFrame) -> DataFrame:
    """Images below, by seven case-specific suffixes, sorted by path part."""
    return _sorted(files.where(F.col("suffix").isin(*names.IMAGE_SUFFIXES)))


def scan_images_by_letters(files: DataFrame, flat: bool = False) -> DataFrame:
    """Images by a letter pattern: no jpeg or bmp, but also ``.jng``; ``flat`` for the root folder alone."""
    found = files.where(F.col("path").rlike(r"\.[jJpP][pPnN][gG]$"))
    return _sorted(found.where("dir = ''") if flat else found)


def scan_flat(files: DataFrame, suffixes: tuple[str, ...], lower: bool) -> DataFrame:
    """Files of the root folder by suffix, compared in lower case if ``lower``."""
    end = F.lower("suffix") if lower else F.col("suffix")
    return files.where((F.col("dir") == "") & end.isin(*suffixes))


def scan_flip_images(files: DataFrame) -> DataFrame:
    return scan_flat(files, names.FLIP_SUFFIXES, True)


def scan_resize_images(files: DataFrame) -> DataFrame:
    return scan_flat(files, names.RESIZE_SUFFIXES, False)


def scan_segment_images(files: DataFrame) -> DataFrame:
    return scan_flat(files, names.SEGMENT_SUFFIXES, True)


def media_kind(suffix: Column | str) -> Column:
    end = F.lower(F.col(suffix) if isinstance(suffix, str) else suffix)
    return F.when(end.isin(*MEDIA_IMAGES), "image").when(end.isin(*MEDIA_VIDEOS), "video")


def scan_media(files: DataFrame) -> DataFrame:
    """Images first, then videos, each by path; raises if there is neither."""
    kinds = files.withColumn("kind", media_kind("suffix"))
    images, videos = (kinds.where(F.col("kind") == k).withColumn("ordinal", F.lit(o)) for o, k in enumerate(("image", "video")))
    both = images.unionByName(videos)
    if not both.take(1):
        raise FileNotFoundError("no images or videos")
    return both.orderBy("ordinal", names.path_order("path")).drop("ordinal")


def scan_videos(files: DataFrame) -> DataFrame:
    return _sorted(files.where(F.lower("suffix").isin(*CAPTURE_VIDEOS)))


def scan_labels(files: DataFrame, suffix: str = "txt", skip_classes: bool = False) -> DataFrame:
    found = files.where(F.col("suffix") == suffix)
    return found.where(names.file_name("path") != "classes.txt") if skip_classes else found


def source_kind(source: str) -> str:
    """``stream`` for a number or an address of a live source, ``files`` otherwise."""
    live = source.isnumeric() or source.lower().startswith(("rtsp://", "rtmp://", "http://", "https://"))
    return "stream" if live else "files"
