"""Decoded images and frames."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

FRAMES = "path string, frame int, height int, width int, channels int, data binary"


def read_images(spark: SparkSession, path: str, keep_broken: bool = False) -> DataFrame:
    """(path, height, width, channels, data in blue-green-red order); images that can't be read are dropped."""
    read = spark.read.format("image").option("dropInvalid", not keep_broken).option("recursiveFileLookup", True).load(path)
    return read.select(F.col("image.origin").alias("path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))


def decoded(images: DataFrame) -> DataFrame:
    """Images whose shape is known."""
    return images.where((F.col("height") > 0) & (F.col("width") > 0))


class _Part(InputPartition):
    def __init__(self, path: str):
        self.path = path


class FrameSource(DataSource):
    """Frames of videos stored as arrays (frames, height, width, channels) in ``.npy`` files, one partition each.

    Options: ``path``, with one file's or several by commas.  Containers with
    codecs, and live addresses, need a library that reads them; ``decoder`` names
    a ``module:function`` from a path or an address to frames: a sequence, of
    which only what is asked for is read, or an iterable, which is walked.
    """

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema) -> DataSourceReader:
        return _FrameReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _FrameStream(self.options)


def _frames(path: str, decoder: str | None):
    """The frames of a video: a sequence where the file or the decoder gives one, else something to walk."""
    import importlib

    import numpy as np

    if decoder:
        module, _, function = decoder.partition(":")
        return getattr(importlib.import_module(module), function)(path)
    return np.load(path, mmap_mode="r")


def _length(frames) -> int:
    """Frames in all; only what has no length of its own is walked."""
    return len(frames) if hasattr(frames, "__len__") else sum(1 for _ in frames)


def _rows(path: str, decoder: str | None, start: int = 0, stop: int | None = None) -> Iterator[tuple]:
    frames = _frames(path, decoder)
    if hasattr(frames, "__len__") and hasattr(frames, "__getitem__"):
        chosen = ((k, frames[k]) for k in range(start, len(frames) if stop is None else min(stop, len(frames))))
    else:
        chosen = islice(enumerate(frames), start, stop)
    for k, image in chosen:
        yield path, k + 1, *(int(x) for x in image.shape), image.tobytes()


class _FrameReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.decoder = options["path"].split(","), options.get("decoder")

    def partitions(self) -> list[InputPartition]:
        return [_Part(p) for p in self.paths]

    def read(self, partition: _Part) -> Iterator[tuple]:
        return _rows(partition.path, self.decoder)


class _Range(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class _FrameStream(DataSourceStreamReader):
    """A live source replayed: each micro-batch offers ``perBatch`` more frames of each path; offsets count frames."""

    def __init__(self, options: dict):
        self.paths, self.decoder = options["path"].split(","), options.get("decoder")
        self.step = int(options.get("perbatch", options.get("perBatch", 8)))
        self.at = 0
        self.most: int | None = None

    def initialOffset(self) -> dict:
        return {"frame": 0}

    def latestOffset(self) -> dict:
        if self.most is None:
            self.most = max(_length(_frames(p, self.decoder)) for p in self.paths)
        self.at = min(self.at + self.step, self.most)
        return {"frame": self.at}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Range(p, start["frame"], end["frame"]) for p in self.paths]

    def read(self, partition: _Range) -> Iterator[tuple]:
        return _rows(partition.path, self.decoder, partition.start, partition.stop)


def read_frames(spark: SparkSession, paths: list[str], decoder: str | None = None) -> DataFrame:
    spark.dataSource.register(FrameSource)
    reader = spark.read.format("frames").option("path", ",".join(paths))
    return (reader.option("decoder", decoder) if decoder else reader).load()
