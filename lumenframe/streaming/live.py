"""Live frames: the latest frame of each source in each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest(frames: DataFrame, source: str, *order: str) -> DataFrame:
    """Of each source the row that is last in order; a reader slower than its source sees no others."""
    rest = [c for c in frames.columns if c != source]
    return frames.groupBy(source).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("last")).select(source, "last.*")


def conflated(frames: DataFrame, source: str, order: tuple[str, ...], write: Callable[[DataFrame, int], None], checkpoint: str, now: bool = True) -> StreamingQuery:
    """Start a query that gives ``write`` the latest frames of each micro-batch; ``now`` ends it with what is available."""

    def each(batch: DataFrame, number: int) -> None:
        write(latest(batch, source, *order), number)

    writer = frames.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if now else writer).start()


def write_by_path(root: str) -> Callable[[DataFrame, int], None]:
    """A writer with an output of its own for each path; a batch that runs again replaces its own files."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("path", "batch").parquet(root)

    return write


def selected(frames: DataFrame, selection: DataFrame) -> DataFrame:
    """The frames that a table of (path, frame) asks for, in place of keys pressed while a video plays."""
    return frames.join(selection, ["path", "frame"])


def rates(query: StreamingQuery) -> list[tuple[int, float]]:
    """Batches and their rows a second."""
    return [(p["batchId"], p["processedRowsPerSecond"]) for p in query.recentProgress if p["numInputRows"]]
