"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, wherever an operator counts or compares words.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is ``spark.checkpoint.dir``.  Only where that is unset, and the session
    is local so that there is one machine anyway, a temporary folder serves.
    """
    set_to = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if set_to:
        return set_to.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="lumenframe-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again, which cuts the lineage."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hold(df: DataFrame) -> DataFrame:
    """Compute a narrow table once and keep it in the executors' memory and disks.

    Its lineage stays, so what a lost executor held is computed again; rows must
    follow from the input alone.  Spark then knows its size when it plans joins.
    """
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    held.count()
    return held


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, n: int) -> Iterator[None]:
    """Jobs inside hand Python at most ``n`` rows at a time; for those with wide rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, min(n, int(before)) if int(before) > 0 else n)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def discard(*frames: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        # An empty table has no files, and nothing to delete.
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def split_join(many: DataFrame, one: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``many`` joined with ``one``, an aggregate that has each key once.

    Where an aggregate is joined as it lies, by its own key, adaptive execution
    can't split a key with very many rows.  By another form of the key both
    sides are dealt anew, and it can.
    """
    # A hash wouldn't be one to one; a reversed string or a negated number is.
    kind = one.schema[key].dataType.simpleString()
    turned = F.bitwise_not(key) if kind in ("bigint", "int") else F.concat(F.lit("=").cast(kind), F.col(key))
    return many.withColumn("_turned", turned).join(one.withColumn("_turned", turned).drop(key), "_turned", how).drop("_turned")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def row_key(text: str = "text") -> Column:
    """A hash of doc_id and text, which tells null from empty; it names a row but for its copies."""
    return F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.md5(F.col(text)), F.lit(""))))


def hash_range(hex_key: Column, ranges: int) -> Column:
    """The range of a hash, of so many of equal width, in the hash's order."""
    return F.floor(F.conv(F.substring(hex_key, 1, 8), 16, 10).cast("double") / 2.0**32 * ranges).cast("long")


def word_count(text: Column) -> Column:
    """Words of a text, null as none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")
