"""The corpus pipeline: five stages, each over all that the one before it kept.

Quality classifier, near-duplicate removal, secret scans (which redact), mixing
to target weights, and packing.  Each stage but the last returns the columns of
``documents``; ``run`` writes each result to the shared folder and reads it again.

In all stages a null text is an empty one, an empty table gives an empty result,
columns besides those of ``documents`` are kept, whatever their names (the last
stage keeps its own only), and texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import common, mixing, near_dups, packing, quality, secrets


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the classifier rejects.

    ``source`` stands for the host and ``source/lang`` for the path; a null one
    is a site of its own.  Repeated rows are judged alike and all count for
    their site.  Without labels of both kinds all documents have one evidence.
    """
    return quality.keep_good(docs, common.table("labels")(spark, sf_dir))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest doc_id of each group of near copies (five words, 0.8).

    Rows repeated with doc_id and text leave one; a null doc_id stays only if
    its group has no other; documents without words are nobody's copies and all
    stay.
    """
    return near_dups.deduplicate(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets by marks of their kind.

    Every row stays, repeated ones too; ``n_chars`` follows the new text where
    something was replaced, and null texts stay null.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    found = secrets.BlobLedger(spark, common.scratch(spark, "blob-ledger")).scan(rows)
    clean = secrets.redact(F.col("text"), F.col("spans"))
    size = F.when(F.size("spans") > 0, F.length(clean).cast("long")).otherwise(F.col("row.n_chars"))
    changed = {"text": clean, "n_chars": size}
    return found.select(*(changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources come to their target weights, in order of virtual finish time.

    The document at which the total budget is reached is cut at that word.
    Documents without words stay once; a null source is the last one by name;
    repeated rows each have turns of their own; ties of time go by source, then
    by a hash of doc_id and text.
    """
    mixed = mixing.mix(docs)
    return mixed.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Give each document its place in a batch.

    A null text has length 0; repeated rows each have a place; a document
    longer than the budget is a batch of its own.
    """
    return packing.pack(docs).select("doc_id", "source", "length", "bucket", "bucket_length", "batch", "slot")


STAGES = [
    ("quality", quality_stage),
    ("near_dups", near_dup_stage),
    ("secrets", secret_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The classifier and the packing can't be said in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table("documents")(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
