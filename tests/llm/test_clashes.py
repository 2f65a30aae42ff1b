"""Columns that are named like an operator's own."""

import pytest

import corpus_pipeline
from lumenframe.llm import common, mixing, near_dups, packing, quality

NAMES = ("key", "sk", "tie", "row", "did", "set", "host", "p", "_hash", "blob", "spans", "size", "taken", "bucket_", "cut", "digest")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, f"word{k} " * (k % 7) + "some more words stand here", "en", "abc"[k % 3], 5) for k in range(40)] + [(None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for n in NAMES:
        df = df.withColumn(n, common.F.lit(n))
    return df


def untouched(df):
    return all(set(df.select(n).distinct().collect()) == {(n,)} for n in NAMES)


def test_operators_keep_them(spark, docs):
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id long, quality int")
    for out in (mixing.mix(docs), near_dups.deduplicate(docs), quality.keep_good(docs, labels)):
        assert out.columns == docs.columns and untouched(out)
    packed = packing.pack(docs)
    assert packed.count() == docs.count() and untouched(packed)


def test_stages_keep_them(spark, docs):
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.materialize(stage(spark, out, "/root/testdata/sf0.001"), name)
        assert out.columns == docs.columns and untouched(out), name
