"""Token counts: lengths only, from batches balanced by bytes.

Long texts are split at safe boundaries, so neither a batch nor the library's
working memory grows with the longest text.

Defined cases: a null text counts as an empty one, with no tokens; repeated
rows each give a row; an empty table gives an empty one; columns other than
those named are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import common

MODEL = "piece_bpe_32k.model"
BYTE_MODEL = "byte_bpe_50k.json"

#: A single blank between two characters that are neither white space nor the
#: library's own blank mark.  No piece of the vocabulary goes on over a blank
#: after another character, so no merge crosses such a blank, and the prefix
#: that the library puts before each text stands for the blank cut out.
PIECE_CUT = re.compile("(?<=[^\\s▁]) (?=[^\\s▁])")
#: The byte-level pre-tokenizer starts a new token at any blank before a
#: visible character, whatever stands before it; the blank goes with it.
BYTE_CUT = re.compile(r"(?= \S)")


def vocabulary_path(name_or_path: str) -> str:
    """A path as it is; the name of a public vocabulary as its place on this machine."""
    if "/" in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


def cut_text(text: str, cut: re.Pattern, size: int) -> list[str]:
    """Parts of about ``size`` characters, which end at the first safe boundary after that."""
    if len(text) <= size:
        return [text]
    parts, at = [], 0
    while len(text) - at > size and (m := cut.search(text, at + size)):
        parts.append(text[at : m.start()])
        at = m.end()
    return [*parts, text[at:]]


def byte_batches(texts: Iterator[str], cut: re.Pattern, batch_bytes: int, part_chars: int) -> Iterator[tuple[list[str], list[int]]]:
    """Batches of parts of at most about ``batch_bytes``, each with the index of the text it is from."""
    parts: list[str] = []
    owners: list[int] = []
    held = 0
    for owner, text in enumerate(texts):
        for part in cut_text(text, cut, part_chars):
            parts.append(part)
            owners.append(owner)
            held += len(part.encode())
            if held >= batch_bytes:
                yield parts, owners
                parts, owners, held = [], [], 0
    if parts:
        yield parts, owners


def load_counter(vocabulary: str) -> tuple[Callable[[list[str]], list[int]], re.Pattern]:
    """A function from texts to their numbers of tokens, and where its texts may be cut."""
    path = vocabulary_path(vocabulary)
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return (lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]), PIECE_CUT
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return (lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]), BYTE_CUT


def token_count(vocabulary: str = MODEL, batch_bytes: int = 1 << 20, part_chars: int = 1 << 15) -> Callable[[Column], Column]:
    """An Arrow function from a text column to its numbers of tokens."""

    @F.arrow_udf("long")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        count, cut = load_counter(vocabulary)
        for batch in batches:
            totals = [0] * len(batch)
            texts = (x.as_py() or "" for x in batch)
            for parts, owners in byte_batches(texts, cut, batch_bytes, part_chars):
                for owner, n in zip(owners, count(parts), strict=True):
                    totals[owner] += n
            yield pa.array(totals, pa.int64())

    return counted


def count_tokens(docs: DataFrame, vocabulary: str = MODEL, limit: int = 4096, text: str = "text") -> DataFrame:
    """``docs`` with n_bytes (UTF-8), n_tokens and over_limit; the text itself goes no further."""
    body = common.text_or_empty(text)
    others = [c for c in docs.columns if c not in (text, "n_bytes", "n_tokens", "over_limit")]
    counted = docs.select(*others, F.octet_length(body).cast("long").alias("n_bytes"), token_count(vocabulary)(body).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table("documents")(spark, sf_dir).select("doc_id", "text")
    return count_tokens(docs).select("doc_id", "n_bytes", "n_tokens", "over_limit")


QUERIES = {"op6_token_counts": op6_token_counts}
