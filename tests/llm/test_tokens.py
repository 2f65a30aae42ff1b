import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenframe.llm import common, token_counts, token_files

ODD = ["", None, " ", "  a", "a  b ", "a\n b", "x\n\n  y", "a  b", "<|endoftext|> a <s>", "▁a ▁ b ▁", "é" * 50, "it's  we'll 12 34\t 5", "\x1c a\x1d b", "word " * 9000, "a" * 3000]
TEXT = st.lists(st.sampled_from([*"ab é1'.!\n\t\r ▁ \x1c日", "<|endoftext|>", "  "]), max_size=60).map("".join)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_counts.vocabulary_path(token_counts.BYTE_MODEL))


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=token_counts.vocabulary_path(token_counts.MODEL))


def test_no_piece_goes_over_a_blank(pieces):
    assert not [p for p in map(pieces.id_to_piece, range(pieces.get_piece_size())) if "▁" in p.lstrip("▁")]


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_cut_texts_have_the_same_tokens(text):
    for vocabulary in (token_counts.MODEL, token_counts.BYTE_MODEL):
        count, cut = token_counts.load_counter(vocabulary)
        assert sum(count(token_counts.cut_text(text, cut, 3))) == count([text])[0]


def test_counts(spark, pieces):
    rows = [(i, t, 5) for i, t in enumerate(ODD)] + [(None, "x y", 1), (0, "x y", 1), (0, "x y", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    found = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs).collect())
    wanted = sorted((str(i), len((t or "").encode()), n := len(pieces.encode(t or "")), n > 4096) for i, t, _ in rows)
    assert found == wanted
    assert token_counts.count_tokens(docs.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, max_size=5))
def test_units_have_the_ids_of_whole_texts(texts):
    ids, lengths = ENCODER.encode(pa.array(texts, pa.string()))
    library = ENCODER.tokenizer
    assert ids.tolist() == [i for t in texts for i in [*library.encode(t, add_special_tokens=False).ids, 0]]
    assert lengths.sum() == len(ids)


ENCODER = token_files.Encoder(keep=50)


def test_units_of_no_break_spaces_stay_apart():
    encoder = token_files.Encoder()
    texts = ["".join(" " + "\xa0" * k for k in range(1, 30)), " a \xa0 \xa0\xa0 b", "\xa0 \xa0", " \u3000 \u2003 \x85", " "]
    units = [" a", " \xa0", " \xa0\xa0", " b", " "]
    encoder._learn(dict.fromkeys(units))
    for unit in units:
        assert encoder._gather(np.array([encoder.known[unit]]))[0].tolist() == encoder.tokenizer.encode(unit, add_special_tokens=False).ids
    assert encoder.encode(pa.array(texts))[0].tolist() == [i for t in texts for i in [*encoder.tokenizer.encode(t, add_special_tokens=False).ids, 0]]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"ab .\n\xa0\u3000\x85", " \xa0", "  "]), max_size=60).map("".join), max_size=5))
def test_units_with_other_white_space(texts):
    ENCODER.forget()
    ids, _ = ENCODER.encode(pa.array(texts, pa.string()))
    assert ids.tolist() == [i for t in texts for i in [*ENCODER.tokenizer.encode(t, add_special_tokens=False).ids, 0]]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 40), st.integers(0, 2**32 - 1)), max_size=300), st.integers(0, 310), st.integers(0, 310), st.sampled_from([0.5, 0.9, 1.0]))
def test_blocks_round_trip(values, a, b, percentile):
    ids = np.array(values, np.uint32)
    shard = token_files.Shard(token_files.encode_shard(ids, [1, None], [len(ids), 0], 64, percentile))
    assert shard.doc_ids == [1, None]
    assert shard.ids(0, len(ids)).tolist() == values
    assert shard.ids(a, b).tolist() == values[a:b]


def test_files(spark, library):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "first"), (3, "again"), (3, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    manifest = token_files.write_tokens(docs, common.scratch(spark, "tokens"), shard_ids=200, batch_bytes=100)
    assert manifest.count() > 4
    got = sorted(token_files.read_tokens(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda d: -1 if d is None else d)
    at = 0
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(t or "")
    for r in got:
        assert r.start == at
        at += r.n_tokens
        sums = [zlib.crc32(np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes()) for t in texts[r.doc_id]]
        assert r.ids_crc32 in sums
    empty = token_files.write_tokens(docs.limit(0), common.scratch(spark, "tokens"))
    assert empty.count() == 0 and token_files.read_tokens(empty).count() == 0
