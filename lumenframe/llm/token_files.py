"""Token ids in binary files of patched frame-of-reference blocks.

A shard file holds, little-endian throughout:

    magic b"LFTOK1", block size u32, number of ids u64, blocks u32, documents u32
    doc ids i64 x documents, null marks u8 x documents, lengths u32 x documents
    block starts u64 x (blocks + 1), in bytes from the first block
    blocks: minimum u32, width u8, exceptions u16, then the packed low bits of
        (id - minimum), the exceptions' places u16 and their high bits u32

The width of a block is what the ``percentile`` of its differences needs; ids
that need more keep their low bits in place and their high bits in the list of
exceptions.  Block starts let a reader fetch any range of ids.

Shards are in ascending doc_id order.  A task gives its file a new name, and
only the names that Spark commits in the manifest count, so a lost executor or
a second attempt leaves no half-written or doubled shard.

Defined cases: a null text is an empty one, of the end id alone; null doc_ids
come first; rows of one doc_id come in the order of their texts' hash, then
text; an empty table gives an empty manifest; other columns are ignored.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.llm import common
from lumenframe.llm.token_counts import BYTE_MODEL, vocabulary_path

MAGIC = b"LFTOK1"
HEAD = struct.Struct("<6sIQII")
BLOCK_HEAD = np.dtype([("low", "<u4"), ("width", "u1"), ("exceptions", "<u2")])
BLOCK = 1024
#: Blocks worked on at a time.
SLICE = 1024
#: Starts a new unit at each blank before a visible character, where the
#: byte-level pre-tokenizer always starts a new token.
UNIT = re.compile(r" (?=\S)")


def _bit_length(x: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(x.astype(np.float64) + 1)).astype(np.int64)


def _pack_rows(rows: np.ndarray, width: int) -> np.ndarray:
    """Rows of values below 2**width as rows of bytes."""
    if not width:
        return np.zeros((len(rows), 0), np.uint8)
    low_first = rows.astype("<u4").view(np.uint8).reshape(*rows.shape, 4)[:, :, : (width + 7) // 8]
    bits = np.unpackbits(low_first, axis=2, bitorder="little", count=width)
    return np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little")


def _unpack_rows(packed: np.ndarray, width: int, n: int) -> np.ndarray:
    if not width:
        return np.zeros((len(packed), n), np.uint32)
    bits = np.unpackbits(packed, axis=1, bitorder="little", count=width * n).reshape(len(packed), n, width)
    wide = np.zeros((len(packed), n, 4), np.uint8)
    wide[:, :, : (width + 7) // 8] = np.packbits(bits, axis=2, bitorder="little")
    return wide.view("<u4")[:, :, 0]


def encode_blocks(ids: np.ndarray, block: int = BLOCK, percentile: float = 0.98) -> list[bytes]:
    """The blocks of ``ids``, in order; the last may be shorter."""
    out: list[bytes] = []
    whole = len(ids) // block * block
    pieces = [ids[at : min(at + SLICE * block, whole)].reshape(-1, block) for at in range(0, whole, SLICE * block)]
    if whole < len(ids):
        pieces.append(ids[whole:].reshape(1, -1))
    for rows in pieces:
        n = rows.shape[1]
        low = rows.min(axis=1)
        over = rows - low[:, None]
        at = min(n - 1, int(np.ceil(percentile * n)) - 1)
        widths = _bit_length(np.partition(over, at, axis=1)[:, at])
        blocks: list[bytes] = [b""] * len(rows)
        for width in np.unique(widths):
            chosen = np.flatnonzero(widths == width)
            part = over[chosen]
            packed = _pack_rows(part & np.uint32((1 << int(width)) - 1), int(width))
            high = part >> np.uint32(width)
            for k, row in enumerate(chosen):
                places = np.flatnonzero(high[k])
                head = np.array([(low[row], width, len(places))], BLOCK_HEAD).tobytes()
                blocks[row] = head + packed[k].tobytes() + places.astype("<u2").tobytes() + high[k][places].astype("<u4").tobytes()
        out += blocks
    return out


def decode_blocks(data: bytes, starts: np.ndarray, n_ids: int, block: int = BLOCK) -> np.ndarray:
    """The ids of consecutive blocks that start at ``starts`` (with the end as the last) in ``data``."""
    n_blocks = len(starts) - 1
    ids = np.empty((n_blocks, block), np.uint32)
    heads = np.empty(n_blocks, BLOCK_HEAD)
    for k in range(n_blocks):
        heads[k] = np.frombuffer(data, BLOCK_HEAD, 1, int(starts[k]))[0]
    lengths = np.full(n_blocks, block)
    if n_blocks:
        lengths[-1] = n_ids - (n_blocks - 1) * block
    for width, n in sorted({(int(w), int(n)) for w, n in zip(heads["width"], lengths, strict=True)}):
        chosen = np.flatnonzero((heads["width"] == width) & (lengths == n))
        size = (width * n + 7) // 8
        for some in np.array_split(chosen, max(1, len(chosen) // SLICE)):
            packed = np.frombuffer(b"".join(data[(s := int(starts[k]) + BLOCK_HEAD.itemsize) : s + size] for k in some), np.uint8).reshape(len(some), size)
            ids[some, :n] = _unpack_rows(packed, width, n)
        for k in chosen[heads["exceptions"][chosen] > 0]:
            at, count = int(starts[k]) + BLOCK_HEAD.itemsize + size, int(heads["exceptions"][k])
            places = np.frombuffer(data, "<u2", count, at)
            ids[k, places] |= np.frombuffer(data, "<u4", count, at + 2 * count) << np.uint32(width)
    ids += heads["low"][:, None]
    return ids.reshape(-1)[:n_ids]


def encode_shard(ids: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray, block: int = BLOCK, percentile: float = 0.98) -> bytes:
    """A shard file's bytes."""
    blocks = encode_blocks(ids.astype(np.uint32, copy=False), block, percentile)
    starts = np.concatenate([[0], np.cumsum([len(b) for b in blocks], dtype=np.uint64)]).astype("<u8")
    return b"".join(
        [
            HEAD.pack(MAGIC, block, len(ids), len(blocks), len(doc_ids)),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            np.array([d is None for d in doc_ids], "u1").tobytes(),
            np.asarray(lengths, "<u4").tobytes(),
            starts.tobytes(),
            *blocks,
        ]
    )


class Shard:
    """A shard file's content, of which any range of ids can be read."""

    def __init__(self, data: bytes):
        magic, self.block, self.n_ids, n_blocks, n_docs = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = HEAD.size
        values = np.frombuffer(data, "<i8", n_docs, at)
        nulls = np.frombuffer(data, "u1", n_docs, at + 8 * n_docs)
        self.doc_ids = [None if null else int(v) for v, null in zip(values, nulls, strict=True)]
        self.lengths = np.frombuffer(data, "<u4", n_docs, at + 9 * n_docs)
        at += 13 * n_docs
        self.starts = np.frombuffer(data, "<u8", n_blocks + 1, at).astype(np.int64)
        self.data = memoryview(data)[at + 8 * (n_blocks + 1) :]

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids from ``start`` up to ``stop``, from the blocks that hold them alone."""
        stop = min(stop, self.n_ids)
        if start >= stop:
            return np.empty(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block + 1
        begin = int(self.starts[first])
        data = bytes(self.data[begin : int(self.starts[last])])
        n = min(last * self.block, self.n_ids) - first * self.block
        found = decode_blocks(data, self.starts[first : last + 1] - begin, n, self.block)
        return found[start - first * self.block : stop - first * self.block]


class Encoder:
    """Texts to ids by the tokenizers library, which sees each distinct unit of a text once.

    A unit is what lies between two blanks that stand before visible
    characters.  The pre-tokenizer always starts a new token at such a blank,
    so the ids of a text are those of its units.  ``keep`` bounds the units
    remembered.  New units are encoded together: each that starts with its only
    blank, before a visible character, gives one token that starts with the
    blank mark, its first.  All others are encoded alone, as white space may
    join that of the next unit.
    """

    def __init__(self, vocabulary: str = BYTE_MODEL, keep: int = 1_200_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary_path(vocabulary))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.keep = keep
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.starts = np.zeros(max(names.values(), default=0) + 1, bool)
        self.starts[[i for name, i in names.items() if name.startswith("Ġ")]] = True
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.empty(0, np.uint32)
        self.at = np.zeros(1, np.int64)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: set[str]) -> None:
        plain = [u for u in new if u[:1] == " " and len(u) > 1 and u.find(" ", 1) < 0 and not u[1].isspace()]
        self._remember(plain, list(set(new).difference(plain)))

    def _remember(self, plain: list[str], odd: list[str], together: int = 4096) -> None:
        """Remember units: ``plain`` ones start with their only blank, before a visible character."""
        joined = self._ids(["".join(plain[at : at + together]) for at in range(0, len(plain), together)])
        flat = np.concatenate([np.array(ids, np.uint32) for ids in joined] or [np.empty(0, np.uint32)])
        begins = np.flatnonzero(self.starts[flat])
        if len(begins) != len(plain):
            raise ValueError("the vocabulary does not mark where words start")
        alone = self._ids(odd)
        sizes = np.concatenate([np.diff(np.append(begins, len(flat))), np.fromiter(map(len, alone), np.int64, len(alone))])
        n = len(self.known)
        self.known.update(zip(chain(plain, odd), range(n, n + len(plain) + len(odd)), strict=True))
        self.flat = np.concatenate([self.flat, flat, *(np.array(ids, np.uint32) for ids in alone)])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(sizes)])

    def _gather(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of units, and how many each has."""
        begin = self.at[which]
        length = self.at[which + 1] - begin
        ends = np.cumsum(length)
        return self.flat[np.repeat(begin - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)], length

    def _odd(self, text: str) -> np.ndarray:
        """The ids of a text in which a blank is followed by white space or nothing."""
        first, *rest = UNIT.split(text)
        units = [first, *(" " + x for x in rest)]
        if new := set(units).difference(self.known):
            self._learn(new)
        return self._gather(np.fromiter(map(self.known.__getitem__, units), np.int64, len(units)))[0]

    def encode(self, texts: pa.Array, end: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string column with ``end`` after each text, and the texts' lengths with it."""
        if len(self.known) > self.keep or len(self.flat) > 32 * self.keep:
            self.forget()
        lists = pc.split_pattern(texts, " ")
        pieces = lists.flatten().dictionary_encode()
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        firsts, sizes = offsets[:-1], np.diff(offsets)
        index, names = pieces.indices.to_numpy(), pieces.dictionary
        doc = np.repeat(np.arange(len(texts)), sizes)

        # What follows a blank and is empty or starts with white space belongs to a text that is encoded apart.
        bad = pc.or_(pc.equal(pc.binary_length(names), 0), pc.utf8_is_space(pc.utf8_slice_codeunits(names, 0, 1))).to_numpy(zero_copy_only=False).astype(bool)
        unsafe = bad[index]
        unsafe[firsts] = False
        odd = np.unique(doc[unsafe])
        heads = names.take(pa.array(index[firsts])).to_pylist()
        units = pc.binary_join_element_wise("", names, " ").to_pylist()
        ids = np.fromiter(map(self.known.get, units, repeat(-1)), np.int64, len(units))
        new = np.flatnonzero((ids < 0) & ~bad)
        ids[new] = np.arange(len(self.known), len(self.known) + len(new))
        self._remember([units[k] for k in new], list(set(heads).difference(self.known)))
        which = ids[index]
        which[firsts] = np.fromiter(map(self.known.__getitem__, heads), np.int64, len(heads))
        plain = np.ones(len(texts), bool)
        plain[odd] = False
        used = plain[doc]
        found, length = self._gather(which[used])
        lengths = np.bincount(doc[used], length, len(texts)).astype(np.int64) + 1
        apart = {int(k): self._odd(texts[int(k)].as_py()) for k in odd}
        for k, ids in apart.items():
            lengths[k] += len(ids)
        out = np.full(int(lengths.sum()), end, np.uint32)
        ends = np.cumsum(lengths)
        body = np.repeat(plain, lengths)
        body[ends - 1] = False
        out[body] = found
        for k, ids in apart.items():
            out[ends[k] - lengths[k] : ends[k] - 1] = ids
        return out, lengths


#: Encoders that this process has made, by vocabulary; what they remember helps later tasks.
_ENCODERS: dict[str, Encoder] = {}


def shared_encoder(vocabulary: str) -> Encoder:
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Encoder(vocabulary)
    return _ENCODERS[vocabulary]


def byte_slices(texts: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``size`` bytes each, a longer text by itself."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(ends):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield at, stop
        at = stop


def _filesystem(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


MANIFEST = "part int, seq int, path string, n_docs long, n_ids long, n_bytes long"


def write_tokens(docs: DataFrame, folder: str, vocabulary: str = BYTE_MODEL, end: int = 0, shard_ids: int = 1 << 22, batch_bytes: int = 1 << 23, block: int = BLOCK, percentile: float = 0.98) -> DataFrame:
    """Write the ids of ``docs`` (doc_id, text) as shards below ``folder``; return the manifest.

    The manifest (part, seq, path, n_docs, n_ids, n_bytes, start) has a row for
    each shard, in ascending doc_id order by (part, seq); ``start`` is the
    number of ids before it.
    """
    spark = docs.sparkSession

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = shared_encoder(vocabulary)
        fs, root = _filesystem(folder)
        part, seq = TaskContext.get().partitionId(), 0
        doc_ids: list[int | None] = []
        held: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        n = 0

        def write() -> pa.RecordBatch:
            nonlocal seq, n
            data = encode_shard(np.concatenate(held), doc_ids, np.concatenate(lengths), block, percentile)
            name = f"{part:06d}-{seq:05d}-{uuid.uuid4().hex}.tok"
            with fs.open_output_stream(f"{root}/{name}") as f:
                f.write(data)
            row = [(part, pa.int32()), (seq, pa.int32()), (f"{folder}/{name}", pa.string()), (len(doc_ids), pa.int64()), (n, pa.int64()), (len(data), pa.int64())]
            doc_ids.clear(), held.clear(), lengths.clear()
            seq, n = seq + 1, 0
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in row], names=["part", "seq", "path", "n_docs", "n_ids", "n_bytes"])

        for batch in batches:
            texts = batch.column(1)
            for at, stop in byte_slices(texts, batch_bytes):
                ids, sizes = encoder.encode(texts.slice(at, stop - at), end)
                held.append(ids)
                lengths.append(sizes)
                doc_ids += batch.column(0).slice(at, stop - at).to_pylist()
                n += len(ids)
                if n >= shard_ids:
                    yield write()
        if doc_ids:
            yield write()

    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange(common.shuffle_partitions(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    written = ordered.select("doc_id", "text").mapInArrow(shards, MANIFEST)
    manifest = common.materialize(written, "token-manifest")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Per document of the shards: doc_id, start, n_tokens and the checksum of its ids."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, at = _filesystem(path)
                with fs.open_input_stream(at) as f:
                    shard = Shard(f.read())
                ends = np.cumsum(shard.lengths, dtype=np.int64)
                begins = ends - shard.lengths
                sums: list[int] = []
                k = 0
                while k < len(ends):
                    last = max(k + 1, int(np.searchsorted(ends, begins[k] + SLICE * shard.block, "right")))
                    ids = shard.ids(int(begins[k]), int(ends[last - 1])).astype("<u4", copy=False)
                    sums += [zlib.crc32(ids[b - begins[k] : e - begins[k]]) for b, e in zip(begins[k:last], ends[k:last], strict=True)]
                    k = last
                columns = [pa.array(shard.doc_ids, pa.int64()), pa.array(begins + start, pa.int64()), pa.array(shard.lengths.astype(np.int64)), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = manifest.select("path", "start").repartition(common.shuffle_partitions(manifest.sparkSession))
    return spread.mapInArrow(documents, READ)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table("documents")(spark, sf_dir).select("doc_id", "text")
    return read_tokens(write_tokens(docs, common.scratch(spark, "tokens")))


QUERIES = {"op4_token_files": op4_token_files}
