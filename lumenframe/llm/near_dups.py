"""Near-duplicate detection: MinHash bands, sequential Bayesian pruning, exact verification.

1. Each text becomes its set of hashed word shingles, a MinHash signature and
   the keys of the signature's bands.  Texts with equal sets are one class.
2. Classes that share a band key are candidates.  A bucket is not expanded into
   pairs: each member meets one pivot, drawn anew for each bucket.  Signatures
   are compared batch by batch, and a pair is dropped once the posterior
   probability that it is similar enough falls below ``miss``; what is left is
   verified on the full sets.
3. Links join classes into components.  Buckets of three or more that still
   hold several components are compared within, in blocks of bounded size,
   between members of different components only, again by pruning and exact
   verification; a block gives no more links than it needs to join components.
4. A document's component is named by its smallest doc_id.

The only loss is a pair that shares no band, or that the pruning drops:
(1 - s**rows)**bands + miss for similarity s.

Defined cases: a null text is an empty one; texts without words are linked with
nothing; repeated rows each get a row; a null doc_id names no component and is
``kept`` only if no other row of its component has an id; an empty table gives
an empty result; other columns are ignored or kept by ``deduplicate``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import common
from lumenframe.llm.components import connected_components

#: Shingles in a block's side, at most, beside its last text.
BLOCK_SHINGLES = 100_000


@dataclass(frozen=True)
class Settings:
    """``words`` in a shingle; linked at ``percent`` of common shingles; ``bands`` of ``rows`` hashes; ``miss`` of the pruning."""

    words: int = 5
    percent: int = 80
    bands: int = 30
    rows: int = 5
    miss: float = 1e-6
    batch: int = 30

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD1342543DE82EF95)
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Texts to sorted arrays of 64-bit shingle hashes; a text of fewer words is one shingle."""

    def __init__(self, words: int, keep: int = 500_000):
        self.words, self.keep = words, keep
        self.known: dict[bytes, int] = {}
        self.factors = np.random.default_rng(11).integers(0, 2**63, words, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        import xxhash

        # ASCII lower case and white space alone, as bytes have it.
        split = [t.lower().split() for t in texts]
        if len(self.known) > self.keep:
            self.known = {}
        for w in {w for words in split for w in words}.difference(self.known):
            self.known[w] = xxhash.xxh3_64_intdigest(w)
        out = []
        for words in split:
            h = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
            n = min(self.words, len(h))
            if not n:
                out.append(h)
                continue
            with np.errstate(over="ignore"):
                total = np.full(len(h) - n + 1, n, np.uint64)
                for k in range(n):
                    total += h[k : len(h) - n + 1 + k] * self.factors[k]
                out.append(np.unique(_mix(total)))
        return out


class MinHasher:
    def __init__(self, s: Settings):
        rng = np.random.default_rng(5)
        self.s = s
        self.a = rng.integers(0, 2**63, s.hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, s.hashes, dtype=np.uint64)
        self.c = rng.integers(0, 2**63, s.rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.salt = rng.integers(0, 2**63, s.bands, dtype=np.uint64)

    def signature(self, shingles: np.ndarray, part: int = 2048) -> np.ndarray:
        with np.errstate(over="ignore"):
            lows = [((shingles[at : at + part, None] * self.a + self.b) >> np.uint64(32)).min(0) for at in range(0, len(shingles), part)]
        return reduce(np.minimum, lows)

    def bands(self, signature: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _mix((signature.reshape(self.s.bands, self.s.rows) * self.c).sum(1, dtype=np.uint64) ^ self.salt).view(np.int64)


@lru_cache(maxsize=8)
def least_matches(s: Settings) -> dict[int, int]:
    """For each number of hashes compared, the matches below which similarity ``percent`` has a posterior probability under ``miss``, from a uniform prior."""
    grid = np.linspace(0, 1, 20_001)[1:-1]
    similar = grid >= s.percent / 100
    found = {}
    for n in [*range(s.batch, s.hashes, s.batch), s.hashes]:
        for m in range(n + 1):
            log = m * np.log(grid) + (n - m) * np.log1p(-grid)
            density = np.exp(log - log.max())
            if density[similar].sum() / density.sum() >= s.miss:
                found[n] = m
                break
    return found


def survivors(left: np.ndarray, right: np.ndarray, s: Settings, least: dict[int, int]) -> np.ndarray:
    """Places of the rows of two signature matrices (``left`` may be one row) that no batch rules out."""
    alive = np.arange(len(right))
    matches = np.zeros(len(right), np.int64)
    at = 0
    for n, m in least.items():
        one = left[:, at:n] if len(left) == 1 else left[alive, at:n]
        matches = matches + (one == right[alive, at:n]).sum(1)
        keep = matches >= m
        alive, matches, at = alive[keep], matches[keep], n
    return alive


def common_shingles(one: np.ndarray, flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many members of the sorted set ``one`` each of the sets in ``flat`` has; ``ends`` are their ends."""
    hit = one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat
    return np.diff(np.concatenate([[0], np.cumsum(hit)[ends - 1]]))


FINGERPRINT = "doc_id long, did long, tie long, n_shingles long, digest binary, signature binary, bands array<long>"


def fingerprints(docs: DataFrame, s: Settings, text: str = "text") -> DataFrame:
    """A row for each document; digest, signature and bands are null without words."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingler, hasher = Shingler(s.words), MinHasher(s)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                sets = shingler.sets(batch.column(3).to_pylist())
                signatures = [hasher.signature(x) if len(x) else None for x in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.columns[:3],
                        pa.array([len(x) for x in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets], pa.binary()),
                        pa.array([None if x is None else x.astype("<u2").tobytes() for x in signatures], pa.binary()),
                        pa.array([None if x is None else hasher.bands(x) for x in signatures], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "did", "tie", "n_shingles", "digest", "signature", "bands"],
                )

    return _texts(docs, text).mapInArrow(hashed, FINGERPRINT)


def _texts(docs: DataFrame, text: str) -> DataFrame:
    """doc_id, the two parts of a row's name, and the text's bytes."""
    body = common.text_or_empty(text)
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(0)).alias("did"), F.xxhash64(body, doc_id.isNull()).alias("tie"), body.cast("binary").alias("body"))


def _with_sets(docs: DataFrame, wanted: DataFrame, s: Settings, text: str) -> DataFrame:
    """``wanted`` (cid, did, tie, signature) with the full sets of their texts, sorted."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(s.words)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                found = pa.array([x.tobytes() for x in shingler.sets(batch.column(2).to_pylist())], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], names=["cid", "signature", "shingles"])

    # Candidates grow with the documents, so they meet the texts by a shuffle at any size.
    keys = wanted.select("cid", "did", "tie")
    texts = _texts(docs, text).join(keys.hint("merge"), ["did", "tie"]).select("cid", "body")
    # Rows repeated with id and text match more than once.
    once = texts.groupBy("cid").agg(F.first("body").alias("body"))
    return once.join(wanted.select("cid", "signature"), "cid").select("cid", "signature", "body").mapInArrow(sets, "cid long, signature binary, shingles binary")


def _verified(pairs: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """The pairs (a, b) that are similar enough: signatures first, full sets of what is left."""

    def side(name: str, *columns: str) -> DataFrame:
        return sets.select(F.col("cid").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in columns))

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = least_matches(s)
        for batch in batches:
            if batch.num_rows:
                left, right = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").reshape(-1, s.hashes) for k in (2, 3))
                yield batch.take(pa.array(survivors(left, right, s, least))).select(["a", "b"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                one, two = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = int(common_shingles(one, two, np.array([len(two)]))[0])
                if 100 * both >= s.percent * (len(one) + len(two) - both):
                    keep.append(k)
            yield batch.take(pa.array(keep, pa.int64())).select(["a", "b"])

    with_signatures = pairs.join(side("a", "signature"), "a").join(side("b", "signature"), "b").select("a", "b", "signature_a", "signature_b")
    left = with_signatures.mapInArrow(prune, "a long, b long")
    with_sets = left.join(side("a", "shingles"), "a").join(side("b", "shingles"), "b").select("a", "b", "shingles_a", "shingles_b")
    with common.arrow_rows(pairs.sparkSession, 512):
        return common.materialize(with_sets.mapInArrow(verify, "a long, b long"), "near-links")


def block_links(a: pd.DataFrame, b: pd.DataFrame | None, s: Settings, least: dict[int, int]) -> list[tuple[int, int]]:
    """Links that join components between the members of ``a`` and ``b``, or within ``a``."""
    within = b is None
    b = a if within else b
    right = np.frombuffer(b"".join(b.signature), "<u2").reshape(-1, s.hashes)
    sets = [np.frombuffer(x, np.uint64) for x in b.shingles]
    sizes = np.array([len(x) for x in sets])
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    labels = b.comp.to_numpy().copy()
    found = []
    for k, (cid, comp, signature, shingles) in enumerate(zip(a.cid, a.comp, a.signature, a.shingles, strict=True)):
        other = np.flatnonzero(labels != find(comp))
        if within:
            other = other[other > k]
        if not len(other):
            continue
        other = other[survivors(np.frombuffer(signature, "<u2")[None, :], right[other], s, least)]
        one = np.frombuffer(shingles, np.uint64)
        for part in np.array_split(other, max(1, int(sizes[other].sum()) // BLOCK_SHINGLES)):
            if len(part):
                both = common_shingles(one, np.concatenate([sets[j] for j in part]), np.cumsum(sizes[part]))
                for j in part[100 * both >= s.percent * (len(one) + sizes[part] - both)]:
                    x, y = find(comp), find(int(b.comp.iat[j]))
                    if x != y:
                        root[max(x, y)] = min(x, y)
                        labels[labels == max(x, y)] = min(x, y)
                        found.append((int(cid), int(b.cid.iat[j])))
    return found


def _within_buckets(members: DataFrame, sets: DataFrame, components: DataFrame, s: Settings) -> DataFrame:
    """Links between components inside buckets that the pivots left in several."""
    labelled = members.join(components, "cid", "left").withColumn("comp", F.coalesce("comp", "cid")).join(sets.select("cid", F.octet_length("shingles").alias("size")), "cid")
    stats = labelled.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("n"), F.sum(F.xxhash64("cid").cast("decimal(38,0)")).alias("who"), F.sum(F.col("size") / 8 + 100).alias("weight"))
    # Buckets with the same members are one.
    left = stats.where((F.col("low") < F.col("high")) & (F.col("n") > 2)).groupBy("n", "who").agg(F.min("key").alias("key"), F.max("weight").alias("weight"))
    chunks = F.ceil(F.col("weight") / BLOCK_SHINGLES).cast("int")
    chunked = common.split_join(labelled, left.select("key", chunks.alias("chunks")), "key").withColumn("chunk", F.pmod(F.xxhash64("cid", F.lit(7)), "chunks").cast("int"))
    blocks = chunked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    blocks = blocks.select("cid", "comp", "key", "chunk", F.least("chunk", "other").alias("c"), F.greatest("chunk", "other").alias("d"))
    full = blocks.join(sets, "cid")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        c, d = int(rows.c.iat[0]), int(rows.d.iat[0])
        links = []
        if rows.comp.nunique() > 1:
            a = rows[rows.chunk == c].reset_index(drop=True)
            b = None if c == d else rows[rows.chunk == d].reset_index(drop=True)
            links = block_links(a, b, s, least_matches(s))
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return common.materialize(full.groupBy("key", "c", "d").applyInPandas(compare, "a long, b long"), "near-links")


def near_duplicates(docs: DataFrame, s: Settings = Settings(), text: str = "text") -> DataFrame:  # noqa: B008
    """A row for each row of ``docs`` (doc_id, text): doc_id, tie, n_shingles, digest, component_id and kept."""
    spark = docs.sparkSession
    with common.arrow_rows(spark, 1024):
        prints = common.materialize(fingerprints(docs, s, text), "near-prints")
    classes = (
        prints.where("n_shingles > 0")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("first_id"), F.min(F.struct("did", "tie")).alias("row"), F.first("signature").alias("signature"), F.first("bands").alias("bands"))
        .select(F.monotonically_increasing_id().alias("cid"), "digest", "first_id", "row.did", "row.tie", "signature", "bands")
    )
    classes = common.materialize(classes, "near-classes")
    keyed = classes.select("cid", F.explode("bands").alias("key"))
    drawn = F.xxhash64("key", "cid")
    buckets = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min_by("cid", drawn).alias("pivot")).where("n > 1")
    members = common.hold(common.split_join(keyed, buckets, "key"))
    wanted = common.hold(members.select("cid").distinct().join(classes.select("cid", "did", "tie", "signature"), "cid"))
    with common.arrow_rows(spark, 1024):
        sets = common.materialize(_with_sets(docs, wanted, s, text), "near-sets")
    pairs = members.where("cid != pivot").select(F.least("cid", "pivot").alias("a"), F.greatest("cid", "pivot").alias("b")).distinct()
    links = _verified(pairs, sets, s)
    components = connected_components(links)
    more = _within_buckets(members.select("cid", "key"), sets, components, s)
    components = connected_components(components.select(F.col("cid").alias("a"), F.col("comp").alias("b")).unionByName(more))

    labelled = classes.select("cid", "digest", "first_id").join(components, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    labelled = common.materialize(labelled, "near-labelled")
    members.unpersist()
    wanted.unpersist()
    common.discard(classes, sets, links, more)
    smallest = labelled.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    of_class = common.split_join(labelled, smallest, "comp").select("digest", "component_id")
    joined = prints.select("doc_id", "tie", "n_shingles", "digest").join(of_class, "digest", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "tie", "n_shingles", "digest", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicate(docs: DataFrame, s: Settings = Settings(), text: str = "text") -> DataFrame:  # noqa: B008
    """One document of each component of ``docs``, with its columns: that of the smallest doc_id.

    Rows repeated with id and text count as one document; documents without
    words all stay.
    """
    found = near_duplicates(docs, s, text)
    kept = found.where("kept").select(F.coalesce("doc_id", F.lit(0)).alias("did"), "tie", F.coalesce(F.hex("digest"), F.lit("")).alias("set")).dropDuplicates(["did", "tie"])
    # A digest's rows that are kept share their id, and only repeated rows share text too.
    one_text = kept.where("set != ''").groupBy("did", "set").agg(F.min("tie").alias("tie"))
    chosen = one_text.select("did", "tie", "set").unionByName(kept.where("set = ''"))
    body = common.text_or_empty(text)
    named = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("did"), F.xxhash64(body, F.col("doc_id").isNull()).alias("tie"))
    joined = named.join(chosen, ["did", "tie"])
    with_words = joined.where("set != ''").groupBy("did", "tie").agg(F.first("row").alias("row"))
    return with_words.select("row.*").unionByName(joined.where("set = ''").select("row.*"))


CONTRACT = Settings(words=4)


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table("documents")(spark, sf_dir).select("doc_id", "text")
    return near_duplicates(docs, CONTRACT).select("doc_id", "n_shingles", "component_id", "kept")


_OP9 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(generate_series(1, len(w) - 3), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * n_both >= 80 * (x.n + y.n - n_both)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)"""

QUERIES = {"op9_near_duplicates": op9_near_duplicates}
ORACLE_SQL = {"op9_near_duplicates": _OP9}
