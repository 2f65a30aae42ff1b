"""Nearest neighbours by the largest inner product: shifted space-filling curves, then an exact check in blocks.

Equal vectors become one class first.  Each of several curves turns the
directions of the vectors by its own random rotation, keeps a few coordinates,
shifts the grid, and orders the classes along a Hilbert curve; Spark
range-partitions that order.  A query meets the classes of the windows next to
it on each curve, and the k-th best of all windows merged is its floor.

The check then makes sure of the rest.  Classes stay in the order of the first
curve, in blocks of near ones; a block whose centre and radius rule out that
any of its vectors reaches a query's floor is passed over, and the others are
compared as a matrix product.  What reaches the floor is scored again, its
products summed in the order of the components, and ranked.  So the result is
exact, for any norms, and the curves decide how much of the table a query must
meet: little where vectors have structure, all of it where they have none.

Windows and blocks hold a set number of places, and a partition a set number of
classes, so memory doesn't grow with the table; queries pass as a stream.

Defined cases: vectors that are null, zero, of a length that isn't the most
common one, or that hold null or non-finite components take no part, nor do
rows without vec_id; repeated rows count once; ties go to the smaller vec_id,
whatever their number; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.llm import common


@dataclass(frozen=True)
class Curves:
    """``window`` places to a window, ``block`` classes to a block, about ``part`` to a partition."""

    curves: int = 3
    coordinates: int = 8
    bits: int = 7
    window: int = 512
    block: int = 2048
    part: int = 65_536
    seed: int = 3


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of rows of grid cells, each coordinate below 2**bits.

    The curve is walked from the coarsest bit down: the cell's orthant gives
    the next digits by its place in a Gray code, and the orthant's own curve is
    entered at some corner along some axis, which the state keeps.
    """
    n, d = cells.shape
    axes = np.arange(d)
    entry = np.zeros(n, np.int64)
    direction = np.zeros(n, np.int64)
    keys = np.zeros(n, np.int64)
    mask = (1 << d) - 1

    def rotate_left(x: np.ndarray, by: np.ndarray) -> np.ndarray:
        by = by % d
        return ((x << by) | (x >> (d - by))) & mask

    for bit in range(bits - 1, -1, -1):
        orthant = (((cells.astype(np.int64) >> bit) & 1) << axes).sum(1)
        turned = rotate_left(orthant ^ entry, d - (direction + 1) % d)
        digit = turned.copy()
        step = 1
        while step < d:
            digit ^= digit >> step
            step *= 2
        keys = (keys << d) | digit
        # The corner at which the digit's cell is entered, and the axis it is crossed along.
        even = np.where(digit == 0, 0, 2 * ((digit - 1) // 2))
        corner = even ^ (even >> 1)
        flips = np.where(digit % 2 == 0, digit - 1, digit)
        trailing = np.zeros(n, np.int64)
        rest = flips.copy()
        open_ = digit > 0
        while (more := open_ & (rest & 1 == 1)).any():
            trailing += more
            rest = np.where(more, rest >> 1, 0)
        across = np.where(digit == 0, 0, trailing % d)
        entry ^= rotate_left(corner, direction + 1)
        direction = (direction + across + 1) % d
    return keys


def curve_frame(dim: int, c: Curves) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each curve its projection and shift."""
    rng = np.random.default_rng(c.seed)
    kept = min(c.coordinates, dim)
    return [(np.linalg.qr(rng.normal(size=(dim, dim)))[0][:, :kept], rng.uniform(-0.5, 0.5, kept)) for _ in range(c.curves)]


def place(points: np.ndarray, frame: tuple[np.ndarray, np.ndarray], scale: float, bits: int) -> np.ndarray:
    """Keys of points on a curve; ``scale`` is the usual size of a coordinate."""
    at = points @ frame[0] / scale + frame[1]
    even = 1 / (1 + np.exp(np.clip(-1.702 * at, -60, 60)))
    return hilbert_keys(np.minimum((even * (1 << bits)).astype(np.int64), (1 << bits) - 1), bits)


def in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of ``a`` with rows of ``b``, summed in the order of the components."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += a[:, k] * b[:, k]
    return total


class Blocks:
    """Classes in the order of a curve, cut into blocks with a centre, a radius and a longest vector each."""

    def __init__(self, points: np.ndarray, size: int):
        self.points = points
        self.cuts = np.append(np.arange(0, len(points), size), len(points))
        parts = [points[a:b] for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True)]
        self.centres = np.stack([p.mean(0) for p in parts])
        self.radius = np.array([np.sqrt(((p - c) ** 2).sum(1).max()) for p, c in zip(parts, self.centres, strict=True)])
        self.longest = np.array([np.sqrt((p * p).sum(1).max()) for p in parts])

    def reached(self, queries: np.ndarray, floors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Pairs (query, place) that may be among the ``k`` best or tie with them, and how many blocks were compared."""
        length = np.sqrt((queries * queries).sum(1))
        # Beyond what rounding can do to a product.
        slack = 1e-13 * queries.shape[1] * length[:, None] * self.longest
        bounds = queries @ self.centres.T + length[:, None] * self.radius + slack
        floors = floors.copy()
        who, where, value, met = [], [], [], 0
        for block, (a, b) in enumerate(zip(self.cuts[:-1], self.cuts[1:], strict=True)):
            asks = np.flatnonzero(~(bounds[:, block] < floors))
            if not len(asks):
                continue
            met += len(asks)
            near = queries[asks] @ self.points[a:b].T
            least = floors[asks] - slack[asks, block]
            many = np.flatnonzero((near >= least[:, None]).sum(1) > k)
            if len(many):
                # So many of this block's classes are a floor too.
                kth = np.partition(near[many], b - a - k, axis=1)[:, b - a - k]
                floors[asks[many]] = np.maximum(floors[asks[many]], kth - slack[asks[many], block])
                least = floors[asks] - slack[asks, block]
            q, at = np.nonzero(near >= least[:, None])
            who.append(asks[q])
            where.append(at + a)
            value.append(near[q, at] + slack[asks[q], block])
        if not who:
            return np.empty(0, np.int64), np.empty(0, np.int64), met
        who, where, value = np.concatenate(who), np.concatenate(where), np.concatenate(value)
        alive = value >= floors[who]
        return who[alive], where[alive], met


def _usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    exact = vectors.schema["embedding"].dataType.simpleString() in ("array<float>", "array<double>")
    vectors = vectors.select("vec_id", (F.col("embedding") if exact else F.col("embedding").cast("array<double>")).alias("embedding"))
    good = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    sizes = good.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dim = sizes[0]["d"] if sizes else 0
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = good.where((F.size("embedding") == dim) & ~bad & F.exists("embedding", lambda x: x != 0))
    return good.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector")), dim


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, c: Curves = Curves()) -> DataFrame:  # noqa: B008
    """For each row whose vec_id is divisible by ``every``, the ``k`` nearest: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    rows, dim = _usable(vectors)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not dim:
        return empty
    kind = rows.schema["vector"].dataType.simpleString()
    # A class needs its k + 1 smallest ids at most; the limit acts before the shuffle too.
    smallest = rows.distinct().withColumn("n", F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    classes = smallest.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    classes = common.materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "ann-classes")
    n = classes.count()
    if not n:
        return empty
    queries = common.hold(rows.where(F.col("vec_id") % every == 0).distinct().join(classes.select("vector", "cid"), "vector").select(F.col("vec_id").alias("query_id"), "cid"))
    asking = queries.select("cid").distinct().withColumn("asks", F.lit(True))
    searched = classes.select("cid", "vector", F.col("ids")[0].alias("first_id")).join(asking, "cid", "left").select("cid", "first_id", F.coalesce("asks", F.lit(False)).alias("asks"), "vector")
    bits = min(c.bits, 62 // min(c.coordinates, dim))

    def on_curves(which: range):
        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            frames = curve_frame(dim, c)
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = _matrix(batch.column(3), dim)
                x = x / np.abs(x).max(1, keepdims=True)
                x = x / np.sqrt((x * x).sum(1, keepdims=True))
                for curve in which:
                    keys = place(x, frames[curve], 1 / np.sqrt(dim), bits)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), curve), pa.int32()), pa.array(keys, pa.int64()), *batch.columns], names=["curve", "key", *batch.schema.names])

        return searched.mapInArrow(placed, f"curve int, key long, cid long, first_id long, asks boolean, vector {kind}")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        curve, cid, asks = (np.concatenate([b.column(at).to_numpy(zero_copy_only=False) for b in held]) for at in (0, 2, 4))
        points = np.concatenate([_matrix(b.column(5), dim) for b in held])
        cuts = np.flatnonzero(np.append(True, curve[1:] != curve[:-1]))
        for start, stop in zip(cuts, np.append(cuts[1:], len(curve)), strict=True):
            for a in range(start, stop, c.window):
                asked = a + np.flatnonzero(asks[a : min(a + c.window, stop)])
                first, last = max(start, a - c.window), min(a + 2 * c.window, stop)
                if not len(asked):
                    continue
                near = points[asked] @ points[first:last].T
                width = min(k + 1, last - first)
                best = np.argpartition(-near, width - 1, axis=1)[:, :width]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(cid[asked], width)), pa.array(cid[first:last][best].ravel()), pa.array(np.take_along_axis(near, best, 1).ravel())], names=["query", "cid", "score"])

    parts = max(common.shuffle_partitions(spark), -(-n * c.curves // c.part))
    ordered = on_curves(range(c.curves)).repartitionByRange(parts, "curve", "key", "cid").sortWithinPartitions("curve", "key", "cid")
    merged = ordered.mapInArrow(windows, "query long, cid long, score double").groupBy("query", "cid").agg(F.max("score").alias("score"))
    by_score = Window.partitionBy("query").orderBy(F.desc("score"), "cid")
    floors = merged.withColumn("n", F.row_number().over(by_score)).where(F.col("n") == k + 1).select(F.col("query").alias("cid"), F.col("score").alias("floor"))

    parts = max(1, min(-(-n // c.block), max(common.shuffle_partitions(spark), -(-n // c.part))))
    along = on_curves(range(1)).repartitionByRange(parts, "key", "cid").withColumn("part", F.spark_partition_id())
    along = common.materialize(along.select("part", F.lit(0).alias("role"), "key", "cid", "first_id", F.lit(0.0).alias("floor"), "vector"), "ann-blocks")
    asked = searched.where("asks").join(floors, "cid", "left").withColumns({"part": F.explode(F.sequence(F.lit(0), F.lit(parts - 1))), "role": F.lit(1), "key": F.lit(0).cast("long"), "floor": F.coalesce("floor", F.lit(float("-inf")))})
    both = along.unionByName(asked.select(*along.columns)).repartitionById(parts, F.col("part")).sortWithinPartitions("role", "key", "cid")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        blocks = None
        for batch in batches:
            asks = batch.column(0).to_numpy() == 1
            if not asks.all():
                held.append(batch.filter(pa.array(~asks)))
            if not asks.any() or not held:
                continue
            if blocks is None:
                # Classes come before queries, so all are here.
                cid, first = (np.concatenate([b.column(at).to_numpy() for b in held]) for at in (1, 2))
                blocks = Blocks(np.concatenate([_matrix(b.column(4), dim) for b in held]), c.block)
            batch = batch.filter(pa.array(asks))
            points = _matrix(batch.column(4), dim)
            who, where, _ = blocks.reached(points, batch.column(3).to_numpy(), k + 1)
            score = np.concatenate([in_order(points[who[at : at + 65536]], blocks.points[where[at : at + 65536]]) for at in range(0, len(who) or 1, 65536)])
            order = np.lexsort((first[where], -score, who))
            who, where, score = who[order], where[order], score[order]
            begin = np.flatnonzero(np.append(True, who[1:] != who[:-1])) if len(who) else who
            rank = np.arange(len(who)) - np.repeat(begin, np.diff(np.append(begin, len(who))))
            best = rank <= k
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(1).to_numpy()[who[best]], pa.int64()), pa.array(cid[where[best]], pa.int64()), pa.array(score[best], pa.float64())], names=["query", "cid", "score"])

    with common.arrow_rows(spark, 512):
        found = common.materialize(both.select("role", "cid", "first_id", "floor", "vector").mapInArrow(check, "query long, cid long, score double"), "ann-found")
    common.discard(along)
    ids = classes.select("cid", "ids", F.col("ids")[0].alias("first_id"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "first_id")
    top = found.join(ids, "cid").withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    each = top.select("query", "score", F.explode("ids").alias("vec_id"))
    each = each.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= k + 1)
    lists = each.select(F.col("query").alias("cid"), "score", "vec_id")
    answers = queries.join(lists, "cid").where("vec_id != query_id")
    final = answers.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return final.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(common.table("embeddings")(spark, sf_dir).select("vec_id", "embedding"))


_OP10 = """
WITH d AS (SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
m AS (SELECT len(v) AS dim FROM d GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
g AS (SELECT vec_id, v FROM d, m WHERE len(v) = dim AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score FROM g q, g c WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""

QUERIES = {"op10_neighbours": op10_neighbours}
ORACLE_SQL = {"op10_neighbours": _OP10}
