"""Packing: padding-optimal length buckets and token-budget batches.

Lengths are counted over the whole table, and the counts of distinct lengths
reach the driver: as many as the longest document has words at most, however
many documents there are.  Dynamic programming over this histogram chooses the
bucket limits with the least padding of all.  Inside a bucket, documents in
hashed order fill batches of as many as the token budget holds at the bucket's
length; a document longer than the budget is a batch of its own.

Places in a bucket come in two levels, counts of ranges of the hash and places
in a range, and the number of ranges grows with the rows, so no group does.
Rows that are alike are one row with a count until each gets its place, and
then in pieces of ``COPIES``, so copies of one row spread as well.

Defined cases: a null text has no words and length 0; repeated rows each get a
place, and rows alike in doc_id and text come in the order of a hash of their
other columns; an empty table gives an empty result; other columns are kept by
``pack`` unless an output has their name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.llm import common

BUCKETS = 16
BUDGET = 16_384
RANGE_ROWS = 50_000
#: Copies of a row that are given their places together, at most.
COPIES = 50_000


def best_limits(lengths: list[int], counts: list[int], buckets: int = BUCKETS) -> list[int]:
    """Upper limits, ascending, of at most ``buckets`` buckets of the ascending ``lengths`` with the least padding in all.

    With one bucket more, the padded total of the first j lengths is the least
    of total(i) + lengths[j - 1] * (documents from i to j) over i.  In
    lengths[j - 1] these are lines, flatter for a later i, so the lines that
    are least somewhere are kept in order and each is left behind for good.
    All in whole numbers.
    """
    n = len(lengths)
    if not n:
        return []
    upto = [0]
    for c in counts:
        upto.append(upto[-1] + c)
    total = [0, *(size * m for size, m in zip(lengths, upto[1:], strict=True))]
    came: list[list[int]] = []
    for _ in range(1, min(buckets, n)):
        new, start = [0] * (n + 1), [0] * (n + 1)
        lines: list[int] = []
        at = 0
        for j in range(1, n + 1):
            i = j - 1
            while len(lines) - at >= 2:
                a, b = lines[-2], lines[-1]
                # The last line is nowhere below both its neighbours.
                if (total[i] - total[a]) * (upto[b] - upto[a]) <= (total[b] - total[a]) * (upto[i] - upto[a]):
                    lines.pop()
                else:
                    break
            lines.append(i)
            size = lengths[j - 1]
            while at + 1 < len(lines) and total[lines[at + 1]] - size * upto[lines[at + 1]] < total[lines[at]] - size * upto[lines[at]]:
                at += 1
            start[j] = lines[at]
            new[j] = total[lines[at]] + size * (upto[j] - upto[lines[at]])
        if new[n] >= total[n]:
            break
        came.append(start)
        total = new
    limits = [lengths[n - 1]]
    at = n
    for start in reversed(came):
        at = start[at]
        if at == 0:
            break
        limits.append(lengths[at - 1])
    return sorted(set(limits))


def histogram(lengths: DataFrame, count: str = "copies") -> tuple[list[int], list[int]]:
    """The distinct lengths, ascending, and how many documents have each."""
    rows = lengths.groupBy("length").agg(F.sum(count).alias("n")).orderBy("length").collect()
    return [r["length"] for r in rows], [r["n"] for r in rows]


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, text: str = "text") -> DataFrame:
    """doc_id, length (words), bucket, bucket_length, batch and slot of each row, and the other columns but the text."""
    outputs = ("length", "bucket", "bucket_length", "batch", "slot")
    others = [c for c in docs.columns if c not in (text, *outputs)]
    slim = docs.select(F.struct(*others).alias("row"), common.word_count(F.col(text)).alias("length"), common.row_key(text).alias("_hash"))
    if "map<" in slim.schema["row"].dataType.simpleString():
        # Maps can't be grouped by.
        slim = slim.withColumns({"copies": F.lit(1).cast("long"), "_tie": F.xxhash64("length")})
    else:
        slim = slim.groupBy("row", "length", "_hash").agg(F.count("*").alias("copies")).withColumn("_tie", F.xxhash64("row"))
    slim = common.hold(slim)
    limits = best_limits(*histogram(slim), buckets)
    if not limits:
        return slim.select("row.*", "length", *(F.lit(0).cast("long").alias(c) for c in outputs[1:]))
    bucket = sum((F.when(F.col("length") > x, 1).otherwise(0) for x in limits[:-1]), F.lit(0)).cast("long")
    ranges = max(64, slim.agg(F.sum("copies")).first()[0] // RANGE_ROWS)
    rows = slim.withColumns({"bucket": bucket, "_range": common.hash_range(F.col("_hash"), ranges)})
    counts = rows.groupBy("bucket", "_range").agg(F.sum("copies").alias("n"))
    before = Window.partitionBy("bucket").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("bucket", "_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    order = Window.partitionBy("bucket", "_range").orderBy("_hash", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("_place", F.sum("copies").over(order) - F.col("copies")).join(offsets, ["bucket", "_range"]).withColumn("_place", F.col("_place") + F.col("_before"))
    pieces = placed.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES)))).repartition("bucket", "_place", "_piece")
    first = F.col("_piece") * COPIES
    placed = pieces.withColumn("_copy", F.explode(F.sequence(first, F.least(first + COPIES, F.col("copies")) - 1))).withColumn("_place", F.col("_place") + F.col("_copy"))
    limit = F.element_at(F.array(*(F.lit(x).cast("long") for x in limits)), (F.col("bucket") + 1).cast("int"))
    holds = F.greatest(F.floor(F.lit(budget) / F.greatest("bucket_length", F.lit(1))), F.lit(1))
    placed = placed.withColumn("bucket_length", limit)
    return placed.select("row.*", "length", "bucket", "bucket_length", F.floor(F.col("_place") / holds).alias("batch"), (F.col("_place") % holds).alias("slot"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table("documents")(spark, sf_dir).select("doc_id", "text"))


_OP8 = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(md5(text), '')) AS k,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS length FROM documents),
x AS (SELECT length, row_number() OVER (ORDER BY length) AS j, CAST(sum(count(*)) OVER (ORDER BY length) AS BIGINT) AS upto FROM d GROUP BY length),
p AS (SELECT 0 AS j, 0 AS length, 0 AS upto UNION ALL SELECT j, length, upto FROM x),
t(layer, j, total, start) AS (SELECT 1, j, length * upto, 0 FROM p
    UNION ALL SELECT t.layer + 1, y.j, min(t.total + y.length * (y.upto - p.upto)), arg_min(t.j, [t.total + y.length * (y.upto - p.upto), t.j])
    FROM t JOIN p ON p.j = t.j JOIN p y ON t.j < y.j OR (t.j = 0 AND y.j = 0) WHERE t.layer < {BUCKETS} GROUP BY t.layer, y.j),
m AS (SELECT max(j) AS m FROM x),
e AS (SELECT t.layer, total, lag(total) OVER (ORDER BY t.layer) AS before FROM t, m WHERE j = m AND t.layer <= m),
k AS (SELECT coalesce(min(layer) FILTER (WHERE total >= before) - 1, max(layer)) AS k FROM e),
w(layer, j) AS (SELECT k, m FROM k, m UNION ALL SELECT w.layer - 1, t.start FROM w JOIN t ON t.layer = w.layer AND t.j = w.j WHERE w.layer > 1 AND t.start > 0),
b AS (SELECT x.length AS bucket_length, row_number() OVER (ORDER BY x.length) - 1 AS bucket, coalesce(lag(x.length) OVER (ORDER BY x.length), -1) AS above FROM (SELECT DISTINCT j FROM w) JOIN x USING (j)),
q AS (SELECT doc_id, length, bucket, bucket_length, row_number() OVER (PARTITION BY bucket ORDER BY k, rid) - 1 AS place, greatest({BUDGET} // greatest(bucket_length, 1), 1) AS holds FROM d JOIN b ON length > above AND length <= bucket_length)
SELECT doc_id, length, bucket, bucket_length, place // holds AS batch, place % holds AS slot FROM q"""

QUERIES = {"op8_packing": op8_packing}
ORACLE_SQL = {"op8_packing": _OP8}
