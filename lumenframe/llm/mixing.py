"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a hash.  A document's virtual finish
time is the number of its source's words up to its end, divided by the source's
target; a source with a target above its size starts over in the same order.
All entries are sorted by virtual finish time over the whole corpus and served
whole, until the total budget is reached; the one that passes it is cut at that
word.  Targets add up to the budget, so at its end each source has its target
but for a document or so.

Rows alike in doc_id, source and text are copies: one entry with a count, up to
the point where each gets its own turn, and then in pieces of ``COPIES``, so a
group of copies of any size spreads.  Running totals come in two levels: totals
of ranges of the shuffled order (or of virtual time), added up over the ranges,
and running sums inside a range.  The number of ranges grows with the rows, so
no group does, however many of the rows one source holds.  All of it is native.

Defined cases: a null text has no words; a null source is a source, the last;
null doc_ids are shuffled by their texts; documents without words take part
with nothing taken; an empty table gives an empty result; other columns are
kept by ``mix`` and clash with nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.llm import common

WEIGHTS = (3, 1, 2)
#: Rows that a range holds on average.
RANGE_ROWS = 50_000
#: Copies of a row that are given their turns together, at most.
COPIES = 50_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets of sources (sk, source, source_size): ``share`` of all words by weight, each at most ``most`` times its source.

    What is above a limit is shared again by weight.  In order of limit over
    weight, a source is at its limit if that is no more than the level that
    the sources from it on would have; the first above it sets the level.
    """
    n = len(weights)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    place = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % n + 1).cast("int")).cast("double")
    rows = sizes.withColumns({"weight": weight, "limit": F.lit(float(most)) * F.col("source_size"), "budget": F.lit(float(share)) * F.sum("source_size").over(everything)})
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    used = F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumns({"level": (F.col("budget") - used) / left, "place": F.row_number().over(order)})
    free = F.col("limit") / F.col("weight") > F.col("level")
    level = F.min(F.when(free, F.struct("place", "level"))).over(everything)["level"]
    target = F.coalesce(F.least("limit", F.col("weight") * level), F.col("limit"))
    return rows.select("sk", "source_size", target.alias("target"), F.floor("budget").alias("budget"))


def _keys(text: str) -> dict[str, Column]:
    return {
        "sk": F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), "source")),
        "key": common.row_key(text),
    }


def schedule(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, text: str = "text") -> DataFrame:
    """All turns of ``docs`` (doc_id, source, text) in the mix, ``ceil(most)`` for each row with words and one for each without.

    Returns doc_id, sk and key (which name a row but for its copies), copy,
    size, source_size, target, turn, finish (virtual) and taken (words, after
    the cut at the total budget).
    """
    each = docs.select("doc_id", "source", *(c.alias(k) for k, c in _keys(text).items()), common.word_count(F.col(text)).alias("size"))
    slim = each.groupBy("sk", "key").agg(F.max("doc_id").alias("doc_id"), F.max("source").alias("source"), F.max("size").alias("size"), F.count("*").alias("copies"))
    slim = common.materialize(slim, "mix-sizes")
    ranges = max(256, (slim.agg(F.sum("copies")).first()[0] or 0) // RANGE_ROWS)
    slim = slim.withColumns({"r": common.hash_range(F.col("key"), ranges), "words": F.col("size") * F.col("copies")})
    totals = slim.groupBy("sk", "r").agg(F.max("source").alias("source"), F.sum("words").alias("words"))
    targets = source_targets(totals.groupBy("sk").agg(F.max("source").alias("source"), F.sum("words").alias("source_size")), weights, share, most)
    earlier = Window.partitionBy("sk").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("sk", "r", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("before")).join(targets, "sk")

    inside = Window.partitionBy("sk", "r").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    placed = slim.withColumn("upto", F.sum("words").over(inside)).join(offsets, ["sk", "r"]).withColumn("begin", F.col("before") + F.col("upto") - F.col("words"))
    pieces = placed.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES)))).repartition("sk", "key", "piece")
    first = F.col("piece") * COPIES
    entries = pieces.withColumn("copy", F.explode(F.sequence(first, F.least(first + COPIES, F.col("copies")) - 1)))
    turns = F.when(F.col("size") > 0, F.sequence(F.lit(0), F.lit(int(-(-most // 1)) - 1))).otherwise(F.array(F.lit(0)))
    entries = entries.withColumn("turn", F.explode(turns))
    end = F.col("turn") * F.col("source_size") + F.col("begin") + (F.col("copy") + 1) * F.col("size")
    entries = entries.withColumn("finish", F.when(F.col("target") > 0, end / F.col("target")).otherwise(0.0))
    entries = common.hold(entries.select("doc_id", "sk", "key", "copy", "size", "source_size", "target", "budget", "turn", "finish"))

    served = entries.where("size > 0").withColumn("v", F.floor(F.col("finish") * ranges))
    by_time = served.groupBy("v").agg(F.sum("size").alias("words"))
    before_v = by_time.select("v", F.coalesce(F.sum("words").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    in_time = Window.partitionBy("v").orderBy("finish", "sk", "key", "copy", "turn").rowsBetween(Window.unboundedPreceding, 0)
    sorted_ = served.withColumn("upto", F.sum("size").over(in_time)).join(before_v, "v")
    passed = F.col("before") + F.col("upto") - F.col("size")
    columns = ("doc_id", "sk", "key", "copy", "size", "source_size", "target", "turn", "finish")
    timed = sorted_.select(*columns, F.greatest(F.lit(0), F.least("size", F.col("budget") - passed)).alias("taken"))
    return timed.unionByName(entries.where("size = 0").select(*columns, F.lit(0).cast("long").alias("taken")))


def first_words(text: Column, n: Column) -> Column:
    """The first ``n`` words of ``text`` with the white space before and between them."""
    pieces = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    return F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), "")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, text: str = "text") -> DataFrame:
    """The mix itself: a row of ``docs`` for each turn taken, in order of virtual finish time, the last cut.

    A document without words is kept once.  Rows alike in doc_id, source and
    text take their other columns from one of them.
    """
    entries = schedule(docs, weights, share, most, text).where((F.col("taken") > 0) | (F.col("size") == 0))
    keys = ["key", "sk"]
    named = docs.select(F.struct(*docs.columns).alias("row"), *(c.alias(k) for k, c in _keys(text).items()))
    once = named.groupBy(*keys).agg(F.first("row").alias("row"))
    joined = once.join(entries.select(*keys, "size", "finish", "taken", "turn"), keys)
    body = F.col("row")[text]
    cut = F.when(F.col("taken") < F.col("size"), first_words(body, F.col("taken"))).otherwise(body)
    ordered = joined.withColumn("cut", cut).repartitionByRange(common.shuffle_partitions(docs.sparkSession), "finish", "key", "turn").sortWithinPartitions("finish", "key", "turn")
    return ordered.select(*(F.col("cut").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table("documents")(spark, sf_dir).select("doc_id", "source", "text")
    return (
        schedule(docs)
        .groupBy("sk", "key", "copy")
        .agg(F.max("doc_id").alias("doc_id"), F.max("size").alias("size"), F.max("source_size").alias("source_size"), F.max("target").alias("target"), F.sum("taken").alias("taken"))
        .select("doc_id", "size", "source_size", "target", "taken")
    )


_OP7 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(md5(text), '')) AS k,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS DOUBLE) AS weight, 2e0 * source_size AS lim, 15e-1 * CAST(sum(source_size) OVER () AS BIGINT) AS budget FROM s),
l AS (SELECT *, row_number() OVER o AS place, (budget - coalesce(sum(lim) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0))
    / sum(weight) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w WINDOW o AS (ORDER BY lim / weight, source NULLS LAST)),
f AS (SELECT arg_min(level, place) AS level FROM l WHERE lim / weight > level),
t AS (SELECT source, source_size, budget, coalesce(least(lim, weight * (SELECT level FROM f)), lim) AS target FROM l),
p AS (SELECT d.*, t.source_size, t.target, t.budget, CAST(sum(size) OVER (PARTITION BY d.source ORDER BY k, rid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
h AS (SELECT *, CASE WHEN target > 0 THEN (turn * source_size + upto) / target ELSE 0e0 END AS finish FROM p, (VALUES (0), (1)) v(turn)),
c AS (SELECT *, CAST(sum(size) OVER (ORDER BY finish, CASE WHEN source IS NULL THEN '' ELSE '=' || source END, k, rid, turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - size AS passed FROM h)
SELECT any_value(doc_id) AS doc_id, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target,
    CAST(sum(greatest(0, least(size, CAST(floor(budget) AS BIGINT) - passed))) AS BIGINT) AS taken FROM c GROUP BY rid"""

QUERIES = {"op7_mixing": op7_mixing}
ORACLE_SQL = {"op7_mixing": _OP7}
