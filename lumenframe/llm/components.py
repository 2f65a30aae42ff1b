"""Connected components by alternating star contractions, all in DataFrame operations.

A star's centre may hold a large share of all links.  Its smallest neighbour is
found by an aggregation that starts before the shuffle, and links meet that by
``common.split_join``, whose hot groups Spark deals over several tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm import common


#: Links in a file of a round.
FILE_LINKS = 100_000


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return common.split_join(both.where("b > a"), least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the smallest of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = common.split_join(down, least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select("a", F.col("m").alias("b"))
    return moved.unionByName(own).where("a != b").distinct()


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Links (a, b), as a table that is cheap to read, to (cid, comp) for each linked node, ``comp`` the smallest node of its component.

    A round costs a few shuffles of the links; the number of rounds grows with
    the logarithm of a component's size.  Each round is written to the shared
    folder, in as many files as its links need, so a lost executor costs no
    more than the round.
    """
    edges = links.where("a != b")
    state = None
    n = edges.count()
    for _ in range(most_rounds):
        now = common.materialize(_small_star(_large_star(edges)).coalesce(1 + n // FILE_LINKS), "links")
        found = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state is not None:
            common.discard(edges)
        edges, n = now, found[0]
        if found == state:
            return edges.select(F.col("a").alias("cid"), F.col("b").alias("comp"))
        state = found
    raise RuntimeError("components did not settle")
