"""Connected components of a link table by large-star and small-star rounds.

Each round is two aggregations and two joins over the links; the number of
rounds grows with the logarithm of the longest chain.  Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlake.llm.common import Scratch


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One star step on links (a > b): hook every neighbour of a node to the least one around it."""
    both = (links.select(F.col("a").alias("u"), F.col("b").alias("v"))
            .unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))) if large else \
        links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    j = both.join(least, "u")
    if large:
        out = j.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = j.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``links`` (a, b: long) to (node, comp): the least node reachable.

    Nodes without a link have no row.  Runs until a round changes nothing.
    """
    cur = scratch.keep(links.filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    sign = None
    while True:
        nxt = scratch.keep(_star(_star(cur, True), False))
        # a star forest maps to itself: same links, so the same count and checksum
        now = nxt.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.free(cur)
        cur = nxt
        if tuple(now) == sign:
            break
        sign = tuple(now)
    return cur.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(
        cur.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())
