"""Connected components of a table of links."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from locigrid.llm.common import stored


def _digest(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _large_star(links: DataFrame) -> DataFrame:
    """Each node gives its larger neighbours the least of its neighbourhood."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = stored(both.groupBy("a").agg(F.min("b").alias("low")), "least")
    out = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.least("low", "a").alias("b"))
    return out.distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node gives its smaller neighbours, and itself, the least of them; links go from larger to smaller."""
    least = stored(links.groupBy("a").agg(F.min("b").alias("low")), "least")
    moved = links.join(least, "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.union(least.select("a", F.col("low").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """node and label of every node of ``links`` (a, b); the label is the least node it can reach.

    Stars around the least node are formed in turn on both sides of the nodes
    until the links no longer change. Minima are aggregated, and written, before
    they are joined back, so that the join can split a node with very many links.
    Each round is written too, and a lost executor repeats at most one.
    """
    now = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = stored(now, "links")
    before = _digest(now)
    while before[0]:
        now = stored(_small_star(_large_star(now)), "links")
        after = _digest(now)
        if after == before:
            break
        before = after
    own = now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(own)
