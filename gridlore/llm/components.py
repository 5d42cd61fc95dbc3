"""Connected components of a graph given by its links, by alternating stars.

Each round replaces links by shorter ones: every node's larger neighbours are tied to its
smallest neighbour, then its smaller ones. Neighbour lists are never collected: a node's
smallest neighbour is a partial aggregate, joined back to its links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridlore.llm.store import keep


def _tied(links: DataFrame, larger: bool) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else links
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("m", "a").alias("m"))
    joined = both.join(least, F.col("a") == F.col("u"))
    if larger:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            joined.select("a", F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component): the smallest node each linked node is connected with, itself included.

    Loops and repeated links are ignored; null ends are dropped; no links give no rows. The
    number of rounds grows with the logarithm of the longest path.
    """
    a, b = F.col(left), F.col(right)
    links = links.where(a.isNotNull() & b.isNotNull() & (a != b)).select(
        F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    links, sign = keep(links, "stars"), None
    while True:
        mark = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if mark[0] == 0 or mark == sign:
            break
        sign = mark
        links = keep(_tied(_tied(links, True), False), "stars")
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots).distinct()
