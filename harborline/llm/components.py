"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.session import materialise


def _signature(links: DataFrame) -> tuple:
    digest = F.xxhash64("a", "b").cast("decimal(38,0)")
    row = links.agg(F.count(F.lit(1)).alias("n"), F.sum(digest).alias("digest")).first()
    return row.n, row.digest


def least_members(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the least node its component reaches, for every linked node.

    Links (a, b) are turned into stars around the least node known, first towards
    all greater neighbours, then among the smaller ones, until they stay the same;
    the number of rounds grows with the logarithm of the longest path. Every round
    is written to the shared folder. Least neighbours are found by aggregation and
    joined back, so a node with very many links is never gathered in one place.
    """
    pairs = links.where("a <> b")
    current = materialise(
        pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "links",
    )
    before = _signature(current)
    while before[0]:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("low"))
        least = least.select("a", F.least("a", "low").alias("low"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = materialise(large.where("a <> b").distinct(), "large-stars")
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        centres = least.select("a", F.col("low").alias("b"))
        current = materialise(small.unionByName(centres).distinct(), "small-stars")
        after = _signature(current)
        if after == before:
            break
        before = after
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
