"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hostwarden.session import shared_dir


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of every node to the least of them: the larger ones (large star) or the smaller ones."""
    u, v = F.col("u"), F.col("v")
    if large:
        sides = edges.unionByName(edges.select(v.alias("u"), u.alias("v")))
    else:
        sides = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = sides.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    linked = sides.join(least, "u")
    if large:
        moved = linked.filter(v > u).select(v.alias("u"), F.col("m").alias("v"))
    else:
        moved = linked.select(v.alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.filter(u != v).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the least node of its component) for every node of ``edges`` (u, v) except the roots.

    Each round is checkpointed, so a lost executor costs no earlier round, and only a
    row count and a checksum come to the driver. The number of rounds follows the
    logarithm of the longest chain.
    """
    shared_dir(edges.sparkSession)
    now = edges.filter("u <> v").distinct().checkpoint()
    state = None
    while True:
        now = _star(_star(now, large=True), large=False).checkpoint()
        # Wide sums of hashes can't overflow as decimals.
        after = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).head())
        if after == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = after
