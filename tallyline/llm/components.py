"""Connected components of an edge table, without holding a component in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.sources.scratch import stored


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node of the undirected ``edges`` (a, b): root is the smallest node.

    Rounds of two steps turn the graph into stars: every node's larger neighbours move to its
    smallest one, then its smaller neighbours do. The number of rounds grows with the logarithm of
    the longest path. Minima are combined before they are shuffled, and each round is stored, so
    the joins on a node with very many neighbours can be split and a lost executor costs a re-read.
    """
    links = stored(
        edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "links",
    )
    before = None
    while True:
        after = _fingerprint(links)
        if after == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = after
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = stored(both.groupBy("a").agg(F.min("b").alias("m")), "lowest")
        large = (
            both.join(lowest, "a").where("b > a")
            .select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        )
        large = stored(large, "large-stars")
        lowest = stored(large.groupBy("a").agg(F.min("b").alias("m")), "lowest")
        moved = large.join(lowest, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = stored(moved.union(lowest.select("a", F.col("m").alias("b"))).distinct(), "small-stars")


def _fingerprint(links: DataFrame):
    mixed = F.xxhash64("a", "b")
    return links.agg(F.count("*"), F.bit_xor(mixed), F.sum(F.shiftright(mixed, 32))).first()
