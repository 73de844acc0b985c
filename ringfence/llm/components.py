"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ringfence.session import cut


def _both(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _with_least(near: DataFrame) -> DataFrame:
    """Neighbours of each node with the least of them and itself. Two aggregations by node, no list of neighbours."""
    least = near.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("least"))
    return near.join(least, "a")


def components(links: DataFrame) -> DataFrame:
    """node, component (its least node) for every node of ``links`` (a, b).

    A large-star step hangs the larger neighbours of a node on the least one, a small-star step the smaller ones;
    components become stars after about log^2 of their size steps. Every step ends in a written table.
    """
    links = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        large = _with_least(_both(links)).filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        # a large-star step keeps links of a node with its least one through the other end
        large = large.filter("a <> b").distinct()
        near = _with_least(large)
        small = near.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(near.select("a", F.col("least").alias("b")))
        links = cut(small.filter("a <> b").distinct(), "links")
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    own = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(own)
