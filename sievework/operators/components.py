"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.storage import materialise


def _lowest(pairs: DataFrame) -> DataFrame:
    """Per `u` the lowest of itself and its neighbours `v`, of at least one."""
    return pairs.groupBy("u").agg(F.least("u", F.min("v")).alias("low"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each larger neighbour of a node to the node's lowest neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    linked = both.where("v > u").join(_lowest(both), "u")
    return linked.select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the lowest of them."""
    low = _lowest(edges)
    linked = edges.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    own = low.select("u", F.col("low").alias("v"))
    return linked.unionByName(own).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """`node` and the lowest node of its component as `root`, for all nodes with
    an edge that are not roots. `edges(u, v)` are pairs of longs.

    Large-star and small-star rounds: each is one aggregate and one join, and
    their number grows with the logarithm of the longest chain. A node with very
    many neighbours is one pre-aggregated minimum, and its rows can be split in
    the join. No edge reaches the driver, which only sees a count and a checksum.
    """
    ordered = edges.where("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    stars = materialise(ordered.distinct(), "edges")
    before = None
    while True:
        state = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before or not state[0]:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = tuple(state)
        stars = materialise(_small_star(_large_star(stars)), "edges")
