"""Connected components of an edge list by alternating large stars and small stars.

Every round hangs each node's neighbours on the smallest node it knows. A round
is one staged job, so a lost executor rereads files. No node's neighbours are
ever gathered: the smallest one is an aggregate with map-side combine, joined
back to the edges, and adaptive execution splits the join where a node is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lakeward.session import stage


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of u move to the smallest node among u and its neighbours."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("_m"))
    # Staged, so that the join has two plain shuffles and the side of a hot node is split.
    least = stage(least, "least")
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("_m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of u, and u itself, move to the smallest of them (edges have u > v)."""
    least = edges.groupBy("u").agg(F.min("v").alias("_m"))
    moved = edges.join(least, "u").where("v <> _m").select(F.col("v").alias("u"), F.col("_m").alias("v"))
    return moved.unionAll(least.select("u", F.col("_m").alias("v"))).distinct()


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """``node, component`` for every node of ``edges``; the component is its smallest node.

    Self links and repeated links do no harm; null ends are ignored. Runs Spark
    jobs while it is called (one per round, about the logarithm of the longest
    chain), and returns a frame over staged files.
    """
    pairs = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
    pairs = pairs.where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col("u") > F.col("v")))
    stars, before = stage(pairs.distinct(), "edges"), None
    while True:
        seen = stars.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if seen == before or not seen[0]:
            break
        before = seen
        stars = stage(_small_star(_large_star(stars)), "stars")
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
