"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.llm.common import settle


def _least(edges: DataFrame) -> DataFrame:
    """Least neighbour (or itself) of every left end; combined before the shuffle, so hubs stay cheap."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` (the least node of its component) for every end of ``edges(u, v)``.

    Loops and repeated edges do no harm; an edge with a null end is left out; no edges, no rows.
    Both tables of each join are settled, so skewed hubs can be split at run time.
    """
    edges = settle(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        both = settle(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        large = settle(both.join(settle(_least(both)), "u").where("v > u and v <> m")
                       .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = settle(_least(large))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = settle(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        # Xor-free fingerprint of the edge set: equal count and sum twice in a row means the stars are stable.
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
