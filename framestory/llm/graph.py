"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framestory.session import cut_lineage


def _signature(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node with an edge; ``root`` is the smallest node that it reaches.

    Alternating large-star and small-star rounds: each round hangs neighbours on
    the smallest node known, so the number of rounds grows with the logarithm of
    the size.  Only minima meet edges, so a node with very many edges is split by
    the skew join; each round is written to the checkpoint folder.
    """
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = cut_lineage(e)
    seen = None
    while (now := _signature(e)) != seen:
        seen = now
        if now[0] == 0:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("_m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("_m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("_m"))
        small = large.join(low, "u").where("v <> _m").select(F.col("v").alias("u"), F.col("_m").alias("v"))
        e = cut_lineage(small.unionByName(low.select("u", F.col("_m").alias("v"))).distinct())
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
