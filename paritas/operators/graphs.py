"""Connected components of many graphs at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paritas.session import cut_lineage


def components(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(*by, node, root): the smallest node of its component for every node of edges(*by, a, b).

    Each value of ``by`` is a graph of its own. Large and small stars take turns: neighbours move to
    the smallest node next to them, so that paths shorten geometrically and the number of rounds
    grows with the logarithm of the longest one. Every round is a written table; the first round that
    changes no edge is the last. Minima combine on the map side, and a busy node's rows are only
    joined, which Spark can split.
    """
    keys = list(by)

    def star(e: DataFrame, large: bool) -> DataFrame:
        ends = e.select(*keys, F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(*keys, "b", "a"))
        ends = ends if large else ends.filter("v < u")
        least = ends.groupBy(*keys, "u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        moved = ends.join(least, [*keys, "u"])
        out = (moved.filter("v > u") if large else moved).select(*keys, F.col("v").alias("x"), "m")
        out = out if large else out.union(least.select(*keys, F.col("u").alias("x"), "m"))
        return out.filter("x <> m").select(*keys, F.col("m").alias("a"), F.col("x").alias("b")).distinct()

    mark = (F.count("*"), F.bit_xor(F.xxhash64(*keys, "a", "b")))
    e = cut_lineage(edges.select(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    seen = e.agg(*mark).first()
    while seen[0]:
        e = cut_lineage(star(star(e, True), False))
        now = e.agg(*mark).first()
        if now == seen:
            break
        seen = now
    leaves = e.groupBy(*keys, "b").agg(F.min("a").alias("root")).withColumnRenamed("b", "node")
    return leaves.unionByName(e.select(*keys, F.col("a").alias("node"), F.col("a").alias("root")).distinct())
