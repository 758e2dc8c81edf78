"""Connected components of a graph of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.sources.shared import stored


def star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (u, v) with u > v. The least neighbour of a node with many is a partial aggregate.

    The least neighbours are written before they meet the edges, so that adaptive execution can split the edges of a
    node with very many.
    """
    both = edges if not large else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    least = stored(least, "least").hint("merge")  # a row for each node: its files are small, a broadcast of it is not
    joined = both.join(least, "u")
    if large:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node and root (the least node of its component) for links (a, b) of longs; roots themselves are left out.

    Each round is written to the shared folder. The rounds needed grow as the logarithm of the longest chain.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges, seen = stored(edges, "edges"), None
    for _ in range(rounds):
        edges = stored(star(stored(star(edges, True), "middle"), False), "edges")
        now = edges.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")).first()
        if seen == now:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
    raise RuntimeError("components have not settled")
