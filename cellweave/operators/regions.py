"""Connected regions of cells (8 neighbours) and what is measured on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.operators.components import components
from cellweave.sources.shared import stored

#: Half of the eight, or four, neighbours; the others are met from the other side.
FORWARD = {8: ((0, 1), (1, -1), (1, 0), (1, 1)), 4: ((0, 1), (1, 0))}
SIDE_BITS = 24


def regions(mask: DataFrame, key: str | None = None, neighbours: int = 8) -> DataFrame:
    """r, c, region: cells and the least cell number (r * 2^32 + c) of their region. With key (a whole number below
    2^15), a column of mask: regions of each key's mask apart; key, r, c, region.

    Cells are linked to their neighbours and joined by star steps, whose number grows as the logarithm of a region's
    length. With key, rows and columns lie below 2^24.
    """
    keys = [key] if key else []
    number = F.col("r").cast("long") * (1 << 32) + F.col("c")
    node = F.col(key).cast("long") * (1 << 2 * SIDE_BITS) + F.col("r").cast("long") * (1 << SIDE_BITS) + F.col("c") if key else number
    cells = stored(mask.select(*keys, "r", "c").distinct().withColumns({"id": node, "cell": number}), "cells")
    step = F.explode(F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y, x in FORWARD[neighbours]]))
    near = cells.withColumn("o", step).select(*keys, F.col("id").alias("a"), (F.col("r") + F.col("o.y")).alias("r"), (F.col("c") + F.col("o.x")).alias("c"))
    links = near.join(cells.select(*keys, "r", "c", F.col("id").alias("b")).hint("merge"), [*keys, "r", "c"]).select("a", "b")
    roots = components(links).withColumnRenamed("node", "id").hint("merge")
    labelled = cells.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    if not key:
        return labelled.select("r", "c", F.col("root").alias("region"))
    low = F.pmod("root", F.lit(1 << 2 * SIDE_BITS))
    region = F.shiftright(low, SIDE_BITS) * (1 << 32) + F.pmod(low, F.lit(1 << SIDE_BITS))
    return labelled.select(key, "r", "c", region.alias("region"))


def region_sizes(found: DataFrame) -> DataFrame:
    box = [F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1")]
    return found.groupBy("region").agg(F.count("*").alias("px"), *box).withColumn("extent", F.greatest(F.col("r1") - F.col("r0"), F.col("c1") - F.col("c0")) + 1)


def drop_small(found: DataFrame, least: int) -> DataFrame:
    big = found.groupBy("region").count().where(F.col("count") >= least).select("region").hint("merge")
    return found.join(big, "region")


def novel_regions(found: DataFrame, near: DataFrame, least: int) -> DataFrame:
    """Sizes of regions of least cells or more, no cell of which is among near."""
    touched = found.join(near.select("r", "c"), ["r", "c"]).select("region").distinct().hint("merge")
    return region_sizes(found.join(touched, "region", "left_anti")).where(F.col("px") >= least)
