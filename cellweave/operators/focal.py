"""Focal operators on grids (r, c, v). Neighbours are met by equi-joins on shifted cells.

Border cells repeat the nearest cell (square windows) or use one-sided differences (gradients), as on dense rasters;
a grid with holes has windows over the cells that are there.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.operators.kernels import over_tiles
from cellweave.operators.stats import histogram, quantiles
from cellweave.sources.shared import stored


def dense(grid: DataFrame, value: str = "v", fill: float = 0.0) -> DataFrame:
    """Every cell of the grid's bounding box, with valid; holes have the fill."""
    box = grid.agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    cells = box.select("c0", "c1", F.explode(F.sequence("r0", "r1")).alias("r")).select("r", F.explode(F.sequence("c0", "c1")).alias("c"))
    return cells.join(grid.select("r", "c", F.col(value).alias("v")), ["r", "c"], "left").select("r", "c", F.coalesce("v", F.lit(fill)).alias("v"), F.col("v").isNotNull().alias("valid"))


def axis_gradient(value: str, along: str, across: str, step: float) -> Column:
    """Central differences inside, one-sided at both ends of a dense row."""
    w = Window.partitionBy(across).orderBy(along)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    return F.when(before.isNull(), (after - F.col(value)) / step).when(after.isNull(), (F.col(value) - before) / step).otherwise((after - before) / (2 * step))


def gradients(grid: DataFrame, step: float = 100.0) -> DataFrame:
    return grid.withColumn("gy", axis_gradient("v", "r", "c", step)).withColumn("gx", axis_gradient("v", "c", "r", step))


def slope_of() -> Column:
    """Degrees, from gradients."""
    return F.degrees(F.atan(F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))))


def slope(grid: DataFrame, step: float = 100.0) -> DataFrame:
    return gradients(grid, step).withColumn("slope", slope_of())


def second_gradients(grid: DataFrame, step: float) -> DataFrame:
    """grid, which has gradients, with curvature."""
    return grid.withColumn("gyy", axis_gradient("gy", "r", "c", step)).withColumn("gxx", axis_gradient("gx", "c", "r", step)).withColumn("curvature", F.col("gxx") + F.col("gyy"))


def curvature(grid: DataFrame, step: float = 100.0) -> DataFrame:
    return second_gradients(gradients(grid, step), step)


def shade_of(azimuth: float = 315.0, altitude: float = 45.0) -> Column:
    """From gradients, as defined on rasters whose first gradient is that of the rows."""
    x, y = F.col("gy"), F.col("gx")
    s = math.pi / 2 - F.atan(F.sqrt(x * x + y * y))
    aspect, az, alt = F.atan2(-x, y), math.radians(360.0 - azimuth), math.radians(altitude)
    shade = math.sin(alt) * F.sin(s) + math.cos(alt) * F.cos(s) * F.cos(F.lit(az - math.pi / 2) - aspect)
    return 255 * (shade + 1) / 2


def hillshade(grid: DataFrame, azimuth: float = 315.0, altitude: float = 45.0, step: float = 100.0) -> DataFrame:
    return gradients(grid, step).withColumn("shade", shade_of(azimuth, altitude))


def window_sums(grid: DataFrame, half: int, columns: dict[str, Column]) -> DataFrame:
    """r, c and, for each named expression, its sum over the square window with the border repeated.

    Separable: each cell gives its row sums to neighbours in its row, then those go to neighbours in its column; a
    neighbour beyond the border counts as the border's cell.
    """
    box = grid.agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    g = grid.select("r", "c", *[e.alias(n) for n, e in columns.items()]).crossJoin(F.broadcast(box))
    for axis, low, high in (("c", "c0", "c1"), ("r", "r0", "r1")):
        other = "r" if axis == "c" else "c"
        weight = F.when((F.col(low) == F.col(high)), 2 * half + 1)
        to = F.explode(F.sequence(F.greatest(F.col(low), F.col(axis) - half), F.least(F.col(high), F.col(axis) + half)))
        moved = g.withColumn("to", to)
        times = (
            weight.when(F.col(axis) == F.col(low), F.greatest(F.lit(0), F.col(low) - (F.col("to") - half)) + 1)
            .when(F.col(axis) == F.col(high), F.greatest(F.lit(0), (F.col("to") + half) - F.col(high)) + 1)
            .otherwise(1)
        )
        sums = [F.sum(F.col(n) * F.col("k")).alias(n) for n in columns]
        g = moved.withColumn("k", times).groupBy(other, F.col("to").alias(axis)).agg(*sums, *[F.first(x).alias(x) for x in ("r0", "r1", "c0", "c1")])
    return g.drop("r0", "r1", "c0", "c1")


def window_stats(grid: DataFrame, size: int) -> DataFrame:
    """r, c, mean, std over valid cells of the window; 0 where half of it or more is missing, null where the cell is."""
    v = F.when(F.col("valid"), F.col("v")).otherwise(0.0)
    s = window_sums(grid, size // 2, {"n": F.col("valid").cast("double"), "s1": v, "s2": v * v})
    area = float(size * size)
    enough = F.col("n") / area > 0.5
    mean = F.col("s1") / F.col("n")
    var = F.greatest(F.lit(0.0), F.col("s2") / F.col("n") - mean * mean)
    out = grid.select("r", "c", "valid").join(s, ["r", "c"])
    return out.select("r", "c", *[F.when(F.col("valid"), F.when(enough, x).otherwise(0.0)).alias(a) for x, a in ((mean, "mean"), (F.sqrt(var), "std"))])


def tpi(grid: DataFrame, radius: int = 3) -> DataFrame:
    s = window_sums(grid, radius, {"s": F.col("v")})
    return grid.join(s, ["r", "c"]).withColumn("tpi", F.col("v") - F.col("s") / float((2 * radius + 1) ** 2)).drop("s")


def tri(grid: DataFrame) -> DataFrame:
    """The mean of nine absolute differences, the cell's own among them, with the border repeated."""
    box = grid.agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    step = F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y in (-1, 0, 1) for x in (-1, 0, 1)])
    asked = grid.crossJoin(F.broadcast(box)).withColumn("o", F.explode(step))
    asked = asked.select(
        "r", "c", "v", F.least("r1", F.greatest("r0", F.col("r") + F.col("o.y"))).alias("nr"), F.least("c1", F.greatest("c0", F.col("c") + F.col("o.x"))).alias("nc")
    )
    other = grid.select(F.col("r").alias("nr"), F.col("c").alias("nc"), F.col("v").alias("nv"))
    return asked.join(other, ["nr", "nc"]).groupBy("r", "c").agg((F.sum(F.abs(F.col("nv") - F.col("v"))) / 9).alias("tri"))


def tpi_of(a: np.ndarray, radius: int = 3) -> np.ndarray:
    """tpi of a whole array without holes."""
    side, wide = 2 * radius + 1, np.pad(a, radius, mode="edge")
    across = sum(wide[:, i : i + a.shape[1]] for i in range(side))
    return a - sum(across[i : i + a.shape[0]] for i in range(side)) / float(side**2)


def tri_of(a: np.ndarray) -> np.ndarray:
    """tri of a whole array without holes."""
    wide = np.pad(a, 1, mode="edge")
    return sum(np.abs(wide[y : y + a.shape[0], x : x + a.shape[1]] - a) for y in range(3) for x in range(3)) / 9


def filled(grid: DataFrame) -> DataFrame:
    """r, c, v, valid of every cell of the bounding box of grid (r, c, v); holes have the median. Tasks share the rows of the box, and
    the median comes from counts of values, of which a task ranks a bucket: no task holds all of either."""
    cells = stored(grid.select("r", "c", "v"), "cells")
    box = cells.agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1")).first()
    kind = {x: cells.schema[x].dataType for x in ("r", "c")}
    rows = cells.sparkSession.range(*((0,) if box.r0 is None else (box.r0, box.r1 + 1))).select(F.col("id").cast(kind["r"]).alias("r"))
    everywhere = rows.select("r", F.explode(F.sequence(F.lit(box.c0).cast(kind["c"]), F.lit(box.c1).cast(kind["c"]))).alias("c"))
    values = histogram(cells.select(F.lit("v").alias("band"), F.col("v").cast("double").alias("v")))
    middle = quantiles(values, {"m": 0.5}).select("m")
    met = everywhere.join(cells.hint("merge"), ["r", "c"], "left").crossJoin(F.broadcast(middle))
    return stored(met.select("r", "c", F.coalesce("v", "m").alias("v"), F.col("v").isNotNull().alias("valid")), "dem")


def dem_stack(grid: DataFrame, step: float = 100.0, tile: int = 256) -> DataFrame:
    """r, c, slope, curvature, tpi, tri, hillshade of a grid (r, c, v) with holes: they take the median while derivatives are
    computed, and are left out of the result. The grid is written once; along a row and along a column derivatives come from one
    pass each, and windows tile by tile, so that no cell moves once for each of its neighbours."""
    full = filled(grid)
    by_gradients = full
    for first, second, along, across in (("gx", "gxx", "c", "r"), ("gy", "gyy", "r", "c")):
        by_gradients = by_gradients.withColumn(first, axis_gradient("v", along, across, step)).withColumn(second, axis_gradient(first, along, across, step))
    out = by_gradients.where("valid").select("r", "c", slope_of().alias("slope"), (F.col("gxx") + F.col("gyy")).alias("curvature"), shade_of().alias("hillshade"))
    wanted = full.where("valid").hint("merge")
    for name, fn, halo in (("tpi", tpi_of, 3), ("tri", tri_of, 1)):
        part = over_tiles(full, fn, tile, halo, wanted=wanted).withColumnRenamed("x", name)
        out = out.join(part.hint("merge"), ["r", "c"])
    return out.select("r", "c", "slope", "curvature", "tpi", "tri", "hillshade")
